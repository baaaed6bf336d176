"""Layout, index, embedding and merges over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import embedding
from siltstone.operators import documents as d
from siltstone.operators import access, layout, operations, probes, retrieval, vector_index
from siltstone.plans import app_documents
from siltstone.plans import tables as t
from siltstone.plans.app import app
from siltstone.storage import new_path

LISTS, PROBES, NEAREST = 16, 14, 50


def laid_out_scan(spark, sf_dir) -> DataFrame:
    """retrieval_scan's ambient reader on tables that are partitioned by tenant and bucketed by document."""
    chunks = layout.stored_by_document(app(spark, sf_dir, "chunks"), "document_id", "document_version")
    docs = layout.stored_by_document(app(spark, sf_dir, "docs"), "id", "current_version")
    seen = d.readable(chunks, docs, app(spark, sf_dir, "kb"), d.reader_of("t0", 3, 8, None))
    return seen.select("id", "document_id", "chunk_index", "filename")


def ann_topk(spark, sf_dir) -> DataFrame:
    """The 50 nearest of every hundredth vector, by an index of 16 lists of which 14 are probed, with the recall against exact search."""
    rows = t.vectors(spark, sf_dir)
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    found = vector_index.search(vector_index.build(rows, LISTS), asked, NEAREST, PROBES)
    return found.join(vector_index.recall(found, retrieval.dense_top_k(rows, asked, NEAREST)).select("query_id", "recall"), "query_id")


def ann_all_lists(spark, sf_dir) -> DataFrame:
    """The same with every list probed: exact."""
    rows = t.vectors(spark, sf_dir)
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector_index.search(vector_index.build(rows, LISTS), asked, NEAREST, LISTS)


def merged_buckets(spark, sf_dir) -> DataFrame:
    """Users' last events by day as a table of buckets: purchases merged in, users of an error on a number divisible by 50 removed."""
    events = t.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type").filter("user_id IS NOT NULL")
    last = lambda rows: operations.latest_per(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "value")
    path = new_path(spark, "buckets")
    layout.store_buckets(last(events.filter("event_type = 'error'")), path, "user_id")
    layout.merge(spark, path, last(events.filter("event_type = 'purchase'")), "user_id", ["event_id"], keep_stored=("value",))
    layout.remove(spark, path, events.filter("event_type = 'error' AND event_id % 50 = 0").select("user_id"), "user_id")
    return layout.read_buckets(spark, path).drop("bucket")


def embedded_documents(spark, sf_dir) -> DataFrame:
    """Each document's trial vector: its first two numbers, and a sum that weighs each by its place."""
    docs = embedding.embedded(t.table(spark, sf_dir, "documents").select("doc_id", "text"))
    weighed = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.lit(embedding.DIMENSIONS)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return docs.select("doc_id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[1], 6).alias("second"), F.round(weighed, 6).alias("weighed"))


def probe_search(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions of several probes (beginnings, a repeated and a blank form) over live documents with trial vectors; every third answer is rejected and asked again by its end."""
    docs = embedding.embedded(t.catalog(spark, sf_dir).filter(access.live()).select("id", "text"))
    item = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    first = probes.probes_of(item.withColumn("sub_queries", F.expr("array(left(text, 60), '  ', text, substr(text, 61, 80), 'of the and')")), 2, 50)
    second = probes.probes_of(item.withColumn("text", F.expr("right(text, 70)")).withColumn("sub_queries", F.lit(None).cast("array<string>")))
    return probes.search_twice(docs, first, item.filter("question_id % 3 = 0"), second)


_LAST = "SELECT user_id, event_id, value FROM events WHERE user_id IS NOT NULL AND {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
SQL = {
    "laid_out_scan": "SELECT id, document_id, chunk_index, filename FROM (" + app_documents.SQL["retrieval_scan"] + ") WHERE how = 'ambient'",
    "ann_all_lists": f"WITH {t.UNIT}, asked AS (SELECT * FROM unit WHERE id % 100 = 0), {t.DENSE.format(queries='asked', vectors='unit')} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM dense",
    "merged_buckets": f"""WITH s AS ({_LAST.format("event_type = 'error'")}), n AS ({_LAST.format("event_type = 'purchase'")})
SELECT user_id, coalesce(n.event_id, s.event_id) AS event_id, coalesce(n.value, s.value) AS value FROM s FULL JOIN n USING (user_id)
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0 AND user_id IS NOT NULL)""",
    "embedded_documents": f"""WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents),
b AS (SELECT doc_id, flatten(list_transform(range({embedding.DIMENSIONS // 8}), lambda c: list_transform(range(8), lambda i: CAST(CAST('0x' || substr(sha256(key || ':' || c), CAST(i * 8 + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE) / 2147483648 - 1))) AS raw FROM k),
v AS (SELECT doc_id, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS u FROM b)
SELECT doc_id, round(u[1], 6) AS first, round(u[2], 6) AS second, round(list_sum(list_transform(list_zip(u, range(1, {embedding.DIMENSIONS + 1})), lambda p: p[1] * p[2])), 6) AS weighed FROM v""",
}
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_EMBED = f"""list_transform(flatten(list_transform(range({embedding.DIMENSIONS // 8}), lambda c: list_transform(range(8), lambda i: CAST(CAST('0x' || substr(sha256(key || ':' || c), CAST(i * 8 + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE) / 2147483648 - 1))), lambda x: x)"""
_TERM_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _probe_sql() -> str:
    strip = _STRIP.format
    sub = f"list_transform([left(text, 60), '  ', text, substr(text, 61, 80), 'of the and'], lambda x: {strip('left(' + strip('x') + ', 50)')})"
    return f"""WITH {t.CATALOG},
items AS (SELECT item_id AS question_id, coalesce(text, '') AS text FROM benchmark),
forms AS (SELECT question_id, 1 AS attempt, list_filter(list_prepend({strip('text')}, {sub}), lambda x: x <> '') AS f FROM items WHERE question_id % 3 <> 0 AND {strip('text')} <> ''
  UNION ALL SELECT question_id, 2, [{strip('right(text, 70)')}] FROM items WHERE question_id % 3 = 0 AND {strip('right(text, 70)')} <> ''),
firsts AS (SELECT question_id, attempt, unnest(list_filter(f, lambda x, i: list_position(f, x) = i)[:3]) AS text, unnest(range(1, len(list_filter(f, lambda x, i: list_position(f, x) = i)[:3]) + 1)) - 1 AS probe FROM forms),
asked AS (SELECT question_id, attempt, question_id * 100 + probe AS query_id, text FROM firsts),
raws AS (SELECT which, n, {_EMBED} AS raw FROM (SELECT 'q' AS which, query_id AS n, sha256(text) AS key FROM asked UNION ALL SELECT 'd', id, sha256(coalesce(text, '')) FROM live)),
vecs AS MATERIALIZED (SELECT which, n, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS u FROM raws),
scored AS (SELECT q.n AS query_id, v.n AS id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 6) AS score FROM vecs q JOIN vecs v ON q.which = 'q' AND v.which = 'd'),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50),
found AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({_TERM_SQL.format('text')}) AS term FROM live) GROUP BY ALL),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_TERM_SQL.format('text')}) AS term FROM asked)),
sparse AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sum(n) DESC, id) AS rank FROM found JOIN terms USING (term) GROUP BY query_id, id QUALIFY rank <= 50),
fused AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(CAST(1 AS DOUBLE) / (60 + d.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + s.rank), 0), 9) DESC, id) AS nr FROM dense d FULL JOIN sparse s USING (query_id, id) QUALIFY nr <= 50),
merged AS (SELECT query_id // 100 AS question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + nr)), 9) AS score, CAST(min(nr) AS INTEGER) AS best_rank, count(*) AS probes FROM fused GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank, CASE WHEN question_id % 3 = 0 THEN 2 ELSE 1 END AS attempt FROM merged QUALIFY rank <= 30"""


SQL["probe_search"] = _probe_sql()
ROWS_ONLY = ("ann_topk",)


def queries() -> dict:
    return {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
