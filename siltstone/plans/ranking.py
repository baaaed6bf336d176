"""Queries that merge, order and measure ranked lists, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import access, evaluation, retrieval
from siltstone.plans import tables as t


def probe_merge(spark, sf_dir) -> DataFrame:
    """Questions of three probes each (the vectors of three ids in a row): every probe's top 50, merged to 50."""
    vectors = t.vectors(spark, sf_dir)
    probes = vectors.filter("id % 100 < 3").select(F.col("id").alias("query_id"), "vector")
    ranked = retrieval.dense_top_k(vectors, probes, 50)
    return retrieval.merge_probes(ranked.select((F.col("query_id") - F.col("query_id") % 100).alias("question_id"), F.col("query_id").alias("probe"), "id", "rank"))


def neighbour_dedupe(spark, sf_dir) -> DataFrame:
    """The 30 longest turns of each conversation, without those beside a longer one that is kept."""
    turns = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("document_id"), F.lit(0).alias("block_order"), F.col("turn").alias("block_chunk_index"), F.length("text").alias("size"))
    hits = retrieval.top_by(turns, "query_id", [F.desc("size"), "block_chunk_index"], 30)
    return retrieval.drop_neighbours(hits.select("query_id", "rank", "document_id", "block_order", "block_chunk_index")).select(F.col("query_id").alias("conv_id"), "rank", F.col("block_chunk_index").alias("turn"))


def fetch_ordered(spark, sf_dir) -> DataFrame:
    """Documents by lists of ids, in the order asked for; hidden and missing ones are left out."""
    item = F.col("item_id")
    asked = t.table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.array(item * 3 + 2, item, F.lit(10**15), item + 100).alias("ids"))
    return retrieval.fetch_in_order(asked, t.catalog(spark, sf_dir).filter(access.live())).select("query_id", "place", "id", "n_chars")


def recall_at_k(spark, sf_dir) -> DataFrame:
    """Of each query's 8 nearest vectors, those with its label, over all that have it."""
    labels = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    vectors = t.vectors(spark, sf_dir)
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return evaluation.recall_at_k(retrieval.dense_top_k(vectors, asked, 8), labels, "label")


def rerank_lexical(spark, sf_dir) -> DataFrame:
    """The 50 lexical candidates of each benchmark item, reordered by the share of its terms that they hold; the first 8."""
    docs = t.catalog(spark, sf_dir).filter(access.live())
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.rerank_by_overlap(retrieval.lexical_top_k(docs, asked, 50), docs, asked, 8)


def round_robin(spark, sf_dir) -> DataFrame:
    """The first 100 documents when owners take turns, each with its smallest id first."""
    docs = t.catalog(spark, sf_dir).select("id", "owner")
    turns = retrieval.top_by(docs, "owner", ["id"], 100, rank="turn")
    return turns.orderBy("turn", F.asc_nulls_last("owner")).limit(100).select("id", "owner", "turn")


def golden_bands(spark, sf_dir) -> DataFrame:
    """Means by band over what is known: labels' bands are the documents' languages."""
    rated = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(t.table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.band_means(rated, "lang", ["quality", "toxic", "n_chars"])


def agreement(spark, sf_dir) -> DataFrame:
    """How two verdicts on the same documents agree: quality, and toxicity the other way round."""
    return evaluation.agreement(t.table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


_ASKED = "asked AS (SELECT id AS query_id, u FROM unit WHERE {where}), scored AS (SELECT q.query_id, v.id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 6) AS score FROM asked q CROSS JOIN unit v)"
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

SQL = {
    "probe_merge": f"""WITH {t.UNIT}, {_ASKED.format(where='id % 100 < 3')},
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50),
merged AS (SELECT query_id - query_id % 100 AS question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, CAST(min(rank) AS INTEGER) AS best_rank, count(*) AS probes FROM ranked GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM merged QUALIFY rank <= 50""",
    "neighbour_dedupe": """WITH RECURSIVE hits AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations QUALIFY rank <= 30),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS turn, false AS stays FROM hits
  UNION ALL SELECT h.conv_id, h.rank, CASE WHEN list_has_any(w.kept, [h.turn - 1, h.turn + 1]) THEN w.kept ELSE list_append(w.kept, h.turn) END, h.turn, NOT list_has_any(w.kept, [h.turn - 1, h.turn + 1])
  FROM walk w JOIN hits h ON h.conv_id = w.conv_id AND h.rank = w.rank + 1)
SELECT conv_id, CAST(rank AS INTEGER) AS rank, turn FROM walk WHERE stays""",
    "fetch_ordered": f"""WITH {t.CATALOG}, asked AS (SELECT item_id AS query_id, unnest([item_id * 3 + 2, item_id, 1000000000000000, item_id + 100]) AS id, unnest([0, 1, 2, 3]) AS place FROM benchmark)
SELECT query_id, place, id, n_chars FROM asked JOIN live USING (id)""",
    "recall_at_k": f"""WITH {t.UNIT}, {_ASKED.format(where='id % 100 = 0')},
top AS (SELECT query_id, id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8),
own AS (SELECT vec_id AS id, label FROM embeddings), wanted AS (SELECT label, count(*) AS n FROM own GROUP BY label)
SELECT query_id, count(*) FILTER (WHERE f.label = q.label) AS hits, any_value(w.n) AS relevant, round(CAST(count(*) FILTER (WHERE f.label = q.label) AS DOUBLE) / any_value(w.n), 6) AS recall
FROM top JOIN own q ON q.id = query_id JOIN own f ON f.id = top.id JOIN wanted w ON w.label = q.label GROUP BY query_id""",
    "rerank_lexical": f"""WITH {t.CATALOG}, words AS (SELECT id, unnest({_TERMS}) AS term FROM live), found AS (SELECT id, term, count(*) AS n FROM words GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)), sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY ALL),
both_sides AS (SELECT query_id, id, CAST(sum(n) AS BIGINT) AS total, count(*) AS shared FROM found JOIN asked USING (term) GROUP BY query_id, id),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS position FROM both_sides QUALIFY position <= 50)
SELECT query_id, id, CAST(position AS INTEGER) AS position, round(CAST(shared AS DOUBLE) / n, 6) AS overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(shared AS DOUBLE) / n, 6) DESC, position) AS INTEGER) AS rank
FROM candidates JOIN sizes USING (query_id) QUALIFY rank <= 8""",
    "round_robin": "SELECT doc_id AS id, source AS owner, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn FROM documents ORDER BY turn, owner NULLS LAST LIMIT 100",
    "golden_bands": "SELECT lang, count(*) AS items, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, round(avg(n_chars), 6) AS mean_n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "agreement": "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both_yes, count(*) FILTER (WHERE NOT quality = 1 AND NOT toxic = 0) AS both_no, count(*) FILTER (WHERE quality = 1 AND NOT toxic = 0) AS first_only, count(*) FILTER (WHERE NOT quality = 1 AND toxic = 0) AS second_only FROM labels",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
