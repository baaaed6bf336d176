"""Search over readable chunks in one plan, the audit log, the sweep and the trial answers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import answers
from siltstone.operators import documents as d
from siltstone.operators import operations, retrieval
from siltstone.plans import tables as t
from siltstone.plans.app import app, app_sql

#: Documents of the application that the driver's documents are dealt to as chunks, and the sweep's time.
DOCUMENTS, SWEEP_AT = 50, 30_000


def hybrid_chunks(spark, sf_dir) -> DataFrame:
    """Each benchmark item as a question of owner 3 in conversation 13: readable chunks, both arms, fusion, no neighbours, the first 30."""
    of = F.pmod("doc_id", F.lit(DOCUMENTS))
    version = F.when(F.col("doc_id") % 5 == 0, 9).otherwise(1 + of % 3).cast("int")
    stored = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), of.alias("document_id"), version.alias("document_version"), F.floor(F.col("doc_id") / DOCUMENTS).alias("chunk_index"),
        F.concat(F.lit("t"), of % 2).alias("tenant_id"), (of % 25).alias("knowledge_base_id"), F.lit("{}").alias("meta"), "text",
    )
    seen = d.readable(stored, app(spark, sf_dir, "docs"), app(spark, sf_dir, "kb"), d.reader_of("t0", 3, 13, None))
    vectors = t.vectors(spark, sf_dir)
    place = (F.lit(0).alias("block_order"), F.col("chunk_index").alias("block_chunk_index"))
    chunks = seen.select("id", "document_id", *place).join(stored.select("id", "text"), "id").join(vectors, "id", "left")
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors.withColumnRenamed("id", "query_id"), "query_id", "left")
    return retrieval.hybrid(chunks, asked)


def audit_pages(spark, sf_dir) -> DataFrame:
    """The log with two more events; a page of all, of one actor's and of one kind's."""
    more = spark.range(2).select((F.col("id") + 10**9).alias("id"), F.lit("ERROR").alias("event_type"), (F.col("id") + 95).alias("created_at"), F.lit(12).alias("actor_id"))
    log = operations.audited(app(spark, sf_dir, "audit"), more)
    pages = {"all": {"limit": 50, "offset": 10}, "actor": {"actor_id": 12}, "kind": {"event_type": "ERROR", "limit": 20}, "both": {"actor_id": 12, "event_type": "ERROR"}}
    out = None
    for name, wanted in pages.items():
        rows = operations.audit_page(log, **wanted).select(F.lit(name).alias("page"), *operations.AUDIT)
        out = rows if out is None else out.unionByName(rows)
    return out


def swept_jobs(spark, sf_dir) -> DataFrame:
    """The jobs after a sweep of which the queue refuses those of documents divisible by 7."""
    jobs = app(spark, sf_dir, "jobs")
    return d.swept(jobs, jobs.filter("document_id % 7 = 0").select("id"), SWEEP_AT).select("id", "status", "error_code", "sent")


def scripted_answers(spark, sf_dir) -> DataFrame:
    """Trial answers to the benchmark's items, with marks out of order and repeated in the context, or none."""
    mark = lambda n: F.concat(F.lit(" [S"), (n + 1).cast("string"), F.lit("]"))
    item = F.col("item_id")
    context = F.when(item % 4 == 0, F.col("text")).otherwise(F.concat("text", mark(item % 12), mark(item % 3), mark(item % 12), mark(item % 5), mark(item % 7)))
    return t.table(spark, sf_dir, "benchmark").select("item_id", answers.scripted_answer(context, F.substring("text", 1, 40)).alias("answer"))


_VERSION = f"CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 1 + doc_id % {DOCUMENTS} % 3 END"
_PAGE = "SELECT * FROM (SELECT '{0}' AS page, * FROM log WHERE {1} ORDER BY created_at DESC, id DESC LIMIT {2} OFFSET {3})"
_MARK = "' [S' || CAST({0} + 1 AS VARCHAR) || ']'"
_MARKS = " || ".join(_MARK.format(f"item_id % {n}") for n in (12, 3, 12, 5, 7))

SQL = {
    "hybrid_chunks": f"""WITH RECURSIVE {app_sql('docs', 'kb')}, {t.UNIT},
mine AS (SELECT id, current_version FROM docs WHERE tenant_id = 't0' AND owner_id = 3 AND searchable AND deleted_at IS NULL AND knowledge_base_id IN (SELECT id FROM kb WHERE visibility = 'GLOBAL' OR conversation_id = 13)),
live AS (SELECT doc_id AS id, text, doc_id % {DOCUMENTS} * 1000000000 + doc_id // {DOCUMENTS} AS place FROM documents JOIN mine ON mine.id = doc_id % {DOCUMENTS} AND {_VERSION} = current_version),
own AS (SELECT * FROM unit WHERE id IN (SELECT id FROM live)), questions AS (SELECT * FROM unit WHERE id IN (SELECT item_id FROM benchmark)),
{t.DENSE.format(queries='questions', vectors='own')}, {t.SPARSE},
fused AS (SELECT query_id, id, CAST(d.rank AS INTEGER) AS dense_rank, CAST(s.rank AS INTEGER) AS sparse_rank, round(coalesce(CAST(1 AS DOUBLE) / (60 + d.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + s.rank), 0), 9) AS score FROM dense d FULL JOIN sparse s USING (query_id, id)),
hits AS (SELECT fused.*, place, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM fused JOIN live USING (id)),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept, false AS stays FROM hits
  UNION ALL SELECT h.query_id, h.pos, CASE WHEN list_has_any(w.kept, [h.place - 1, h.place + 1]) THEN w.kept ELSE list_append(w.kept, h.place) END, NOT list_has_any(w.kept, [h.place - 1, h.place + 1])
  FROM walk w JOIN hits h ON h.query_id = w.query_id AND h.pos = w.pos + 1)
SELECT query_id, id, dense_rank, sparse_rank, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank FROM hits JOIN walk USING (query_id, pos) WHERE stays QUALIFY rank <= 30""",
    "audit_pages": f"""WITH {app_sql('audit')}, log AS (SELECT * FROM audit UNION ALL SELECT 1000000000 + i, 'ERROR', 12, NULL, NULL, NULL, 95 + i FROM range(2) r(i)) {' UNION ALL '.join((
        _PAGE.format('all', 'true', 50, 10), _PAGE.format('actor', 'actor_id = 12', 100, 0), _PAGE.format('kind', "event_type = 'ERROR'", 20, 0), _PAGE.format('both', "actor_id = 12 AND event_type = 'ERROR'", 100, 0)))}""",
    "swept_jobs": f"""WITH {app_sql('jobs')}, stuck AS (SELECT id, created_at, document_id % 7 = 0 AS no FROM jobs WHERE job_type = 'INGEST' AND status = 'QUEUED' AND error_code = 'ENQUEUE_FAILED' AND created_at < {SWEEP_AT} ORDER BY created_at, id LIMIT 100),
done AS (SELECT id FROM stuck QUALIFY NOT bool_or(no) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
SELECT id, status, CASE WHEN id IN (SELECT id FROM done) THEN NULL ELSE error_code END AS error_code, id IN (SELECT id FROM done) AS sent FROM jobs""",
    "scripted_answers": rf"""WITH c AS (SELECT item_id, trim('Grounded answer to: ' || substr(text, 1, 40), ' ') AS head, list_sort(list_distinct(list_transform(regexp_extract_all(text || CASE WHEN item_id % 4 = 0 THEN '' ELSE {_MARKS} END, '\[S(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))) AS marks FROM benchmark)
SELECT item_id, CASE WHEN len(marks) = 0 THEN '{answers.NO_GROUND.replace(chr(39), chr(39) * 2)}' ELSE head || array_to_string(list_transform(marks[1:3], lambda n: ' Supported by source [S' || CAST(n AS VARCHAR) || '].'), '') END AS answer FROM c""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
