"""Queries over the application's documents, chunks and jobs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import chunks as ch
from siltstone.operators import documents as d
from siltstone.plans.app import PIPELINE, app, app_sql
from siltstone.plans.tables import table

NOW, QUOTA = 9_000, 60_000


def _tables(spark, sf_dir, *names) -> tuple[DataFrame, ...]:
    return tuple(app(spark, sf_dir, n) for n in names)


def retrieval_scan(spark, sf_dir) -> DataFrame:
    """What owner 3 reads in conversation 8: ambient scope; by mentions; by a base; by mentions that can't be read (nothing)."""
    chunks, docs, bases = _tables(spark, sf_dir, "chunks", "docs", "kb")
    readers = {
        "ambient": d.reader_of("t0", 3, 8, None),
        "mentioned": d.reader_of("t0", 3, 8, ["10", "x", "52", "94"]),
        "base": d.reader_of("t0", 3, 8, None, [10, 13, 3]),
        "unreadable": d.reader_of("t0", 3, 8, ["x", "-"]),
    }
    out = None
    for name, reader in readers.items():
        rows = d.readable(chunks, docs, bases, reader).select(F.lit(name).alias("how"), "id", "document_id", "chunk_index", "filename")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_listing(spark, sf_dir) -> DataFrame:
    return d.listing(*_tables(spark, sf_dir, "docs", "kb", "jobs")).select("id", "visibility", "status", "job_id", "job_status", "job_version")


def owner_documents(spark, sf_dir) -> DataFrame:
    """The second page of twenty of owner 2's live documents, and those of base 9 that are active."""
    listed = d.listing(*_tables(spark, sf_dir, "docs", "kb", "jobs"))
    second = d.owner_page(listed, 2, limit=20, offset=20).select(F.lit("page").alias("how"), "id", "created_at")
    narrow = d.owner_page(listed, 2, knowledge_base_id=9, status="ACTIVE").select(F.lit("base").alias("how"), "id", "created_at")
    one = d.one_listing(listed, 19, 5).unionByName(d.one_listing(listed, 19, 4)).unionByName(d.one_listing(listed, 11, None))
    return second.unionByName(narrow).unionByName(one.select(F.lit("one").alias("how"), "id", "created_at"))


def upload_duplicates(spark, sf_dir) -> DataFrame:
    """Documents whose base holds the same content in an older live one."""
    docs = app(spark, sf_dir, "docs").withColumn("knowledge_base_id", F.col("knowledge_base_id") % 2)
    return d.same_checksum(docs, docs)


def job_facts(spark, sf_dir) -> DataFrame:
    return d.job_facts(*_tables(spark, sf_dir, "docs", "jobs"))


def undispatched_ingests(spark, sf_dir) -> DataFrame:
    return d.undispatched(app(spark, sf_dir, "jobs"), 30_000).select("id", "document_id", "created_at")


def scoped_jobs(spark, sf_dir) -> DataFrame:
    jobs, docs = _tables(spark, sf_dir, "jobs", "docs")
    own = d.scoped_jobs(jobs, docs, 4).select(F.lit("owner").alias("who"), "id", "status")
    return own.unionByName(d.scoped_jobs(jobs, docs, None).select(F.lit("admin").alias("who"), "id", "status"))


def document_rows(spark, sf_dir) -> DataFrame:
    return d.row_state(d.listing(*_tables(spark, sf_dir, "docs", "kb", "jobs")), 7, NOW)


def scope_bases(spark, sf_dir) -> DataFrame:
    """An upload's base: global, of a conversation, and of one that has none (no row)."""
    bases = app(spark, sf_dir, "kb")
    cases = [("global", 3, "GLOBAL", None), ("chat", 4, "CONVERSATION", 11), ("unknown", 4, "CONVERSATION", 12), ("none", 4, "CONVERSATION", None)]
    out = None
    for name, owner, scope, chat in cases:
        rows = d.scope_base(bases, owner, scope, chat).select(F.lit(name).alias("how"), "knowledge_base_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_states(spark, sf_dir) -> DataFrame:
    """The swap of every running document, then a failure, a deletion gate and a tombstone."""
    docs = app(spark, sf_dir, "docs")
    swapped = docs.filter("status = 'RUNNING'").select("id", (F.col("chunk_count") + 1).alias("chunk_count"), (F.col("current_version") + 1).cast("int").alias("version"), F.lit(None).cast("int").alias("page_count"))
    docs = d.mark_active(docs, swapped)
    docs = d.set_status(docs, F.col("id") % 10 == 4, "FAILED", error_message="late")
    docs = d.set_status(docs, F.col("id") % 20 == 2, "QUEUED", clear_error=True)
    docs = d.delete_gate(docs, F.col("id") % 10 == 5)
    docs = d.tombstone(docs, F.col("id") % 20 == 15, NOW)
    return docs.select("id", "status", "searchable", "current_version", "page_count", "chunk_count", "error_message", "deleted_at")


def job_states(spark, sf_dir) -> DataFrame:
    """Jobs begin, succeed, fail at their last try or before, are superseded, and are put back."""
    jobs = app(spark, sf_dir, "jobs")
    jobs = d.update_jobs(jobs, (F.col("status") == "QUEUED") & (F.col("id") % 4 == 0), "RUNNING", NOW, progress=5)
    jobs = d.update_jobs(jobs, (F.col("status") == "RUNNING") & (F.col("id") % 5 == 1), "SUCCEEDED", NOW, progress=100, clear_error=True)
    jobs = d.after_failure(jobs, (F.col("status") == "RUNNING") & (F.col("id") % 5 == 2), NOW, "BUSY", terminal=F.col("document_id") % 3 == 0)
    jobs = d.supersede(jobs)
    jobs = d.requeue(jobs, (F.col("status") == "DEAD_LETTER") & (F.col("id") % 2 == 0))
    return jobs.select("id", "status", "progress", "attempt_count", "error_code", "started_at", "completed_at")


def next_versions(spark, sf_dir) -> DataFrame:
    return d.next_version(*_tables(spark, sf_dir, "docs", "jobs"))


def upload_verdicts(spark, sf_dir) -> DataFrame:
    """Every document uploaded again, for even ids to the next base and by its owner, some of them twice: accepted, known by then, or beyond the owner's quota at its turn."""
    docs = app(spark, sf_dir, "docs").withColumn("owner_id", F.col("knowledge_base_id") % 7)
    base = (F.col("knowledge_base_id") + F.col("id") % 2) % 25
    again = docs.withColumn("copy", F.explode(F.when(F.col("id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    again = again.select(((F.col("id") + 1_000_000) * 2 + F.col("copy")).alias("id"), (base % 7).alias("owner_id"), base.alias("knowledge_base_id"), "checksum", "size_bytes")
    return d.admit(docs.filter("owner_id < 3 OR id % 50 = 0"), again, QUOTA)


def _stale(spark, sf_dir) -> DataFrame:
    chunks, docs, jobs = _tables(spark, sf_dir, "chunks", "docs", "jobs")
    return ch.split_by_work(ch.drift_by_document(chunks, docs, PIPELINE), jobs)


def stale_documents(spark, sf_dir) -> DataFrame:
    """The first 500 stale documents without open work, the oldest first."""
    return d.page(_stale(spark, sf_dir).filter("NOT in_flight"), F.col("created_at"), F.col("document_id"), limit=500).select("document_id", "chunks", "tokens", "inputs")


def stale_totals(spark, sf_dir) -> DataFrame:
    return ch.drift_totals(_stale(spark, sf_dir))


def stale_checks(spark, sf_dir) -> DataFrame:
    """Whether single versions have drifted: one has, one hasn't, and one has no chunk."""
    chunks = app(spark, sf_dir, "chunks")
    out = None
    for document, version in ((6, 1), (7, 99), (10, 2), (11, 3)):
        row = ch.is_stale(chunks, document, version, PIPELINE).select(F.lit(document).alias("document_id"), F.lit(version).alias("version"), "stale")
        out = row if out is None else out.unionByName(row)
    return out


def rebuilt_documents(spark, sf_dir) -> DataFrame:
    """Every live document asked to be built anew; some originals are gone or altered."""
    chunks, docs, jobs = _tables(spark, sf_dir, "chunks", "docs", "jobs")
    stored = table(spark, sf_dir, "documents").filter("doc_id % 19 > 0").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("checksum"))
    return ch.rebuilds(docs, chunks, stored, jobs, PIPELINE)


def vector_sources(spark, sf_dir) -> DataFrame:
    chunks, docs = _tables(spark, sf_dir, "chunks", "docs")
    return ch.vector_sources(chunks, docs.select(F.col("id").alias("document_id"), F.col("current_version").alias("version")))


def missing_vectors(spark, sf_dir) -> DataFrame:
    return ch.missing_vectors(app(spark, sf_dir, "chunks"))


def chunk_order(spark, sf_dir) -> DataFrame:
    return ch.of_version(*_tables(spark, sf_dir, "chunks", "docs"))


_OWN = "own AS (SELECT id AS document_id, current_version AS document_version, filename, knowledge_base_id FROM docs WHERE tenant_id = 't0' AND owner_id = 3 AND searchable AND deleted_at IS NULL)"
_READ = "SELECT '{}' AS how, c.id, c.document_id, c.chunk_index, o.filename FROM chunks c JOIN own o USING (document_id, document_version) WHERE c.tenant_id = 't0' AND {}"
_LISTED = """newest AS (SELECT document_id, id AS job_id, status AS job_status, document_version AS job_version FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1),
listed AS (SELECT docs.*, kb.visibility, job_id, job_status, job_version FROM docs JOIN kb ON kb.id = docs.knowledge_base_id LEFT JOIN newest ON newest.document_id = docs.id)"""
_DRIFT = " OR ".join(f"(json_extract_string(meta, '$.{k}') IS DISTINCT FROM '{v}')" for k, v in PIPELINE.items())
_FLAGS = ", ".join(f"bool_or(json_extract_string(meta, '$.{k}') IS DISTINCT FROM '{v}') AS {k}" for k, v in PIPELINE.items())
_STALE = f"""stale AS (SELECT c.document_id, d.created_at, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, {_FLAGS} FROM chunks c JOIN docs d ON d.id = c.document_id AND d.current_version = c.document_version
WHERE d.searchable AND d.deleted_at IS NULL GROUP BY ALL HAVING embedding_model OR chunking_version OR preprocessing_version),
split AS (SELECT *, EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = stale.document_id AND j.job_type = 'INGEST' AND j.status IN ('QUEUED', 'RUNNING')) AS in_flight FROM stale)"""

SQL = {
    "retrieval_scan": f"""WITH {app_sql('kb', 'docs', 'chunks')}, {_OWN}
{_READ.format('ambient', "o.knowledge_base_id IN (SELECT id FROM kb WHERE visibility = 'GLOBAL' OR conversation_id = 8)")}
UNION ALL {_READ.format('mentioned', 'c.document_id IN (10, 52, 94)')} UNION ALL {_READ.format('base', 'o.knowledge_base_id IN (10, 13, 3)')}""",
    "document_listing": f"WITH {app_sql('kb', 'docs', 'jobs')}, {_LISTED} SELECT id, visibility, status, job_id, job_status, job_version FROM listed",
    "owner_documents": f"""WITH {app_sql('kb', 'docs', 'jobs')}, {_LISTED}
(SELECT 'page' AS how, id, created_at FROM listed WHERE owner_id = 2 AND deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20)
UNION ALL (SELECT 'base', id, created_at FROM listed WHERE owner_id = 2 AND deleted_at IS NULL AND knowledge_base_id = 9 AND status = 'ACTIVE' ORDER BY created_at DESC, id DESC LIMIT 100)
UNION ALL SELECT 'one', id, created_at FROM listed WHERE (id = 19 AND owner_id = 5) OR (id = 19 AND owner_id = 4) OR id = 11""",
    "upload_duplicates": f"WITH {app_sql('docs')}, b AS (SELECT *, knowledge_base_id % 2 AS base FROM docs) SELECT n.id AS new_id, min(o.id) AS id FROM b n JOIN b o ON o.base = n.base AND o.checksum = n.checksum AND o.deleted_at IS NULL AND o.id < n.id GROUP BY n.id",
    "job_facts": f"""WITH {app_sql('docs', 'jobs')} SELECT d.id, count(*) FILTER (WHERE job_type = 'INGEST' AND j.status IN ('QUEUED', 'RUNNING')) AS open_ingests, coalesce(bool_or(job_type = 'DELETE'), false) AS has_deletion,
max(document_version) FILTER (WHERE job_type = 'INGEST') AS latest_version, count(*) FILTER (WHERE job_type = 'INGEST' AND document_version = current_version) AS current_ingests FROM docs d LEFT JOIN jobs j ON j.document_id = d.id GROUP BY d.id""",
    "undispatched_ingests": f"WITH {app_sql('jobs')} SELECT id, document_id, created_at FROM jobs WHERE job_type = 'INGEST' AND status = 'QUEUED' AND error_code = 'ENQUEUE_FAILED' AND created_at < 30000 ORDER BY created_at, id LIMIT 100",
    "scoped_jobs": f"WITH {app_sql('docs', 'jobs')} SELECT 'owner' AS who, j.id, j.status FROM jobs j JOIN docs d ON d.id = j.document_id WHERE d.owner_id = 4 UNION ALL SELECT 'admin', j.id, j.status FROM jobs j WHERE j.document_id IN (SELECT id FROM docs)",
    "document_rows": f"""WITH {app_sql('kb', 'docs', 'jobs')}, {_LISTED}, s AS (SELECT *, status IN ('QUEUED', 'RUNNING') AND {NOW} - updated_at > 900 AS stalled FROM listed)
SELECT id, CASE WHEN visibility = 'GLOBAL' THEN 'global' WHEN knowledge_base_id = 7 THEN 'chat' END AS section, stalled, coalesce(status = 'FAILED' AND job_version > current_version, false) AS replace_failed,
CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN status IN ('QUEUED', 'RUNNING') AND NOT stalled THEN 'busy' END AS blocked FROM s""",
    "scope_bases": f"WITH {app_sql('kb')} SELECT 'global' AS how, min(id) AS knowledge_base_id FROM kb WHERE owner_id = 3 AND visibility = 'GLOBAL' HAVING min(id) IS NOT NULL UNION ALL SELECT 'chat', id FROM kb WHERE owner_id = 4 AND conversation_id = 11 UNION ALL SELECT 'unknown', id FROM kb WHERE owner_id = 4 AND conversation_id = 12",
    "document_states": f"""WITH {app_sql('docs')}, a AS (SELECT id, status = 'RUNNING' AS r, * EXCLUDE (id) FROM docs),
b AS (SELECT id, CASE WHEN r THEN 'ACTIVE' ELSE status END AS status, r OR searchable AS searchable, CAST(current_version + CASE WHEN r THEN 1 ELSE 0 END AS INTEGER) AS current_version, CASE WHEN NOT r THEN page_count END AS page_count,
  CAST(chunk_count + CASE WHEN r THEN 1 ELSE 0 END AS INTEGER) AS chunk_count, CASE WHEN NOT r THEN error_message END AS error_message, deleted_at FROM a)
SELECT id, CASE WHEN id % 20 = 15 THEN 'DELETED' WHEN id % 10 = 5 THEN 'DELETE_PENDING' WHEN id % 20 = 2 THEN 'QUEUED' WHEN id % 10 = 4 THEN 'FAILED' ELSE status END AS status, searchable AND id % 10 <> 5 AS searchable, current_version, page_count,
  CASE WHEN id % 20 = 15 THEN 0 ELSE chunk_count END AS chunk_count, CASE WHEN id % 20 = 2 THEN NULL WHEN id % 10 = 4 THEN 'late' ELSE error_message END AS error_message, CASE WHEN id % 20 = 15 THEN {NOW} ELSE deleted_at END AS deleted_at FROM b""",
    "job_states": f"""WITH {app_sql('jobs')},
a AS (SELECT *, status = 'QUEUED' AND id % 4 = 0 AS hit FROM jobs),
b AS (SELECT id, document_id, job_type, attempt_count, CASE WHEN hit THEN 'RUNNING' ELSE status END AS status, CASE WHEN hit THEN 5 ELSE progress END AS progress, error_code, CASE WHEN hit THEN coalesce(started_at, {NOW}) ELSE started_at END AS started_at, completed_at FROM a),
c AS (SELECT * REPLACE (CASE WHEN h THEN 'SUCCEEDED' ELSE status END AS status, CASE WHEN h THEN 100 ELSE progress END AS progress, CASE WHEN h THEN NULL ELSE error_code END AS error_code, CASE WHEN h THEN {NOW} ELSE completed_at END AS completed_at) FROM (SELECT *, status = 'RUNNING' AND id % 5 = 1 AS h FROM b)),
e AS (SELECT * REPLACE (CASE WHEN NOT f THEN status WHEN t THEN 'FAILED' WHEN l THEN 'DEAD_LETTER' ELSE 'QUEUED' END AS status, CASE WHEN f THEN 'BUSY' ELSE error_code END AS error_code, CASE WHEN NOT f THEN completed_at WHEN t OR l THEN {NOW} END AS completed_at)
  FROM (SELECT *, status = 'RUNNING' AND id % 5 = 2 AS f, document_id % 3 = 0 AS t, attempt_count >= 5 AS l FROM c)),
g AS (SELECT * REPLACE (CASE WHEN job_type = 'INGEST' AND status IN ('QUEUED', 'RUNNING') AND id < max(id) OVER (PARTITION BY document_id, job_type) THEN 'SUPERSEDED' ELSE status END AS status) FROM e),
k AS (SELECT *, status = 'DEAD_LETTER' AND id % 2 = 0 AS q FROM g)
SELECT id, CASE WHEN q THEN 'QUEUED' ELSE status END AS status, CASE WHEN q THEN 0 ELSE progress END AS progress, attempt_count, CASE WHEN q THEN NULL ELSE error_code END AS error_code, started_at, CASE WHEN q THEN NULL ELSE completed_at END AS completed_at FROM k""",
    "next_versions": f"WITH {app_sql('docs', 'jobs')} SELECT d.id, CAST(greatest(any_value(current_version), coalesce(max(document_version) FILTER (WHERE job_type = 'INGEST'), 0)) + 1 AS INTEGER) AS version FROM docs d LEFT JOIN jobs j ON j.document_id = d.id GROUP BY d.id",
    "upload_verdicts": f"""WITH RECURSIVE {app_sql('docs')}, own AS (SELECT * REPLACE (knowledge_base_id % 7 AS owner_id) FROM docs), stored AS (SELECT * FROM own WHERE (owner_id < 3 OR id % 50 = 0) AND deleted_at IS NULL), used AS (SELECT owner_id, sum(size_bytes) AS used FROM stored GROUP BY ALL),
again AS (SELECT (id + 1000000) * 2 + copy AS id, (knowledge_base_id + id % 2) % 25 AS base, base % 7 AS owner_id, checksum, coalesce(size_bytes, 0) AS size FROM own, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR id % 4 = 0),
turn AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY id) AS n, NOT EXISTS (SELECT 1 FROM stored s WHERE s.knowledge_base_id = again.base AND s.checksum = again.checksum) AND (checksum IS NULL OR row_number() OVER (PARTITION BY base, checksum ORDER BY id) = 1) AS fresh FROM again),
judged AS (SELECT o.owner_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(coalesce(used, 0) AS BIGINT) AS used, '' AS verdict FROM (SELECT DISTINCT owner_id FROM again) o LEFT JOIN used USING (owner_id)
UNION ALL SELECT t.owner_id, t.n, t.id, CAST(j.used + CASE WHEN fresh AND j.used + size <= {QUOTA} THEN size ELSE 0 END AS BIGINT), CASE WHEN j.used + size > {QUOTA} THEN 'over_quota' WHEN fresh THEN 'accepted' ELSE 'duplicate' END FROM judged j JOIN turn t ON t.owner_id = j.owner_id AND t.n = j.n + 1)
SELECT id, verdict FROM judged WHERE n > 0""",
    "stale_documents": f"WITH {app_sql('docs', 'chunks', 'jobs')}, {_STALE} SELECT document_id, chunks, tokens, concat_ws(',', CASE WHEN embedding_model THEN 'embedding_model' END, CASE WHEN chunking_version THEN 'chunking_version' END, CASE WHEN preprocessing_version THEN 'preprocessing_version' END) AS inputs FROM split WHERE NOT in_flight ORDER BY created_at, document_id LIMIT 500",
    "stale_totals": f"WITH {app_sql('docs', 'chunks', 'jobs')}, {_STALE} SELECT in_flight, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM split GROUP BY in_flight",
    "rebuilt_documents": f"""WITH {app_sql('docs', 'chunks', 'jobs')}, s AS (SELECT document_id AS id, document_version AS current_version, bool_or({_DRIFT}) AS stale FROM chunks GROUP BY ALL), o AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 17 = 0 THEN text || '.' ELSE text END) AS found FROM documents WHERE doc_id % 19 > 0),
b AS (SELECT document_id AS id, max(document_version) AS begun, count(*) FILTER (WHERE status IN ('QUEUED', 'RUNNING')) AS open FROM jobs WHERE job_type = 'INGEST' GROUP BY ALL),
v AS (SELECT d.id, CASE WHEN d.status <> 'ACTIVE' THEN 'not_active' WHEN s.stale IS DISTINCT FROM true THEN 'not_stale' WHEN found IS NULL OR checksum IS NULL OR found <> checksum THEN 'corrupt' ELSE 'queued' END AS verdict, CAST(CASE WHEN verdict = 'queued' THEN coalesce(begun, d.current_version) + 1 END AS INTEGER) AS version, open FROM docs d LEFT JOIN s ON s.id = d.id AND s.current_version = d.current_version LEFT JOIN o ON o.id = d.id LEFT JOIN b ON b.id = d.id WHERE d.deleted_at IS NULL)
SELECT id, verdict, version, 'ingest:' || id || ':v' || version AS idempotency_key, CASE WHEN version IS NOT NULL THEN coalesce(open, 0) END AS superseded FROM v""",
    "stale_checks": f"WITH {app_sql('chunks')}, v(document_id, version) AS (VALUES (6, 1), (7, 99), (10, 2), (11, 3)) SELECT v.document_id, version, coalesce(bool_or({_DRIFT}) FILTER (WHERE c.id IS NOT NULL), false) AS stale FROM v LEFT JOIN chunks c ON c.document_id = v.document_id AND c.document_version = version GROUP BY ALL",
    "vector_sources": f"WITH {app_sql('docs', 'chunks')} SELECT document_id, embedding_fingerprint, max(document_version) AS version FROM chunks c WHERE vector IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs d WHERE d.id = c.document_id AND d.current_version = c.document_version) GROUP BY ALL",
    "missing_vectors": f"WITH {app_sql('chunks')} SELECT document_id, document_version, count(*) FILTER (WHERE vector IS NULL) AS missing FROM chunks GROUP BY ALL",
    "chunk_order": f"WITH {app_sql('docs', 'chunks')} SELECT document_id, chunk_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS place FROM chunks c JOIN docs d ON d.id = c.document_id AND d.current_version = c.document_version",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
