"""Queries of the document-retrieval surface over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import access, operations, retrieval
from siltstone.plans import app_documents, app_fulltext, app_index, app_passages, app_prompts, app_search, app_streams, app_turns, ingestion, ranking, writes
from siltstone.plans.app import app, app_sql
from siltstone.plans.tables import CATALOG, DENSE, NORMALIZED, SPARSE, UNIT, catalog, table, vectors

QUOTA = 500_000


def access_filter(spark, sf_dir):
    return catalog(spark, sf_dir).filter(access.live()).groupBy("owner").agg(F.count(F.lit(1)).alias("visible"), F.sum("n_chars").alias("chars"))


def ambient_scope(spark, sf_dir):
    docs = catalog(spark, sf_dir)
    bases = docs.select("kb_id").distinct().select("kb_id", F.when(F.col("kb_id") == "en", "GLOBAL").otherwise("CONVERSATION").alias("visibility"), F.concat(F.lit("chat-"), "kb_id").alias("conversation_id"))
    return access.in_scope(docs.filter(access.live()), bases, "chat-de").select("id", "kb_id")


def dense_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.dense_top_k(rows, asked, 50)


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def sparse_topk(spark, sf_dir):
    return retrieval.lexical_top_k(catalog(spark, sf_dir).filter(access.live()), _questions(spark, sf_dir), 50)


def hybrid_search(spark, sf_dir):
    """Each benchmark item as a question, with the vector of the same number: both arms' top 50, fused, top 30."""
    docs = catalog(spark, sf_dir).filter(access.live())
    rows = vectors(spark, sf_dir)
    asked = _questions(spark, sf_dir)
    dense = retrieval.dense_top_k(rows.join(docs.select("id"), "id", "left_semi"), rows.withColumnRenamed("id", "query_id").join(asked.select("query_id"), "query_id", "left_semi"), 50)
    return retrieval.fuse(dense, retrieval.lexical_top_k(docs, asked, 50)).select("query_id", "id", "dense_rank", "sparse_rank", "score", "rank")


def latest_event_per_user(spark, sf_dir):
    return operations.latest_per(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def conversation_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn"))


def token_usage(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(operations.token_estimate(F.col("text"))).alias("tokens"))


def budget_check(spark, sf_dir):
    return operations.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200).select("conv_id", "turn", "tokens", "total")


def message_tail(spark, sf_dir):
    return operations.newest_kept(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 4).select("conv_id", "turn", "role")


def preceding_user(spark, sf_dir):
    turns = operations.preceding(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user", "turn", "asked_at")
    return turns.filter("role = 'assistant'").select("conv_id", "turn", "asked_at")


def latest_answer(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return operations.latest_per(answers, "conv_id", "turn")


def owner_quota(spark, sf_dir):
    return operations.quota(catalog(spark, sf_dir).filter(access.live()), "owner", "n_chars", QUOTA)


def checksum_duplicates(spark, sf_dir):
    return operations.duplicates_by_checksum(catalog(spark, sf_dir), "text", "id")


def drift_report(spark, sf_dir):
    """Owners with documents of another language than the one on record (English): how many, and whether any is live."""
    docs = catalog(spark, sf_dir)
    stale = ~F.col("kb_id").eqNullSafe("en")
    return docs.groupBy("owner").agg(F.count_if(stale).alias("stale"), operations.any_true(stale & access.live()).alias("any_live")).filter("stale > 0")


def drift_totals(spark, sf_dir):
    return drift_report(spark, sf_dir).agg(F.count(F.lit(1)).alias("owners"), F.coalesce(F.sum("stale"), F.lit(0)).cast("long").alias("stale"))


def open_job_anti(spark, sf_dir):
    """Documents without an open ingestion, and those with one."""
    docs, jobs = app(spark, sf_dir, "docs").select("id", "status"), app(spark, sf_dir, "jobs")
    busy = jobs.filter("job_type = 'INGEST' AND status IN ('QUEUED', 'RUNNING')").select(F.col("document_id").alias("id"))
    idle = operations.without_open(docs, busy, "id").withColumn("open", F.lit(False))
    return idle.unionByName(operations.without_open(docs, busy, "id", negate=False).withColumn("open", F.lit(True)))


def checkpoint_keep_n(spark, sf_dir):
    return operations.newest_kept(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "n")


def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


def calibration_separation(spark, sf_dir):
    """Median length of documents marked good and bad, how many, and the gap."""
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    by = lambda q: F.median(F.when(F.col("quality") == q, F.col("n_chars").cast("double")))
    return rated.agg(F.count_if(F.col("quality") == 1).alias("liked"), F.count_if(F.col("quality") == 0).alias("disliked"), by(1).alias("liked_median"), by(0).alias("disliked_median")).withColumn("gap", F.col("liked_median") - F.col("disliked_median"))


def threshold_sweep(spark, sf_dir):
    """For ten thresholds of length: documents kept of either label; one pass, thresholds in an array."""
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    level = F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: x * 500)).alias("threshold")
    return rated.select("quality", "n_chars", level).groupBy("threshold").agg(F.count_if((F.col("n_chars") >= F.col("threshold")) & (F.col("quality") == 1)).alias("good"), F.count_if((F.col("n_chars") >= F.col("threshold")) & (F.col("quality") == 0)).alias("bad"))


def outcome_mix(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def groundedness(spark, sf_dir):
    """Coverage by block, and its band."""
    found = app_turns.grounded_answers(spark, sf_dir)
    return found.select("conv_id", "turn", F.col("score").alias("coverage"), tx.score_band(F.col("score")).alias("band"))


def normalize_text(spark, sf_dir):
    clean = tx.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("checksum"))


def event_windows(spark, sf_dir):
    per_hour = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("hour"), "event_type")
    return per_hour.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_TOKENS = "CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)"
_DRIFT = """drift AS (SELECT owner, count(*) FILTER (WHERE kb_id IS DISTINCT FROM 'en') AS stale, coalesce(bool_or(kb_id IS DISTINCT FROM 'en' AND searchable AND NOT deleted), false) AS any_live FROM catalog GROUP BY owner HAVING stale > 0)"""

_OWN = {
    "access_filter": f"WITH {CATALOG} SELECT owner, count(*) AS visible, CAST(sum(n_chars) AS BIGINT) AS chars FROM live GROUP BY owner",
    "ambient_scope": f"WITH {CATALOG} SELECT id, kb_id FROM live WHERE kb_id IN ('en', 'de')",
    "dense_topk": f"WITH {UNIT}, asked AS (SELECT * FROM unit WHERE id % 100 = 0), {DENSE.format(queries='asked', vectors='unit')} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM dense",
    "sparse_topk": f"WITH {CATALOG}, {SPARSE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM sparse",
    "hybrid_search": f"""WITH {CATALOG}, {UNIT}, own AS (SELECT * FROM unit WHERE id IN (SELECT id FROM live)), questions AS (SELECT * FROM unit WHERE id IN (SELECT item_id FROM benchmark)),
{DENSE.format(queries='questions', vectors='own')}, {SPARSE},
both_arms AS (SELECT query_id, id, CAST(d.rank AS INTEGER) AS dense_rank, CAST(s.rank AS INTEGER) AS sparse_rank, round(coalesce(CAST(1 AS DOUBLE) / (60 + d.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + s.rank), 0), 9) AS score FROM dense d FULL JOIN sparse s USING (query_id, id))
SELECT query_id, id, dense_rank, sparse_rank, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM both_arms QUALIFY rank <= 30""",
    "latest_event_per_user": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "conversation_counts": "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'assistant') AS answers, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "token_usage": f"SELECT conv_id, role, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, role",
    "budget_check": f"SELECT conv_id, turn, {_TOKENS} AS tokens, CAST(sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM conversations QUALIFY total <= 200",
    "message_tail": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "preceding_user": "SELECT conv_id, turn, asked_at FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_at FROM conversations) WHERE role = 'assistant'",
    "latest_answer": "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "owner_quota": f"WITH {CATALOG} SELECT owner, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS bytes, sum(n_chars) > {QUOTA} AS over_quota FROM live GROUP BY owner",
    "checksum_duplicates": "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1",
    "drift_report": f"WITH {CATALOG}, {_DRIFT} SELECT * FROM drift",
    "drift_totals": f"WITH {CATALOG}, {_DRIFT} SELECT count(*) AS owners, CAST(coalesce(sum(stale), 0) AS BIGINT) AS stale FROM drift",
    "open_job_anti": f"WITH {app_sql('docs', 'jobs')} SELECT id, status, id IN (SELECT document_id FROM jobs WHERE job_type = 'INGEST' AND status IN ('QUEUED', 'RUNNING')) AS open FROM docs",
    "checkpoint_keep_n": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM events QUALIFY n <= 3",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS missing FROM events GROUP BY event_type",
    "calibration_separation": "SELECT count(*) FILTER (WHERE quality = 1) AS liked, count(*) FILTER (WHERE quality = 0) AS disliked, median(CAST(n_chars AS DOUBLE)) FILTER (WHERE quality = 1) AS liked_median, median(CAST(n_chars AS DOUBLE)) FILTER (WHERE quality = 0) AS disliked_median, liked_median - disliked_median AS gap FROM labels JOIN documents USING (doc_id)",
    "threshold_sweep": "SELECT CAST(500 * i AS INTEGER) AS threshold, count(*) FILTER (WHERE n_chars >= 500 * i AND quality = 1) AS good, count(*) FILTER (WHERE n_chars >= 500 * i AND quality = 0) AS bad FROM labels JOIN documents USING (doc_id), range(1, 11) r(i) GROUP BY i",
    "outcome_mix": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "groundedness": f"SELECT conv_id, turn, score AS coverage, CASE WHEN score >= 0.9 THEN 'good' WHEN score >= 0.8 THEN 'warn' ELSE 'bad' END AS band FROM ({app_turns.SQL['grounded_answers']})",
    "normalize_text": f"SELECT doc_id, length(t) AS n_chars, sha256(t) AS checksum FROM (SELECT doc_id, {NORMALIZED} AS t FROM documents)",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}


_PARTS = (ranking, ingestion, writes, app_documents, app_turns, app_prompts, app_search, app_fulltext, app_index, app_streams, app_passages)
SQL = dict(_OWN)
for _part in _PARTS:
    SQL |= _part.SQL


def queries() -> dict:
    found = {name: globals()[name] for name in _OWN}
    for part in _PARTS:
        found |= part.queries()
    return found
