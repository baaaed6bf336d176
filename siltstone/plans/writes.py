"""Queries of the write surface over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import operations, writes
from siltstone.plans import tables as t


def _state(events: DataFrame) -> DataFrame:
    return operations.latest_per(events, "user_id", "ts", "event_id").select("user_id", "event_id", "value")


def upsert_state(spark, sf_dir) -> DataFrame:
    """Each user's last error, overwritten by the last purchase; a purchase without a value leaves the value."""
    events = t.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type").filter("user_id IS NOT NULL")
    return writes.upsert(_state(events.filter("event_type = 'error'")), events.filter("event_type = 'purchase'"), "user_id", ["ts", "event_id"], keep_stored=("value",))


def insert_missing(spark, sf_dir) -> DataFrame:
    """Labels, and -1 for each document that has none."""
    labels = t.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return writes.insert_missing(labels, docs, "doc_id")


def release_locks(spark, sf_dir) -> DataFrame:
    """Users' locks (token: the last event) that no error with the same token releases."""
    events = t.table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    locks = _state(events.select("user_id", "event_id", "ts", "value")).select("user_id", "event_id")
    return writes.delete(locks, events.filter("event_type = 'error'"), "user_id", "event_id")


def cascade_delete(spark, sf_dir) -> DataFrame:
    """Conversations of over four turns go, and their messages with them."""
    turns = t.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    doomed = turns.groupBy("conv_id").count().filter("count > 4")
    return writes.cascade({"messages": turns, "conversations": turns.select("conv_id").distinct()}, doomed, "conv_id")[1]


def version_swap(spark, sf_dir) -> DataFrame:
    """Line items as chunks of a part in versions by line number: the highest stays."""
    chunks = t.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("int").alias("version"))
    done = chunks.groupBy("id").agg(F.max("version").alias("version"))
    return writes.swap_versions(chunks, done, "id", "version").groupBy("id").agg(F.max("version").alias("current_version"), F.count(F.lit(1)).alias("chunk_count"))


_LAST = "SELECT user_id, event_id, value FROM events WHERE user_id IS NOT NULL AND {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
SQL = {
    "upsert_state": f"""WITH s AS ({_LAST.format("event_type = 'error'")}), n AS ({_LAST.format("event_type = 'purchase'")})
SELECT user_id, coalesce(n.event_id, s.event_id) AS event_id, coalesce(n.value, s.value) AS value FROM s FULL JOIN n USING (user_id)""",
    "insert_missing": "SELECT doc_id, CAST(quality AS INTEGER) AS quality FROM labels UNION ALL SELECT DISTINCT doc_id, -1 FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
    "release_locks": f"WITH l AS ({_LAST.format('true')}) SELECT user_id, event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = l.user_id AND e.event_id = l.event_id)",
    "cascade_delete": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'messages' AS "table", CAST(coalesce(sum(n) FILTER (WHERE n <= 4), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE n > 4), 0) AS BIGINT) AS deleted FROM c
UNION ALL SELECT 'conversations', count(*) FILTER (WHERE n <= 4), count(*) FILTER (WHERE n > 4) FROM c""",
    "version_swap": "SELECT l_partkey AS id, CAST(l_linenumber AS INTEGER) AS current_version, count(*) AS chunk_count FROM lineitem GROUP BY l_partkey, l_linenumber QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_partkey)",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
