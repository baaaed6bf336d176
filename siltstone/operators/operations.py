"""Operational queries: latest per key, counts, quotas, drift, retention, conversation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order; one aggregation with partial results, no sort."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def quota(docs: DataFrame, owner: str, size: str, limit: int) -> DataFrame:
    return docs.groupBy(owner).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).withColumn("over_quota", F.col("bytes") > limit)


def duplicates_by_checksum(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Checksums that several live documents share: their number and the least id."""
    return docs.groupBy(F.sha2(text, 256).alias("checksum")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")


def any_true(flag: Column) -> Column:
    """bool_or; false over nothing or nulls alone."""
    return F.coalesce(F.bool_or(flag), F.lit(False))


def without_open(docs: DataFrame, jobs: DataFrame, key: str, negate: bool = True) -> DataFrame:
    """docs with no open job (or, the other way, with one)."""
    return docs.join(jobs.select(key), key, "left_anti" if negate else "left_semi")


def newest_kept(df: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The newest `keep` rows of each key; partial limits apply before the shuffle."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= keep)


def oldest_beyond(df: DataFrame, at: str, key: str, days: int, batch: int) -> DataFrame:
    """The `batch` oldest rows of over `days` before the newest one; none where days is 0."""
    if not days:
        return df.limit(0)
    cut = df.agg((F.max(at) - F.expr(f"INTERVAL {days} DAYS")).alias("__cut"))  # one row
    return df.join(F.broadcast(cut), F.col(at) < F.col("__cut")).orderBy(at, key).limit(batch).drop("__cut")


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0).cast("long")


def within_budget(turns: DataFrame, conversation: str, order: str, text: str, budget: int) -> DataFrame:
    """The newest turns of each conversation whose estimates together stay within the budget."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("tokens", token_estimate(F.col(text))).withColumn("total", F.sum("tokens").over(w)).filter(F.col("total") <= budget)


def preceding(turns: DataFrame, conversation: str, order: str, role: str, wanted: str, value: str, out: str) -> DataFrame:
    """turns with the latest earlier value of a turn whose role is `wanted`."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(out, F.last(F.when(F.col(role) == wanted, F.col(value)), ignorenulls=True).over(w))


AUDIT = ("id", "event_type", "actor_id", "target_type", "target_id", "details", "created_at")


def audited(log: DataFrame, events: DataFrame) -> DataFrame:
    """The audit log with further events: nothing in it changes; an event needs id, event_type and created_at, the rest may be left out."""
    kinds = dict(log.dtypes)
    return log.select(*AUDIT).unionByName(events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in AUDIT]))


def audit_page(log: DataFrame, *, actor_id: int | None = None, event_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ties by the greater id; of one actor, one kind of event, both or neither."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    own = log if actor_id is None else log.filter(F.col("actor_id") == actor_id)
    own = own if event_type is None else own.filter(F.col("event_type") == event_type)
    return own.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
