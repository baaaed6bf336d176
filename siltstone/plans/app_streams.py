"""Streams over the driver's tables run to their end, and the same in SQL on what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.chunking import Sizes
from siltstone.operators import staging
from siltstone.plans import tables as t
from siltstone.plans.app import app, app_sql
from siltstone.storage import new_path, written
from siltstone.streaming import consumer, feed

TICKS, STALL_MS = 4, 43_200_500


def change_feed(spark, sf_dir) -> DataFrame:
    """Users' events as versions of a document (its kind is watched, an error removes it, a click or view is open work): the first quarter of the time is the snapshot, the rest comes in three ticks."""
    events = t.table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    states = events.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.xxhash64("event_type").alias("fingerprint"), (F.col("event_type") == "error").alias("deleted"),
        F.col("event_type").isin("click", "view").alias("open"), F.col("ts").cast("timestamp").alias("ts"),
    )
    span = states.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    if span.a is None:
        return spark.createDataFrame([], "user_id bigint, event_id bigint, kind string")
    tick = F.floor(TICKS * (F.unix_micros("ts") - span.a) / F.lit(span.b - span.a + 1))
    first = states.filter(tick == 0).groupBy("id").agg(F.max_by(F.struct("version", "fingerprint", "deleted", "open", "ts"), "version").alias("s")).select("id", "s.*")
    path = new_path(spark, "feed")
    stream = feed.replayed([states.filter(tick == k).repartition(2, "id") for k in range(1, TICKS)], f"{path}/in")
    run = feed.changes(stream, stall_after_ms=STALL_MS, first=first).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(feed.CHANGES).parquet(f"{path}/out").select(F.col("id").alias("user_id"), F.col("version").alias("event_id"), "kind")


def _deliveries(spark, sf_dir) -> DataFrame:
    return app(spark, sf_dir, "jobs").select(F.col("id").alias("job_id"), "document_id", F.col("document_version").cast("long").alias("version"))


def attempted(rows: DataFrame) -> DataFrame:
    """A trial handler: jobs divisible by five fail as often as their number modulo seven says."""
    fails = (F.col("job_id") % 5 == 0) & (F.col("attempt") <= F.col("job_id") % 7)
    return rows.withColumn("error", F.when(fails, "TRIAL")).withColumn("result", F.when(~fails, F.concat(F.lit("r"), F.col("job_id").cast("string"))))


def consumed_jobs(spark, sf_dir) -> DataFrame:
    """Jobs delivered up to four times: what the ledger says of each."""
    jobs, path = _deliveries(spark, sf_dir), new_path(spark, "jobs")
    versions = app(spark, sf_dir, "docs").select(F.col("id").alias("document_id"), F.col("current_version").cast("long").alias("current_version"))
    for stream in feed.arriving([jobs.filter(F.col("job_id") % 4 >= k) for k in range(4)], f"{path}/in"):
        consumer.consume(stream, path, versions, attempted)
    ledger = consumer.dealt(consumer.read(spark, f"{path}/ledger", consumer.LEDGER), "job_id")
    return ledger.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), F.max("attempt").alias("attempts"), F.max_by("outcome", "batch_id").alias("outcome"))


SIZES = Sizes(600, 60, 60)


def staged_ingest(spark, sf_dir) -> DataFrame:
    """Documents taken in once, then every third in a new version (one more sentence; every ninth without content) by a run that fails, and by one that doesn't: what readers see after each."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), "text")
    path = new_path(spark, "ingest")
    staging.ingest(spark, docs, path, 1, sizes=SIZES)

    def seen(when: str) -> DataFrame:
        return staging.visible(spark, path).groupBy("document_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("chunks")).select(F.lit(when).alias("after"), "*")

    newer = docs.filter("document_id % 3 = 0").select("document_id", F.lit(2).alias("version"), F.when(F.col("document_id") % 9 != 0, F.concat("text", F.lit(" One more sentence."))).alias("text"))

    def fail() -> None:
        raise RuntimeError("trial failure")

    try:
        staging.ingest(spark, newer, path, 2, sizes=SIZES, before_commit=fail)
    except RuntimeError:
        pass
    failed = written(seen("failed"))
    staging.ingest(spark, newer, path, 2, sizes=SIZES)
    whole = seen("done").join(staging.errors(spark, path).filter("run = 2").select("document_id", "error"), "document_id", "left")
    return failed.withColumn("error", F.lit(None).cast("string")).unionByName(whole).groupBy("after", "version").agg(F.count(F.lit(1)).alias("documents"), F.count("error").alias("errors"))


SQL = {
    "change_feed": f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL), s AS (SELECT min(us) AS a, max(us) AS b FROM e),
k AS (SELECT e.*, CAST(floor(CAST({TICKS} * (us - a) AS DOUBLE) / (b - a + 1)) AS INTEGER) AS tick, b FROM e, s),
o AS (SELECT *, lag(event_type) OVER w AS was, lead(us) OVER w AS next, lead(tick) OVER w AS next_tick FROM k WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
c AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN was <> 'error' THEN 'removed' END WHEN was IS NULL OR was = 'error' THEN 'added' WHEN was <> event_type THEN 'changed' END AS kind FROM o WHERE tick > 0)
SELECT * FROM c WHERE kind IS NOT NULL
UNION ALL SELECT user_id, event_id, 'stalled' FROM o WHERE event_type IN ('click', 'view') AND (tick > 0 OR next_tick > 0 OR next IS NULL) AND coalesce(next, b - 1000000) // 1000 - us // 1000 > {STALL_MS}""",
    "consumed_jobs": f"""WITH {app_sql('jobs', 'docs')}, j AS (
  SELECT j.id AS job_id, j.id % 4 + 1 AS n, coalesce(j.document_version < d.current_version, false) AS stale, CASE WHEN j.id % 5 = 0 THEN j.id % 7 ELSE 0 END AS f FROM jobs j LEFT JOIN docs d ON d.id = j.document_id)
SELECT job_id, CAST(CASE WHEN stale THEN 1 ELSE least(n, f + 1, {consumer.MOST}) END AS BIGINT) AS entries, CAST(CASE WHEN stale THEN 1 ELSE least(n, f + 1, {consumer.MOST}) END AS BIGINT) AS attempts,
  CASE WHEN stale THEN 'stale' WHEN f + 1 <= least(n, {consumer.MOST}) THEN 'done' WHEN n >= {consumer.MOST} THEN 'dead' ELSE 'retry' END AS outcome FROM j""",
    "staged_ingest": r"""WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS newer, doc_id % 9 = 0 AS bad FROM documents WHERE regexp_matches(text, '[^\s]'))
SELECT 'failed' AS after, 1 AS version, count(*) AS documents, 0 AS errors FROM d HAVING count(*) > 0
UNION ALL SELECT 'done', CASE WHEN newer AND NOT bad THEN 2 ELSE 1 END AS v, count(*), count(*) FILTER (WHERE bad) FROM d GROUP BY v""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
