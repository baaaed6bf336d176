"""The change feed, the consumer of jobs and staged ingestion: replays, restarts and failures leave what they should."""

import hashlib
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.functions.chunking import Sizes
from siltstone.operators import staging
from siltstone.streaming import consumer, feed

STATES = "id long, version long, fingerprint long, deleted boolean, open boolean, ts timestamp"
START = datetime(2024, 1, 1)


def state(key, version, mark, deleted=False, open=False, minute=0):
    return (key, version, mark, deleted, open, START + timedelta(minutes=minute))


def run(spark, path, ticks, first=None, **options):
    stream = feed.replayed([spark.createDataFrame(rows, STATES).coalesce(1) for rows in ticks], f"{path}/in")
    known = spark.createDataFrame(first, STATES) if first else None
    query = feed.changes(stream, first=known, **options).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return sorted((r.id, r.version, r.kind) for r in spark.read.schema(feed.CHANGES).parquet(f"{path}/out").collect())


def test_delta_of_snapshots(spark):
    schema = "id int, status string"
    before = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], schema)
    now = spark.createDataFrame([(1, "A"), (2, "B"), (3, ""), (4, "A")], schema)
    assert sorted(feed.delta(before, now, "id", ["status"]).collect()) == [(2, "changed"), (3, "changed"), (4, "added")]
    assert sorted(feed.delta(now, before, "id", ["status"]).collect())[-1] == (4, "removed")


def test_stream_of_changes(spark, tmp_path):
    ticks = [[state(1, 1, 10), state(2, 1, 20)], [state(1, 2, 10), state(2, 2, 21)], [state(2, 2, 99), state(1, 3, 10, deleted=True)], [state(1, 4, 10), state(1, 4, 10), state(2, 1, 5)]]
    found = run(spark, str(tmp_path), ticks)
    assert found == [(1, 1, "added"), (1, 3, "removed"), (1, 4, "added"), (2, 1, "added"), (2, 2, "changed")]


def test_feed_begins_from_a_snapshot_and_reports_what_stalls(spark, tmp_path):
    """The changes since the snapshot, applied to it, are the last snapshot; open work that is silent is told of once."""
    first = [state(1, 1, 10, open=True), state(2, 1, 20), state(3, 1, 30, open=True), state(4, 1, 40, deleted=True, open=True)]
    ticks = [[state(1, 2, 11, minute=20), state(2, 2, 20, open=True, minute=20)], [state(5, 1, 50, open=True, minute=30), state(4, 2, 41, minute=31)], [state(5, 2, 50, minute=33), state(2, 3, 20, deleted=True, minute=58)]]
    found = run(spark, str(tmp_path), ticks, first, stall_after_ms=15 * 60_000)
    # 1 was heard of too late, 3 never again, 2 was silent from minute 20 to its removal in minute 58; 5 closed in time
    assert found == [(1, 1, "stalled"), (1, 2, "changed"), (2, 2, "stalled"), (2, 3, "removed"), (3, 1, "stalled"), (4, 2, "added"), (5, 1, "added")]
    alive = {r[0] for r in first if not r[3]}
    for key, _, kind in sorted(found, key=lambda x: x[1]):
        alive = alive | {key} if kind == "added" else alive - {key} if kind == "removed" else alive
    assert alive == {1, 3, 4, 5}


def test_stalled(spark):
    jobs = spark.createDataFrame([("RUNNING", datetime(2024, 1, 1)), ("DONE", datetime(2024, 1, 1)), ("QUEUED", datetime(2024, 1, 2)), (None, None)], "status string, updated_at timestamp")
    assert [r.stalled for r in feed.stalled(jobs, F.lit(datetime(2024, 1, 2))).collect()] == [True, False, False, False]


def rows_of(path):
    return {p.relative_to(path): p.name for p in Path(path).rglob("*.parquet")}


def test_batches_that_run_twice_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    versions = spark.createDataFrame([(1, 1), (2, 5)], "document_id long, current_version long")
    schema = "job_id long, document_id long, version long"
    batches = [[(10, 1, 1), (10, 1, 1), (11, 1, 1), (12, 2, 4)], [(10, 1, 1), (11, 1, 1), (13, 3, 1)], [(11, 1, 1), (12, 2, 4), (14, 1, 1)], [(11, 1, 1), (14, 1, 1)]]
    calls = []

    def handle(rows):
        calls.append(sorted((r.job_id, r.attempt) for r in rows.collect()))
        bad = (F.col("job_id") == 11) | ((F.col("job_id") == 14) & (F.col("attempt") == 1))
        return rows.withColumn("error", F.when(bad, "broken")).withColumn("result", F.when(~bad, F.lit("ok")))

    def table():
        return sorted(tuple(r) for r in consumer.read(spark, f"{path}/ledger", consumer.LEDGER).collect()), sorted(tuple(r) for r in consumer.results(spark, path).collect()), sorted(tuple(r) for r in consumer.dead_letters(spark, path).collect())

    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        consumer.step(batch, k, path=path, versions=versions, handle=handle)
        once = table()
        consumer.step(batch, k, path=path, versions=versions, handle=handle)
        assert table() == once
    ledger, done, dead = once
    assert ledger == [(10, 1, 1, "done", 0), (11, 1, 1, "retry", 0), (11, 1, 2, "retry", 1), (11, 1, 3, "dead", 2), (12, 4, 1, "stale", 0), (13, 1, 1, "done", 1), (14, 1, 1, "retry", 2), (14, 1, 2, "done", 3)]
    assert done == [(10, 1, "ok"), (13, 1, "ok"), (14, 1, "ok")] and dead == [(11, 1, 3, "broken")]
    assert calls[::2] == calls[1::2] and calls[-1] == [(14, 2)]  # what is settled isn't attempted again


def test_a_run_that_fails_leaves_the_old_version(spark, tmp_path):
    path, sizes = str(tmp_path), Sizes(60, 10, 10)
    schema = "document_id long, version long, text string"
    body = "The first sentence is here. The second one follows it at once. And the third one ends the text."
    staging.ingest(spark, spark.createDataFrame([(1, 1, body), (2, 1, "Short."), (3, 1, None), (4, 1, " \n ")], schema), path, 1, sizes=sizes)
    seen = lambda: {(r.document_id, r.version): r.n for r in staging.visible(spark, path).groupBy("document_id", "version").agg(F.count("*").alias("n")).collect()}
    before = seen()
    assert set(before) == {(1, 1), (2, 1)} and before[1, 1] > 1
    assert sorted((r.document_id, r.error) for r in staging.errors(spark, path).collect()) == [(3, "NO_CONTENT"), (4, "EMPTY")]
    newer = spark.createDataFrame([(1, 2, body + " A fourth sentence was added to it."), (2, 2, None), (5, 1, "New."), (1, 1, "an older one")], schema)

    def fail():
        raise RuntimeError("trial failure")

    with pytest.raises(RuntimeError):
        staging.ingest(spark, newer, path, 2, sizes=sizes, before_commit=fail)
    assert seen() == before
    for _ in range(2):  # the same run once more, and again after its commit
        staging.ingest(spark, newer, path, 2, sizes=sizes) if (1, 2) not in seen() else None
        assert set(seen()) == {(1, 2), (2, 1), (5, 1)}
    reused = {r.document_id: r.n for r in staging.visible(spark, path).groupBy("document_id").agg(F.count_if("reused").alias("n")).collect()}
    assert reused[1] >= 1 and reused[5] == 0
    staging.ingest(spark, spark.createDataFrame([(1, 1, "older")], schema), path, 3, sizes=sizes)
    assert set(seen()) == {(1, 2), (2, 1), (5, 1)}
