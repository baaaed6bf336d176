"""A consumer of jobs that are delivered at least once: a ledger makes each (job, version) count once.

Every micro-batch is one step: deliveries that the ledger has settled are skipped, those of a version that the
document has left behind are stale, the others are attempted. A failed attempt is retried
with a later delivery until MOST attempts have failed; then the job is dead. Results and ledger rows are
written as the batch's own partition, results first, so a batch that is run again (as a stream does after a
failure) writes the same rows in their place. It reads the ledger of earlier batches alone. Rows are dealt by
their job before anything is gathered by it, so what a task holds is its share of the jobs, not of a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MOST = 3
KEY = ["job_id", "version"]
LEDGER = "job_id bigint, version bigint, attempt bigint, outcome string, batch_id bigint"
SETTLED = ("done", "stale", "dead")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty before its first batch."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows over as many tasks as a shuffle has, whatever their size: numbers are small when they are shuffled, and large when they are sorted or gathered."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def settle(deliveries: DataFrame, ledger: DataFrame, versions: DataFrame, most: int = MOST) -> DataFrame:
    """deliveries (job_id, document_id, version), one of each job and version, with the attempt's number and `outcome`: skipped, stale, or null for those to be attempted.

    versions: (document_id, current_version). The ledger is summed up by job before it meets the deliveries.
    """
    past = dealt(ledger, *KEY).groupBy(*KEY).agg(F.count_if(F.col("outcome") == "retry").alias("failed"), F.bool_or(F.col("outcome").isin(*SETTLED)).alias("settled"))
    one = dealt(deliveries, *KEY).dropDuplicates(KEY).join(past, KEY, "left").join(versions, "document_id", "left")
    stale = F.coalesce(F.col("version") < F.col("current_version"), F.lit(False))
    outcome = F.when(F.coalesce("settled", F.lit(False)), "skipped").when(stale, "stale")
    return one.select(*deliveries.columns, (F.coalesce("failed", F.lit(0)) + 1).cast("long").alias("attempt"), outcome.alias("outcome"))


def step(batch: DataFrame, batch_id: int, *, path: str, versions: DataFrame, handle: Callable[[DataFrame], DataFrame], most: int = MOST) -> None:
    """One micro-batch. handle: (deliveries with attempt) to the same rows with `error` (null: it worked) and `result`."""
    spark = batch.sparkSession
    ledger = read(spark, f"{path}/ledger", LEDGER).filter(F.col("batch_id") < batch_id)
    known = settle(batch, ledger, versions, most)
    tried = handle(known.filter("outcome IS NULL").drop("outcome"))
    failed = F.col("error").isNotNull()
    outcome = F.when(~failed, "done").when(F.col("attempt") >= most, "dead").otherwise("retry")
    tried = tried.withColumn("outcome", outcome)
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    save(tried.select(*KEY, "attempt", "result", "error", "outcome"), "attempts")
    now = read(spark, f"{path}/attempts", f"{LEDGER}, result string, error string").filter(F.col("batch_id") == batch_id)
    save(now.select(*KEY, "attempt", "outcome").unionByName(known.filter("outcome = 'stale'").select(*KEY, "attempt", "outcome")), "ledger")


def consume(deliveries: DataFrame, path: str, versions: DataFrame, handle: Callable[[DataFrame], DataFrame], most: int = MOST) -> None:
    """Run a stream of deliveries to its end."""
    run = deliveries.writeStream.foreachBatch(lambda batch, batch_id: step(batch, batch_id, path=path, versions=versions, handle=handle, most=most))
    query = run.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, version, result) of the jobs that are done."""
    done = read(spark, f"{path}/ledger", LEDGER).filter("outcome = 'done'").select(*KEY, "batch_id")
    return read(spark, f"{path}/attempts", f"{LEDGER}, result string, error string").filter("outcome = 'done'").join(done, [*KEY, "batch_id"], "left_semi").select(*KEY, "result")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, version, attempt, error) of the jobs that were given up."""
    return read(spark, f"{path}/attempts", f"{LEDGER}, result string, error string").filter("outcome = 'dead'").select(*KEY, "attempt", "error")
