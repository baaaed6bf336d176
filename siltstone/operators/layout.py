"""How chunks and documents lie on disk, so that reads prune and joins need no exchange, and writes touch what changes.

Chunks and documents are partitioned by tenant and bucketed by document and version, in as many buckets: a
reader's tenant prunes partitions, and the two tables meet bucket by bucket. Bucketing is recorded in
the session's catalog, with the files in the shared folder.

Tables that are changed in place are partitioned by a bucket of the key: a merge reads and overwrites
the buckets of the keys that it has, and leaves the files of all others as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import writes
from siltstone.storage import new_path, written

BUCKETS = 16


def stored_by_document(rows: DataFrame, *keys: str, tenant: str = "tenant_id", buckets: int = BUCKETS) -> DataFrame:
    """rows as a table partitioned by tenant and bucketed by the keys that it is joined on (document and version), read back."""
    name = f"siltstone_{uuid.uuid4().hex}"
    spark = rows.sparkSession
    rows.repartition(buckets, *keys).write.partitionBy(tenant).bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, "layout")).saveAsTable(name)
    return spark.table(name)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """rows as a table of buckets of the key."""
    rows.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def touched(new: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets of new's keys: at most `buckets` numbers."""
    return sorted(r.bucket for r in new.filter(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect())


def _changed(spark: SparkSession, path: str, key: str, own: list[int], buckets: int, change) -> DataFrame:
    """change(rows of the buckets `own`) as the table's columns; written apart first, as the buckets are read for it."""
    stored = spark.read.parquet(path)
    now = change(stored.filter(F.col("bucket").isin(own)).drop("bucket"))
    return written(now, "staged").withColumn("bucket", bucket_of(F.col(key), buckets)).select(stored.columns).repartition("bucket")


def merge(spark: SparkSession, path: str, new: DataFrame, key: str, order: list[str], *, buckets: int = BUCKETS, keep_stored: tuple[str, ...] = ()) -> list[int]:
    """new's rows put in place of those of the same key (as writes.upsert); returns the buckets that were rewritten."""
    own = touched(new, key, buckets)
    if not own:
        return []
    fresh = _changed(spark, path, key, own, buckets, lambda rows: writes.upsert(rows, new.filter(F.col(key).isNotNull()), key, order, keep_stored))
    writes.replace_partitions(fresh, path, "bucket")
    return own


def remove(spark: SparkSession, path: str, doomed: DataFrame, key: str, *, buckets: int = BUCKETS) -> list[int]:
    """Rows whose key is doomed go; returns the buckets that were rewritten (a bucket that would be empty keeps no rows)."""
    own = touched(doomed, key, buckets)
    if not own:
        return []
    fresh = _changed(spark, path, key, own, buckets, lambda rows: writes.delete(rows, doomed, key))
    left = {r.bucket for r in fresh.select("bucket").distinct().collect()}
    writes.replace_partitions(fresh, path, "bucket")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for bucket in set(own) - left:
        gone = at(f"{path}/bucket={bucket}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return own
