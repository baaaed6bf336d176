"""An approximate index for dense search: inverted lists over learned centroids, stored by list.

Build. Centroids are fitted by k-means on unit vectors of a bounded sample (SAMPLE rows, by the least
hash of the id); every vector is stored with its nearest centroid's list, as a partition of the table.
A list's rows are dealt over several files by their id, so a large list is no single task.

Search. A question goes to the `probes` lists whose centroids are nearest; lists that no question
probes aren't read (partitions are pruned when the questions are known), and the rows of those that
are meet their questions by list, slices of rows against blocks of questions: a pair is a number of a
product and no row, and only a slice's k best of a question are shuffled. Scores are exact cosines; recall grows with `probes`, and with
all lists the search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import _best, _by_blocks, top_by, unit
from siltstone.storage import new_path

SAMPLE, ROUNDS, SEED = 100_000, 15, 11
#: Rows of a list's file, about.
FILE_ROWS = 1 << 20


@dataclass(frozen=True)
class Index:
    """path: (id, unit vector) by list; centroids: of each list, at most `lists` of them."""

    path: str
    centroids: list[list[float]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, unit array<double>, list int").parquet(self.path)


def build(vectors: DataFrame, lists: int, path: str | None = None) -> Index:
    """An index of vectors (id, vector); null ids and vectors are left out."""
    spark = vectors.sparkSession
    rows = vectors.filter("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").select(F.col("id").cast("long").alias("id"), unit(F.col("vector")).alias("unit"))
    path = path or new_path(spark, "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    if sample.isEmpty():
        rows.withColumn("list", F.lit(0)).write.partitionBy("list").parquet(path)
        return Index(path, [])
    model: KMeansModel = KMeans(k=lists, maxIter=ROUNDS, seed=SEED).fit(sample)
    dealt = model.transform(rows.withColumn("features", array_to_vector("unit"))).select("id", "unit", F.col("prediction").alias("list"))
    dealt.repartition("list", F.shiftright(F.xxhash64("id"), 62)).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(path)
    return Index(path, [c.tolist() for c in model.clusterCenters()])


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank): of each query (query_id, vector) the k ids of greatest cosine in its `probes` nearest lists; ties by id."""
    spark = queries.sparkSession
    table = index.table(spark)
    if not index.centroids:
        return table.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    centroids = F.array(*[F.struct(F.lit(k).alias("list"), F.array(*[F.lit(float(x)) for x in c]).alias("at")) for k, c in enumerate(index.centroids)])
    away = lambda c: F.aggregate(F.zip_with(c["at"], F.col("asked"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    asked = queries.filter("query_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").select("query_id", unit(F.col("vector")).alias("asked"))
    near = F.sort_array(F.transform(centroids, lambda c: F.struct(away(c).alias("away"), c["list"].alias("list"))))
    probed = asked.select("query_id", "asked", F.posexplode(near).alias("nth", "near")).filter(F.col("nth") < probes).select("query_id", "asked", F.col("near.list").alias("list"))

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def prepare(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return block.column("query_id").to_numpy(zero_copy_only=False), matrix(block.column("asked"), block.num_rows).T

    def meet(rows: pa.RecordBatch, asked: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        ids = rows.column("id").to_numpy(zero_copy_only=False)
        score = np.round(matrix(rows.column("unit"), len(ids)) @ q, 6)
        places = [_best(score[:, j], ids, k) for j in range(len(asked))]
        of, at = np.repeat(np.arange(len(asked)), [len(p) for p in places]), np.concatenate(places)
        return pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(ids[at]), pa.array(score[at, of])], ["query_id", "id", "score"])

    known = table.join(F.broadcast(probed.select("list").distinct()), "list", "left_semi")  # a row for each list
    met = _by_blocks(known, probed, prepare, meet, "query_id bigint, id bigint, score double", on="list")
    return top_by(met, "query_id", [F.desc("score"), "id"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted, recall) of a search against the exact one."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.round(F.col("hits") / F.col("wanted"), 6))
