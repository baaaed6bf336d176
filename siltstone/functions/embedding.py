"""Deterministic vectors of texts for trials: a hash stream in counter mode, in place of a model.

A text's key is its SHA-256; block c of the stream is the SHA-256 of key and c, eight numbers from -1
to 1; the vector is brought to length 1. Equal texts have equal vectors, others unrelated ones. As the
key is all that a vector depends on, distinct keys are embedded once, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.operators.retrieval import unit

DIMENSIONS = 64


def key_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def vector_of(key: Column, dimensions: int = DIMENSIONS) -> Column:
    """The unit vector of a key; dimensions must be a multiple of eight."""
    if dimensions <= 0 or dimensions % 8:
        raise ValueError("a block gives eight numbers: dimensions must be a multiple of eight")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(dimensions // 8 - 1)), lambda c: F.sha2(F.concat(key, F.lit(":"), c.cast("string")), 256))
    number = lambda block, i: F.conv(F.substr(block, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / float(1 << 31) - 1.0
    return unit(F.flatten(F.transform(blocks, lambda block: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: number(block, i)))))


def embedded(rows: DataFrame, *, text: str = "text", out: str = "vector", dimensions: int = DIMENSIONS, observed: Observation | None = None) -> DataFrame:
    """rows with the vector of their text; `observed` counts the inputs that were embedded (distinct texts)."""
    keyed = rows.withColumn("__key", key_of(F.col(text)))
    unique = keyed.select("__key").distinct()
    if observed is not None:
        unique = unique.observe(observed, F.count(F.lit(1)).alias("embedded"))
    # a left join to distinct keys: who doesn't ask for the vectors doesn't have them made
    return keyed.join(unique.withColumn(out, vector_of(F.col("__key"), dimensions)), "__key", "left").drop("__key")
