"""Measures of ranked lists and of answers: recall, means by band, agreement of two verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(ranked: DataFrame, items: DataFrame, label: str) -> DataFrame:
    """(query_id, hits, relevant, recall): of all items with the query's label, those in its list (query_id, id).

    items: (id, label), the queries among them.
    """
    own = items.select(F.col("id").alias("query_id"), F.col(label).alias("wanted"))
    sizes = items.groupBy(F.col(label).alias("wanted")).agg(F.count(F.lit(1)).alias("relevant"))
    asked = own.join(ranked.select("query_id").distinct(), "query_id", "left_semi").join(sizes, "wanted")
    found = ranked.select("query_id", "id").join(items, "id").join(asked, "query_id")
    out = found.groupBy("query_id", "relevant").agg(F.count_if(F.col(label) == F.col("wanted")).alias("hits"))
    return out.select("query_id", "hits", "relevant", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))


def band_means(items: DataFrame, band: str, metrics: list[str]) -> DataFrame:
    """Items of each band, and each metric's mean over those that have it (null if none has)."""
    means = [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics]
    return items.groupBy(band).agg(F.count(F.lit(1)).alias("items"), *means)


def agreement(items: DataFrame, first: Column, second: Column) -> DataFrame:
    """Items on which two verdicts agree and differ; those without one of the verdicts aren't counted."""
    cells = {"both_yes": first & second, "both_no": ~first & ~second, "first_only": first & ~second, "second_only": ~first & second}
    return items.agg(*[F.count_if(c).alias(name) for name, c in cells.items()])
