"""Golden sets: integrity of questions and passages, and what an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integrity(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(what, id): repeated ids, references to unknown passages, and bands whose rule is broken.

    passages: (id); questions: (id, band, supporting, distractors arrays). Answerable questions have a
    supporting passage, unanswerable ones none.
    """
    repeated = lambda df, name: df.groupBy("id").count().filter("count > 1").select(F.lit(name).alias("what"), "id")
    wanted = questions.select("id", F.explode(F.array_union(F.coalesce("supporting", F.array().cast("array<bigint>")), F.coalesce("distractors", F.array().cast("array<bigint>")))).alias("passage"))
    unknown = wanted.join(passages.select(F.col("id").alias("passage")), "passage", "left_anti").select(F.lit("unknown_reference").alias("what"), "id").distinct()
    broken = questions.filter((F.col("band") == "unanswerable") == (F.size("supporting") > 0)).select(F.lit("band_rule").alias("what"), "id").distinct()
    return repeated(passages, "repeated_passage").unionByName(repeated(questions, "repeated_question")).unionByName(unknown).unionByName(broken)


def subset(cited: Column, sources: Column) -> Column:
    """Whether every cited id is one of the sources."""
    return F.size(F.array_except(cited, sources)) == 0


def overrides(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(slot, model): each default slot's override where one is stored and not blank; unknown slots are ignored."""
    known = stored.select("slot", F.col("model").alias("__own")).filter(F.trim("__own") != "")
    return defaults.join(known, "slot", "left").select("slot", F.coalesce("__own", "model").alias("model"))
