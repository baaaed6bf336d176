"""Writes as rewrites: each function gives a table's next state, which replace_partitions() or a plain write then stores.

Keys that are null equal no key, as in SQL: such rows are never overwritten or deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.operations import latest_per


def upsert(stored: DataFrame, new: DataFrame, key: str, order: list[str], keep_stored: tuple[str, ...] = ()) -> DataFrame:
    """stored with new's rows in place of those of the same key; of several new ones the last by `order` wins.

    In a column of `keep_stored` a null doesn't overwrite.
    """
    last = latest_per(new, key, *order).select(F.struct(*stored.columns).alias("__new"))
    old = stored.select(F.struct(*stored.columns).alias("__old"))
    both = old.join(last, F.col(f"__old.{key}") == F.col(f"__new.{key}"), "full_outer")

    def value(name: str):
        fresh, before = F.col(f"__new.{name}"), F.col(f"__old.{name}")
        return F.when(F.col("__new").isNull(), before).otherwise(F.coalesce(fresh, before) if name in keep_stored else fresh).alias(name)

    return both.select(*map(value, stored.columns))


def insert_missing(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored and those rows of new whose key it lacks; of several new ones with one key (or null), one."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(stored.columns))


def delete(rows: DataFrame, doomed: DataFrame, *keys: str) -> DataFrame:
    """rows without those that equal a doomed one in all keys: deletion by id, and compare-and-delete by owner and token."""
    return rows.join(doomed.select(*keys), list(keys), "left_anti")


def cascade(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays in each table once the doomed keys are gone from all, and (table, kept, deleted)."""
    stay = {name: delete(rows, doomed, key) for name, rows in tables.items()}
    gone = doomed.select(F.col(key).alias("__doomed")).distinct()
    report = None
    for name, rows in tables.items():
        hit = F.col("__doomed").isNotNull()
        counted = rows.join(gone, F.col(key) == F.col("__doomed"), "left").agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("deleted")).select(F.lit(name).alias("table"), "kept", "deleted")
        report = counted if report is None else report.unionByName(counted)
    return stay, report


def swap_versions(chunks: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    """chunks with, for each document of `done` (key, version), that version alone; others keep all of theirs."""
    current = done.select(F.col(key).alias("__key"), F.col(version).alias("__current"))
    met = chunks.join(current, F.col(key) == F.col("__key"), "left")
    return met.filter(F.col("__key").isNull() | (F.col(version) == F.col("__current"))).select(chunks.columns)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites those partitions that rows has, and no other: a repeated run gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
