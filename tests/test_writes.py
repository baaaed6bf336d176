"""Rewrites on nulls, repeats and empty sides."""

from siltstone.operators import writes

KIND = "id long, v string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], KIND)
    new = spark.createDataFrame([(1, "x", 10, 1), (1, None, None, 2), (3, "z", None, 1)], KIND + ", seq int")
    assert rows(writes.upsert(stored, new, "id", ["seq"], keep_stored=("n",))) == sorted([(1, None, 1), (2, "b", 2), (None, "c", 3), (3, "z", None)], key=repr)
    assert rows(writes.upsert(stored, new.filter("false"), "id", ["seq"])) == rows(stored)


def test_insert_and_delete(spark):
    stored = spark.createDataFrame([(1, "a", 1), (None, "c", 3)], KIND)
    new = spark.createDataFrame([(1, "x", 9), (4, "y", 9), (4, "y", 9)], KIND)
    assert rows(writes.insert_missing(stored, new, "id")) == sorted([(1, "a", 1), (None, "c", 3), (4, "y", 9)], key=repr)
    assert rows(writes.delete(stored, new, "id", "v")) == rows(stored)
    stay, report = writes.cascade({"t": stored}, new, "id")
    assert rows(stay["t"]) == [(None, "c", 3)] and rows(report) == [("t", 1, 1)]


def test_swap_and_partitions(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)], KIND)
    done = spark.createDataFrame([(1, 2)], "id long, n int")
    kept = writes.swap_versions(chunks, done, "id", "n")
    assert {r.v for r in kept.collect()} == {"b", "c", "d"}
    path = str(tmp_path / "chunks")
    for _ in range(2):
        writes.replace_partitions(chunks.filter("id IS NOT NULL"), path, "id")
    writes.replace_partitions(kept.filter("id = 1"), path, "id")
    assert {r.v for r in spark.read.parquet(path).collect()} == {"b", "c"}
