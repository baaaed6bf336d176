"""The approximate index, the tables' layout, merges by bucket and the trial embedder."""

import hashlib
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from siltstone.functions import embedding
from siltstone.operators import documents as d
from siltstone.operators import layout, retrieval, vector_index
from siltstone.plans import app_index, queries
from siltstone.plans.app import app

SF = "/root/testdata/sf0.01"


def physical(df) -> str:
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan ==") :]


def test_recall_and_pruned_lists(spark):
    rows = app_index.ann_topk(spark, SF).collect()
    assert np.mean([r.recall for r in rows if r["rank"] == 1]) >= 0.95
    vectors = queries.vectors(spark, SF)
    index = vector_index.build(vectors, 16)
    one = vectors.filter("id = 100").select(F.col("id").alias("query_id"), "vector")
    found = vector_index.search(index, one, 10, 2)
    assert "dynamicpruning" in physical(found) and found.count() == 10
    lists = {r.id: r.list for r in index.table(spark).collect()}
    assert len({lists[r.id] for r in found.collect()}) <= 2 and len(set(lists.values())) == 16 and len(lists) == vectors.count()


def test_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, []), (4, [0.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.withColumnRenamed("id", "query_id")
    found = vector_index.search(vector_index.build(df, 2), asked.filter("query_id = 1").distinct(), 5, 2).collect()
    assert [(r.id, r.score) for r in found] == [(1, 1.0), (1, 1.0), (4, 0.0)]
    assert vector_index.search(vector_index.build(df.filter("false"), 2), asked, 5, 2).collect() == []


def test_layout_prunes_and_joins_without_an_exchange(spark):
    chunks = layout.stored_by_document(app(spark, SF, "chunks"), "document_id", "document_version")
    docs = layout.stored_by_document(app(spark, SF, "docs"), "id", "current_version")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with documents that are too many to send
    try:
        plan = physical(d.readable(chunks, docs, app(spark, SF, "kb"), d.Reader("t0", 3, None, False, None, None)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert plan.count("PartitionFilters: [isnotnull(tenant_id") >= 2 and "Bucketed: true" in plan


def test_a_merge_leaves_other_buckets_files_as_they_are(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    layout.store_buckets(rows, path, "k", 8)
    files = lambda: {p.relative_to(path): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, -1), (5, -2), (1000, 7), (None, 9)], "k long, v long")
    own = layout.merge(spark, path, new, "k", ["v"], buckets=8)
    after = files()
    other = {p: h for p, h in before.items() if int(p.parts[0].split("=")[1]) not in own}
    assert 0 < len(own) <= 2 and len(other) >= 6 and all(after[p] == h for p, h in other.items())
    now = {r.k: r.v for r in layout.read_buckets(spark, path).collect()}
    assert now == {**{k: 10 * k for k in range(200)}, 5: -1, 1000: 7}
    again = layout.merge(spark, path, new, "k", ["v"], buckets=8)  # a repeated run gives the same table
    assert again == own and {r.k: r.v for r in layout.read_buckets(spark, path).collect()} == now
    doomed = spark.range(200).select(F.col("id").alias("k")).filter(layout.bucket_of(F.col("k"), 8) == own[0])
    layout.remove(spark, path, doomed.unionByName(spark.createDataFrame([(1000,)], "k long")), "k", buckets=8)
    left = {r.k for r in layout.read_buckets(spark, path).collect()}
    assert left == set(now) - {r.k for r in doomed.collect()} - {1000}
    assert layout.merge(spark, path, new.filter("k IS NULL"), "k", ["v"], buckets=8) == []


def test_trial_vectors_against_plain_hashing(spark):
    texts = ["a", "b", "a", None, "", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = Observation("embedded")
    found = {r.id: r.vector for r in embedding.embedded(df, dimensions=16, observed=seen).collect()}
    assert seen.get["embedded"] == 3  # distinct texts, a null being empty
    for k, text in enumerate(texts):
        key = hashlib.sha256((text or "").encode()).hexdigest()
        blocks = [hashlib.sha256(f"{key}:{c}".encode()).hexdigest() for c in range(2)]
        raw = [int(b[8 * i : 8 * i + 8], 16) / 2**31 - 1 for b in blocks for i in range(8)]
        assert found[k] == pytest.approx([x / math.sqrt(sum(y * y for y in raw)) for x in raw])
    with pytest.raises(ValueError):
        embedding.vector_of(F.lit("x"), 12)
    assert retrieval.unit(F.array(F.lit(0.0))) is not None


def test_probes_are_cleaned_and_bounded(spark):
    from siltstone.operators import probes

    rows = [(1, "  What is it? \n", ["what", " what ", "", None, "What is it?", "a longer form of it", "one more"]), (2, " \t", ["x"]), (3, None, None), (4, "q", None)]
    df = spark.createDataFrame(rows, "question_id long, text string, sub_queries array<string>")
    found = [(r.question_id, r.probe, r.text) for r in probes.probes_of(df, 2, 8).orderBy("question_id", "probe").collect()]
    assert found == [(1, 0, "What is it?"), (1, 1, "what"), (1, 2, "What is"), (4, 0, "q")]
    with pytest.raises(ValueError):
        probes.probes_of(df, 100)
