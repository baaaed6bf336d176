"""Plans and helpers whose cost must not grow faster than their input."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import embedding
from siltstone.functions import text as tx
from siltstone.operators import fulltext, probes, retrieval, vector_index
from siltstone.streaming import consumer, feed


def physical(df) -> str:
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan ==") :]


def test_a_unit_vector_takes_its_length_once(spark):
    made = retrieval.unit(F.transform(F.sequence(F.lit(1), F.col("id")), lambda x: F.sqrt(x)))
    assert physical(spark.range(3).select(made.alias("u"))).count("sequence(") == 1
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<float>").select(retrieval.unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in rows] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_vectors_that_nothing_reads_are_not_made(spark):
    docs = embedding.embedded(spark.range(9).select("id", F.col("id").cast("string").alias("text")))
    assert "sha2" not in physical(docs.select("id", "text")) and docs.select("id", "vector").count() == 9


def test_both_passes_of_a_search_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(30).select("id", F.concat(F.lit("cat "), F.col("id")).alias("text")).write.parquet(path)
    asked = spark.createDataFrame([(k, 0, f"cat {k}") for k in range(6)], "question_id long, probe int, text string")
    chunks = embedding.embedded(spark.read.parquet(path))
    found = probes.search_twice(chunks, asked, asked.filter("question_id < 2"), asked.withColumn("text", F.concat(F.lit("cat "), F.col("question_id") + 10)))
    assert physical(found).split("== Initial Plan ==")[0].count(f"{path}") <= 3  # the dense arm reads keys and rows, the lexical one texts
    best = {r.question_id: (r.id, r.attempt) for r in found.filter("rank = 1").collect()}
    assert best == {k: (k + 10 if k < 2 else k, 2 if k < 2 else 1) for k in range(6)}


@pytest.mark.parametrize("every", [False, True])
def test_occurrences_are_no_rows(spark, every):
    docs = spark.createDataFrame([(1, "a cat and a dog"), (1, "a cat and a dog"), (2, "cats, dogs and a cat"), (3, "cow")], "id long, text string")
    asked = fulltext.questions(spark.createDataFrame([(7, "cat dog"), (8, "cow unknown")], "query_id long, text string"))
    found = fulltext.top_k(docs, asked, 5, every=every)
    assert "position" not in physical(found) and "MapInArrow" in physical(found)
    rows = {(r.query_id, r.id): r.covers for r in found.collect()}
    assert rows == ({(7, 1): 1, (7, 2): 2} if every else {(7, 1): 2, (7, 2): 3, (8, 3): 1})


def test_stems_are_counted_without_a_row_for_each_distinct_count(spark):
    docs = spark.createDataFrame([(1, "a cat and cats"), (1, "CATS cat"), (2, "cats dog"), (None, "dog cow"), (3, None)], "id long, text string")
    found = fulltext.stem_counts(docs)
    assert "Expand" not in physical(found) and "array_except" in physical(found)
    assert sorted(map(tuple, found.collect())) == [("cat", 2, 5, 2), ("cow", 1, 1, 0), ("dog", 1, 2, 1)]
    assert fulltext.stem_counts(docs.limit(0)).collect() == []


def test_unicode_forms_slice_by_slice():
    texts = pa.array(["é", None, "plain", "ﬁ", "x" * 3_000_000 + "é"] * 300)[:1400]
    texts = pa.concat_arrays([texts.slice(0, 4), pa.array(["y"] * 700), texts.slice(4, 2)])
    for form in ("NFC", "NFKC"):
        assert tx.in_form(texts, form).to_pylist() == [unicodedata.normalize(form, x or "") for x in texts.to_pylist()]
    assert tx.in_form(pa.array([], pa.string()), "NFC").to_pylist() == []


def test_pairs_of_an_index_are_no_rows(spark):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, draw.normal(size=4).tolist()) for k in range(300)], "id long, vector array<double>")
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    found = vector_index.search(vector_index.build(rows, 5), asked, 7, 5)
    assert "MapInArrow" in physical(found) and "zip_with(unit" not in physical(found)
    assert sorted(found.collect()) == sorted(retrieval.dense_top_k(rows, asked, 7).collect())


def test_a_tick_of_many_files_is_one_batch_of_many_tasks(spark, tmp_path):
    path = str(tmp_path)
    jobs = spark.range(0, 40, 1, 4).select(F.col("id").alias("job_id"), F.col("id").alias("document_id"), F.lit(1).cast("long").alias("version"))
    versions = jobs.select("document_id", F.lit(1).cast("long").alias("current_version"))
    handle = lambda rows: rows.withColumns({"error": F.when(F.col("attempt") == 1, "first"), "result": F.lit("ok")})
    for stream in feed.arriving([jobs, jobs.filter("job_id < 30")], f"{path}/in"):
        consumer.consume(stream, path, versions, handle)
    ledger = consumer.read(spark, f"{path}/ledger", consumer.LEDGER)
    assert len(list((tmp_path / "in" / "tick=0").glob("part-*"))) == 4
    assert {(r.batch_id, r.outcome): r["count"] for r in ledger.groupBy("batch_id", "outcome").count().collect()} == {(0, "retry"): 40, (1, "done"): 30}
    plan = physical(consumer.settle(jobs, ledger, versions))
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "partial_first" not in plan.split("REPARTITION_BY_NUM")[-1]


def test_a_blank_text_is_told_without_rewriting_it(spark):
    rows = spark.createDataFrame([("",), (None,), (" \t\r\n\x0b\x0c ",), ("\n x",), ("\u00a0",), ("x" * 100_000,)], "t string").select("t", tx.is_blank(F.col("t")).alias("b"))
    assert "regexp_replace" not in physical(rows)
    assert [r.b for r in rows.collect()] == [True, True, True, False, False, False]
