import numpy as np
import pytest

from siltstone.operators import access, retrieval


def ranked(spark, rows):
    return spark.createDataFrame([("q", i, r) for i, r in rows], "query_id string, id string, rank int")


def test_fusion_scores_and_ranks(spark):
    rows = {r.id: r for r in retrieval.fuse(ranked(spark, [("a", 1), ("b", 2)]), ranked(spark, [("b", 1), ("a", 2)])).collect()}
    assert rows["a"].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and (rows["a"].dense_rank, rows["a"].sparse_rank) == (1, 2)
    assert rows["a"].rank == 1 and rows["b"].rank == 2  # ties by id


def test_fusion_of_one_arm_and_repeats(spark):
    rows = {r.id: r for r in retrieval.fuse(ranked(spark, [("a", 1), ("b", 2), ("a", 3)]), ranked(spark, [])).collect()}
    assert rows["a"].score == pytest.approx(1 / 61, abs=1e-9) and rows["a"].sparse_rank is None
    with pytest.raises(ValueError):
        retrieval.fuse(ranked(spark, []), ranked(spark, []), k=0)


@pytest.mark.parametrize(
    "hits, kept",
    [
        ([("d", 0, 3), ("d", 0, 4)], [1]),
        ([("d", 0, 3), ("d", 0, 4), ("d", 0, 5)], [1, 3]),
        ([("d", None, None), ("d", None, None)], [1, 2]),
        ([("d", 0, 5), ("d", 1, 6)], [1, 2]),
    ],
)
def test_neighbours_go_greedily(spark, hits, kept):
    df = spark.createDataFrame([("q", k + 1, *h) for k, h in enumerate(hits)], "query_id string, rank int, document_id string, block_order int, block_chunk_index int")
    assert sorted(r.rank for r in retrieval.drop_neighbours(df).collect()) == kept


def test_fetch_keeps_the_order_asked_for(spark):
    ids = spark.createDataFrame([("q", ["c", "x", "a"])], "query_id string, ids array<string>")
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    assert [r.id for r in retrieval.fetch_in_order(ids, docs).orderBy("place").collect()] == ["c", "a"]


def test_null_flags_hide(spark):
    df = spark.createDataFrame([(1, True, False), (2, None, False), (3, True, None), (4, True, True)], "id int, searchable boolean, deleted boolean")
    assert [r.id for r in df.filter(access.live()).orderBy("id").collect()] == [1, 3]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_searches_over_several_blocks_of_queries(spark, threshold):
    """Broadcast and paired partitions give the same as a plain search; odd rows take no part."""
    draw = np.random.default_rng(4)
    rows, asked = draw.integers(-4, 5, (700, 6)).astype(float), draw.integers(-4, 5, (2_300, 6)).astype(float)
    words = [" ".join(draw.choice(list("abcdefgh"), draw.integers(0, 9))) for _ in range(700)]
    docs = spark.createDataFrame([(k, v.tolist(), w) for k, (v, w) in enumerate(zip(rows, words))] + [(None, [1.0] * 6, "a"), (900, None, None)], "id long, vector array<double>, text string").repartition(5)
    questions = spark.createDataFrame([(k, v.tolist(), " ".join({"abcdefgh"[k % 8], "abcdefgh"[k // 8 % 8]})) for k, v in enumerate(asked)] + [(None, [1.0] * 6, "a"), (5_000, None, "?")], "query_id long, vector array<double>, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        dense = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.dense_top_k(docs, questions, 3).collect()}
        sparse = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.lexical_top_k(docs, questions, 3).collect()}
        assert retrieval.dense_top_k(docs, questions.limit(0), 3).count() == 0 == retrieval.lexical_top_k(docs.limit(0), questions, 3).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    score = np.round(unit(asked) @ unit(rows).T, 6)
    for k in range(0, 2_300, 37):
        best = sorted(range(700), key=lambda i: (-score[k, i], i))[:3]
        assert [dense[k, r][1] for r in (1, 2, 3)] == pytest.approx([score[k, i] for i in best])
        counts = [sum(w.split().count(t) for t in {"abcdefgh"[k % 8], "abcdefgh"[k // 8 % 8]}) for w in words]
        assert [sparse[k, r] for r in (1, 2, 3)] == [(i, counts[i]) for i in sorted(range(700), key=lambda i: (-counts[i], i))[:3]]
    assert len(dense) == 3 * 2_300 and len(sparse) == 3 * 2_300


def test_no_job_runs_while_a_search_is_planned(spark):
    docs = spark.range(50).selectExpr("id", "array(id, 1D) AS vector", "'a b' AS text")
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    try:
        retrieval.dense_top_k(docs, docs.withColumnRenamed("id", "query_id"), 3)
        retrieval.lexical_top_k(docs, docs.withColumnRenamed("id", "query_id"), 3)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
