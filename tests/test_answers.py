"""Groundedness, scores, routes and display texts on given cases."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import answers as an
from siltstone.functions import groundedness as gr

GROUNDED = [
    ("The sky is very blue. [S1] The sea is quite deep. [S2]", 2, 2, None),
    ("The sky is very blue. The sea is quite deep.", 2, 0, "no_citations"),
    ("The sky is very blue. [S1] The sea is quite deep. The land is rather dry.", 3, 1, "partial_coverage"),
    ("The sky is very blue. The sea is quite deep. [S1]", 2, 2, None),
    ("The sky is very blue.\n\nThe sea is quite deep. [S1]", 2, 1, "partial_coverage"),
    ("[S1] The sky is very blue.", 1, 1, None),
    ("A heading\n[S1]\n\nThe sky is very blue.", 1, 0, "partial_coverage"),
    ("Yes. [S1]", 0, 0, "no_claims"),
    ("", 0, 0, "no_citations"),
    ("Dr. Smith met J. Brown of the U.S. office at 3.5 metres. [S1]", 1, 1, None),
    ("```\nthis code is not a claim at all\n```\n- a list item of five words [S1]\n- another item of some words", 2, 1, "partial_coverage"),
    ("The sky is very blue.\n\nShort one.\n[S1]\n\nThe sea is quite deep.", 2, 1, "partial_coverage"),
    ("The sky is very blue. [S7]", 1, 0, "no_citations"),
]


def test_groundedness(spark):
    rows = spark.createDataFrame([(k, *r[:1]) for k, r in enumerate(GROUNDED)], "id int, answer string")
    sources = F.array(F.lit("a"), F.lit("b"))
    found = {r.id: r.g for r in rows.select("id", gr.assess(gr.marked(F.col("answer"), sources)).alias("g")).collect()}
    for k, (text, claims, supported, reason) in enumerate(GROUNDED):
        assert (found[k].claims, found[k].supported, found[k].reason) == (claims, supported, reason), text
    assert found[7].score == 1.0 and found[8].score == 0.0 and found[2].score == pytest.approx(1 / 3)


def test_scores_and_routes(spark):
    rows = spark.createDataFrame([('{"scores":[{"id":2,"score":7},{"id":1,"score":3},{"id":2,"score":9},{"id":99,"score":1},{"id":-1,"score":1}]}',), ('{"scores":[{"id":1,"score":12},{"id":2,"score":-4},{"id":true,"score":5},{"id":3,"score":true}]}',), (None,), ("[1]",)], "p string")
    got = [[(x.id, x.score) for x in r.s] for r in rows.select(an.parse_scores(F.col("p"), F.lit(3).cast("long")).alias("s")).collect()]
    assert got == [[(2, 7.0), (1, 3.0)], [(1, 10.0), (2, 0.0)], [], []]
    q = spark.createDataFrame([("What is A? And what is B?",), ("cost of rent and power",), ("the rent",), ("how long is the notice period",)], "q string")
    routed = [(r.r.query_class, r.r.probes) for r in q.select(an.offline_route(F.col("q")).alias("r")).collect()]
    assert routed == [("multi_part", ["What is A?", "And what is B?"]), ("multi_part", ["cost of rent", "power"]), ("vague", ["the rent details"]), ("simple", [])]
    shown = spark.range(1).select(an.duration(F.lit(5405)).alias("d"), an.duration(F.lit(-3)).alias("z"), an.file_size(F.lit(2304)).alias("s"), an.file_size(F.lit(None).cast("long")).alias("n"), an.badge(F.lit("a.b.PDF")).alias("b"), an.badge(F.lit("none")).alias("o"), an.retry_window(F.lit(8)).alias("w")).first()
    assert tuple(shown) == ("90:05", "00:00", "2.3 KB", None, "PDF", "DOC", 600.0)
