"""Stems against the Snowball project's published samples, and ranks against brute force over covers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import stemming
from siltstone.operators import fulltext

SAMPLES = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consolation": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "constables": "constabl", "constancy": "constanc",
    "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "knees": "knee", "knightly": "knight", "knights": "knight", "knitted": "knit", "knots": "knot", "knowing": "know", "knuckles": "knuckl",
    "generate": "generat", "generates": "generat", "generic": "generic", "general": "general", "generously": "generous", "communism": "communism", "arsenal": "arsenal", "relational": "relat", "conditional": "condit", "happy": "happi", "by": "by", "say": "say",
    "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed", "skies": "sky", "dying": "die", "news": "news", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "inning": "inning", "proceed": "proceed",
    "luxuriated": "luxuri", "sized": "size", "shed": "shed", "sing": "sing", "youth": "youth", "enjoying": "enjoy", "rationalization": "ration", "hopefulness": "hope", "vietnamization": "vietnam", "adjustable": "adjust", "adoption": "adopt", "bowdlerize": "bowdler", "rate": "rate", "cease": "ceas", "controlling": "control", "rolling": "roll", "formative": "format", "analogi": "analog", "triplicate": "triplic", "electrical": "electr", "sensibility": "sensibl", "decisiveness": "decis", "a": "a", "42": "42",
}


def test_stems_of_published_samples(spark):
    df = spark.createDataFrame([(list(SAMPLES),)], "words array<string>")
    found = dict(zip(SAMPLES, df.select(stemming.stems("words").alias("s")).first().s))
    assert {w: s for w, s in found.items() if s != SAMPLES[w]} == {}


def brute(rows, terms, every):
    """(covers, rank) of one document: positions with a term, and every least stretch that satisfies the question."""
    places = sorted(p for p, s in rows if s in terms)
    held = dict(rows)
    if not every:
        return len(places), round(0.1 * len(places), 9)
    full = [(p, q) for p, q in itertools.combinations_with_replacement(places, 2) if {held[x] for x in places if p <= x <= q} == set(terms)]
    least = [(p, q) for p, q in full if not any((a, b) != (p, q) and p <= a and b <= q for a, b in full)]
    return len(least), round(sum(0.1 / (1 + (q - p) - (sum(p <= x <= q for x in places) - 1)) for p, q in least), 9)


@pytest.mark.parametrize("every", [False, True])
def test_rank_against_brute_force(spark, every):
    draw = random.Random(5)
    words = ["cat", "dog", "cow", "the", "xyz", "cats", "running", "run"]
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(0, 14)))) for k in range(60)] + [(100, None), (101, ""), (None, "cat dog"), (102, "CAT-dog, run!")]
    asked = [(1, "The cats and a dog"), (2, "cow"), (3, "the of"), (4, None), (5, "running dog cow")]
    stem = {"cat": "cat", "cats": "cat", "dog": "dog", "cow": "cow", "xyz": "xyz", "running": "run", "run": "run"}
    terms = {1: ["cat", "dog"], 2: ["cow"], 5: ["run", "dog", "cow"]}
    q = fulltext.questions(spark.createDataFrame(asked, "query_id long, text string"))
    assert {k: [r.stem for r in sorted(q.filter(F.col("query_id") == k).collect(), key=lambda r: r.nth)] for k in terms} == terms and q.count() == 6
    found = {(r.query_id, r.id): (r.covers, r.score) for r in fulltext.top_k(spark.createDataFrame(docs, "id long, text string"), q, 100, every=every).collect()}
    want = {}
    for query, own in terms.items():
        for doc, text in docs:
            rows = [(p, stem[w]) for p, w in enumerate((text or "").lower().replace("-", " ").replace(",", "").replace("!", "").split()) if w in stem]
            covers, rank = brute(rows, own, every)
            if covers and doc is not None:
                want[query, doc] = (covers, rank)
    assert found == want


def test_occurrences_meet_questions_without_a_shuffle(spark):
    docs = spark.range(50).select("id", F.lit("a cat and two dogs").alias("text"))
    q = fulltext.questions(spark.createDataFrame([(1, "cat"), (2, "dog")], "query_id long, text string"))
    plan = fulltext.top_k(docs, q, 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "WindowGroupLimit" in physical and fulltext.top_k(docs.filter("false"), q, 3).collect() == []
