r"""How far an answer's claims are covered by its citation marks, block by block.

A claim is a sentence of four words or more outside fenced code; lines are sentences of their own, and
signs after an initial, an abbreviation or a token with a stop inside end none. A mark covers
the claims of its block (blank lines part blocks) that begin before it; one with none before it in its
block covers the nearest earlier claim; the first mark of an answer, where nothing stands before it in
its block and no claim before that, covers the first claim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.citations import segments

# Abbreviations that end in a stop without ending a sentence.
ABBREVIATIONS = "al approx cf dr eg esp etc fig ie inc jr ltd mr mrs ms no prof sr st vs".split()
#: Stand-ins within a text that is being judged: a mark, a stop that ends nothing, the end of a sentence.
MARK, STOP, END = "\u0001", "\u0002", "\u0003"
# The start of a code fence, leading signs of a line, and a word.
FENCE, DECORATION, WORD = r"^\s*(```|~~~)", r"^([>#*+\-•]+[ \t]*|[0-9]+[.)][ \t]+)+", r"[0-9A-Za-z][0-9A-Za-z'’-]*"
#: A letter alone, an abbreviation or letters with stops between, and the signs behind it, whichever they are and however many.
_TOKEN = r"(^\.*|[^A-Za-z.]\.*)([A-Za-z]|(?i:" + "|".join(ABBREVIATIONS) + r")|[A-Za-z]+(?:\.+[A-Za-z]+)+)[.!?]+"


def marked(answer: Column, sources: Column) -> Column:
    """The answer with MARK in place of each citation that names a source, and without the others."""
    return F.array_join(F.transform(segments(answer, sources), lambda s: F.when(s["id"].isNotNull(), MARK).otherwise(s["text"])), "")


def sentences(line: Column) -> Column:
    """The sentences of a line, marks included where they stand."""
    kept = line
    for _ in range(2):  # neighbouring tokens share the sign between them
        kept = F.regexp_replace(kept, _TOKEN, f"$1$2{STOP}")
    parted = F.regexp_replace(kept, f"([.!?]+[\"')\\]]*{MARK}*)(\\s+|$)", f"$1{END}")
    return F.filter(F.split(parted, END), lambda s: F.trim(s) != "")


def claims(text: Column, least: int = 4) -> Column:
    """array<struct<block, claim, mark>> in order: a row for each claim, and one for each mark (after the claim in which it stands)."""
    bare = lambda s: F.replace(s, F.lit(MARK), F.lit(""))
    # blocks, and whether a line is code
    row = "array<struct<line:string,block:int,code:boolean>>"
    start = F.struct(F.array().cast(row).alias("done"), F.lit(0).alias("block"), F.lit(False).alias("blank"), F.lit(False).alias("code"))

    def step(state: Column, line: Column) -> Column:
        empty, fence = F.trim(bare(line)) == "", bare(line).rlike(FENCE)
        block = state["block"] + F.when(state["blank"] & ~empty, 1).otherwise(0)
        code = F.when(fence, ~state["code"]).otherwise(state["code"])
        now = F.struct(line.alias("line"), block.alias("block"), (state["code"] | fence).alias("code"))
        return F.struct(F.concat(state["done"], F.array(now)).alias("done"), block.alias("block"), empty.alias("blank"), code.alias("code"))

    lines = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, lambda s: s["done"])
    item = lambda block, claim, mark, prose: F.struct(block.alias("block"), claim.alias("claim"), mark.alias("mark"), prose.alias("prose"))
    yes, no = F.lit(True), F.lit(False)

    def items(x: Column) -> Column:
        def of(s: Column) -> Column:
            body = F.trim(bare(s))
            # marks before the first letter of a sentence stand before its claim
            before = F.length(F.regexp_extract(s, f"^[\\s{MARK}]*", 0)) - F.length(F.replace(F.regexp_extract(s, f"^[\\s{MARK}]*", 0), F.lit(MARK), F.lit("")))
            all_marks = F.length(s) - F.length(bare(s))
            words = F.regexp_count(F.regexp_replace(body, DECORATION, ""), F.lit(WORD))
            claim = ~x["code"] & (words >= least)
            mark = F.array(item(x["block"], no, yes, no))
            return F.concat(F.array_repeat(mark[0], before), F.when(body != "", F.array(item(x["block"], claim, no, yes))).otherwise(F.slice(mark, 1, 0)), F.array_repeat(mark[0], all_marks - before))

        return F.flatten(F.transform(F.when(x["code"], F.array(x["line"])).otherwise(sentences(x["line"])), of))

    return F.flatten(F.transform(lines, items))


def assess(text: Column, least: int = 4) -> Column:
    """struct<claims, supported, citations, score, reason> of an answer whose marks are MARK."""
    found = claims(text, least)
    # own: claims of the block; open: those of them without a mark yet; covered: the last claim has one;
    # prose: something stands in the block; first: a mark before everything waits for the first claim
    kind = "struct<claims:int,supported:int,citations:int,block:int,own:int,open:int,covered:boolean,prose:boolean,first:boolean>"
    start = F.expr(f"cast(named_struct('claims', 0, 'supported', 0, 'citations', 0, 'block', -1, 'own', 0, 'open', 0, 'covered', false, 'prose', false, 'first', false) as {kind})")

    def step(a: Column, x: Column) -> Column:
        new = x["block"] != a["block"]
        own, opened, prose = F.when(new, 0).otherwise(a["own"]), F.when(new, 0).otherwise(a["open"]), ~new & a["prose"]
        nearest = (own == 0) & (a["claims"] > 0)
        gained = F.when(x["mark"], F.when(own > 0, opened).when(nearest & ~a["covered"], 1).otherwise(0)).when(x["claim"] & a["first"], 1).otherwise(0)
        one = lambda hit: F.when(hit, 1).otherwise(0)
        return F.struct(
            (a["claims"] + one(x["claim"])).alias("claims"),
            (a["supported"] + gained).alias("supported"),
            (a["citations"] + one(x["mark"])).alias("citations"),
            x["block"].alias("block"),
            (own + one(x["claim"])).alias("own"),
            F.when(x["mark"], 0).otherwise(opened + one(x["claim"] & ~a["first"])).alias("open"),
            F.when(x["mark"], a["covered"] | (a["claims"] > 0)).when(x["claim"], a["first"]).otherwise(a["covered"]).alias("covered"),
            (prose | x["prose"]).alias("prose"),
            F.when(x["claim"], F.lit(False)).otherwise(a["first"] | (x["mark"] & (a["claims"] == 0) & ~prose)).alias("first"),
        )

    def close(a: Column) -> Column:
        score = F.when(a["claims"] > 0, a["supported"] / a["claims"]).when(a["citations"] > 0, 1.0).otherwise(0.0)
        reason = F.when(a["citations"] == 0, "no_citations").when(a["claims"] == 0, "no_claims").when(a["supported"] < a["claims"], "partial_coverage")
        return F.struct(a["claims"].alias("claims"), a["supported"].alias("supported"), a["citations"].alias("citations"), score.alias("score"), reason.alias("reason"))

    return F.aggregate(found, start, step, close)
