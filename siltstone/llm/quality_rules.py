r"""Operator 9: quality rules by distribution divergence, with DataFrame functions only.

For each document two histograms are compared to those of four languages by the Jensen-Shannon
distance (square root of the divergence to base 2, 0 to 1): shares of character classes, and shares
of the language's common words with the rest of the words as one more bin. The nearest language
counts, so no language column is needed. A word distance is taken relative to the language's own
distance to a text without any of its common words (from 0.31 to 0.40), so that 1 means the same for
each. A document whose character distance or word distance to every language is too great is rejected;
shorter ones than the minimum lengths are not judged by that histogram. Thresholds were set on labelled
rows: of those of 100 words or more the good ones lie at 0.72 of the word distance at most, nine in
ten of the bad ones above 0.75. Before that, base rules reject documents of under 50 words and those of which over
half the words stand in three-word windows that recur in the text.

One pass over the rows without any shuffle; work is linear in a text's words, but for one sort.

Defined cases: a null or empty text has no words and fails the base rules; the lines that repeat
are those equal in full to an earlier line of the text; three-word windows are compared by 64-bit
hashes of their words; repeated rows get the same verdict; other columns pass unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import fresh

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A histogram of fewer characters or words is not judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.75

SPACES = r"\x20\x09-\x0D"
#: Character classes as RE2 and Java both read them; what is in none of them is a letter.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "punctuation": r"[.,;:!?'\"()-]"}

# Shares of characters by class, and of the commonest words, in running prose.
CHAR_REFERENCE = {
    "en": {"upper": 0.025, "digit": 0.005, "symbol": 0.001, "punctuation": 0.025, "space": 0.165},
    "fr": {"upper": 0.025, "digit": 0.005, "symbol": 0.001, "punctuation": 0.030, "space": 0.160},
    "de": {"upper": 0.050, "digit": 0.005, "symbol": 0.001, "punctuation": 0.025, "space": 0.145},
    "es": {"upper": 0.025, "digit": 0.005, "symbol": 0.001, "punctuation": 0.025, "space": 0.165},
}
WORD_REFERENCE = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.020, "is": 0.011, "that": 0.010, "for": 0.009, "it": 0.009, "was": 0.009, "on": 0.007},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.023, "et": 0.021, "les": 0.019, "des": 0.016, "en": 0.014, "un": 0.011, "du": 0.010, "une": 0.009, "que": 0.008, "dans": 0.008},
    "de": {"der": 0.032, "die": 0.031, "und": 0.027, "in": 0.017, "den": 0.012, "von": 0.010, "zu": 0.009, "das": 0.009, "mit": 0.008, "des": 0.007, "ist": 0.007, "nicht": 0.006},
    "es": {"de": 0.060, "la": 0.038, "que": 0.030, "el": 0.028, "en": 0.025, "y": 0.024, "a": 0.020, "los": 0.015, "del": 0.011, "se": 0.011, "las": 0.010, "un": 0.009},
}
_BINS = ("upper", "digit", "symbol", "punctuation", "space", "letter")
#: A letter of its own for each common word, as it stands in the string of a document's common words.
COMMON = {word: chr(ord("A") + k) for k, word in enumerate(sorted({w for words in WORD_REFERENCE.values() for w in words}))}


def char_reference(lang: str) -> list[float]:
    known = [CHAR_REFERENCE[lang][b] for b in _BINS[:-1]]
    return [*known, 1 - sum(known)]


def word_reference(lang: str) -> list[float]:
    known = list(WORD_REFERENCE[lang].values())
    return [*known, 1 - sum(known)]


def without_common_words(lang: str) -> float:
    """The distance of a text without any common word to the language's reference."""
    reference = word_reference(lang)
    rest = reference[-1]
    divergence = sum(reference[:-1]) + math.log2(2 / (1 + rest)) + rest * math.log2(2 * rest / (1 + rest))
    return math.sqrt(divergence / 2)


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts, over its total, to a reference."""

    def term(count: Column, q: Column) -> Column:
        p = count / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    parts = F.zip_with(counts, F.array(*[F.lit(float(q)) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(df: DataFrame, *, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the rules' columns, and their names in it by what they hold (they may differ where df has such names).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
    held = ("text", "size", "words", "lines", "windows", "marks", "classes", "common", "wordcounts")
    new = fresh(df, *(f"__{x}" for x in held), *names)
    at = dict(zip((*held, *names), new))
    c = {k: F.col(v) for k, v in at.items()}
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda what: F.length(F.regexp_replace(c["marks"], f"[^{what[1:]}+", "")).cast("long")

    out = df.withColumn(at["text"], body)
    out = out.withColumns(
        {
            at["size"]: F.length(c["text"]).cast("long"),
            at["words"]: F.array_remove(F.split(c["text"], f"[{SPACES}]+"), ""),
            at["lines"]: F.filter(F.split(c["text"], "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
            at["marks"]: F.regexp_replace(c["text"], f"[^{SPACES}{''.join(x[1:-1] for x in CLASSES.values())}]+", ""),
        }
    )
    out = out.withColumn(at["classes"], F.array(*[count(CLASSES[b]) if b in CLASSES else count(f"[{SPACES}]") for b in _BINS[:-1]]))
    third = lambda i: F.xxhash64(c["words"][i], c["words"][i + 1], c["words"][i + 2])
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(c["words"]) - 3), lambda i: F.struct(third(i).alias("h"), i.alias("i"))))
    # the common words of a document as a string of letters, in which they are then counted
    forms = {**COMMON, **{w.capitalize(): letter for w, letter in COMMON.items()}}
    letters = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    short = F.array_join(F.transform(F.filter(c["words"], lambda w: w.isin(*forms)), lambda w: letters[w]), "")
    size = c["size"]  # a column of its own: length() of a text reads all of it each time
    out = out.withColumns(
        {
            at["windows"]: F.when(F.size(c["words"]) >= 3, windows),
            at["common"]: short,
            at["n_words"]: F.size(c["words"]).cast("long"),
            at["word_chars"]: size - c["classes"][4],
            at["n_symbols"]: c["classes"][2],
            at["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        }
    )
    w = c["windows"]  # sorted by hash: equal windows are neighbours
    words_of_both = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2))
    pairs = F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w) - 1), words_of_both), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(pairs)))
    bins = F.concat(c["classes"], F.array(size - F.aggregate(c["classes"], F.lit(0).cast("long"), lambda a, x: a + x)))
    tally = {word: (F.length(c["common"]) - F.length(F.replace(c["common"], F.lit(letter)))).cast("long") for word, letter in COMMON.items()}
    out = out.withColumns(
        {
            at["n_repeat_words"]: F.when(c["windows"].isNull(), 0).otherwise(covered).cast("long"),
            at["classes"]: bins,
            at["wordcounts"]: F.struct(*[tally[word].alias(f"w{k}") for k, word in enumerate(COMMON)]),
        }
    )
    place = {word: f"w{k}" for k, word in enumerate(COMMON)}

    def in_language(lang: str) -> Column:
        own = [c["wordcounts"][place[word]] for word in WORD_REFERENCE[lang]]
        counts = F.array(*own, c["n_words"] - sum(own[1:], own[0]))
        return js_distance(counts, c["n_words"], word_reference(lang)) / F.lit(without_common_words(lang))

    out = out.withColumns(
        {
            at["char_distance"]: F.when(size > 0, F.least(*[js_distance(c["classes"], size, char_reference(lang)) for lang in CHAR_REFERENCE])).otherwise(1.0),
            at["word_distance"]: F.when(c["n_words"] > 0, F.least(*[in_language(lang) for lang in WORD_REFERENCE])).otherwise(1.0),
        }
    )
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    far_chars = (size >= MIN_CHARS_JUDGED) & (c["char_distance"] > MAX_CHAR_DISTANCE)
    far_words = (c["n_words"] >= MIN_WORDS_JUDGED) & (c["word_distance"] > MAX_WORD_DISTANCE)
    out = out.withColumn(at["base_failed"], failed)
    out = out.withColumn(at["kept"], ~c["base_failed"] & ~far_chars & ~far_words)
    return out.drop(*[at[x] for x in held]), {x: at[x] for x in names}


def kept_only(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with df's columns.

    The verdict goes through a generator: a plain filter on it would be pushed below the projections
    and there be written out as one expression that computes the shared parts many times over.
    """
    judged, at = judge(df, text=text)
    (verdict,) = fresh(judged, "__verdict")
    return judged.withColumn(verdict, F.explode_outer(F.array(F.col(at["kept"])))).filter(F.col(verdict)).select(df.columns)
