"""English lexemes: the Snowball "English" (Porter2) stemmer and stop words, as expressions.

A stemmer step maps a word to a word. Each is one CASE expression in the SQL that Spark and DuckDB
share, so words are stemmed in the JVM, and the same text serves as the oracle. What stands before a
suffix tells the regions: the suffix is in R1 if that part has a vowel followed by a consonant, in R2 if it
has two such.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Snowball project's English stop words, exceptions, and suffixes of each step.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
UNCHANGED_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
SPECIAL_R1 = "gener commun arsen".split()
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()

_V, _C = "[aeiouy]", "[^aeiouy]"
_SPECIAL = f"({'|'.join(SPECIAL_R1)})"
_SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _r1(part: str) -> str:
    return f"CASE WHEN regexp_like(w, '^{_SPECIAL}') THEN regexp_like({part}, '^{_SPECIAL}') ELSE regexp_like({part}, '{_V}{_C}') END"


def _r2(part: str) -> str:
    return f"CASE WHEN regexp_like(w, '^{_SPECIAL}') THEN regexp_like({part}, '^{_SPECIAL}.*{_V}{_C}') ELSE regexp_like({part}, '{_V}{_C}.*{_V}{_C}') END"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _suffixes(table: dict[str, str], region) -> str:
    """WHEN branches for the suffixes, longest first: replaced if in the region, else the word stays."""
    return " ".join(f"WHEN endswith(w, '{s}') THEN CASE WHEN {region(_cut(len(s)))} THEN concat({_cut(len(s))}, '{r}') ELSE w END" for s, r in sorted(table.items(), key=lambda x: (-len(x[0]), x[0])))


def _in(words) -> str:
    return f"w IN ({', '.join(repr(x) for x in words)})"


def _ed(suffix: str) -> str:
    """What step 1b leaves of a word with ed, edly, ing or ingly."""
    n = len(suffix)
    rest = _cut(n)
    ends = " OR ".join(f"endswith({rest}, '{x}')" for x in ("at", "bl", "iz"))
    double = f"regexp_like({rest}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')"
    short = f"regexp_like({rest}, '{_SHORT}') AND NOT regexp_like({rest}, '{_V}{_C}.')"
    return f"WHEN endswith(w, '{suffix}') THEN CASE WHEN NOT regexp_like({rest}, '{_V}') THEN w WHEN {ends} THEN concat({rest}, 'e') WHEN {double} THEN {_cut(n + 1)} WHEN {short} THEN concat({rest}, 'e') ELSE {rest} END"


_DONE = "left(w, 1) = '='"  # a word that no further step changes is marked until the end
STEPS = [
    f"CASE WHEN length(w) <= 2 OR {_in(UNCHANGED)} THEN concat('=', w) {' '.join(f'WHEN w = {a!r} THEN {chr(39)}={b}{chr(39)}' for a, b in EXCEPTIONS.items())} ELSE regexp_replace(w, '^y', 'Y') END",
    # y after a vowel is a consonant; twice, as matches don't overlap
    "regexp_replace(regexp_replace(w, '([aeiou])y', '{1}Y', 'g'), '([aeiou])y', '{1}Y', 'g')",
    f"CASE WHEN {_DONE} THEN w WHEN endswith(w, 'sses') THEN {_cut(2)} WHEN endswith(w, 'ied') OR endswith(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
    f"WHEN endswith(w, 'us') OR endswith(w, 'ss') THEN w WHEN endswith(w, 's') AND regexp_like({_cut(2)}, '{_V}') THEN {_cut(1)} ELSE w END",
    f"CASE WHEN {_DONE} THEN w WHEN {_in(UNCHANGED_AFTER_1A)} THEN concat('=', w) WHEN endswith(w, 'eedly') THEN CASE WHEN {_r1(_cut(5))} THEN {_cut(3)} ELSE w END {_ed('ingly')} {_ed('edly')} "
    f"WHEN endswith(w, 'eed') THEN CASE WHEN {_r1(_cut(3))} THEN {_cut(1)} ELSE w END {_ed('ing')} {_ed('ed')} ELSE w END",
    f"CASE WHEN {_DONE} THEN w WHEN regexp_like(w, '.{_C}[yY]$') THEN concat({_cut(1)}, 'i') ELSE w END",
    f"CASE WHEN {_DONE} THEN w {_suffixes(STEP_2, _r1)} WHEN endswith(w, 'ogi') THEN CASE WHEN endswith(w, 'logi') AND {_r1(_cut(3))} THEN {_cut(1)} ELSE w END "
    f"WHEN endswith(w, 'li') THEN CASE WHEN regexp_like(w, '[cdeghkmnrt]li$') AND {_r1(_cut(2))} THEN {_cut(2)} ELSE w END ELSE w END",
    f"CASE WHEN {_DONE} THEN w {_suffixes(STEP_3, _r1)} WHEN endswith(w, 'ative') THEN CASE WHEN {_r1(_cut(5))} AND {_r2(_cut(5))} THEN {_cut(5)} ELSE w END ELSE w END",
    f"CASE WHEN {_DONE} THEN w {_suffixes({s: '' for s in STEP_4}, _r2)} WHEN endswith(w, 'ion') THEN CASE WHEN regexp_like(w, '[st]ion$') AND {_r2(_cut(3))} THEN {_cut(3)} ELSE w END ELSE w END",
    f"CASE WHEN {_DONE} THEN w WHEN endswith(w, 'e') AND ({_r2(_cut(1))} OR ({_r1(_cut(1))} AND NOT regexp_like({_cut(1)}, '{_SHORT}'))) THEN {_cut(1)} WHEN endswith(w, 'll') AND {_r2(_cut(1))} THEN {_cut(1)} ELSE w END",
    "lower(regexp_replace(w, '^=', ''))",
]
#: Words are runs of letters and digits; hyphenated ones and addresses are their parts.
WORD = r"[\p{L}\p{N}]+"


def _spark(step: str) -> str:
    return step.replace("{1}", "$1").replace(", 'g')", ")").replace("\\", "\\\\")


def stems_sql(words: str) -> str:
    """An array of lower-case words as their stems, in DuckDB."""
    for step in STEPS:
        words = f"list_transform({words}, lambda w: {step.replace('regexp_like', 'regexp_matches').replace('{1}', chr(92) + '1').replace('endswith(', 'ends_with(')})"
    return words


def stems(words: str) -> Column:
    """The array column `words` of lower-case words as their stems."""
    out = words
    for step in STEPS:
        out = f"transform({out}, w -> {_spark(step)})"
    return F.expr(out)


def words_of(text: Column) -> Column:
    """The lower-case words of a text, in order; a null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"
