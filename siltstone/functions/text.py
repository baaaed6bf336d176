"""Text functions that are DataFrame expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


# Characters that show nothing (soft hyphen, zero widths, byte order mark), and spaces other than U+0020.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"


#: Rows and bytes of the slices in which a batch's texts are Python's.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def in_form(texts: pa.Array, form: str) -> pa.Array:
    """Each text in a Unicode form, a null as empty. Slices are gone through one by one, ASCII ones as they are, so no more than a slice's texts are Python's at a time."""
    if len(texts) > 1 and (len(texts) > SLICE_ROWS or texts.nbytes > SLICE_BYTES):
        half = len(texts) // 2
        return pa.concat_arrays([in_form(texts.slice(0, half), form), in_form(texts.slice(half), form)])
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return pc.fill_null(texts, "").cast(pa.string())
    return pa.array([unicodedata.normalize(form, x.as_py() or "") for x in texts], pa.string())


def formed(text: Column, form: str) -> Column:
    """A text in a Unicode form, which has no built-in."""

    @arrow_udf("string")
    def formed_texts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield in_form(batch, form)
            pa.default_memory_pool().release_unused()  # workers stay when their tasks have ended

    return formed_texts(text)


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC)."""
    return formed(text, "NFC")


def normalized(text: Column) -> Column:
    """Line ends made one newline, control and invisible characters dropped, odd spaces made plain, NFC, no white space at line ends, at most one blank line, none outside."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    clean = F.regexp_replace(clean, f"[\\x00-\\x08\\x0B-\\x1F\\x7F{INVISIBLE}]", "")
    clean = composed(F.regexp_replace(clean, f"[{SPACES}]", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n")
    return F.regexp_replace(clean, r"^[ \t\n]+|[ \t\n]+$", "")


def is_blank(text: Column) -> Column:
    """Nothing but white space, or null; the search ends at the first other character."""
    return F.coalesce(~F.regexp_like(text, F.lit(r"\S")), F.lit(True))


def or_query(text: Column) -> Column:
    """A search that any word satisfies: no leading minus signs, no quotation marks around words."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, '^[-"]+|"+$', ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " OR ")


def row_text(cells: Column) -> Column:
    """Cells as `a | b`, white space within them collapsed."""
    return F.array_join(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), " | ")


def history_tail(text: Column, most: int = 600) -> Column:
    """The last characters of a turn, marked where its start is cut; null if blank."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(body != "", F.when(F.length(body) > most, F.concat(F.lit("[…]"), F.right(body, F.lit(most)))).otherwise(body))


def budget_percent(used: Column, window: int = 10_400) -> Column:
    """Share of the context window in percent, to one place, 100 at most."""
    return F.least(F.bround(100 * used / F.lit(float(window)), 1), F.lit(100.0))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "good").when(score >= 0.8, "warn").otherwise("bad")
