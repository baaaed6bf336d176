"""What a parser's pieces of text become before they are chunked: normalised blocks of bounded size, within a document's budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.functions import text as tx

#: Characters of a block and of a document, and the least table.
BLOCK_CHARS, DOCUMENT_CHARS, TABLE_ROWS, TABLE_COLUMNS = 200_000, 120_000_000, 2, 2
TOO_COMPLEX = "too_complex"


def is_table(rows: Column, columns: Column, least_rows: int = TABLE_ROWS, least_columns: int = TABLE_COLUMNS) -> Column:
    """Whether a grid is large enough to be kept as a table; smaller ones are prose, and lose no text by it."""
    return F.coalesce((rows >= least_rows) & (columns >= least_columns), F.lit(False))


def parts(text: str, most: int = BLOCK_CHARS) -> list[str]:
    """The text in runs of whole lines, as many as fit in `most` with their line ends; a longer line is cut hard. Blank parts go.

    Each part is a stretch of the text, so its end is the last line end in reach: one search backwards a part.
    """
    if len(text) <= most:
        return [text]
    found, at = [], 0
    while at < len(text):
        end = text.rfind("\n", at, at + most)
        if len(text) - at < most:  # the last line needs room for an end too
            stop = resume = len(text)
        elif end >= 0:
            stop, resume = end, end + 1
        elif at + most >= len(text) or text[at + most] == "\n":
            stop, resume = at + most, at + most + 1
        else:
            stop = resume = at + most
        found.append(text[at:stop])
        at = resume
    return [p for p in found if p.strip()]


def _split(text: Column, most: int) -> Column:
    @arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([parts(x.as_py(), most) for x in batch], pa.list_(pa.string()))

    return split(text)


def emit(pieces: DataFrame, *, key: str = "id", most_block: int = BLOCK_CHARS, most_document: int = DOCUMENT_CHARS) -> DataFrame:
    """(key, block_order, text, header, error) of pieces (key, piece_order, text, headed): normalised, blank ones left out, long ones split at lines.

    headed: a piece's first line labels those below; each later part of it begins with that line, and is longer
    by it. A document with more than most_document normalised characters gives one row with an error and no
    blocks. Budget and block numbers share one shuffle, by document.
    """
    clean = pieces.select(key, "piece_order", F.coalesce("headed", F.lit(False)).alias("headed"), tx.normalized(F.col("text")).alias("text"))
    own = Window.partitionBy(key)
    known = clean.withColumns({"__all": F.sum(F.length("text")).over(own), "__place": F.row_number().over(own.orderBy("piece_order"))})
    refused = F.col("__all") > most_document
    # blank pieces go behind the windows, as a filter before them would normalise twice; of a refused document one piece stays, without its text
    kept = known.filter(F.when(refused, F.col("__place") == 1).otherwise(F.col("text") != "")).select(key, "piece_order", refused.alias("__refused"), F.when(F.col("headed") & ~refused, F.substring_index("text", "\n", 1)).otherwise("").alias("header"), F.when(~refused, F.col("text")).otherwise("").alias("text"))
    cut = kept.select(key, "piece_order", "__refused", "header", F.posexplode(_split(F.col("text"), most_block)).alias("__part", "text"))
    whole = F.when((F.col("header") != "") & (F.col("__part") > 0), F.concat("header", F.lit("\n"), "text")).otherwise(F.col("text"))
    number = F.row_number().over(own.orderBy("piece_order", "__part")) - 1
    of = lambda c: F.when(~F.col("__refused"), c)
    return cut.select(key, of(number).alias("block_order"), of(whole).alias("text"), of(F.col("header")).alias("header"), F.when(F.col("__refused"), TOO_COMPLEX).alias("error"))
