"""Operator 4: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are whole: a long one is cut only where no pre-token can cross (a letter or digit before a
space or a sign), so the ids are those of one call over the whole text. Decoding returns raw bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null id list decodes to
no bytes; rows repeat as they come; other columns pass unchanged, and a new one whose name is taken
gets underscores; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import fresh

#: Texts of more characters than this are cut at safe boundaries before encoding.
LONG_TEXT = 1 << 16
#: Ids are decoded in runs of this many.
LONG_IDS = 1 << 16
#: A place after a letter or digit and before a space, a line end or a sign other than an apostrophe: no match of the pattern crosses it.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\p{M}'])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: The safe places before a space alone.
SAFE_SPACE = regex.compile(r"(?<=[\p{L}\p{N}])(?= )")


def safe_pieces(text: str, most: int = LONG_TEXT, at: regex.Pattern = SAFE) -> Iterator[str]:
    """text in pieces of about `most` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > most and (cut := at.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The text's ids; Python numbers exist for one piece at a time only."""
    if not text:
        return np.zeros(0, np.int32)
    pieces = safe_pieces(text) if len(text) > LONG_TEXT else (text,)
    return np.concatenate([np.array(enc.encode_ordinary(piece), np.int32) for piece in pieces])


def int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """array<int> of the rows, from one flat buffer."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(df: DataFrame, rank_file: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """df with `out`, the token ids of `text` (array<int>)."""

    @arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in texts:
            yield int_lists([encode_text(enc, x.as_py()) for x in batch])

    return df.withColumn(*fresh(df, out), ids(F.col(text)))


def decode(df: DataFrame, rank_file: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`, the raw bytes that the ids stand for (binary)."""

    @arrow_udf("binary")
    def raw(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in lists:
            rows = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else () for x in batch)
            yield pa.array([b"".join(enc.decode_bytes(x[k : k + LONG_IDS].tolist()) for k in range(0, len(x), LONG_IDS)) for x in rows], pa.binary())

    return df.withColumn(*fresh(df, out), raw(F.col(ids)))
