"""Shared helpers: fresh column names, durable intermediate tables, flat text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read or hashed at a time: what a buffer's masks, running sums and powers take is bounded by it.
HASH_BYTES = 1 << 20
#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until it clashes with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siltstone.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("siltstone.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and the path: lineage ends there and any executor may be lost."""
    path = f"{shared_dir(df.sparkSession)}/siltstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return written(df)[0]


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) array end to end, and n + 1 offsets into them; a null is empty."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if pa.types.is_dictionary(text.type):
        text = text.dictionary_decode()
    text = text.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = text.buffers()
    n = len(text)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, text.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(text: pa.Array, most: int = 1 << 20):
    """(start, stop) row ranges whose texts together hold about `most` bytes; a longer single text stands alone."""
    _, offsets = flat(text)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of non-space bytes, and each one's row."""
    n, z = len(data), np.zeros(0, np.int64)
    begins, stops = [z], [z]
    for lo in range(0, n, HASH_BYTES):
        hi = min(lo + HASH_BYTES, n)
        word = np.zeros(hi - lo + 2, bool)  # with a byte of each neighbour
        word[1:-1] = ~SPACE[data[lo:hi]]
        word[0], word[-1] = lo > 0 and not SPACE[data[lo - 1]], hi < n and not SPACE[data[hi]]
        begins.append(np.flatnonzero(word[1:-1] & ~word[:-2]) + lo)
        stops.append(np.flatnonzero(word[1:-1] & ~word[2:]) + lo + 1)
    edge = np.unique(offsets[1:-1])
    edge = edge[(edge > 0) & (edge < n)]
    edge = edge[~SPACE[data[edge]] & ~SPACE[data[edge - 1]]]  # one text's last word ends and the next one's first begins
    starts, ends = (np.sort(np.concatenate([*x, edge])) if len(edge) else np.concatenate(x) for x in (begins, stops))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        out[0] = 1
        have = _POWERS[kind] = np.cumprod(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial sum of each span, counted from its own start; from one running sum over all of data."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data) + 1)[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * _powers("down", len(data) + 1)[starts]


def _long_sum(data: np.ndarray) -> np.uint64:
    """The same for one span of any length, piece by piece."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    up = _powers("up", HASH_BYTES + 1)
    for lo in range(0, len(data), HASH_BYTES):
        piece = data[lo : lo + HASH_BYTES]
        total += shift * ((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)]).sum(dtype=np.uint64)
        shift *= up[HASH_BYTES : HASH_BYTES + 1]
    return total[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of byte spans, HASH_BYTES of the buffer at a time."""
    if len(starts) > 1 and (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return span_hashes(data, starts[order], ends[order])[back]
    out = np.zeros(len(starts), np.uint64)
    lo, reach = 0, np.maximum.accumulate(ends) if len(ends) else ends
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(reach, first + HASH_BYTES, "right")))
        if int(ends[lo]) - first > HASH_BYTES:
            hi, out[lo] = lo + 1, _long_sum(data[first : int(ends[lo])])
        else:
            out[lo:hi] = _sums(data[first : int(reach[hi - 1])], starts[lo:hi] - first, ends[lo:hi] - first)
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def cuts(data: np.ndarray, most: int = HASH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end behind white space, so that no word is cut; a longer word stays whole."""
    start, n = 0, len(data)
    while start < n:
        stop, back = min(start + most, n), 0
        if stop < n:
            tail = np.flatnonzero(SPACE[data[start:stop]])
            back = len(tail)
            stop = start + int(tail[-1]) + 1 if back else stop
        while not back and stop < n:  # a word of over `most` bytes: up to the next white space
            ahead = np.flatnonzero(SPACE[data[stop : stop + most]])
            back = len(ahead)
            stop = stop + int(ahead[0]) + 1 if back else min(stop + most, n)
        yield start, stop
        start = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the number of words of each; in slices, so that a word's own eight bytes are all that grows with a text."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    most = HASH_BYTES
    groups = [(0, 0)]
    while groups[-1][1] < len(counts):  # texts of `most` bytes together, or one longer text
        first = groups[-1][1]
        groups.append((first, max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)))
    for a, b in groups[1:]:
        own = data[offsets[a] : offsets[b]]
        for lo, hi in cuts(own, most) if b == a + 1 else [(0, len(own))]:
            low = lowered(own[lo:hi])
            starts, ends, row = words_of(low, offsets[a : b + 1] - offsets[a] if b > a + 1 else np.array([0, hi - lo]))
            out.append(span_hashes(low, starts, ends))
            counts[a:b] += np.bincount(row, minlength=b - a)
    return np.concatenate(out), counts


def give_back() -> None:
    """Return the memory that Arrow holds for later use: the executor's workers stay when their tasks have ended."""
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves `rest` modulo `mod`; a null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
