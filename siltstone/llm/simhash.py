"""Operator 7: SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints within `distance` d <= 3 bits differ in
at most d bytes, so they share at least 8 - d >= 5 of the eight: the guaranteed minimum of the count
filter. Five shared bytes put three or more into one half (positions 0-3 or 4-7), so postings are
made for the eight (half, three positions) combinations. Within a posting list, pairs' shared
positional bytes are tallied, pairs below the minimum are dropped, and the rest are verified by
their differing bits.

Equal fingerprints are one posting, whatever the number of documents. A list of over SMALL
fingerprints is dealt out once more by two of its remaining five positions (a pair that reaches the
minimum shares two of those as well); what is then still long is searched by flipping up to d of the
24 bits that are left, not by comparing all pairs. Lists give spanning links of their connected
fingerprints instead of all links, so a group of near copies costs a number of links that is linear
in its size. Components come from large-star/small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond") over links only, with every step written to the shared folder.

Defined cases: a null or empty text has no words and fingerprint zero, and links like any other;
fewer words than the shingle's are one shingle; a very long text is read in slices; repeated rows count as documents with one
fingerprint; a null document id gets its component's smallest id (null if it has none); other
columns pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import cuts, drop_table, fresh, materialize, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Posting lists of up to this many fingerprints are compared pair by pair.
SMALL = 512
#: A node with over FEW rows, and over 1 / HOT of all rows, meets its smallest neighbour by broadcast: fewer than HOT nodes have so many.
FEW, HOT = 64, 512
_HALVES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Unsigned 64-bit hashes of the text's shingles, in slices: the last words of one begin the next."""
    data, digest, carry, some = (text or "").encode(), xxhash.xxh64_intdigest, [], False
    for lo, hi in cuts(np.frombuffer(data, np.uint8)):
        words = carry + data[lo:hi].lower().split()  # bytes: lower() is A-Z only, split() is at \x20 and \x09-\x0D
        carry = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        if len(words) < shingle:
            continue
        some = True
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        yield np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    if carry and not some:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def simhash(parts: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts: a bit is 1 if it is set in over half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for a in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True) if n else 0


def fingerprints(df: DataFrame, *, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """df with `out`, the fingerprint's 64 bits as a signed bigint."""

    @arrow_udf("bigint")
    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([simhash(shingle_hashes(x.as_py(), shingle)) for x in batch], pa.int64())

    return df.withColumn(out, mark(F.col(text)))


# ---- links within one posting list -------------------------------------------------------------


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b, each node's smallest connected node."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of a 64-bit difference's bytes are zero: the tally of shared positional bytes."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def pair_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct values that reach the minimum of shared bytes and are within the distance."""
    a, b = [], []
    for i in range(0, len(values) - 1, 256):
        block = values[i : i + 256, None] ^ values[None, i:]
        rows, cols = np.nonzero((_shared_bytes(block) >= 8 - distance) & (np.bitwise_count(block) <= distance))
        keep = rows < cols
        a.append(rows[keep] + i)
        b.append(cols[keep] + i)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def flip_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same links for sorted distinct values, found by flipping up to `distance` of the bits in which they differ at all.

    Links are chained: of a value's found partners all are given, in blocks of flips, without all pairs.
    """
    differ = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [1 << k for k in range(64) if differ >> k & 1]
    masks = np.array([sum(c) for n in range(1, distance + 1) for c in combinations(bits, n)], np.uint64)
    label = np.arange(len(values))
    for mask in masks:
        want = values ^ mask
        at = np.minimum(np.searchsorted(values, want), len(values) - 1)
        hit = np.flatnonzero((values[at] == want) & (at > np.arange(len(values))))
        if len(hit):
            label = _forest(len(values), np.concatenate([np.arange(len(values)), hit]), np.concatenate([label, at[hit]]))
    own = np.flatnonzero(label != np.arange(len(values)))
    return own, label[own]


def list_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (greater, smaller) of the connected values of one posting list."""
    values = np.unique(values)
    if len(values) <= 4 * SMALL:
        label = _forest(len(values), *pair_links(values, distance))
        own = np.flatnonzero(label != np.arange(len(values)))
        low = label[own]
    else:
        own, low = flip_links(values, distance)
    return values[own], values[low]


def _positional(fp, positions) -> object:
    """The given positional bytes of a fingerprint as one number."""
    out = F.lit(0).cast("long")
    for p in positions:
        out = out * 256 + F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255)
    return out


def _list_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (combination, value): each run is a posting list."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(combo, value, fp):
        first = np.flatnonzero(np.concatenate([[True], (combo[1:] != combo[:-1]) | (value[1:] != value[:-1])]))
        u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for a, b in zip(first, np.append(first[1:], len(fp))):
            if b - a > 1:
                x, y = list_links(fp[a:b].view(np.uint64), distance)
                u.append(x)
                v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], ["u", "v"])

    for batch in batches:
        now = tuple(batch.column(k).to_numpy() for k in range(3))
        if not len(now[0]):
            continue
        held.append(now)
        if held[0][0][0] == now[0][-1] and held[0][1][0] == now[1][-1]:
            continue  # one list so far
        rows = tuple(np.concatenate(c) for c in zip(*held))
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1
        held = [tuple(c[last:] for c in rows)]
        yield links(*(c[:last] for c in rows))
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held)))


def near_links(prints: DataFrame, *, distance: int = DISTANCE, small: int = SMALL) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints (column fp) within the distance, directly or through one another."""
    if not 0 <= distance <= 3:
        raise ValueError("the minimum of shared bytes is guaranteed for distances of 0 to 3 bits")
    fp = F.col("fp")
    combos = F.array(*[F.struct(F.lit(k).alias("combo"), _positional(fp, c).alias("value")) for k, c in enumerate(_HALVES)])
    postings = prints.select("fp", F.inline(combos)).repartition("combo", "value")
    sizes = materialize(postings.groupBy("combo", "value").count().filter("count > 1"))
    listed = postings.join(sizes, ["combo", "value"])
    # a long list's fingerprints are dealt out by two more positions each
    deeper = []
    for k, c in enumerate(_HALVES):
        rest = [p for p in range(8) if p not in c]
        for j, two in enumerate(combinations(rest, 2)):
            deeper.append(F.struct(F.lit(100 + 10 * k + j).alias("combo"), (F.col("value") * 65536 + _positional(fp, two)).alias("value")))
    own = F.array(F.struct(F.col("combo"), F.col("value")))
    parts = F.when(F.col("count") <= small, own).otherwise(F.slice(F.array(*deeper), F.col("combo") * 10 + 1, F.lit(10)))
    dealt = listed.select("fp", F.inline(parts)).select("combo", "value", "fp").repartition("combo", "value").sortWithinPartitions("combo", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _list_batches(batches, distance)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """The n rows (u, v) with m, the smallest of u and its v.

    Minima are combined before their shuffle. The rows of a hub don't go to one task: hubs, fewer
    than HOT by the count above which they are ones, are broadcast, and only the rest is dealt by u.
    """
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
    hub = F.col("size") > max(FEW, n // HOT)
    met = rows.join(F.broadcast(least.filter(hub).select("u", "m")), "u", "left")
    rest = met.filter("m IS NULL").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return met.filter("m IS NOT NULL").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: the smallest node that it is connected with."""
    links, path = written(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda: links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        # large star: each node's greater neighbours move to its smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = written(_with_least(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        drop_table(links.sparkSession, path)
        # small star: a node and its smaller neighbours move to the smallest of these
        small = _with_least(large, before[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, path = written(small.filter("u != v").distinct())
        drop_table(links.sparkSession, large_path)
        now = state()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, keep_text: bool = True, fingerprint: str = "fingerprint", component: str = "component_id", first: str = "is_first") -> DataFrame:
    """df (without the text, if so asked) with each row's fingerprint (signed bigint), its component, and whether it is the component's first row.

    A component's id is the smallest document id that links lead to; its first row is that of the
    least id (nulls before any), and of rows with one id, one. Names that df has get underscores.
    """
    fingerprint, component, first, row = fresh(df, fingerprint, component, first, "__row")
    marked = fingerprints(df, text=text, out=fingerprint, shingle=shingle).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked if keep_text else marked.drop(text))
    narrow = marked.select(F.col(fingerprint).alias("fp"), F.col(row).alias("row"), F.col(doc_id).alias("id"))
    prints = materialize(narrow.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "row")).alias("winner")))
    roots = components(near_links(prints.select("fp"), distance=distance))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").withColumn("parent", F.coalesce("root", "fp")).drop("node", "root")
    per_root = rooted.groupBy("parent").agg(F.min("least").alias("component"), F.min("winner").alias("winner"))
    named = rooted.select("fp", "parent").join(per_root, "parent").select("fp", "component", F.col("winner.row").alias("winner"))
    # documents of one fingerprint, however many, meet its component as rows of numbers; texts are dealt by their row
    told = narrow.select("fp", "row").join(named, "fp").select(F.col("row").alias("__told"), F.col("component").alias("__component"), (F.col("row") == F.col("winner")).alias("__first"))
    told = told.toDF(*fresh(marked, "__told", "__component", "__first"))
    key, own, is_first = told.columns
    return marked.join(told, F.col(row) == F.col(key)).withColumnsRenamed({own: component, is_first: first}).drop(key, row)
