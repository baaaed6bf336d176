"""Operator 13: vectors as codes of one byte a part, with Exponion search (Newling and Fleuret, "Fast k-means with accurate bounds", ICML 2016).

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts. Each part
position has a codebook, which begins as that part of the `entries` smallest ids, and moves for some
rounds: all parts go to their nearest entry, then each entry to the floor of its parts' mean.

Search. A part starts at the entry that it had before, at a squared distance d. A nearer entry, or one
as near, is at most twice that distance from the starting entry, so only the starting entry's
neighbours within that radius are scanned, in order of their distance from it; the radius shrinks to
the sum of both distances as nearer entries are found. Distances are whole numbers and exact, and of
equal ones the lower index counts.

At scale. A round is one narrow pass: tasks read vectors and codes, and write vectors, new codes and
their own sums of each entry's parts (a row for each entry and task) into one table of the shared
folder. The sums are read from their own columns, so the vectors aren't read twice, and added up by
Spark; codebooks (entries x vector length numbers, whatever the input) go to the driver and back.
No vector is ever shuffled.

Defined cases: null vectors, vectors with a null or non-finite component, empty ones and those whose
length isn't a multiple of the number of parts take no part, and neither do vectors of another length
than that of the smallest id's; null ids come after all others in the order of ids, and equal ids in
the order of their vectors; each of repeated rows counts; with fewer vectors than entries there are
fewer entries; an empty table gives no rows and empty codebooks. Only the id, the vector and the kept
columns are read, so other columns' names can't clash. A component beyond the range of a long counts
as the nearest long; distances are exact at any size, and errors beyond the range of a long are given
as the greatest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import drop_table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors searched at a time, and neighbours scanned at a time.
ROWS, STEP = 1 << 15, 32
_MOST = (1 << 63) - 1
#: Up to this, sums of squares are exact in doubles, and with an index beside them in longs.
_EXACT = float(1 << 52)


class Codebook:
    """A part position's entries, and each one's neighbours by distance."""

    def __init__(self, entries: list[list[int]]):
        self.whole = np.array(entries, dtype=object).reshape(len(entries), -1)
        self.most = float(max((abs(x) for row in entries for x in row), default=0))
        self.fits = self._exact(self.most)
        self.entries = self.whole.astype(np.float64 if self.fits else object)
        self.square = (self.entries * self.entries).sum(axis=1)
        apart = self.square[:, None] + self.square[None, :] - 2 * (self.entries @ self.entries.T)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.gap = np.take_along_axis(apart, self.near, axis=1)

    def _exact(self, most: float) -> bool:
        return 4 * max(self.whole.shape[1], 1) * (most + 1) ** 2 < _EXACT / ENTRIES

    def search(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry and squared distance, from its starting entry on."""
        most = float(np.abs(parts.astype(np.float64)).max(initial=0))
        if self.fits and not self._exact(most):
            return Wide(self.whole.tolist()).search(parts, start)
        x = parts.astype(self.entries.dtype)
        square = (x * x).sum(axis=1)
        key_type = np.int64 if self.fits else object
        first = square + self.square[start] - 2 * (x * self.entries[start]).sum(axis=1)
        key = first.astype(key_type) * len(self.entries) + start  # by distance, then by index
        order = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[order], np.arange(len(self.entries) + 1))
        for a in np.flatnonzero(edges[1:] > edges[:-1]):
            rows = order[edges[a] : edges[a + 1]]
            reach = np.searchsorted(self.gap[a], 4 * first[rows], "right")
            for lo in range(0, len(self.entries), STEP):
                more = reach > lo
                if not more.any():
                    break
                rows, reach = rows[more], reach[more]
                near = self.near[a, lo : lo + min(STEP, int(reach.max()) - lo)]
                found = square[rows][:, None] + self.square[near][None, :] - 2 * (x[rows] @ self.entries[near].T)
                key[rows] = np.minimum(key[rows], (found.astype(key_type) * len(self.entries) + near).min(axis=1))
                # whatever is as near as the best so far is at most both distances from the starting entry
                best, far = (key[rows] // len(self.entries)).astype(np.float64), first[rows].astype(np.float64)
                radius = (far + best + 2 * np.sqrt(far * best)) * (1 + 1e-9) + 1
                reach = np.minimum(reach, np.searchsorted(self.gap[a].astype(np.float64) * (1 - 1e-9), radius, "right"))
        return (key % len(self.entries)).astype(np.int64), key // len(self.entries)


class Wide(Codebook):
    """The same in whole numbers of any length."""

    def _exact(self, most: float) -> bool:
        return False


@dataclass(frozen=True)
class Codes:
    """codes: (vec_id, kept, code, error); codebooks: by part, entry and position."""

    codes: DataFrame
    codebooks: list[list[list[int]]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches' rows, about ROWS at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _cut(data: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors by row, part and position, and the codes by row and part."""
    vectors = data.column("vector").combine_chunks().flatten().to_numpy().reshape(data.num_rows, parts, -1)
    return vectors, np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(data.num_rows, parts)


def _assigned(data: pa.Table, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, list]:
    vectors, before = _cut(data, len(books))
    code, errors = np.zeros(before.shape, np.uint8), []
    for j, book in enumerate(books):
        code[:, j], error = book.search(vectors[:, j], before[:, j].astype(np.int64))
        errors.append(error)
    return vectors, code, errors


def _binary(code: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in code], pa.binary())


def _totals(sums: dict[tuple[int, int], list], vectors: np.ndarray, code: np.ndarray) -> None:
    """Add each entry's number of parts and their sums."""
    small = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * len(vectors) < _EXACT
    for j in range(code.shape[1]):
        order = np.argsort(code[:, j], kind="stable")
        used, first = np.unique(code[order, j], return_index=True)
        own = vectors[order, j]
        added = np.add.reduceat(own if small else own.astype(object), first, axis=0)
        for entry, n, total in zip(used.tolist(), np.diff(np.append(first, len(order))).tolist(), added.tolist()):
            had = sums.get((j, entry))
            sums[j, entry] = [n, total] if had is None else [had[0] + n, [a + b for a, b in zip(had[1], total)]]


def compress(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors of df; the columns of `keep` come along in the struct `kept`."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is a byte: entries must be from 1 to 256")
    v, far = F.col(vector), float(1 << 63)
    number = lambda x: x.cast("double")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * number(x), F.lit(far)), F.lit(-far))))
    usable = df.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~bad)
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows, path = written(usable.select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("kept"), whole.alias("vector"), F.lit(bytes(parts)).alias("code")))
    by_id = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    result = T.StructType([rows.schema["vec_id"], rows.schema["kept"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    least = rows.orderBy(*by_id).limit(1).select(F.size("vector")).first()
    if least is None:
        return Codes(rows.sparkSession.createDataFrame([], result), [[] for _ in range(parts)])
    width = least[0] // parts
    rows = rows.filter(F.size("vector") == least[0])
    start = [r[0] for r in rows.orderBy(*by_id).limit(entries).select("vector").collect()]  # at most `entries` rows
    books = [[x[j * width : (j + 1) * width] for x in start] for j in range(parts)]
    moved = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DecimalType(38, 0)))])
    ids, kinds = pa.int64(), pa.list_(pa.decimal128(38, 0))

    def move(books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, sums, like = [Codebook(b) for b in books], {}, None
            for data in _chunks(batches):
                vectors, code, _ = _assigned(data, search)
                _totals(sums, vectors, code)
                like, n = data.schema, data.num_rows
                out = [data.column("vec_id"), data.column("kept"), data.column("vector"), _binary(code), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, ids), pa.nulls(n, kinds)]
                yield from pa.table(out, moved.names).combine_chunks().to_batches()
            if sums:
                keys, n = list(sums), len(sums)
                numbers = [pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)]
                total = pa.array([sums[k][1] for k in keys], pa.list_(pa.decimal128(38, 0)))
                out = [pa.nulls(n, like.field(c).type) for c in ("vec_id", "kept", "vector")] + [pa.nulls(n, pa.binary()), *numbers, pa.array([sums[k][0] for k in keys], ids), total]
                yield pa.record_batch(out, moved.names)

        return run

    for _ in range(rounds):
        (table, now), before = written(rows.mapInArrow(move(books), moved)), path
        drop_table(table.sparkSession, before)
        path, rows = now, table.filter("part IS NULL").select("vec_id", "kept", "vector", "code")
        sums = table.filter("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        for r in sums.collect():  # at most parts x entries rows
            books[r.part][r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for data in _chunks(batches):
            _, code, errors = _assigned(data, search)
            error = [min(sum(x), _MOST) for x in zip(*[e.tolist() for e in errors])]
            yield from pa.table([data.column("vec_id"), data.column("kept"), _binary(code), pa.array(error, ids)], result.names).combine_chunks().to_batches()

    codes = written(rows.mapInArrow(finish, result))[0]
    drop_table(rows.sparkSession, path)
    return Codes(codes, books)


def decompress(codes: DataFrame, codebooks: list[list[list[int]]], *, out: str = "vector") -> DataFrame:
    """codes with `out`, the entries that a row's code names, end to end (the codebooks are bounded, and travel as a literal)."""
    book = F.lit(codebooks) if codebooks and codebooks[0] else F.array()
    entry = lambda j: F.conv(F.hex(F.substring("code", j + 1, 1)), 16, 10).cast("int")
    return codes.withColumn(out, F.flatten(F.array(*[book[j][entry(j)] for j in range(len(codebooks))])))
