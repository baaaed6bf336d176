"""Operator 8: exact top-k by inner product with vector-approximation files (Weber et al., VLDB 1998).

File. Rows are dealt once into slices by their number. A slice's approximation file holds, for each
row, the cell of each component on a grid of CELLS equal cells per dimension (a byte each, an eighth of
the vector), and the grid; it is written beside the exact vectors to the shared folder, as columns of
one table, so that a scan of cells reads no vector.

Scan. A query and a cell bound the score from both sides, as the cell's corners bound each product.
Queries in blocks meet slices of cells, and nothing else; both sides of a group are of bounded size.
A row goes on if its upper bound reaches the query's k-th greatest lower bound, first within the
slice, then over all slices.

Reading. Only then are exact vectors read: each slice's candidates in the order of their upper bounds,
until no unread one's bound reaches the k-th best exact score (equal bounds are read, as ties go by
id). Slices' results are merged to each query's k best.

Defined cases: null vectors, vectors with a null or non-finite component, empty vectors and null ids
take no part; vectors of another length than the query's are no candidates for it; repeated ids are
candidates each, but one query only (of equal ids, the least vector); a query's own id is never its
candidate; ties go to the smaller id; an empty table gives no rows; other columns take no part.
A component beyond the range of a long counts as the nearest long. Scores are exact at any size
(where 64 bits might not do, they are computed in whole numbers of any length); one beyond the range
of a long is given as the nearest long, and ties of such go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._common import materialize, shuffle_parts

K, CELLS = 5, 64
#: Rows of a slice (fewer, but LEAST_ROWS or more, where tasks would be idle) and queries of a block.
SLICE_ROWS, LEAST_ROWS, BLOCK_ROWS = 1 << 16, 1 << 11, 1 << 12
#: Bounds of so many rows and queries are held at a time.
TILE = 1 << 22
FILE = "dim int, slice int, row bigint, vec_id bigint, cell binary, grid array<bigint>, vector array<bigint>"
BOUNDS = "dim int, slice int, query_id bigint, row bigint, lower double, upper double"
RESULT = "query_id bigint, vec_id bigint, score bigint"
_WIDE = float(1 << 62)


def quantized(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector array<bigint>): floor(scale * x) of every component of the vectors that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    far = float(1 << 63)
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(far)), F.lit(-far))))
    return df.filter(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vector"))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, -1)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; in whole numbers of any length where 64 bits might not do."""
    if (np.abs(vectors.astype(np.float64)).max(axis=0, initial=0) @ np.abs(query.astype(np.float64))) < _WIDE:
        return vectors @ query
    return vectors.astype(object) @ query.astype(object)


class Approximation:
    """The cells of a slice of integer vectors: a byte for each component, and each dimension's least value and cell width."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        span = high.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, right for any two longs
        self.low, self.width = low, (span // np.uint64(cells) + np.uint64(1)).astype(np.int64)
        self.cell = ((vectors.astype(np.uint64) - low.astype(np.uint64)) // self.width.astype(np.uint64)).astype(np.uint8)


def bounds(cell: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of the cells' low corners by row and query, what to add for the lower and for the upper bound of each query).

    In doubles: what rounding can change is added to the bounds.
    """
    low, width, q = low.astype(np.float64), width.astype(np.float64), queries.astype(np.float64)
    base = (low + cell * width) @ q.T
    spread = (width - 1)[None, :] * q
    slack = (np.abs(low) + 256 * width) @ np.abs(q).T * 2.0**-44
    return base, np.minimum(spread, 0).sum(axis=1) - slack, np.maximum(spread, 0).sum(axis=1) + slack


def scan(ids: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place, rows, lower bounds, upper bounds) of what may be among each query's k best of the slice."""
    step = max(1, TILE // max(len(ids), 1))
    for lo in range(0, len(queries), step):
        base, fall, lift = bounds(cell, low, width, queries[lo : lo + step])
        for j in range(base.shape[1]):
            free = np.flatnonzero(ids != query_ids[lo + j])
            own = base[free, j]
            if len(own) > k:
                certain = np.partition(own, len(own) - k)[len(own) - k] + fall[j]
                maybe = own + lift[j] >= certain
                free, own = free[maybe], own[maybe]
            yield lo + j, free, own + fall[j], own + lift[j]


def read_in_order(ids: np.ndarray, vectors: np.ndarray, upper: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """The k best (id, score) of a query's candidates in a slice, read by falling upper bounds until the k-th is certain."""
    order = np.argsort(-upper, kind="stable")
    found, scores, step = np.zeros(0, np.int64), [], max(4 * k, 64)
    for lo in range(0, len(order), step):
        if len(scores) >= k and upper[order[lo]] < float(scores[k - 1]):
            break
        rows = order[lo : lo + step]
        scores = [*scores, *exact(vectors[rows], query).tolist()]
        found = np.append(found, ids[rows])
        best = sorted(range(len(scores)), key=lambda i: (-scores[i], found[i]))[:k]
        found, scores = found[best], [scores[i] for i in best]
    return found, scores


def approximation_file(vectors: DataFrame, slices: int) -> DataFrame:
    """FILE of vectors (vec_id, vector): a row for each vector, and for each slice one (row -1) with its grid."""
    # repeated ids are spread over the slices as well: by a number of the row, not by its id
    numbered = vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))

    def build(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        n, matrix = data.num_rows, _matrix(data.column("vector"), data.num_rows)
        files = Approximation(matrix)
        none = pa.nulls(1, pa.list_(pa.int64()))
        row = lambda first, rest: pa.concat_arrays([first, rest])
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "slice": pa.array([key[1].as_py()] * (n + 1), pa.int32()),
                "row": row(pa.array([-1]), data.column("row").combine_chunks()),
                "vec_id": row(pa.nulls(1, pa.int64()), data.column("vec_id").combine_chunks()),
                "cell": row(pa.nulls(1, pa.binary()), pa.array([x.tobytes() for x in files.cell], pa.binary())),
                "grid": row(pa.array([np.append(files.low, files.width)], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))),
                "vector": row(none, data.column("vector").combine_chunks().cast(pa.list_(pa.int64()))),
            }
        )

    return numbered.withColumn("dim", F.size("vector")).groupBy("dim", "slice").applyInArrow(build, FILE)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors; both sides: (vec_id, vector array<bigint>)."""
    rows, asked = vectors.count(), queries.count()
    slices, blocks = max(1, math.ceil(rows / SLICE_ROWS), min(shuffle_parts(vectors.sparkSession), rows // LEAST_ROWS)), max(1, math.ceil(asked / BLOCK_ROWS))
    file = materialize(approximation_file(vectors, slices))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    blocked = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("slice", spread(slices))

    def bound(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        at = data.column("slice")[0].as_py() if data.num_rows else 0
        dim = data.column("dim")[0].as_py() if data.num_rows else 0
        if data.num_rows and asked.num_rows:
            head = np.asarray(data.column("row")) < 0
            grid = data.filter(pa.array(head)).column("grid")[0].values.to_numpy()
            own = data.filter(pa.array(~head))
            cell = np.frombuffer(b"".join(own.column("cell").to_pylist()), np.uint8).reshape(own.num_rows, dim)
            row, query_ids = own.column("row").to_numpy(), asked.column("vec_id").to_numpy()
            for j, free, lower, upper in scan(own.column("vec_id").to_numpy(), cell, grid[:dim], grid[dim:], query_ids, _matrix(asked.column("vector"), asked.num_rows), k):
                out.append((np.full(len(free), query_ids[j]), row[free], lower, upper))
        query, row, lower, upper = map(np.concatenate, zip(*out))
        return pa.table({"dim": pa.array(np.full(len(row), dim, np.int32)), "slice": pa.array(np.full(len(row), at, np.int32)), "query_id": query, "row": row, "lower": lower, "upper": upper})

    def read(data: pa.Table, maybe: pa.Table) -> pa.Table:
        query, vec, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if data.num_rows and maybe.num_rows:
            row = data.column("row").to_numpy()
            order = np.argsort(row)
            maybe = maybe.sort_by("query_id")
            matrix, ids = _matrix(data.column("vector"), data.num_rows), data.column("vec_id").to_numpy()
            asked, want, upper = (maybe.column(c).to_numpy() for c in ("query_id", "row", "upper"))
            first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
            for a, b in zip(first, np.append(first[1:], len(asked))):
                at = order[np.searchsorted(row[order], want[a:b])]
                found, scores = read_in_order(ids[at], matrix[at], upper[a:b], maybe.column("vector")[int(a)].values.to_numpy(), k)
                query.append(np.full(len(found), asked[a]))
                vec.append(found)
                score += [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        return pa.table({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": pa.array(score, pa.int64())})

    cells = file.select("dim", "slice", "row", "vec_id", "cell", "grid", spread(blocks).alias("block"))
    key = ["dim", "slice", "block"]
    found = cells.groupBy(*key).cogroup(blocked.groupBy(*key)).applyInArrow(bound, BOUNDS)
    by_query = Window.partitionBy("query_id")
    nth = F.row_number().over(by_query.orderBy(F.desc("lower")))
    kth = F.max(F.when(F.col("nth") == k, F.col("lower"))).over(by_query)
    maybe = found.withColumn("nth", nth).withColumn("kth", kth).filter("kth IS NULL OR upper >= kth").select("dim", "slice", "query_id", "row", "upper")
    maybe = maybe.join(wanted.select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    exactly = file.filter("row >= 0").select("dim", "slice", "row", "vec_id", "vector").groupBy("dim", "slice").cogroup(maybe.groupBy("dim", "slice")).applyInArrow(read, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exactly.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
