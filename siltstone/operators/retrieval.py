"""Dense and lexical ranking, reciprocal rank fusion, neighbour de-duplication, ordered lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, and rows and bytes of a slice that meets it.
QUERY_BLOCK, SLICE_ROWS, SLICE_BYTES = 1024, 512, 1 << 22


def top_by(df: DataFrame, key: str, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank; partial limits apply before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= n)


def unit(vector: Column) -> Column:
    """The vector in doubles at length 1; all zeros where its length is 0.

    The vector and its length are named values, so each is found once for a row and not once for a number.
    """
    once = lambda c, f: F.transform(F.array(c), f)[0]
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda v, norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
    return once(F.transform(vector, lambda x: x.cast("double")), lambda v: once(length(v), lambda norm: scaled(v, norm)))


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows, halved while over SLICE_BYTES; a single longer row is one."""
    if batch.num_rows > 1 and (batch.num_rows > SLICE_ROWS or batch.nbytes > SLICE_BYTES):
        half = batch.num_rows // 2
        yield from _slices(batch.slice(0, half))
        yield from _slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _by_blocks(rows: DataFrame, queries: DataFrame, prepare: Callable[[pa.RecordBatch], tuple], search: Callable[..., pa.RecordBatch], schema: str, on: str | None = None) -> DataFrame:
    """search(slice of rows, *prepare(block of queries)) of every slice and every block, in one plan: no job runs for it beforehand.

    Queries (query_id and one more column) are dealt to blocks of some QUERY_BLOCK by their ids' hashes; rows
    aren't shuffled. Blocks and slices are one row each, so that Spark chooses by their size how they meet:
    small queries are broadcast, beyond the broadcast's threshold partitions meet in pairs. on: a column of
    whole numbers that both sides have; only rows and queries of the same number meet.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [None] if on is None else batch.column(on).unique().to_pylist()
            for number in numbers:
                own = batch if on is None else batch.filter(pc.equal(batch.column(on), number)).drop_columns([on])
                for part in _slices(own):
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([_bytes(part)], pa.binary()), **({} if on is None else {"__on": pa.array([number], pa.int64())})})

    def gather(block: pa.Table) -> pa.Table:
        number = None if on is None else block.column(on)[0].as_py()
        block = block.drop_columns(["__block", *filter(None, [on])]).combine_chunks()
        return pa.table({"block": pa.array([_bytes(block.to_batches()[0])], pa.binary()), **({} if on is None else {"__on": pa.array([number], pa.int64())})})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, ()
        for batch in batches:
            for part, block in zip(batch.column("slice"), batch.column("block")):
                if last is None or not last.equals(block):
                    last, ready = block, prepare(_batch(block))
                yield search(_batch(part), *ready)

    blocks = queries.agg(F.greatest(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK), F.lit(1)).alias("__blocks"))  # one row
    dealt = queries.join(F.broadcast(blocks)).withColumn("__block", F.pmod(F.xxhash64("query_id"), "__blocks")).drop("__blocks")
    if on is None:
        met = rows.mapInArrow(pack, "slice binary").crossJoin(dealt.groupBy("__block").applyInArrow(gather, "block binary"))
    else:
        met = rows.mapInArrow(pack, "slice binary, __on bigint").join(dealt.groupBy(on, "__block").applyInArrow(gather, "block binary, __on bigint"), "__on").select("slice", "block")
    return met.mapInArrow(run, schema)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        place = np.flatnonzero(score >= least)
    else:
        place = np.arange(len(score))
    return place[np.lexsort((ids[place], -score[place]))][:k]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k ids of greatest cosine similarity to each query, rounded to 6; ties by id.

    vectors: (id, vector), queries: (query_id, vector). Each Arrow batch of vectors is multiplied with a
    block of queries at once and gives its own k best of each query; only these are shuffled.
    """

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def prepare(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return block.column("query_id").to_numpy(zero_copy_only=False), matrix(block.column("vector"), block.num_rows).T

    def search(rows: pa.RecordBatch, asked: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        ids = rows.column("id").to_numpy(zero_copy_only=False)
        score = np.round(matrix(rows.column("vector"), len(ids)) @ q, 6)
        places = [_best(score[:, j], ids, k) for j in range(len(asked))]
        of, at = np.repeat(np.arange(len(asked)), [len(p) for p in places]), np.concatenate(places)
        return pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(ids[at]), pa.array(score[at, of])], ["query_id", "id", "score"])

    known = vectors.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select("query_id", "vector").filter("query_id IS NOT NULL AND vector IS NOT NULL")
    return top_by(_by_blocks(known, asked, prepare, search, "query_id bigint, id bigint, score double"), "query_id", [F.desc("score"), "id"], k)


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def count_top_k(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k documents (id, terms) with most occurrences of a query's terms (query_id, terms: distinct ones); ties by id.

    A batch of documents meets a block of queries: the terms asked for are counted by document, and the
    counts are multiplied with the queries' terms. Only each batch's k best of a query are shuffled, so
    neither the documents' terms nor the documents that hold a common term are.
    """

    def prepare(block: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        asked, lists = block.column("query_id").to_numpy(zero_copy_only=False), block.column("terms")
        known = lists.flatten().unique()
        wanted = np.zeros((len(known), len(asked)), np.float32)
        wanted[pc.index_in(lists.flatten(), known).to_numpy(), np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))] = 1
        return asked, known, wanted

    def search(rows: pa.RecordBatch, asked: np.ndarray, known: pa.Array, wanted: np.ndarray) -> pa.RecordBatch:
        ids, own, n = rows.column("id").to_numpy(zero_copy_only=False), rows.column("terms"), rows.num_rows
        place = pc.index_in(own.flatten(), known)
        of = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))[np.asarray(place.is_valid())]
        cell = of * len(known) + place.drop_null().to_numpy()
        score = np.bincount(cell, minlength=n * len(known)).reshape(n, -1).astype(np.float32) @ wanted
        places = [p[score[p, j] > 0] for j in range(len(asked)) for p in (_best(score[:, j], ids, k),)]
        q, at = np.repeat(np.arange(len(asked)), [len(p) for p in places]), np.concatenate(places)
        return pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[at]), pa.array(score[at, q].astype(np.int64))], ["query_id", "id", "score"])

    own, wanted = docs.select("id", "terms").filter("id IS NOT NULL AND size(terms) > 0"), asked.select("query_id", "terms").filter("query_id IS NOT NULL AND size(terms) > 0")
    return top_by(_by_blocks(own, wanted, prepare, search, "query_id bigint, id bigint, score bigint"), "query_id", [F.desc("score"), "id"], k)


def lexical_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k documents with most occurrences of a query's distinct terms; ties by id."""
    own = docs.select("id", terms(F.col("text")).alias("terms"))
    return count_top_k(own, queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms")), k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, top: int = 30) -> DataFrame:
    """Reciprocal rank fusion of two ranked arms (query_id, id, rank): the sum of 1 / (k + rank); ties by id."""
    if k <= 0:
        raise ValueError("k must be positive")
    arm = lambda df, name: df.groupBy("query_id", "id").agg(F.min("rank").alias(name))
    both = arm(dense, "dense_rank").join(arm(sparse, "sparse_rank"), ["query_id", "id"], "full_outer")
    share = lambda name: F.coalesce(1.0 / (F.lit(k) + F.col(name)), F.lit(0.0))
    return top_by(both.withColumn("score", F.round(share("dense_rank") + share("sparse_rank"), 9)), "query_id", [F.desc("score"), "id"], top)


def merge_probes(ranked: DataFrame, k: int = 60, top: int = 50) -> DataFrame:
    """Fusion over a question's probes (question_id, probe, id, rank): the sum of 1 / (k + rank), the best rank, the number of probes; ties by id."""
    best = ranked.groupBy("question_id", "probe", "id").agg(F.min("rank").alias("rank"))
    merged = best.groupBy("question_id", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("probes"))
    return top_by(merged, "question_id", [F.desc("score"), "id"], top)


def rerank_by_overlap(candidates: DataFrame, docs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, position, overlap, rank): candidates by the share of the query's distinct terms that they hold, then by position.

    Only candidates' texts are read for it: they are few to a query, and meet their terms by id.
    """
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("asked"))
    words = docs.join(candidates.select("id").distinct(), "id", "left_semi").select("id", F.array_distinct(terms(F.col("text"))).alias("words"))
    both = candidates.select("query_id", "id", F.col("rank").alias("position")).join(words, "id").join(asked, "query_id")
    overlap = F.round(F.size(F.array_intersect("asked", "words")) / F.size("asked"), 6)
    return top_by(both.select("query_id", "id", "position", overlap.alias("overlap")), "query_id", [F.desc("overlap"), "position"], n)


def drop_neighbours(hits: DataFrame) -> DataFrame:
    """Greedy, in rank order: a hit goes if a kept one is the chunk before or after it in the same block.

    hits: (query_id, rank, document_id, block_order, block_chunk_index); a list is a query's hits, tens at most.
    """
    row = F.struct("rank", "document_id", "block_order", "block_chunk_index")
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("hits"))
    near = lambda a, b: (a["document_id"] == b["document_id"]) & (a["block_order"] == b["block_order"]) & (F.abs(a["block_chunk_index"] - b["block_chunk_index"]) == 1)
    step = lambda kept, x: F.when(F.exists(kept, lambda y: F.coalesce(near(x, y), F.lit(False))), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), step)
    return ranked.select("query_id", F.inline(kept))


def fetch_in_order(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of docs by (query_id, ids array), with their place in the request; missing ones are left out."""
    asked = ids.select("query_id", F.posexplode("ids").alias("place", "id"))
    return asked.join(docs, "id")


def hybrid(chunks: DataFrame, queries: DataFrame, *, arm: int = 50, top: int = 30) -> DataFrame:
    """(query_id, id, dense_rank, sparse_rank, score, rank): both arms' best fused, without neighbours of a better hit, the first `top`.

    chunks: what the reader may see (id, text, vector or null, document_id, block_order, block_chunk_index);
    queries: (query_id, text, vector). From the fusion on, a query has at most 2 * arm rows.
    """
    dense = dense_top_k(chunks, queries.filter("vector IS NOT NULL"), arm)
    fused = fuse(dense, lexical_top_k(chunks, queries, arm), top=2 * arm).withColumnRenamed("rank", "fused")
    place = chunks.select("id", "document_id", "block_order", "block_chunk_index")
    hits = fused.join(place, "id").select("query_id", F.col("fused").alias("rank"), "document_id", "block_order", "block_chunk_index")
    kept = drop_neighbours(hits).select("query_id", F.col("rank").alias("fused"))
    return top_by(fused.join(kept, ["query_id", "fused"], "left_semi"), "query_id", ["fused"], top).drop("fused")
