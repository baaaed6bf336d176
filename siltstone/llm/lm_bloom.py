"""Operator 6: language-model scoring with a log-frequency Bloom filter (Talbot and Osborne).

Counting. Each task hashes its words to 64 bits, counts words and word pairs of the training rows,
and emits them packed: for each range of the hash space one blob of sorted hashes and counts. One
shuffle brings the blobs of a range together, where they are added up. The work and the volume grow
with the corpus; nothing is sampled.

Filter. A count c is quantised to level 1 + floor(log c / log BASE). An n-gram of level q is put into
the filter q times, as (n-gram, 1) to (n-gram, q), so its level is read back by probing level by
level until the first miss. Every n-gram is in it, those seen once at level 1. A range of the hash space
is a segment of the filter, built in the task that holds the range, with BITS_PER_KEY bits for each
key at every size of the corpus. The filter is never in one place and nothing of it is broadcast.

Probes. The texts to score are cut into blocks of about BLOCK_TOKENS tokens. A block asks each segment
once for those of its words and pairs that fall there, however often they occur; the asks go to the
segments in one shuffle, and the levels and the words' exact counts come back to the block in another.

Scores. P(w | v) = (1 - s) min(c(v, w) / c(v), 1) + s (c(w) + 1) / (N + V + 1), with counts from the
filter and s the share of pairs seen once (Good and Turing's mass of the unseen). The base score has
the exact counts of words.

Words are identified by 64-bit hashes and pairs by 48 bits of theirs; with 10^8 distinct words the
chance that any two of them collide is below 3 in 10,000.

Defined cases: a null or empty text is the end token alone; repeated rows count and are scored as
often as they come; a null id is learned from (it isn't held out); without training rows N = V = 0
and all words are unknown; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import by_bytes, flat, fresh, materialize, mix, shuffle_parts, word_hashes

BASE, BITS_PER_KEY, PROBES = 1.5, 10, 7
#: Words counted in a task before its blobs are emitted.
FLUSH_WORDS = 1 << 21
#: Tokens of the texts whose probes go out together, and bits of a block's number in its partition.
BLOCK_TOKENS, BLOCK_BITS = 1 << 20, 36
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
WORD, PAIR, ASK = 0, 1, 2
_LEVEL_SALT = np.uint64(0xA0761D6478BD642F)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, an end token after each text's, and n + 1 offsets."""
    data, offsets = flat(text)
    hashes, counts = word_hashes(data, offsets)
    n = len(offsets) - 1
    out_offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(out_offsets[-1]), END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), counts)] = hashes
    return out, out_offsets


def pairs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it, of which the low 16 bits are clear."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[offsets[:-1]] = START
    return mix(words + mix(before)) & ~np.uint64(0xFFFF)


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(data: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _open(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes and their counts: byte planes of differences, compressed."""
    return _squeeze(_planes(np.diff(hashes, prepend=np.uint64(0))) + _planes(counts.astype("<u8")))


def unpack(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = _open(blob, 16 * n)
    return np.cumsum(_unplanes(planes[: 8 * n], "<u8"), dtype=np.uint64), _unplanes(planes[8 * n :], "<u8").astype(np.int64)


def _add_up(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def count_ngrams(df: DataFrame, segments: int, *, text: str = "text") -> DataFrame:
    """(kind, segment, n, total, once, blob): a segment's words or pairs with their counts, and how many were seen once."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blobs():
            rows = []
            for kind, parts in enumerate(zip(*held)):
                grams, counts = _add_up(np.concatenate(parts))
                bounds = np.searchsorted(segment_of(grams, segments), np.arange(segments + 1, dtype=np.uint64))
                rows += [(kind, k, int(b - a), pack(grams[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["kind", "segment", "n", "blob"])

        for batch in batches:
            for a, b in by_bytes(batch.column(0)):
                words, offsets = tokens(batch.column(0).slice(a, b - a))
                held.append((words, pairs(words, offsets)))
                if sum(len(x[0]) for x in held) >= FLUSH_WORDS:
                    yield blobs()
        yield blobs()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            grams, counts = _add_up(*map(np.concatenate, zip(*held)))
            total, once = int(counts.sum()), int((counts == 1).sum())
            row = (key[0], key[1], len(grams), total, once, pack(grams, counts) if len(grams) else b"")
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["kind", "segment", "n", "total", "once", "blob"])

        for batch in batches:
            for kind, segment, n, blob in zip(*(batch.column(k) for k in range(4))):
                now = (kind.as_py(), segment.as_py())
                if now != key and held:
                    yield out()
                key = now
                held.append(unpack(n.as_py(), blob.as_py()))
        if held:
            yield out()

    emitted = df.select(text).mapInArrow(count, "kind int, segment int, n bigint, blob binary")
    dealt = emitted.repartition("kind", "segment").sortWithinPartitions("kind", "segment")
    return dealt.mapInArrow(add, "kind int, segment int, n bigint, total bigint, once bigint, blob binary")


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range; 0 for level 0."""
    return np.where(level > 0, np.maximum(BASE ** (level - 0.5), 1.0), 0.0)


class LogFrequencyFilter:
    """Segments of equal size, one after the other; `probes` bits for each key, all in the n-gram's segment."""

    def __init__(self, bits: np.ndarray, segments: int, segment_bits: int, probes: int):
        self.bits, self.segments, self.segment_bits, self.probes = bits, segments, segment_bits, probes

    @staticmethod
    def positions(keys: np.ndarray, level: np.ndarray | int, probe: int, segment_bits: int) -> np.ndarray:
        salted = mix(keys + np.asarray(level, np.uint64) * _LEVEL_SALT)
        step = (salted >> np.uint64(32)) | np.uint64(1)
        return (salted + np.uint64(probe) * step) % np.uint64(segment_bits)

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, segment_bits: int, probes: int) -> bytes:
        bits = np.zeros(segment_bits, bool)
        top = levels(counts)
        for level in range(1, int(top.max(initial=0)) + 1):
            now = keys[top >= level]
            for probe in range(probes):
                bits[cls.positions(now, level, probe, segment_bits).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: probed level by level until the first miss."""
        out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        base = segment_of(keys, self.segments) * np.uint64(self.segment_bits)
        while len(alive) and level < 256:
            salted = mix(keys[alive] + np.array([level], np.uint64) * _LEVEL_SALT)  # positions(), mixed once for all probes
            step, start = (salted >> np.uint64(32)) | np.uint64(1), base[alive]
            for probe in range(self.probes):
                at = start + (salted + np.uint64(probe) * step) % np.uint64(self.segment_bits)
                hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, salted, step, start = alive[hit], salted[hit], step[hit], start[hit]
            out[alive] = level
            level += 1
        return out


def word_keys(words: np.ndarray) -> np.ndarray:
    """Words' keys in the filter: apart from any pair's, in the same segment of the hash space."""
    return words ^ np.uint64(0x55)


class Model:
    """What scoring needs besides the table: the number of segments, and totals."""

    def __init__(self, segments: int, total: int, types: int, unseen: float):
        self.segments, self.total, self.types, self.unseen = segments, total, types, unseen


def fit(df: DataFrame, *, text: str = "text") -> tuple[Model, DataFrame]:
    """A model of the rows of df, and the table of their n-grams' counts (written to the shared folder)."""
    segments = 4 * shuffle_parts(df.sparkSession)
    table = materialize(count_ngrams(df, segments, text=text))
    sums = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("once").alias("once")).collect()}
    types, total = (sums[WORD]["n"], sums[WORD]["total"]) if sums else (0, 0)
    unseen = min(max(sums[PAIR]["once"] / sums[PAIR]["total"], 0.05), 1.0) if sums else 1.0
    return Model(segments, total, types, unseen), table


def pack_block(words: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block's texts: their lengths in tokens, its distinct words, and each token's place among these."""
    unique, at = np.unique(words, return_inverse=True)
    body = _planes(lengths.astype("<u4")) + _planes(np.diff(unique, prepend=np.uint64(0))) + _planes(at.astype("<u4"))
    return np.array([len(lengths), len(unique), len(at)], "<i8").tobytes() + _squeeze(body)


def unpack_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, each token's place among them, n + 1 offsets of the texts)."""
    n, u, t = np.frombuffer(blob, "<i8", 3).tolist()
    body = _open(blob[24:], 4 * n + 8 * u + 4 * t)
    lengths, gaps, at = _unplanes(body[: 4 * n], "<u4"), _unplanes(body[4 * n : 4 * n + 8 * u], "<u8"), _unplanes(body[4 * n + 8 * u :], "<u4")
    return np.cumsum(gaps, dtype=np.uint64), at.astype(np.int64), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Segment:
    """A range of the hash space: its words' exact counts, and the filter of its words and pairs."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]):
        self.words, self.counts = words
        keys, counts = np.concatenate([word_keys(words[0]), pairs[0]]), np.concatenate([words[1], pairs[1]])
        bits = max(64, -(-BITS_PER_KEY * int(levels(counts).sum()) // 8) * 8)
        self.bloom = LogFrequencyFilter(np.frombuffer(LogFrequencyFilter.segment(keys, counts, bits, PROBES), np.uint8), 1, bits, PROBES)

    def exact(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[place] == words, self.counts[place], 0)


def score_block(model: Model, blob: bytes, counts: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray) -> tuple:
    """(known, base, score) of each text of a block, by the answers for its distinct words and pairs in their order."""
    unique, at, offsets = unpack_block(blob)
    first, words = offsets[:-1], unique[at]
    room = model.total + model.types + 1
    exact = counts[at]
    base = np.add.reduceat(np.log10((exact + 1) / room), first)
    known = np.add.reduceat((exact > 0).astype(np.int64), first)
    approximate = level_count(word_levels)
    alone = (np.minimum(approximate, max(model.total, 1)) + 1) / room
    before = np.empty(len(words), np.float64)
    before[1:] = approximate[at[:-1]]
    before[first] = max(approximate[np.searchsorted(unique, END)], 1.0)  # a text starts as often as one ends
    together = level_count(pair_levels)[np.unique(pairs(words, offsets), return_inverse=True)[1]]
    p = (1 - model.unseen) * np.minimum(together / np.maximum(before, 1.0), 1.0) + model.unseen * alone[at]
    return known, base, np.add.reduceat(np.log10(p), first)


def score(df: DataFrame, model: Model, table: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of df with n_tokens, n_known, train_tokens, base_score and score of each text."""
    segments = model.segments
    source = df.select(*keep, F.col(text).alias(fresh(df, "__text")[0]))
    block, place, n_tokens, payload = fresh(source, "__block", "__place", "__n_tokens", "__payload")
    new = [T.StructField(c, t) for c, t in ((block, T.LongType()), (place, T.IntegerType()), (n_tokens, T.LongType()), (payload, T.BinaryType()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their places in blocks; a block's texts go with its first row."""
        number, held, size = TaskContext.get().partitionId() << BLOCK_BITS, [], 0

        def out():
            blob, done = pack_block(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])), 0
            for rows, _, lengths in held:
                n = len(lengths)
                columns = [pa.array([number] * n, pa.int64()), pa.array(range(done, done + n), pa.int32()), pa.array(lengths, pa.int64()), pa.array([blob if done + k == 0 else None for k in range(n)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], [*rows.schema.names[:-1], block, place, n_tokens, payload])
                done += n
            held.clear()

        for batch in batches:
            for a, b in by_bytes(batch.columns[-1]):
                rows = batch.slice(a, b - a)
                words, offsets = tokens(rows.columns[-1])
                held.append((rows, words, np.diff(offsets)))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield from out()
                    number, size = number + 1, 0
        if held:
            yield from out()

    kept = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]]
    rows = materialize(source.mapInArrow(cut, T.StructType([*kept, *new])))
    blocks = rows.filter(F.col(payload).isNotNull()).select(F.col(block).alias("block"), F.col(payload).alias("blob"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(segments + 1, dtype=np.uint64)
        for batch in batches:
            for number, blob in zip(batch.column(0), batch.column(1)):
                unique, at, offsets = unpack_block(blob.as_py())
                both = [unique, np.unique(pairs(unique[at], offsets))]
                bounds = [np.searchsorted(segment_of(x, segments), edges) for x in both]
                out = []
                for k in range(segments):
                    w, p = (x[b[k] : b[k + 1]] for x, b in zip(both, bounds))
                    if len(w) + len(p):
                        out.append((k, ASK, number.as_py(), len(w), len(p), _squeeze(b"".join(_planes(np.diff(x, prepend=np.uint64(0))) for x in (w, p)))))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["segment", "kind", "block", "n", "m", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A segment's counts come before what is asked of it; a task holds one segment at a time."""
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        now, counts, held = None, {}, None
        def probe(held, asked):
            """The answers to a segment's asks, probed together."""
            if not asked:
                return []
            keys, at = np.unique(np.concatenate([x for _, _, w, p in asked for x in (word_keys(w), p)]), return_inverse=True)
            found, done, rows = held.bloom.level(keys).astype(np.uint8)[at], 0, []
            for number, segment, w, p in asked:
                n, m = len(w), len(p)
                rows.append((number, segment, n, m, _squeeze(_planes(held.exact(w).astype("<u8")) + found[done : done + n + m].tobytes())))
                done += n + m
            return rows

        for batch in batches:
            out, asked, size = [], [], 0
            for segment, kind, number, n, m, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if segment != now:
                    out, asked, size = out + probe(held, asked), [], 0
                    now, counts, held = segment, {}, None
                if kind != ASK:
                    counts[kind] = unpack(n, blob.as_py()) if n else none
                    continue
                if held is None:
                    held, counts = Segment(counts.get(WORD, none), counts.get(PAIR, none)), {}
                body = _open(blob.as_py(), 8 * (n + m))
                w, p = (np.cumsum(_unplanes(x, "<u8"), dtype=np.uint64) for x in (body[: 8 * n], body[8 * n :]))
                asked.append((number, segment, w, p))
                size += n + m
                if size >= FLUSH_WORDS:
                    out, asked, size = out + probe(held, asked), [], 0
            out += probe(held, asked)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["block", "segment", "n", "m", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's texts come first (segment -1), then the answers by segment, which is the order of the hashes."""
        now, texts, found = None, None, []

        def out():
            known, base, score = score_block(model, texts, *map(np.concatenate, zip(*found)))
            n = len(known)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(known), pa.array(base), pa.array(score)], ["b", "p", "known", "base", "score"])

        for batch in batches:
            for number, segment, n, m, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if segment < 0:
                    if texts is not None:
                        yield out()
                    now, texts, found = number, blob.as_py(), []
                    continue
                body = _open(blob.as_py(), 9 * n + m)
                found.append((_unplanes(body[: 8 * n], "<u8").astype(np.int64), body[8 * n : 9 * n].astype(np.int64), body[9 * n :].astype(np.int64)))
        if texts is not None:
            yield out()

    zero = F.lit(0).cast("long")
    counts = table.select("segment", "kind", zero.alias("block"), "n", zero.alias("m"), "blob")
    asked = blocks.mapInArrow(ask, "segment int, kind int, block bigint, n bigint, m bigint, blob binary")
    dealt = counts.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "kind")
    answered = dealt.mapInArrow(answer, "block bigint, segment int, n bigint, m bigint, blob binary")
    texts = blocks.select("block", F.lit(-1).alias("segment"), zero.alias("n"), zero.alias("m"), "blob")
    met = texts.unionByName(answered).repartition("block").sortWithinPartitions("block", "segment")
    b, p, known, base, result = fresh(rows, "__b", "__p", "__known", "__base", "__score")
    scored = met.mapInArrow(finish, "b bigint, p int, known bigint, base double, score double").toDF(b, p, known, base, result)
    return rows.drop(payload).join(scored, (F.col(block) == F.col(b)) & (F.col(place) == F.col(p))).select(
        *keep,
        F.col(n_tokens).alias("n_tokens"),
        F.col(known).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        F.col(base).alias("base_score"),
        F.col(result).alias("score"),
    )
