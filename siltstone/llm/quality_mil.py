"""Operator 2: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, of which every one is encoded: shares of
byte classes, word shapes and repetition, and its words, hashed to BUCKETS, each with a learned vector;
through one hidden layer. Gated attention (Ilse, Tomczak and Welling, "Attention-based Deep Multiple
Instance Learning") weighs the passages, and the weighted mean representation is scored. All weights
are learned from document labels alone.

Fitting uses a bounded sample of labelled rows: of each label, the SAMPLE documents whose ids hash
lowest among those that may be learned from and are short enough for a bag of SAMPLE_PASSAGES / BAGS
passages, and of these as many, in that order, as have SAMPLE_PASSAGES passages together: BAGS at
least. So long documents take no other's place. Their bags are whole, and are learned from in
mini-batches of whole bags. Both labels must be there: with one alone nothing is learned, and a
warning says so. Scoring encodes every passage of every text in one pass without a shuffle.

Defined cases: a null or empty text, or one of white space, is one passage without words, and is
scored like any other; labels with null parts are left out, and of several labels for an id the
greatest counts; of rows with one id the least bag is learned from; without labels of both kinds, or
over an empty table, every score is 0.5; repeated rows get the same score; a very long text is encoded
in slices of about HASH_BYTES that end where a passage ends (a longer passage stays whole); other
columns pass unchanged and are never inputs, and the score's name gets underscores where it is taken.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import HASH_BYTES, by_bytes, flat, fresh, give_back, span_hashes, words_of

PASSAGE_WORDS, SAMPLE, SAMPLE_PASSAGES, BAGS, BUCKETS = 50, 3000, 100_000, 16, 1024
HIDDEN, ATTENTION, RATE, DECAY = 16, 8, 0.02, 1e-4
#: Passages encoded at a time when scoring.
AT_ONCE = 512
#: Passages of a mini-batch (of whole bags), and the least numbers of passes and of steps.
BATCH_PASSAGES, EPOCHS, STEPS = 8192, 10, 240

_KINDS = 8
_KIND = np.full(256, 6, np.uint8)  # other signs
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>!"]] = 5
_KIND[128:] = 7
_SHAPES = _KINDS + 9
#: A passage is a row of shapes and of its words' buckets (BUCKETS where it has fewer words).
FEATURES = _SHAPES + PASSAGE_WORDS


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES numbers for each passage of each text, and the passages' texts."""
    if len(offsets) != 2 or len(data) <= HASH_BYTES:
        return _encode(data, offsets)
    rows, start = [], 0
    while start < len(data):  # one long text: slices that end where a passage ends
        size = HASH_BYTES
        while True:
            stop = min(start + size, len(data))
            starts = words_of(data[start:stop], np.array([0, stop - start]))[0]
            whole = (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
            if stop == len(data) or whole > 0:
                break
            size *= 2
        stop = stop if stop == len(data) else start + int(starts[whole])
        rows.append(_encode(data[start:stop], np.array([0, stop - start]))[0])
        start = stop
    x = np.concatenate(rows)
    return x, np.zeros(len(x), np.int64)


def _kinds(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes of each kind each passage has."""
    total = len(begin)
    if len(data) <= 2 * HASH_BYTES:
        of_byte = np.repeat(np.arange(total), size)
        return np.bincount(of_byte * _KINDS + _KIND[data], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float64)
    out = np.zeros((total, _KINDS))
    for k, (a, n) in enumerate(zip(begin.tolist(), size.tolist())):
        for lo in range(a, a + n, HASH_BYTES):
            out[k] += np.bincount(_KIND[data[lo : min(lo + HASH_BYTES, a + n)]], minlength=_KINDS)
    return out


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, row = words_of(data, offsets)
    per_text = np.bincount(row, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(per_text)])
    passages = np.maximum(1, -(-per_text // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(passages)])
    total, text = int(first[-1]), np.repeat(np.arange(n), passages)
    nth = np.arange(total) - first[text]
    opening = np.minimum(first_word[text] + nth * PASSAGE_WORDS, max(len(starts) - 1, 0))
    begin = np.where((nth == 0) | (len(starts) == 0), offsets[:-1][text], starts[opening] if len(starts) else 0)
    size = np.diff(np.append(begin, offsets[-1]))
    out = np.zeros((total, FEATURES), np.float32)
    out[:, :_KINDS] = _kinds(data, begin, size) / np.maximum(size, 1)[:, None]
    out[:, _SHAPES:] = BUCKETS
    if len(starts):
        nth_word = np.arange(len(starts)) - first_word[row]
        word_at = first[row] + nth_word // PASSAGE_WORDS
        words = np.bincount(word_at, minlength=total)
        share = lambda hit: np.bincount(word_at, hit, total) / np.maximum(words, 1)
        length = (ends - starts).astype(np.float64)
        head, tail = _KIND[data[starts]], _KIND[data[ends - 1]]
        hashes = span_hashes(data, starts, ends)
        again = np.zeros(len(starts))
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_at[1:] == word_at[:-1])
        order = np.lexsort((hashes, word_at))
        fresh = np.ones(len(starts))
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_at[order][1:] != word_at[order][:-1])
        mean = share(length)
        out[:, _KINDS] = np.minimum(mean / 10, 3)
        out[:, _KINDS + 1] = np.minimum(np.sqrt(np.maximum(share(length**2) - mean**2, 0)) / 10, 3)
        out[:, _KINDS + 2] = share(head == 1)
        out[:, _KINDS + 3] = share(tail == 1)
        out[:, _KINDS + 4] = share(tail == 5)
        out[:, _KINDS + 5] = share(head == 5)
        out[:, _KINDS + 6] = share(again)
        out[:, _KINDS + 7] = np.bincount(word_at[order], fresh, total) / np.maximum(words, 1)
        out[:, _KINDS + 8] = np.log1p(words) / 4
        out[word_at, _SHAPES + nth_word % PASSAGE_WORDS] = hashes % np.uint64(BUCKETS)
    return out, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and scorer; bags come as passages in order and the bag's number of each."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        """mean and scale: of the shapes."""
        draw = np.random.default_rng(seed)
        weights = lambda a, b: draw.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = mean, scale
        self.p = {"W": weights(_SHAPES, HIDDEN), "E": np.zeros((BUCKETS, HIDDEN)), "b": np.zeros(HIDDEN), "V": weights(HIDDEN, ATTENTION), "U": weights(HIDDEN, ATTENTION), "w": np.zeros(ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def _inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled shapes, and the share of each bucket in the passage's words."""
        n, ids = len(x), x[:, _SHAPES:].astype(np.int64)
        share = np.bincount((np.arange(n)[:, None] * (BUCKETS + 1) + ids).ravel(), minlength=n * (BUCKETS + 1)).reshape(n, BUCKETS + 1)[:, :BUCKETS]
        words = np.maximum((ids < BUCKETS).sum(axis=1), 1)
        return np.clip((x[:, :_SHAPES] - self.mean) / self.scale, -4, 4), share / words[:, None]

    def _encoded(self, shapes: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.tanh(shapes @ self.p["W"] + share @ self.p["E"] + self.p["b"])

    def _pooled(self, h: np.ndarray, bag: np.ndarray):
        """Attention over the passages of each bag, and its score."""
        p = self.p
        first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bag))))
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[at])
        a = e / np.add.reduceat(e, first)[at]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return t, s, a, z, first, at, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        h = np.concatenate([self._encoded(*self._inputs(x[lo : lo + AT_ONCE])) for lo in range(0, len(x), AT_ONCE)])
        return self._pooled(h, bag)[-1]

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 11) -> None:
        """x: the bags' passages end to end; a step takes whole bags of about BATCH_PASSAGES passages."""
        stop, draw, steps = np.cumsum(sizes), np.random.default_rng(seed), 0
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for epoch in range(max(EPOCHS, STEPS)):
            if epoch >= EPOCHS and steps >= STEPS:
                break
            order = draw.permutation(len(sizes))
            for bags in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // BATCH_PASSAGES)) + 1):
                rows = np.concatenate([np.arange(stop[b] - sizes[b], stop[b]) for b in bags])
                steps += 1
                self._step(x[rows], np.repeat(np.arange(len(bags)), sizes[bags]), y[bags], weight[bags], steps, m, v)

    def gradients(self, x, bag, y, weight) -> tuple[float, dict]:
        """The mean weighted loss of the bags, and its slope by each parameter."""
        p = self.p
        shapes, share = self._inputs(x)
        h = self._encoded(shapes, share)
        t, s, a, z, first, at, score = self._pooled(h, bag)
        sure = np.clip(score, 1e-12, 1 - 1e-12)
        loss = float(-((y * np.log(sure) + (1 - y) * np.log(1 - sure)) * weight).sum() / weight.sum())
        err = (score - y) * weight / weight.sum()
        dz = err[:, None] * p["c"]
        da = (dz[at] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[at])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = (a[:, None] * dz[at] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return loss, {"W": shapes.T @ dh, "E": share.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def _step(self, x, bag, y, weight, step: int, m: dict, v: dict) -> None:
        p = self.p
        for k, g in self.gradients(x, bag, y, weight)[1].items():
            g = g + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _bags(text: pa.Array) -> list[np.ndarray]:
    x, of = encode_passages(*flat(text))
    return [bag.ravel() for bag in np.split(x, np.flatnonzero(np.diff(of)) + 1)] if len(x) else []


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> AttentionModel | None:
    """A model of `label` (0 or 1) fitted on at most `sample` documents and `passages` passages of each; None without any."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    # a passage but the last has PASSAGE_WORDS words and as many spaces, so these bags have passages / BAGS passages at most
    short = docs.filter(F.coalesce(F.octet_length(text), F.lit(0)) < passages // BAGS * 2 * PASSAGE_WORDS)
    known = known.join(short.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi")
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x sample rows of two numbers

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in by_bytes(batch.column("text")):
                own = pa.array(_bags(batch.column("text").slice(lo, hi - lo)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("id", "y")), own], ["id", "y", "bag"])
            give_back()

    found = short.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(chosen, "id").select("id", "y", "text")
    found = found.mapInArrow(bags, T.StructType([found.schema["id"], found.schema["y"], T.StructField("bag", T.ArrayType(T.FloatType()))]))
    found = found.groupBy("id", "y").agg(F.min("bag").alias("bag")).withColumn("n", F.size("bag") / FEATURES)
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))  # over at most `sample` rows
    found = found.withColumn("so_far", so_far).filter(F.col("so_far") <= passages).select("id", "y", "bag").toArrow().sort_by("id")
    if len(set(found.column("y").to_pylist())) < 2:
        warnings.warn(f"nothing is learned: the sample has labels {sorted(set(found.column('y').to_pylist()))} alone", stacklevel=2)
        return None
    flats = found.column("bag").combine_chunks()
    x = flats.flatten().to_numpy().reshape(-1, FEATURES)
    sizes = np.diff(flats.offsets.to_numpy()) // FEATURES
    y = found.column("y").to_numpy().astype(np.float64)
    shapes = x[:, :_SHAPES]
    model = AttentionModel(shapes.mean(axis=0, dtype=np.float64), np.maximum(shapes.std(axis=0, dtype=np.float64), 1e-3))
    share = np.clip(np.bincount(y.astype(int), minlength=2) / len(y), 1e-9, 1)
    model.fit(x, sizes, y, 0.5 / share[y.astype(int)])
    return model


def score(df: DataFrame, model: AttentionModel | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """df with `out`, how likely label 1 is for the whole text."""

    @arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [np.zeros(0)]
            for lo, hi in by_bytes(batch):
                parts.append(model.scores(*encode_passages(*flat(batch.slice(lo, hi - lo)))) if model else np.full(hi - lo, 0.5))
            yield pa.array(np.concatenate(parts))
            give_back()

    return df.withColumn(*fresh(df, out), run(F.col(text)))
