"""Operator 12: language identification with a byte convolutional network.

A text's lower-cased UTF-8 bytes are cut into windows of WINDOW bytes, all of it. Bytes become vectors;
filters of several widths slide over a window; each filter's greatest response is kept, and a softmax
layer over those gives the languages. All weights, the byte vectors included, are trained in numpy by
gradient descent on labelled text. A text's logits are its windows' logits, weighted by their bytes.

A filter's response is a sum over its places, so each place's product with each byte (or pair of bytes)
is tabulated once, and a window is scored by look-ups and sums.

Fitting uses a bounded sample of labelled rows: of each language, the documents whose ids hash lowest,
SAMPLE together, and of each PIECES windows of its text at even distances. It goes to the driver: at
most SAMPLE x PIECES windows (with more than SAMPLE / LEAST languages, LEAST documents of each).
Scoring reads every byte of every text in one pass without a shuffle, AT_ONCE windows at a time.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null id is never learned
from, and of rows with one id and language the least sample counts; null texts, null languages and
texts without letters aren't learned from; without anything to learn from every prediction is `und`;
of equally likely languages the first in order of their names is predicted; repeated rows get the same
prediction; very long texts are held once, their windows in slices; other columns pass unchanged, and
the results' names get underscores where they are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import flat, fresh

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
SAMPLE, LEAST, PIECES, MOST_SENT = 6000, 50, 3, 100_000
#: Passes over the sample, but at least STEPS steps.
EPOCHS, STEPS, BATCH, RATE, DECAY = 4, 600, 64, 0.01, 1e-4
#: Windows scored at a time.
AT_ONCE = 256
UNKNOWN = "und"


def has_letter(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\p{L}")


class ByteConv:
    """The network. A window is a row of WINDOW + max(WIDTHS) - 1 bytes, padded with zeros, and its length."""

    def __init__(self, langs: list[str], seed: int = 5):
        draw = np.random.default_rng(seed)
        normal = lambda *shape: draw.normal(0, 1 / math.sqrt(shape[0]), shape).astype(np.float32)
        self.langs = langs
        self.p = {"E": draw.normal(0, 0.5, (256, EMBED)).astype(np.float32), "U": normal(FILTERS * len(WIDTHS), len(langs)), "c": np.zeros(len(langs), np.float32)}
        for k in WIDTHS:
            self.p |= {f"W{k}": normal(k * EMBED, FILTERS), f"b{k}": np.zeros(FILTERS, np.float32)}

    def _forward(self, rows: np.ndarray, lengths: np.ndarray):
        """Pooled responses, and for each the place it comes from."""
        n, embedded, pooled, places = len(rows), self.p["E"][rows], [], []
        beyond = np.arange(WINDOW)[None, :] >= np.maximum(lengths, 1)[:, None]
        for k in WIDTHS:
            spans = np.lib.stride_tricks.sliding_window_view(embedded, k, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(n * WINDOW, k * EMBED)
            found = (spans @ self.p[f"W{k}"]).reshape(n, WINDOW, FILTERS)
            found[beyond] = -np.inf
            places.append(found.argmax(axis=1))
            pooled.append(np.take_along_axis(found, places[-1][:, None, :], axis=1)[:, 0] + self.p[f"b{k}"])
        return np.tanh(np.concatenate(pooled, axis=1)), places

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """The mean weighted loss, and its slope by each parameter."""
        n, p = len(rows), self.p
        hidden, places = self._forward(rows, lengths)
        logits = hidden @ p["U"] + p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-(np.log(prob[np.arange(n), y]) * weight).sum() / weight.sum())
        prob[np.arange(n), y] -= 1
        err = (prob * (weight / weight.sum())[:, None]).astype(hidden.dtype)
        back = (err @ p["U"].T) * (1 - hidden**2)
        grad = {"U": hidden.T @ err, "c": err.sum(axis=0), "E": np.zeros_like(p["E"])}
        for i, k in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"b{k}"] = own.sum(axis=0)
            grad[f"W{k}"] = np.zeros_like(p[f"W{k}"])
            for j in range(k):  # only the places of the greatest responses count
                at = np.take_along_axis(rows, places[i] + j, axis=1)
                part = p[f"W{k}"][j * EMBED : (j + 1) * EMBED]
                grad[f"W{k}"][j * EMBED : (j + 1) * EMBED] = np.einsum("nfe,nf->ef", p["E"][at], own)
                np.add.at(grad["E"], at, own[:, :, None] * part.T[None])
        return loss, grad

    def fit(self, windows: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 3) -> None:
        """Adam over shuffled batches; some windows are cut short, as texts may be short too."""
        draw, step = np.random.default_rng(seed), 0
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        batches = math.ceil(len(windows) / BATCH)
        epochs = max(EPOCHS, math.ceil(STEPS / batches))
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                short = draw.integers(8, WINDOW + 1, len(own))
                cut = draw.random(len(own)) < 0.3
                lengths = np.array([min(len(windows[i]), s) if c else len(windows[i]) for i, s, c in zip(own, short, cut)])
                rows = padded([windows[i][:n] for i, n in zip(own, lengths)])
                step += 1
                _, grad = self.gradients(rows, lengths, y[own], weight[own])
                rate = RATE * (1 - (step - 1) / (epochs * batches))
                for k, g in grad.items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """Of each width, (place, bytes looked up together, the products): pairs of bytes, and a last single one."""
        out = []
        for k in WIDTHS:
            one = [self.p["E"] @ self.p[f"W{k}"][j * EMBED : (j + 1) * EMBED] for j in range(k)]
            pairs = [(j, 2, (one[j][:, None] + one[j + 1][None]).reshape(1 << 16, FILTERS)) for j in range(0, k - 1, 2)]
            out.append(pairs + ([(k - 1, 1, one[-1])] if k % 2 else []))
        return out

    def logits(self, rows: np.ndarray, lengths: np.ndarray, tables: list) -> np.ndarray:
        """The same as training's forward pass, by look-ups."""
        pair = (rows[:, :-1].astype(np.uint16) << 8) | rows[:, 1:]
        partial = np.flatnonzero(lengths < WINDOW)
        beyond = np.arange(WINDOW)[None, :] >= np.maximum(lengths[partial], 1)[:, None]
        pooled = []
        for k, parts in zip(WIDTHS, tables):
            found = None
            for j, size, table in parts:
                got = table[(pair if size == 2 else rows)[:, j : j + WINDOW]]
                found = got if found is None else found + got
            if len(partial):
                found[partial] = np.where(beyond[:, :, None], -np.inf, found[partial])
            pooled.append(found.max(axis=1) + self.p[f"b{k}"])
        return np.tanh(np.concatenate(pooled, axis=1)) @ self.p["U"] + self.p["c"]

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables: list) -> np.ndarray:
        """Mean logits of each text, over all of its windows."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        total = np.zeros((n, len(self.langs)))
        count = np.maximum(1, -(-size // WINDOW))
        first = np.concatenate([[0], np.cumsum(count)])
        for lo in range(0, int(first[-1]), AT_ONCE):
            at = np.arange(lo, min(lo + AT_ONCE, int(first[-1])))
            text = np.searchsorted(first, at, "right") - 1
            begin = offsets[text] + (at - first[text]) * WINDOW
            lengths = np.minimum(offsets[text + 1] - begin, WINDOW)
            rows = np.zeros((len(at), WINDOW + max(WIDTHS) - 1), np.uint8)
            places = begin[:, None] + np.arange(WINDOW)[None, :]
            inside = np.arange(WINDOW)[None, :] < lengths[:, None]
            rows[:, :WINDOW][inside] = data[places[inside]]
            np.add.at(total, text, self.logits(rows, lengths, tables) * np.maximum(lengths, 1)[:, None])
        return total / np.maximum(size, 1)[:, None]


def padded(windows: list[bytes]) -> np.ndarray:
    wide = WINDOW + max(WIDTHS) - 1
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in windows), np.uint8).reshape(len(windows), wide)


def _pieces(text: bytes) -> list[bytes]:
    """PIECES windows at even distances; fewer of a short text."""
    n = min(PIECES, max(1, len(text) // WINDOW))
    return [text[s : s + WINDOW] for s in ((len(text) - WINDOW) * i // max(n - 1, 1) if len(text) > WINDOW else 0 for i in range(n))]


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> ByteConv | None:
    """A network of all values of `lang`, fitted on a sample; None without any."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    slim = known.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("hash"))
    sizes = slim.groupBy("lang").agg(F.count("*").alias("rows"))
    n_langs = sizes.count()
    if not n_langs:
        return None
    share = max(LEAST, sample // n_langs)
    # some four times the share has hashes this low, so a language's ranks are of few rows at any size
    few = n_langs <= MOST_SENT
    low = slim.join(F.broadcast(sizes) if few else sizes, "lang").filter(F.col("hash") < F.lit(4.0 * share * (1 << 40)) / F.col("rows"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    chosen = low.withColumn("nth", nth).filter(F.col("nth") <= share).select("id", "lang").distinct()
    if share * n_langs <= MOST_SENT:  # rows at most; with more languages Spark picks the join
        chosen = F.broadcast(chosen)

    @arrow_udf("array<binary>")
    def pieces(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([_pieces(memoryview(x.as_buffer()).tobytes()) for x in batch], pa.list_(pa.binary()))

    found = known.join(chosen, ["id", "lang"]).select("id", "lang", pieces(F.lower("text")).alias("pieces"))
    rows = sorted(found.groupBy("id", "lang").agg(F.min("pieces").alias("pieces")).collect(), key=lambda r: (r.lang, r.id))
    langs = sorted({r.lang for r in rows})
    windows = [bytes(w) for r in rows for w in r.pieces]
    y = np.array([langs.index(r.lang) for r in rows for _ in r.pieces])
    model = ByteConv(langs)
    share_of = np.bincount(y, minlength=len(langs)) / len(y)
    model.fit(windows, y, (1 / share_of[y]).astype(np.float32))
    return model


def identify(df: DataFrame, model: ByteConv | None, *, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the likeliest language of each whole text and its probability."""

    @arrow_udf("struct<lang string, score double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = model.tables()
        for batch in texts:
            langs, scores = [], []
            for lo in range(0, len(batch), 1024):
                logits = model.predict(*flat(batch.slice(lo, 1024)), tables)
                logits -= logits.max(axis=1, keepdims=True)
                prob = np.exp(logits)
                prob /= prob.sum(axis=1, keepdims=True)
                best = prob.argmax(axis=1)
                langs += [model.langs[i] for i in best]
                scores.append(prob[np.arange(len(best)), best])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["lang", "score"])

    pred, score, both = fresh(df, *out, "__found")
    if model is None:
        return df.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shown = df.withColumn(both, F.when(has_letter(F.col(text)), run(F.lower(text))))
    return shown.withColumns({pred: F.coalesce(F.col(both)["lang"], F.lit(UNKNOWN)), score: F.coalesce(F.col(both)["score"], F.lit(0.0))}).drop(both)
