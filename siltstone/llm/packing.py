"""Operator 10: sum-of-squares online packing of token ids into fixed windows.

Every partition packs its own rows as they stream by: full windows are cut from a long document at
once; what is left goes to the fill level that makes the sum of squared counts of partially filled
windows smallest (Csirik et al., "On the Sum-of-Squares Algorithm for Bin Packing"), kept in an
array of counts by level. Among equal costs the fullest level wins. With MAX_OPEN windows open, the
emptiest one gives its pieces to the gap of the fullest, and the rule goes on with all the others as
they are. When a partition ends, its emptiest windows are cut up into the gaps of the fullest, so at
most one window of a partition is left short. No shuffle: only the open windows' ids are held,
MAX_OPEN windows at most.

Defined cases: a null or empty text is just the closing id; a null document id is kept as null;
repeated rows are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm._common import by_bytes
from siltstone.llm.bpe import LONG_TEXT, SAFE_SPACE, safe_pieces

WINDOW = 2048
MAX_OPEN = 2048
#: sequence ids: the partition's number, then this many bits of the window's number in it.
SEQUENCE_BITS = 36
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    """Strings that the file's tokenizer takes out of a text before its splits, such as <|endoftext|>."""
    return tuple(token.content for token in tokenizer(path).get_added_tokens_decoder().values())


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def as_ranks(path: str, pattern: str) -> tiktoken.Encoding | None:
    """The same vocabulary as merge ranks, a faster way to the same ids; None where it isn't the same.

    It is the same if the file has plain byte-level BPE with the pattern's splits, if each merge
    gives the next id, and if every token's own string is encoded as that token.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None and spec["post_processor"] is None
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    letters, vocab = _bytes_of_letters(), model["vocab"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(vocab.get(token) != 256 + k for k, token in enumerate(merges)) or len(vocab) != 256 + len(merges):
        return None
    enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={bytes(letters[c] for c in token): i for token, i in vocab.items()}, special_tokens={})
    known, texts = [], []
    for i in range(len(vocab)):
        try:
            texts.append(enc.decode_single_token_bytes(i).decode())
            known.append(i)
        except UnicodeDecodeError:
            continue
    same = all(a.ids == enc.encode_ordinary(x) for a, x in zip(tokenizer(path).encode_batch(texts, add_special_tokens=False), texts))
    return enc if same else None


def ids_of(path: str, enc: tiktoken.Encoding | None, text: str) -> np.ndarray:
    """The ids of Tokenizer.from_file(path).encode(text, add_special_tokens=False); what holds an added token goes to that library."""
    added = added_tokens(path)
    # a cut is before a space, so no added token without one is cut
    whole = len(text) <= LONG_TEXT or any(" " in token for token in added)
    found = []
    for x in (text,) if whole else safe_pieces(text, at=SAFE_SPACE):
        if enc is None or any(token in x for token in added):
            found.append(np.array(tokenizer(path).encode(x, add_special_tokens=False).ids, np.uint32))
        else:
            found.append(enc.encode_to_numpy(x))
    return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4")


class Packer:
    """The open windows of one partition. A piece: (doc_id, start, ids, tokens of its document)."""

    def __init__(self, window: int, first: int, most_open: int = MAX_OPEN):
        self.window, self.next_id, self.most_open = window, first, most_open
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill level; a full one isn't counted
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.done.append((doc, start, len(ids), n, self.next_id, offset, ids.tobytes()))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, start, w = len(ids), 0, self.window
        while n - start >= w:
            self._close([(doc, start, ids[start : start + w], n)])
            start += w
        if start == n:
            return
        size, counts = n - start, self.counts
        # growth of the sum of squares: from level h to h + size it is 2 (count there - count here + 1), to a full window 1 - 2 count here
        here = counts[1 : w - size + 1]
        cost = 2 * (counts[1 + size : w + 1] - here + 1)
        cost[-1:] -= 2 * counts[w] + 1
        cost[here == 0] = np.iinfo(np.int64).max
        level = len(cost) - int(np.argmin(cost[::-1])) if len(cost) else 0  # of equals the fullest
        if not level or cost[level - 1] > 2 * counts[size] + 1:
            pieces, level = [], 0
        else:
            pieces = self.open[level].pop()
            counts[level] -= 1
        pieces.append((doc, start, ids[start:].copy(), n))
        if level + size == w:
            self._close(pieces)
        else:
            self._reopen(pieces, level + size)
            if counts.sum() > self.most_open:
                self.join_two()

    def join_two(self) -> None:
        """The emptiest window's pieces, cut where need be, go to the gap of the fullest: one open window fewer."""
        levels = np.flatnonzero(self.counts)
        low, high = int(levels[0]), int(levels[-1])
        giver, taker = self.open[low].pop(0), self.open[high].pop()
        self.counts[low] -= 1
        self.counts[high] -= 1
        gap = self.window - high
        while gap and giver:
            doc, start, ids, n = giver.pop()
            if len(ids) > gap:
                giver.append((doc, start + gap, ids[gap:], n))
                ids = ids[:gap]
            taker.append((doc, start, ids, n))
            gap -= len(ids)
        if gap:
            self._reopen(taker, self.window - gap)
        else:
            self._close(taker)
        if giver:
            self._reopen(giver, sum(len(p[2]) for p in giver))

    def _reopen(self, pieces: list, level: int) -> None:
        self.open[level].append(pieces)
        self.counts[level] += 1

    def settle(self) -> None:
        """Cut the emptiest open windows up into the gaps of the fullest; one window at most stays short."""
        windows = [x for level in range(self.window, 0, -1) for x in self.open[level]]
        self.open, lo, hi = [[] for _ in self.open], 0, len(windows) - 1
        self.counts[:] = 0
        fill = [sum(len(p[2]) for p in x) for x in windows]
        while lo < hi:
            gap = self.window - fill[lo]
            if not gap:
                self._close(windows[lo])
                lo += 1
                continue
            doc, start, ids, n = windows[hi].pop()
            if len(ids) > gap:  # the front of the piece fills the gap, the rest stays
                windows[hi].append((doc, start + gap, ids[gap:], n))
                ids = ids[:gap]
            windows[lo].append((doc, start, ids, n))
            fill[lo] += len(ids)
            fill[hi] -= len(ids)
            if not windows[hi]:
                hi -= 1
        for x in windows[lo : hi + 1]:
            self._close(x)


def pack(df: DataFrame, tokenizer_file: str, pattern: str, *, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document: where it starts there, its ids (little-endian 32-bit), its window and its offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = as_ranks(tokenizer_file, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def out():
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW.types)], schema=_ARROW)

        for batch in batches:
            for a, b in by_bytes(batch.column(1)):
                part = batch.slice(a, b - a)
                for doc, x in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = ids_of(tokenizer_file, enc, x.as_py() or "")
                    packer.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4"))
                yield out()
        packer.settle()
        yield out()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
