"""Operator 5: token counts that follow edits.

Each document keeps two segment trees over leaves of whole pre-tokens: characters and token counts.
An edit descends the character tree to the leaf it touches, re-encodes that leaf (with a neighbour
where the edit made their common boundary unsafe), and updates the sums on the path to the root. A
leaf that has grown beyond MOST_CHARS is split, and the trees take their new shape over the leaves'
known counts; a text of one unbroken word stays one leaf, as its count can't be had by parts.

Leaves end where a letter or digit precedes a space or a sign: no pre-token crosses such a place, so
the sum of the leaves' counts is the count of the whole text.

Defined cases: a null text counts as empty; edits apply in array order, each to the text that the
ones before left; a position beyond the end (or a null one) means the end, a negative one the
start; a null or negative length removes nothing, a null replacement inserts nothing; a null edit
is skipped and a null list of edits changes nothing. Rows repeat as they come; an empty table gives
no rows; other columns pass unchanged, and a new one whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import fresh
from siltstone.llm.bpe import SAFE, encode_text, encoding, int_lists

#: A leaf has at least this many characters, and ends at the next safe boundary.
LEAF_CHARS = 256
#: A longer leaf is split after an edit, if it has a safe boundary.
MOST_CHARS = 8 * LEAF_CHARS
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITED = f"struct<n_tokens:bigint,reencoded_chars:bigint,text:string,tree:{TREE}>"


def leaves_of(text: str) -> list[str]:
    out, start = [], 0
    while len(text) - start > LEAF_CHARS and (cut := SAFE.search(text, start + LEAF_CHARS)):
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def _tree(values: list[int]) -> list[int]:
    """Sums over values as a heap: node k holds nodes 2k and 2k + 1; leaves start at half its length."""
    width = 1 << max(0, (len(values) - 1).bit_length())
    tree = [0] * width + values + [0] * (width - len(values))
    for k in range(width - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return tree


class CountTree:
    """The trees of one document, and the leaves' texts while it is being edited."""

    def __init__(self, enc: tiktoken.Encoding, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.enc, self.reencoded = enc, 0
        if chars is None:
            self.leaves = leaves_of(text)
            self.chars = _tree([len(x) for x in self.leaves])
            self.tokens = _tree([len(encode_text(enc, x)) for x in self.leaves])
        else:
            self.chars, self.tokens, self.leaves, at = list(chars), list(tokens), [], 0
            for n in chars[len(chars) // 2 :]:
                self.leaves.append(text[at : at + n])
                at += n
        self.leaves += [""] * (len(self.chars) // 2 - len(self.leaves))

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the position within it."""
        node, width = 1, len(self.chars) // 2
        while node < width:
            node *= 2
            if position > self.chars[node] or (position == self.chars[node] and self.chars[node + 1]):
                position -= self.chars[node]
                node += 1
        return node - width, position

    def _put(self, leaf: int, text: str, count: bool = True) -> None:
        self.leaves[leaf] = text
        tokens = len(encode_text(self.enc, text)) if count else 0
        self.reencoded += len(text) if count else 0
        node = leaf + len(self.chars) // 2
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, position: int | None, length: int | None, replacement: str | None) -> None:
        size = self.chars[1]
        position = size if position is None else min(max(position, 0), size)
        left, replacement = min(max(length or 0, 0), size - position), replacement or ""
        if not left and not replacement:
            return
        first, at = self._find(position)
        new, last = self.leaves[first][:at] + replacement, first
        rest = self.leaves[first][at:]
        while left > len(rest):
            left -= len(rest)
            last += 1
            rest = self.leaves[last]
        new += rest[left:]
        for k in range(first + 1, last + 1):
            if self.leaves[k]:
                self._put(k, "", count=False)
        # boundary context: a neighbour joins the region where the edit made the place between them unsafe
        before = next((k for k in range(first - 1, -1, -1) if self.leaves[k]), None)
        if before is not None and new and not SAFE.match(self.leaves[before][-1] + new[0], 1):
            new, old, first = self.leaves[before] + new, first, before
            self._put(old, "", count=False)
        after = next((k for k in range(last + 1, len(self.leaves)) if self.leaves[k]), None)
        if after is not None and new and not SAFE.match(new[-1] + self.leaves[after][0], 1):
            new += self.leaves[after]
            self._put(after, "", count=False)
        parts = leaves_of(new) if len(new) > MOST_CHARS else [new]
        if len(parts) == 1:
            self._put(first, new)
        else:
            self._split(first, parts)

    def _split(self, leaf: int, parts: list[str]) -> None:
        """Several leaves in place of one: only these are encoded, the trees' sums are added up anew."""
        width = len(self.chars) // 2
        counts = [len(encode_text(self.enc, x)) for x in parts]
        self.reencoded += sum(map(len, parts))
        held = [(x, n) for x, n in zip(self.leaves, self.tokens[width:])]
        held[leaf : leaf + 1] = zip(parts, counts)
        held = [(x, n) for x, n in held if x]
        self.leaves = [x for x, _ in held]
        self.chars, self.tokens = _tree([len(x) for x in self.leaves]), _tree([n for _, n in held])
        self.leaves += [""] * (len(self.chars) // 2 - len(self.leaves))


def _trees(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([int_lists([chars for chars, _ in found]), int_lists([tokens for _, tokens in found])], ["chars", "tokens"])


def _numbers(doc: CountTree) -> tuple[np.ndarray, np.ndarray]:
    return np.array(doc.chars, np.int32), np.array(doc.tokens, np.int32)


def count_tokens(df: DataFrame, rank_file: str, pattern: str, *, text: str = "text", out: str = "tree") -> DataFrame:
    """df with `out`, the document's trees; tokens[1] of it is the whole text's count."""

    @arrow_udf(TREE)
    def build(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for batch in texts:
            yield _trees([_numbers(CountTree(enc, x.as_py() or "")) for x in batch])

    return df.withColumn(*fresh(df, out), build(F.col(text)))


def apply_edits(df: DataFrame, rank_file: str, pattern: str, *, text: str = "text", tree: str = "tree", edits: str = "edits", out: str = "edited") -> DataFrame:
    """df with `out`: count, text and trees after `edits`, array<struct<position:int,length:int,replacement:string>>."""

    @arrow_udf(EDITED)
    def edit(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for texts, trees, lists in batches:
            counts, reencoded, after, numbers = [], [], [], []
            for x, t, changes in zip(texts, trees, lists):
                known = t.as_py()
                doc = CountTree(enc, x.as_py() or "", *((known["chars"], known["tokens"]) if known else ()))
                for e in changes.as_py() or ():
                    if e is not None:
                        doc.edit(e["position"], e["length"], e["replacement"])
                counts.append(doc.tokens[1])
                reencoded.append(doc.reencoded)
                after.append(doc.text)
                numbers.append(_numbers(doc))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(reencoded, pa.int64()), pa.array(after, pa.string()), _trees(numbers)], ["n_tokens", "reencoded_chars", "text", "tree"])

    return df.withColumn(*fresh(df, out), edit(F.col(text), F.col(tree), F.col(edits)))
