"""Operator 3: removal of repeated byte strings through suffix arrays of co-located windows.

A byte goes if a string of `length` bytes that covers it also starts earlier (at a smaller document
id, or earlier in the same document). Every such string is a window; the job is to find, exactly,
which windows are equal.

Co-location. Of the 16-byte grams in a window, the leftmost with the least hash is its anchor. Equal
windows have equal anchors at equal places in them, so windows are dealt by their anchor's hash;
consecutive windows with one anchor travel as one segment of at most 2 * length bytes. Before any
text moves, hashes and places stream by in order: of equal segments all but the earliest are repeats
in full, whatever their number, and an anchor that is left with one segment holds no other equal
windows. Segments are equal by the anchor's hash and 96 further bits, in two hashes of which one is
made of the segment's halves: even 10^9 segments of one anchor hold a false pair with a chance below
10^-10. Each task drops such repeats from its own buffers before the shuffle, so a passage in a third
of all rows sends a row for each buffer, not for each copy. The text of the remaining segments, and
only theirs, goes on.

Classes. The distinct segments of a batch of whole anchor groups (about BATCH_BYTES) form one
string with unique ends. From its suffix array comes the Burrows-Wheeler transform, and a
breadth-first backward extension of intervals (Beller, Gog, Ohlebusch and Schnattinger, "Computing
the longest common prefix array based on the Burrows-Wheeler transform") sets common-prefix values
in increasing order. It stops at `length`: places that are still unset have at least that common
prefix, so windows between two set places are equal. Of each class the earliest window stays.

A group whose distinct segments alone exceed GROUP_BYTES is not held: its windows are dealt once
more, each by a 128-bit hash of its own bytes, and resolved as sorted runs.

Defined cases: a null or empty text has no bytes and loses none; rows equal in document id and text
are one document, and get the same result each; rows with one id and different texts are ordered by
a hash of the text; a null id sorts first; other columns pass unchanged, new ones get underscores
where their names are taken; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import by_bytes, flat, fresh, mix, span_hashes

LENGTH, GRAM = 100, 16
#: Groups are searched in batches of about so many bytes of segments; a single group of more than GROUP_BYTES isn't held.
BATCH_BYTES, GROUP_BYTES = 1_000_000, 4_000_000
#: Longer texts are searched for anchors in slices of this many windows.
SLICE = (1 << 20) - 1
_AT = 20  # bits of a window count in a packed place
_ID = 21  # bits of a place within most batches
_LOW = (1 << _ID) - 1


def _order(n: int, *keys: np.ndarray) -> np.ndarray:
    """The order by up to two keys below n; where they fit, sorted as one packed number, which is faster than sorting places."""
    if n > _LOW:
        return np.lexsort(keys[::-1])
    packed = keys[0].astype(np.int64)
    for k in keys[1:]:
        packed = (packed << _ID) | k
    return np.sort((packed << _ID) | np.arange(len(packed))) & _LOW


# ---- anchors ------------------------------------------------------------------------------------


def _twice_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of hash of each span, and 32 more that depend on its halves."""
    middle = (starts + ends) // 2
    halves = span_hashes(data, starts, middle) + np.uint64(3) * mix(span_hashes(data, middle, ends))
    return span_hashes(data, starts, ends), (mix(halves) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, the first window's place in data, the number of windows."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(n - gram + 1)
    hashes = span_hashes(data, starts, starts + gram)
    key = (hashes & ~np.uint64(0xFFFFFFFF)) | starts.astype(np.uint64)  # of equal hashes, the leftmost is least
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    count = n - length + 1
    least = np.minimum(key[:count], key[wide - span : wide - span + count])
    crossing = np.zeros(count + 1, np.int64)  # windows that run over the end of a text
    ends = offsets[1:-1]
    np.add.at(crossing, np.clip(np.maximum(ends - length + 1, offsets[:-2]), 0, count), 1)
    np.add.at(crossing, np.clip(ends, 0, count), -1)
    own = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (least[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)]))
    return hashes[place[first]], own[first], np.diff(np.append(first, len(own)))


def _runs(begin: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in the order of their begins, those of one row that touch made one: begin, stop, row."""
    if not len(begin):
        return begin, stop, row
    reach = np.maximum.accumulate(stop)
    head = np.flatnonzero(np.concatenate([[True], (begin[1:] > reach[:-1]) | (row[1:] != row[:-1])]))
    return begin[head], reach[np.append(head[1:], len(begin)) - 1], row[head]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments' hashes and places. Of equal ones in a buffer the earliest goes on; the others are repeats already (h null), as few spans."""
    for batch in batches:
        for a, b in by_bytes(batch.column("text")):
            rid, doc = (batch.column(k).slice(a, b - a).to_numpy() for k in ("rid", "did"))
            data, offsets = flat(batch.column("text").slice(a, b - a))
            step = SLICE if b - a == 1 else max(len(data), 1)  # a single row may be very long
            for lo in range(0, len(data), step):
                part = data[lo : lo + step + length - 1]
                h, at, n = anchors(part, np.array([0, len(part)]) if b - a == 1 else offsets, length)
                row = np.searchsorted(offsets, at + lo, "right") - 1
                packed = ((at + lo - offsets[row]) << _AT) | n
                whole, more = _twice_hashed(part, at, at + n - 1 + length)
                order = np.lexsort((packed, rid[row], doc[row], more, whole, h))
                same = np.ones(len(order), bool)
                same[:1] = False
                for x in (h[order], whole[order], more[order]):
                    same[1:] &= x[1:] == x[:-1]
                first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                again = np.sort(order[same & ((rid[row][order] != rid[row][first]) | (doc[row][order] != doc[row][first]) | (packed[order] != packed[first]))])
                go = order[~same]
                begin, stop, of = _runs(at[again], at[again] + n[again] - 1 + length, row[again])
                gone = ((begin + lo - offsets[of]) << _AT) | (stop - begin - length + 1)
                null = np.arange(len(go) + len(of)) >= len(go)
                both = np.append(row[go], of)
                pad = np.zeros(len(of), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(h[go].view(np.int64), pad), mask=null), pa.array(np.append(whole[go].view(np.int64), pad)), pa.array(np.append(more[go], pad.astype(np.int32))), pa.array(doc[both]), pa.array(rid[both]), pa.array(np.append(packed[go], gone))],
                    ["h", "whole", "more", "did", "rid", "at"],
                )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (h, whole, more, did, rid, at): those that matter.

    Equal segments (equal h, whole and more) after the first are repeats in full: h null.
    First ones go on if their anchor has another segment too. One row is held between batches.
    Rows whose h is null are repeats and pass.
    """
    names = ("h", "whole", "more", "did", "rid", "at")
    held = None  # the last segment's first row, whether its group has several, and the group's first row while it hasn't
    for batch in batches:
        known = batch.column("h").is_null()
        if known.true_count:
            yield batch.filter(known).select(["h", "did", "rid", "at"])
            batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in names]
        if held is not None:
            rows = [np.append([x], y) for x, y in zip(held[0], rows)]
        h, whole, more, did, rid, at = rows
        new_group = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_group | np.concatenate([[True], (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])])
        group = np.cumsum(new_group) - 1
        several = np.bincount(group, new) > 1
        if held is not None:
            several[0] |= held[1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        repeat = ~new & ((did != did[first]) | (rid != rid[first]) | (at != at[first]))
        go = new & several[group]
        if held is not None:
            go[0] = several[0] and not held[1]  # held back so far
        out = np.flatnonzero(repeat | go)
        yield pa.RecordBatch.from_arrays([pa.array(h[out], mask=repeat[out]), *(pa.array(x[out]) for x in (did, rid, at))], ["h", "did", "rid", "at"])
        held = ([x[first[-1]] for x in rows], bool(several[-1]))


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The segments' bytes; and a document's repeats so far, as few spans (h null)."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for a, b in by_bytes(batch.column("text"), 1 << 19):
            part, rows = batch.slice(a, b - a), []
            for doc, rid, text, places in zip(part.column("did").to_pylist(), part.column("rid").to_pylist(), part.column("text"), part.column("places")):
                fields = places.values.flatten()
                h, packed = fields[0].to_pylist(), fields[1].to_numpy()
                lo, stop = packed >> _AT, (packed >> _AT) + (packed & ((1 << _AT) - 1)) - 1 + length
                data = text.as_py().encode() if any(x is not None for x in h) else b""
                rows += [(x, data[u:v], doc, rid, u) for x, u, v in zip(h, lo.tolist(), stop.tolist()) if x is not None]
                gone = np.array([x is None for x in h])
                rows += [(None, (v - u).to_bytes(8, "little"), doc, rid, u) for u, v in merged(list(zip(lo[gone].tolist(), stop[gone].tolist())))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["h", "segment", "did", "rid", "at"])


# ---- classes of equal windows -------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, segment: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Order of the suffixes of segments that end in unique symbols (0, ordered by segment), by prefix doubling."""
    n = len(symbols)
    used = np.bincount(symbols, minlength=257) > 0
    dense = (np.cumsum(used) - used[0])[symbols]  # 0 stays 0
    bits = max(1, int(dense.max(initial=1)).bit_length())
    wide = 2 * _ID // bits
    key = dense << (bits * (wide - 1))
    for j in range(1, wide):
        inside = to_end[: n - j] >= j
        key[: n - j] |= np.where(inside, dense[j:], 0) << (bits * (wide - 1 - j))
    segments = int(segment[-1]) + 1
    while True:
        if n > _LOW:
            order = np.argsort(key)
            key = key[order]
        else:
            packed = np.sort((key << _ID) | np.arange(n))
            order, key = packed & _LOW, packed >> _ID
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        follow = segment.astype(np.int64)  # the end is within the prefix: its segment decides
        inside = np.flatnonzero(to_end >= wide)
        follow[inside] = rank[inside + wide] + segments
        key = (rank << (_ID if n <= _LOW else 32)) | follow
        wide *= 2


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and each one's range."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size), which


def short_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place p in the order: whether suffixes p - 1 and p have a common prefix of under `length`."""
    n = len(order)
    bwt = symbols[order - 1]  # before a segment's start stands another's end (0)
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    del by_symbol
    ends = int((symbols == 0).sum())
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for value in range(length):
        at, which = _ragged(lo, hi)
        symbol = bwt[at]
        use = symbol > 0
        to, which, symbol = back[at[use]], which[use], symbol[use]
        sort = _order(n, to)
        to, which, symbol = to[sort], which[sort], symbol[sort]
        first = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1] + 1) | (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])])) if len(to) else np.zeros(0, np.int64)
        lo, hi = to[first], to[np.append(first[1:], len(to)) - 1] + 1 if len(to) else to
        if value == 0:  # each end is a symbol of its own
            lo, hi = np.append(np.arange(ends), lo), np.append(np.arange(ends) + 1, hi)
        fresh_place = ~known[hi]
        lo, hi = lo[fresh_place], hi[fresh_place]
        known[hi] = True  # the common prefix there is `value`
        if not len(hi):
            break
    return known[:n]


def repeated_windows(segments: list[bytes], docs: np.ndarray, rids: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that also start earlier: segment, first and last window (both within the segment)."""
    size = np.array([len(s) for s in segments])
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(size + 1) - 1
    symbols[ends] = 0
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), size + 1)
    to_end = (ends[segment] - np.arange(len(symbols))).astype(np.int32)
    order = suffix_array(symbols, segment, to_end)
    group = np.cumsum(short_prefixes(symbols, order, length), dtype=np.int32)
    window = to_end[order] >= length
    at, group = order[window], group[window].astype(np.int64)
    total = len(symbols)
    del symbols, to_end, order, window
    own = segment[at]
    offset = at - (ends - size)[own]
    rank = np.empty(len(segments), np.int64)
    document = np.lexsort((rids, docs))
    rank[document] = np.cumsum(np.concatenate([[0], (docs[document][1:] != docs[document][:-1]) | (rids[document][1:] != rids[document][:-1])]))
    # within a document, segments hold windows that come one after the other: their order is their windows'
    earlier = np.empty(len(segments), np.int64)
    earlier[np.lexsort((places, rank))] = np.arange(len(segments))
    sort = _order(total, group, earlier[own])
    later = np.concatenate([[False], group[sort][1:] == group[sort][:-1]])
    own, offset = own[sort][later], offset[sort][later]
    sort = np.argsort((own.astype(np.int64) << 32) | offset)
    own, offset = own[sort], offset[sort]
    if not len(own):
        return own, offset, offset
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    return own[first], offset[first], offset[np.append(first[1:], len(own)) - 1]


#: Spans (key 0 parts null), and windows of oversized groups, which are told apart by two hashes.
FOUND = "key bigint, other bigint, did bigint, rid bigint, start int, stop int"
_FOUND = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch], length: int, most: int, most_of_group: int) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (h, segment, did, rid, at)."""
    held: list[tuple] = []  # distinct segments with their earliest place: whole groups, then the current one
    whole = held_bytes = group_bytes = 0
    group, last, first_place, oversized = None, None, None, False
    out: list[tuple] = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _FOUND)], schema=_FOUND)

    def classes(rows):
        docs, rids, at = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        for k, a, b in zip(*(x.tolist() for x in repeated_windows([r[0] for r in rows], docs, rids, at, length))):
            lo = int(at[k])
            out.append((rows[k][2], None, rows[k][1], rows[k][2], lo + a, lo + b + length))

    def windows(segment, doc, rid, at):
        data = np.frombuffer(segment, np.uint8)
        begin = np.arange(len(data) - length + 1)
        one = span_hashes(data, begin, begin + length)
        two = mix(span_hashes(data, begin, begin + length // 2) + mix(span_hashes(data, begin + length // 2, begin + length)))
        for k, (x, y) in enumerate(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist())):
            out.append((x, y, doc, rid, at + k, at + k + length))

    for batch in batches:
        for h, segment, doc, rid, at in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if h is None:
                out.append((rid, None, doc, rid, at, at + int.from_bytes(segment, "little")))
                continue
            if h == group and segment == last:
                if (doc, rid, at) != first_place:
                    out.append((rid, None, doc, rid, at, at + len(segment)))
                continue
            if h != group:
                if held_bytes >= most:
                    classes(held)
                    held, held_bytes = [], 0
                    yield batch_of(out)
                    out = []
                group, oversized, whole, group_bytes = h, False, len(held), 0
            last, first_place = segment, (doc, rid, at)
            if oversized:
                windows(segment, doc, rid, at)
            else:
                held.append((segment, doc, rid, at))
                held_bytes += len(segment) + 1
                group_bytes += len(segment) + 1
                if group_bytes > most_of_group:
                    for r in held[whole:]:
                        windows(*r)
                    del held[whole:]
                    held_bytes -= group_bytes
                    oversized = True
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)
        out = []
    if held:
        classes(held)
    yield batch_of(out)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (key, other, did, rid, start): spans pass, of equal windows all but the first do."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        span = np.asarray(batch.column("other").is_null())
        key = batch.column("key").to_numpy()
        other = batch.column("other").fill_null(0).to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (other[1:] == other[:-1]) & ~span[:-1]
        if last is not None:
            same[0] = (key[0], other[0]) == last
        last = None if span[-1] else (key[-1], other[-1])
        yield batch.filter(pa.array(span | same)).select(["did", "rid", "start", "stop"])


# ---- the operator -------------------------------------------------------------------------------


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


ROW = ("did", "rid")


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """df's columns as c0, c1, ... with what tells documents apart: did, the id (the least number for a null), and rid, a hash of id and text."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    least = F.lit(-(1 << 63)).cast("long")
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()], F.coalesce(F.col(doc_id).cast("long"), least).alias("did"), F.xxhash64(doc_id, text).alias("rid"), F.col(text).alias("text"))
    return rows.drop(names[text])


def repeats(rows: DataFrame, dealt: DataFrame, *, length: int = LENGTH, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(did, rid, spans): byte spans to remove from each document that has any; rows: those of keyed(), dealt: the same dealt by ROW."""
    found = rows.select(*ROW, "text").mapInArrow(lambda batches: _anchor_rows(batches, length), "h bigint, whole bigint, more int, did bigint, rid bigint, at bigint")
    again = found.repartition(F.coalesce("h", "rid")).sortWithinPartitions("h", "whole", "more", *ROW, "at").mapInArrow(_collapse, "h bigint, did bigint, rid bigint, at bigint")
    places = again.groupBy(*ROW).agg(F.collect_list(F.struct("h", "at")).alias("places"))  # bounded by the document's own length
    # all columns go into this step, though it reads few of them: pruned ones would need an exchange of their own
    cut = dealt.join(places, list(ROW)).mapInArrow(lambda batches: _segment_rows(batches, length), "h bigint, segment binary, did bigint, rid bigint, at bigint")
    grouped = cut.repartition(F.coalesce("h", "rid")).sortWithinPartitions("h", "segment", *ROW, "at")
    spans = grouped.mapInArrow(lambda batches: _find(batches, length, batch_bytes, group_bytes), FOUND)
    spans = spans.repartition("key").sortWithinPartitions("key", "other", *ROW, "start").mapInArrow(_resolve, "did bigint, rid bigint, start int, stop int")
    return spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def deduplicate(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", kept: str = "kept_bytes", kept_text: str = "kept_text", spans: str = "spans", length: int = LENGTH, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """df with `kept`, the remaining bytes of the text, `kept_text`, those that are whole characters, and `spans`, the maximal removed runs of bytes."""
    kept, kept_text, spans = fresh(df, kept, kept_text, spans)
    rows = keyed(df, doc_id, text)
    dealt = rows.repartition(*ROW)  # whole rows move once: both joins read this one exchange
    found = repeats(rows, dealt, length=length, batch_bytes=batch_bytes, group_bytes=group_bytes)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    names = [f"c{k}" for k, c in enumerate(df.columns) if c != text]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, runs = [], []
            for x, s in zip(batch.column("text"), batch.column("spans")):
                data, at, rest = (x.as_py() or "").encode(), 0, []
                gone = merged([(p["start"], p["stop"]) for p in s.as_py() or ()])
                for a, b in gone:
                    rest.append(data[at:a])
                    at = b
                bodies.append(b"".join([*rest, data[at:]]) if gone else data)
                runs.append([{"start": a, "stop": b} for a, b in gone])
            made = [pa.array(bodies, pa.binary()), pa.array([b.decode(errors="ignore") for b in bodies], pa.string()), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "text")), *made], [*names, "text", "kept", "rest", "gone"])

    # as a step over whole rows: where a column isn't used further on, the exchange would be pruned for this join alone and not be shared
    whole = T.StructType([dealt.schema[c] for c in (*names, "text")]).add("kept", T.BinaryType()).add("rest", T.StringType()).add("gone", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())))
    out = dealt.join(found, list(ROW), "left").mapInArrow(remove, whole)
    own = [F.col("text" if c == text else f"c{k}").alias(c) for k, c in enumerate(df.columns)]
    return out.select(*own, F.col("kept").alias(kept), F.col("rest").alias(kept_text), F.col("gone").alias(spans))
