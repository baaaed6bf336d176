"""Operator 7 for a wide distance: near copies by the similarity of their sets of word shingles.

At a Jaccard similarity of 0.8 about 15 % of a SimHash's bits differ, so 64 bits within three of each
other say little. Here a fingerprint has 512 bits, 64 positional bytes, made of the distinct shingles
of five words; of sets of similarity s, arccos(2 s / (1 + s)) / pi of the bits differ on average.

Index. A posting is made for each of BANDS combinations of three positional bytes, so a pair on one
list shares at least three, the least that the filter asks for. A posting carries eight more of the
positional bytes: a pair is a candidate if these differ in no more bits than those of the asked
similarity do, SPREAD standard deviations added (at 0.8, 99 in 100 are within that, and of unrelated
pairs 1 in 30,000). Nothing is decided by the estimate: each candidate's similarity is computed from
both sets of shingles, and links are the pairs that have it. A pair of similarity 0.8 shares a list
with a chance of some 0.94, one of 0.85 with 0.99, and a member of a group has many to be found by.

Dense groups. Nodes are distinct sets, so exact copies are one node, whatever their number. A list gives
all its near pairs, if these are LIST_PAIRS for each of its nodes or fewer. A denser one gives each
node with the PARTNERS smallest nodes that it is near, and stays open for the nodes of the pairs left out. Of what
a node's lists together give, its FEW smallest partners are compared; the other pairs are left for later. Most of a dense
group is connected by then, and a pair of connected nodes needs no look. So nodes meet again on those of their lists
that are open for them, with what they are connected to, and so do the ends of pairs left for later: near pairs that
aren't connected are compared, for each node MORE times as many in each round, until no node has had to leave one out;
a pair is told on the first only of the lists on which it is near. A pair that can't be alike is no row there: sets differ in at least as many shingles as their sizes do, and as there are parts of the
hashes' range (64 * LONGS of them) of which one has an odd number and the other an even one. Every near
pair of a list is then compared, connected, or shown not to be alike; only a group that is near by estimate
and by these bounds, and not alike by its sets, has all its pairs compared.

Rows are known by their id and a hash of their text. Texts move twice: those of candidates to be
compared, and all to meet the verdict.

Defined cases: texts without words, null ones included, have one (empty) set and form one group; texts
of fewer words than a shingle's are one shingle; a very long text is read in slices; rows equal in id
and text are one document, of which one row stays; of a group the least id stays (nulls before any);
other columns pass unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siltstone.llm._common import by_bytes, drop_table, flat, give_back, mix, shuffle_parts, word_hashes, written
from siltstone.llm.simhash import components
from siltstone.llm.suffix_dedup import ROW, keyed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, LONGS, SPREAD, PARTNERS = 200, 8, 2.5, 1
#: Pairs of a node with smaller ones that the first round compares, of all its lists together.
FEW = 16
#: Comparisons of a list and near pairs for each of its nodes beyond which it stays open, and the growth of a node's pairs from round to round.
LIST_CELLS, LIST_PAIRS, MORE = 1 << 20, 1, 64
PRINT, ODD = tuple(f"f{k}" for k in range(LONGS)), tuple(f"o{k}" for k in range(LONGS))
#: The bands whose lists are open for a node, a bit each.
OPEN = tuple(f"b{k}" for k in range(-(-BANDS // 64)))
PAIRS = f"u bigint, v bigint, {', '.join(f'{c} bigint' for c in OPEN)}"
_SALTS = mix(np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Three positional bytes for each band (63 of the 64 in each of several orders), and the eight that a posting carries: none of the three.
_TRIPLES = np.concatenate([np.random.default_rng(k).permutation(8 * LONGS)[: 8 * LONGS - 1].reshape(-1, 3) for k in range(-(-BANDS // 21))])[:BANDS]
_CARRIED = np.array([next(j for j in range(k, k + LONGS) if j % LONGS not in t // 8) % LONGS for k, t in enumerate(_TRIPLES)])


def bits_at(similarity: float, spread: float, bits: int = 64) -> int:
    """The differing bits that a pair of this similarity has on average, and `spread` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + spread * math.sqrt(bits * share * (1 - share)))


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z count as a-z."""
    words, per_text = word_hashes(*flat(text))
    first = np.concatenate([[0], np.cumsum(per_text)])
    for a, n in zip(first.tolist(), per_text.tolist()):
        if n < shingle:
            few = np.zeros(min(n, 1), np.uint64)
            for k in range(n):
                few = mix(few + words[a + k])
            yield few
            continue
        found = np.zeros(0, np.uint64)
        for lo in range(a, a + n - shingle + 1, 1 << 20):
            hi = min(lo + (1 << 20), a + n - shingle + 1)
            h = np.zeros(hi - lo, np.uint64)
            for k in range(shingle):
                h = mix(h + words[lo + k : hi + k])
            found = np.unique(np.concatenate([found, h])) if len(found) else np.unique(h)
        yield found


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """LONGS numbers of 64 bits; a bit is 1 if it is set in over half the shingles' hashes."""
    ones = np.zeros(64 * LONGS, np.int64)
    for a in range(0, len(shingles), 1 << 14):
        part = mix(shingles[a : a + (1 << 14), None] ^ _SALTS[None, :])
        bits = np.unpackbits(part.view(np.uint8), axis=1)
        for b in range(0, len(bits), 255):  # sums of 255 fit a byte
            ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def odd_parts(shingles: np.ndarray) -> np.ndarray:
    """LONGS numbers of 64 bits; a bit is 1 if its part of the hashes' range holds an odd number of the shingles."""
    part = (shingles >> np.uint64(64 - (64 * LONGS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.uint64)


def may_be_alike(sizes: np.ndarray, odds: np.ndarray, size: int, odd: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets may have the similarity to a further one: two differ in as many shingles as their sizes and as their odd parts do, or more."""
    apart = np.maximum(np.abs(sizes - size), np.bitwise_count(odds ^ odd).sum(axis=1, dtype=np.int64))
    return apart * (1 + similarity) <= (sizes + size) * (1 - similarity) + 1e-6


def first_met(prints: np.ndarray, own: np.ndarray, band: int, most: int) -> np.ndarray:
    """Which of the fingerprints are on no list of an earlier band together with a further one and near it there."""
    apart = prints ^ own
    same, bits, (x, y, z) = apart.view(np.uint8) == 0, np.bitwise_count(apart), _TRIPLES[:band].T
    return ~(same[:, x] & same[:, y] & same[:, z] & (bits[:, _CARRIED[:band]] <= most)).any(axis=1)


def list_pairs(node: np.ndarray, carried: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one list, each node with the PARTNERS smallest nodes whose carried bytes are within `most` bits of its own."""
    order = np.argsort(node)
    node, carried = node[order], carried[order]
    met, u, v, rest = np.zeros(len(node), np.int64), [node[:0]], [node[:0]], np.arange(len(node))
    for k in range(len(node) - 1):
        rest = rest[rest > k]
        near = rest[np.bitwise_count(carried[rest] ^ carried[k]) <= most]
        if len(near):
            u.append(np.full(len(near), node[k]))
            v.append(node[near])
            met[near] += 1
            rest = rest[met[rest] < PARTNERS]
        if not len(rest):
            break
    return np.concatenate(u), np.concatenate(v)


def whole_list(node: np.ndarray, carried: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one list, all pairs within `most` bits; if that is much, those of list_pairs() and each end of a pair left out with itself: the list stays open for it."""
    u, v = list_pairs(node, carried, most)
    if not len(v):
        return u, v
    order = np.argsort(node)
    node, carried = node[order], carried[order]
    later = np.flatnonzero(np.isin(node, v))  # who has a smaller near node
    if len(later) * len(node) <= LIST_CELLS:
        x, y = np.nonzero((np.bitwise_count(carried[later, None] ^ carried[None, :]) <= most) & (later[:, None] > np.arange(len(node))))
        if len(x) <= LIST_PAIRS * len(node):
            return node[y], node[later[x]]
        first, size = _runs(x)
        out = np.arange(len(x)) - np.repeat(first, size) >= PARTNERS
        node = node[np.union1d(later[x[out]], y[out])]
    return np.concatenate([u, node]), np.concatenate([v, node])


def apart_pairs(node: np.ndarray, carried: np.ndarray, root: np.ndarray, sets: list[np.ndarray], most: int, partners: int, similarity: float, band: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one list, pairs of different roots within `most` bits that may be alike: for each node outside the commonest root the `partners` smallest; where there are more, all concerned with themselves.

    sets: nothing, or the nodes' sizes and their odd parts, and their fingerprints, if a pair is to be told
    in the first band only of those where it is near.
    """
    order = np.argsort(node)
    node, carried, root, sets = node[order], carried[order], root[order], [x[order] for x in sets]
    roots, nodes = np.unique(root, return_counts=True)
    for k in np.flatnonzero(root != roots[nodes.argmax()]) if len(roots) > 1 else ():
        near = np.flatnonzero((np.bitwise_count(carried ^ carried[k]) <= most) & (root != root[k]))
        near = near[may_be_alike(*(x[near] for x in sets[:2]), *(x[k] for x in sets[:2]), similarity)] if sets else near
        near = node[near[first_met(sets[2][near], sets[2][k], band, most)] if len(sets) > 2 else near]
        yield np.minimum(near[:partners], node[k]), np.maximum(near[:partners], node[k])
        if len(near) > partners:
            yield np.append(near, node[k]), np.append(near, node[k])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once for each band, or for each of its OPEN ones if told, with the band and its three bytes as one number, eight more bytes, and its other columns."""
    for batch in batches:
        prints = np.stack([batch.column(c).to_numpy() for c in PRINT], axis=1)
        body = np.ascontiguousarray(prints).view(np.uint8).astype(np.int64)
        more = [c for c in batch.schema.names if c != "node" and c not in PRINT and c not in OPEN]
        bands = [batch.column(c).to_numpy() for c in OPEN] if OPEN[0] in batch.schema.names else None
        for k, (x, y, z) in enumerate(_TRIPLES):
            key = (k << 24) | (body[:, x] << 16) | (body[:, y] << 8) | body[:, z]
            rows = pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), batch.column(PRINT[_CARRIED[k]]), *map(batch.column, more)], ["key", "node", "carried", *more])
            rows = rows if bands is None else rows.filter(pa.array((bands[k // 64] >> (k % 64) & 1).astype(bool)))
            if rows.num_rows:
                yield rows


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of rows, as many whole lists at a time as have come: rows come in the order of their keys, the first column, and a list is held until it ends."""
    held: list[tuple] = []
    for batch in batches:
        now = tuple(batch.column(k).to_numpy() for k in range(batch.num_columns))
        if not len(now[0]):
            continue
        held.append(now)
        if held[0][0][0] == now[0][-1]:
            continue  # one list so far
        rows = tuple(np.concatenate(c) for c in zip(*held))
        last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1
        held = [tuple(c[last:] for c in rows)]
        yield tuple(c[:last] for c in rows)
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins, and its size."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key)))


def _rows(u: np.ndarray, v: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
    """The pairs, each once; a node with itself has the bits of its bands."""
    order = np.lexsort((u, v))
    u, v, band = u[order], v[order], band[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    bits = np.where((u == v) & (band // 64 == np.arange(len(OPEN))[:, None]), np.int64(1) << (band % 64), 0)
    bits = np.bitwise_or.reduceat(bits, np.flatnonzero(new), axis=1) if len(u) else bits
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (u[new], v[new], *np.ascontiguousarray(bits))], ["u", "v", *OPEN])


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray, int | np.ndarray]], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The pairs of a task's lists with their bands, `most` at a time: what several of them hold is told once."""
    held, n = [], 0
    for u, v, band in found:
        held.append((u, v, np.broadcast_to(band, len(u))))
        n += len(u)
        if n > most:
            yield _rows(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield _rows(*map(np.concatenate, zip(*held)))


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each list, and each node for which one stays open with itself."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, int | np.ndarray]]:
        for key, node, carried in _lists(batches):
            carried = carried.view(np.uint64)
            first, size = _runs(key)
            two = first[size == 2]
            two = two[np.bitwise_count(carried[two] ^ carried[two + 1]) <= most]
            yield np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1]), key[two] >> 24
            for a, n in zip(first[size > 2], size[size > 2]):
                yield *whole_list(node[a : a + n], carried[a : a + n], most), int(key[a]) >> 24

    yield from _gathered(found())


def _apart(batches: Iterator[pa.RecordBatch], most: int, partners: int, similarity: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """The same of open lists whose nodes have roots, and sizes, odd parts and fingerprints if told: near pairs that no root connects."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for key, node, carried, root, *sets in _lists(batches):
            carried = carried.view(np.uint64)
            sets = [sets[0], *(np.stack(sets[a : a + LONGS], axis=1).view(np.uint64) for a in range(1, len(sets), LONGS))] if sets else []
            for a, m in zip(*_runs(key)):
                own, band = slice(a, a + m), int(key[a]) >> 24
                for u, v in apart_pairs(node[own], carried[own], root[own], [x[own] for x in sets], most, partners, similarity, band):
                    yield u, v, band

    yield from _gathered(found())


def _thinned(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of the lists' rows (v, u, *OPEN), which come in this order, each once: pairs but for a node's `most` smallest partners are left for later."""
    for v, u, *bands in _lists(batches):
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])])
        bands = [np.bitwise_or.reduceat(b, np.flatnonzero(new)) for b in bands]
        v, u = v[new], u[new]
        before = np.cumsum(u != v) - (u != v)
        first, size = _runs(v)
        left = (u != v) & (before - np.repeat(before[first], size) >= most)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u, v, *bands, left)], ["u", "v", *OPEN, "left"])


def thinned(found: DataFrame, most: int) -> DataFrame:
    """Rows (u, v, *OPEN) of all lists as those of _thinned()."""
    return found.select("v", "u", *OPEN).repartition("v").sortWithinPartitions("v", "u").mapInArrow(lambda batches: _thinned(batches, most), f"{PAIRS}, left boolean")


def still_apart(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of different roots that may be alike, as may_be_alike() has it; known: (node, root, n, *ODD)."""
    for c in "uv":
        pairs = pairs.join(known.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("root", "n", *ODD))), c)
    parts = functools.reduce(operator.add, (F.bit_count(F.col(f"u_{o}").bitwiseXOR(F.col(f"v_{o}"))) for o in ODD))
    apart = F.greatest(F.abs(F.col("u_n") - F.col("v_n")), parts)
    return pairs.filter((F.col("u_root") != F.col("v_root")) & (apart * (1 + similarity) <= (F.col("u_n") + F.col("v_n")) * (1 - similarity) + 1e-6)).select("u", "v")


def set_links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, str]:
    """Of the pairs (u, v) of nodes those whose sets have the similarity; nodes: (node, winner), the ROW of a document with the set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in by_bytes(batch.column("text")):
                own = pa.array([s.view(np.int64) for s in shingle_sets(batch.column("text").slice(lo, hi - lo), shingle)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), own], ["node", "own"])
            give_back()

    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("node", "winner.*")
    own = rows.select(*ROW, "text").join(wanted, list(ROW)).dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node bigint, own array<bigint>")
    own, path = written(own)
    met = pairs.join(own.toDF("u", "left"), "u").join(own.toDF("v", "right"), "v")
    both = F.size(F.array_intersect("left", "right"))
    links, links_path = written(met.filter(both >= similarity * (F.size("left") + F.size("right") - both)).select("u", "v"))
    drop_table(rows.sparkSession, path)
    return links, links_path


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (of, root) after more links of nodes: only the components that these connect are gone through."""
    end = lambda c: roots.toDF(f"{c}_of", f"{c}_root")
    over = links.join(end("u"), F.col("u") == F.col("u_of"), "left").join(end("v"), F.col("v") == F.col("v_of"), "left")
    moved = components(over.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))).toDF("node", "now")
    kept = roots.join(moved, F.col("root") == F.col("node"), "left").select("of", F.coalesce("now", "root").alias("root"))
    return kept.unionByName(moved.join(roots, F.col("node") == F.col("of"), "left_anti").toDF("of", "root"))


def first_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that are the first of their group of near copies, with df's columns."""
    spark, most = df.sparkSession, bits_at(similarity, SPREAD)

    @arrow_udf(f"struct<{','.join(f'{c}:bigint' for c in (*PRINT, 'x', 'y', 'n', *ODD))}>")
    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The fingerprint, what tells sets apart (two sums over their hashes, and their size), and their odd parts."""
        for batch in texts:
            rows = []
            for lo, hi in by_bytes(batch):
                for s in shingle_sets(batch.slice(lo, hi - lo), shingle):
                    sums = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _SALTS[0]).sum(dtype=np.uint64), len(s)], np.uint64)
                    rows.append(np.concatenate([wide_print(s), sums, odd_parts(s)]))
            whole = np.stack(rows).view(np.int64) if rows else np.zeros((0, 2 * LONGS + 3), np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(whole[:, k])) for k in range(2 * LONGS + 3)], [*PRINT, "x", "y", "n", *ODD])
            give_back()

    rows = keyed(df, doc_id, text)
    told = rows.select(*ROW, mark(F.col("text")).alias("f")).select(*ROW, "f.*")
    nodes, nodes_path = written(told.groupBy(*PRINT, "x", "y", "n", *ODD).agg(F.min(F.struct(*ROW)).alias("winner")).withColumn("node", F.monotonically_increasing_id()))
    postings = nodes.select("node", *PRINT).mapInArrow(_postings, "key bigint, node bigint, carried bigint")
    found = postings.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key").mapInArrow(lambda batches: _candidates(batches, most), PAIRS)
    last, last_path = written(thinned(found, FEW))
    pairs = last.filter("u != v AND NOT left").select("u", "v")
    links, links_path = set_links(rows, nodes, pairs, shingle, similarity)
    roots, roots_path = written(components(links).toDF("of", "root"))
    gone, partners = [nodes_path, last_path, links_path, roots_path], MORE
    told = ("root", "n", *ODD, *(f"p{k}" for k in range(LONGS)))
    while not last.filter("u = v OR left").isEmpty():
        known = nodes.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
        still = known.join(last.filter("u = v").select(F.col("u").alias("node"), *OPEN), "node")
        still = still.select("node", *PRINT, *OPEN, "root", "n", *ODD, *(F.col(c).alias(f"p{k}") for k, c in enumerate(PRINT)))
        # a row becomes up to BANDS: dealt over all tasks before that
        postings = still.repartition(shuffle_parts(spark)).mapInArrow(_postings, f"key bigint, node bigint, carried bigint, {', '.join(f'{c} bigint' for c in told)}")
        found = postings.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key").mapInArrow(lambda batches, partners=partners: _apart(batches, most, partners, similarity), PAIRS)
        later = still_apart(last.filter("left"), known, similarity).select("u", "v", *(F.lit(0).cast("long").alias(c) for c in OPEN))
        last, last_path = written(thinned(found.join(pairs, ["u", "v"], "left_anti").unionByName(later), partners))
        gone.append(last_path)
        partners *= MORE
        now = last.filter("u != v AND NOT left").select("u", "v")
        if not now.isEmpty():
            pairs = pairs.unionByName(now)
            more, more_path = set_links(rows, nodes, now, shingle, similarity)
            gone.append(more_path)
            if not more.isEmpty():
                roots, roots_path = written(_joined(roots, more))
                gone.append(roots_path)
    rooted = nodes.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    winners, _ = written(rooted.groupBy("root").agg(F.min("winner").alias("winner")).select("winner.*"))
    for path in gone:
        drop_table(spark, path)
    own = [F.col("text" if c == text else f"c{k}").alias(c) for k, c in enumerate(df.columns)]
    return rows.join(winners, list(ROW), "left_semi").dropDuplicates(list(ROW)).select(*own)
