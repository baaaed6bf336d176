"""Operator 11: the trie of conversations' common beginnings, built and rolled up level by level.

A path is a conversation's sequence of turns. Every distinct beginning of d turns is a node of depth d,
known by its depth and its smallest member. At each depth the live paths are grouped by (parent node,
next turn), and the smallest id names the group; then, from the deepest level up, joins of a level with
its children roll up leaves and savings.

At scale. A turn is known by the SHA-256 digest of role and text, so texts are read once and never
shuffled; what moves is some fifty bytes a turn. Turns are numbered, and summed, in blocks of BLOCK
within a conversation, so one giant conversation is dealt over many tasks. Equal paths are one class
with a weight (known by 128 bits over all their turns and the number of turns), so a hot conversation
is counted by partial sums before any level. A class alone in its node shares nothing further down:
it leaves the live set, and its remaining nodes are its own turns. So as many levels are run as paths
that differ have turns in common, over fewer and fewer rows; groups are found by partial aggregation
and given back by a join, which splits hot groups. Each level is a table in the shared folder.

A class's ids are listed in blocks of 2^BLOCK_BITS consecutive ids. The digest of a list of several
blocks is computed by streaming them in order through one hash state, as SHA-256 requires; memory is
a block at a time.

Defined cases: a null role or text is empty; a null turn comes first; equal turns of a conversation go
by the digest of role and text; repeated rows are turns of their own; rows with a null id belong to no
conversation; an empty table has no nodes, not even a root; long texts matter by their digest and size
alone; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._common import drop_table, written

BLOCK, BLOCK_BITS = 1 << 12, 14
NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def running(rows: DataFrame, key: str, at: Column, order: list[Column], value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """rows with `out`: the sum of value over the key's rows up to each one in order.

    order must begin with `at`, a number; a key's rows are dealt out by blocks of it, nulls first.
    """
    blocked = rows.withColumn("__block", F.coalesce(F.floor(at / block), F.lit(-(1 << 62)))).withColumn("__value", value)
    inside = F.sum("__value").over(Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_block = blocked.groupBy(key, "__block").agg(F.sum("__value").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    later_blocks = per_block.withColumn("__before", earlier).filter("__before IS NOT NULL").drop("__sum")
    return blocked.withColumn(out, inside).join(later_blocks, [key, "__block"], "left").withColumn(out, (F.col(out) + F.coalesce("__before", F.lit(0))).cast("long")).drop("__block", "__value", "__before")


def turns_of(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, position from 1, sig, bytes) of every turn; a table in the shared folder."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sig = F.unhex(F.sha2(F.concat(F.octet_length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)), 256))
    slim = df.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), sig.alias("sig"), F.octet_length(empty(text)).cast("long").alias("bytes"))
    slim, path = written(slim)
    numbered = running(slim, "conv_id", F.col("turn"), [F.asc_nulls_first("turn"), F.asc("sig")], F.lit(1), "position", block)
    out = written(numbered.select("conv_id", "position", "sig", "bytes"))[0]
    drop_table(df.sparkSession, path)
    return out


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Paths of conversations that begin with another one's first turns, and all ids.

    base and heads are of `conv_id`: the other conversation, and of how many (at most `most`) of its first turns
    the conversation's own first ones are replaced by. (conv_id, depth, sig, bytes), and (conv_id).
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    asked = sizes.select("conv_id", base.alias("base"), heads.alias("h"))
    convs = asked.join(sizes.select(F.col("conv_id").alias("base"), "size"), "base", "left").withColumn("taken", F.least("h", F.coalesce("size", F.lit(0)))).select("conv_id", "base", "h", "taken")
    own = turns.join(convs, "conv_id").filter("position > h").select("conv_id", (F.col("taken") + F.col("position") - F.col("h")).cast("long").alias("depth"), "sig", "bytes")
    first = turns.filter(F.col("position") <= most).select(F.col("conv_id").alias("base"), "position", "sig", "bytes")
    lent = convs.filter("taken > 0").join(first, "base").filter("position <= h").select("conv_id", F.col("position").cast("long").alias("depth"), "sig", "bytes")
    # the levels read by depth: in this order a reader skips the pages of other depths
    return written(own.unionByName(lent).sortWithinPartitions("depth"))[0], sizes.select("conv_id")


def classes_of(paths: DataFrame, ids: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(cid, w, len, ends) of each distinct path: smallest id, number of ids, turns, digest of the ids; a table in the shared folder."""
    marked = paths.select("conv_id", "depth", "sig").unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("sig")))
    mark = lambda *c: F.coalesce(F.bit_xor(F.when(F.col("depth").isNotNull(), F.xxhash64(*c))), F.lit(0))
    key = ["x", "y", "len"]
    known = marked.groupBy("conv_id").agg(mark("depth", "sig").alias("x"), mark(F.lit("second"), "sig", "depth").alias("y"), F.count("depth").alias("len"))
    listed = known.groupBy(*key, F.shiftright("conv_id", bits).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # 2^bits ids at most
    blocks, path = written(listed.select(*key, "block", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("listed")))
    found = blocks.groupBy(*key).agg(F.min("first").alias("cid"), F.sum("n").alias("w"), F.count("*").alias("blocks"), F.min(F.sha2("listed", 256)).alias("ends"))
    several = found.filter("blocks > 1").select(*key)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in key], batch.column("listed")):
                if row[:3] != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[3].as_buffer())
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "digest"], r)) for r in out], schema)
            out = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "digest"], (*now, state.hexdigest())))], schema)

    schema = pa.schema([*[(c, pa.int64()) for c in key], ("digest", pa.string())])
    digests = blocks.join(several, key, "left_semi").repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(stream, "x bigint, y bigint, len bigint, digest string")
    out = written(found.join(digests, key, "left").select("cid", "w", "len", F.when(F.col("blocks") == 1, F.col("ends")).otherwise(F.col("digest")).alias("ends")))[0]
    drop_table(paths.sparkSession, path)
    return out


def trie(paths: DataFrame, ids: DataFrame, *, block: int = BLOCK, bits: int = BLOCK_BITS) -> DataFrame:
    """COLUMNS for each node of the paths (conv_id, depth from 1, sig, bytes), of which ids (conv_id) may have none."""
    spark = paths.sparkSession
    classes = classes_of(paths, ids, bits)
    top = classes.agg(F.min("cid").alias("root"), F.sum("w").alias("n_convs")).first()
    if top.root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # down: the live paths of each depth, by parent and next turn
    levels: list[DataFrame] = []
    used: list[str] = []
    live = classes.filter("len > 0").select("cid", F.lit(top.root).alias("parent"), "w", "len")
    while not live.isEmpty():
        depth = len(levels) + 1
        step = paths.filter(F.col("depth") == depth).select(F.col("conv_id").alias("cid"), "sig", "bytes")
        rows = live.join(step, "cid")
        groups = rows.groupBy("parent", "sig").agg(F.min("cid").alias("node"), F.sum("w").alias("n_convs"), F.count("*").alias("n_classes"))
        level, path = written(rows.join(groups, ["parent", "sig"]).select(F.lit(depth).cast("long").alias("depth"), "cid", "node", "parent", "n_convs", "n_classes", "bytes", "w", "len"))
        levels.append(level)
        used.append(path)
        live = level.filter((F.col("n_classes") > 1) & (F.col("len") > depth)).select("cid", F.col("node").alias("parent"), "w", "len")

    # classes alone in their node: from there on their own turns are the nodes
    digests = classes.select("cid", "ends")
    ended = classes.filter("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(top.root).alias("node"), "ends")
    chain = None
    if levels:
        every = levels[0]
        for table in levels[1:]:
            every = every.unionByName(table)
        alone = every.filter("n_classes = 1").select("cid", F.col("depth").alias("since"), "parent", "w", "len").join(digests, "cid")
        ended = ended.unionByName(every.filter("n_classes > 1 AND len = depth").join(digests, "cid").select("depth", "node", "ends"))
        own = paths.withColumnRenamed("conv_id", "cid").drop("sig").join(alone, "cid").filter("depth >= since")
        saving = (F.col("w") - 1) * F.col("bytes")
        summed = running(own.filter("w > 1"), "cid", -F.col("depth"), [F.desc("depth")], saving, "saved", block)
        chain = written(own.filter("w = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(summed))[0]

    # up: each level's nodes with several classes, from the deepest
    out, below = [], None
    for depth in range(len(levels), -1, -1):
        if depth:
            nodes = levels[depth - 1].filter("n_classes > 1 AND cid = node").select("node", "parent", "n_convs", "bytes")
        else:
            nodes = spark.range(1).select(F.lit(top.root).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(top.n_convs).alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
        if chain is not None and depth < len(levels):
            children = chain.filter((F.col("since") == depth + 1) & (F.col("depth") == depth + 1)).select("parent", F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
            children = children.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
            sums = children.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(sums, "node", "left")
        else:  # nodes of several paths have children, so the deepest level has none of them
            nodes = nodes.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved")})
        rolled = nodes.select(
            F.lit(depth).cast("long").alias("depth"),
            "node",
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        below, path = written(rolled)
        used.append(path)
        out.append(below)
    shared = out[0]
    for level in out[1:]:
        shared = shared.unionByName(level)
    shared = shared.join(ended, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    )
    shared = written(shared)[0]
    for path in used:
        drop_table(spark, path)
    if chain is None:
        return shared
    own = chain.select(
        F.col("cid").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("cid")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return shared.unionByName(own)
