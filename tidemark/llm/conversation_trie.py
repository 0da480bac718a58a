"""Operator 12, the prefix trie of conversations from padded turn-id matrices.

A conversation's turns are cut into blocks of WIDTH; a block is a row of a
matrix, with the digest of all turns before it in front and padded at its end.
Rows are dealt out by ranges of their whole sequence of digests. In a range
NumPy gives the turns dense ids, sorts the padded matrix with lexsort, marks
where each column changes, and accumulates the marks over the columns with OR: a
mark that stands is a node's first row. reduceat over these rows gives every
depth's members, smallest member and children. A node that goes on in another
range, or below its block, is open: its parts are put together by its digest.

What a subtree adds up is a sum over its members' rows (a node counts at the
first row that has it, a childless node at the last), so ranges only need to
know the last row before them and the first after them. Rows of a conversation's
later blocks are summed up first and carried to its earlier blocks.

A conversation that holds a third of all turns is as many rows as it has blocks,
and places of turns are counted by ranges too; a sequence that a third of all
conversations share is split between ranges by conversation. A node's members
that end there are hashed as one stream, in chunks.

A turn is known by 128 bits of hash over its depth and an MD5 digest.

Defined cases: rows without a conv_id belong to no conversation; a null turn
comes first; turns of one number stand in the order of their digests (MD5 of the
role's length, a colon, role and text), repeated rows one after another; null
roles and texts are empty; extra columns are not read; an empty table has no
nodes, not even a root; texts of any length are read whole, and only their
digests and lengths are shuffled.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, shared_folder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 16
RANGE_ROWS = 20_000
GROUP = 100
HEADS = 6
EMPTY = hashlib.sha256(b"").hexdigest()


def _checkpoint(df: DataFrame) -> DataFrame:
    """checkpoint() keeps partitions apart, so that a range keeps its number."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and size (code points) of every turn; places are counted range by range."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    turns = stored(turns)
    by = ("conv_id", "turn", "digest", "row")
    ranges = max(1, -(-turns.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = np.asarray(b.column(0))
            if not len(ids):
                continue
            row = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(np.r_[True, ids[1:] != ids[:-1]], row, 0))
            place = row - first + np.where(first == 0, seen if ids[0] == conv else 0, 0)
            conv, seen = ids[-1], place[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(place), pa.array(np.full(len(ids), part, np.int32))], names=["conv_id", "digest", "size", "place", "part"]
            )

    dealt = turns.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("conv_id", "digest", "size")
    dealt = stored(dealt.mapInArrow(run, "conv_id long, digest string, size long, place long, part int"))
    edges = dealt.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).orderBy("part").collect()
    before, conv, seen = [], None, 0  # a row for each range that goes on with a conversation
    for r in edges:
        if r.first == conv:
            before.append((r.part, conv, seen))
        seen = r.last.place + 1 + (seen if r.last.conv_id == conv else 0)
        conv = r.last.conv_id
    before = dealt.sparkSession.createDataFrame(before, "part int, conv_id long, before long")
    moved = dealt.join(F.broadcast(before), ["part", "conv_id"], "left")
    return moved.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, place, digest and size: the first h turns of each group's first conversation, then the own turns after the first h.

    A conversation also has one row of place -1, so that one without turns stays.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    heads = (
        turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS - 1)).groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("head"))
    )
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<place:long,digest:string,size:long>>")), F.lit(1), h.cast("int"))
    known = stored(convs.join(heads, "base", "left").select("conv_id", head.alias("head"), F.greatest(F.col("own") - h, F.lit(0)).alias("rest")))
    shift, n = F.size("head"), (F.size("head") + F.col("rest")).alias("n_turns")
    own = turns.where(F.col("place") >= h).join(known.select("conv_id", shift.alias("shift"), n), "conv_id")
    return (
        own.select("conv_id", "n_turns", (F.col("place") - h + F.col("shift")).alias("place"), "digest", "size")
        .unionByName(known.select("conv_id", n, F.explode("head").alias("t")).select("conv_id", "n_turns", "t.*"))
        .unionByName(known.select("conv_id", n, F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("size")))
    )


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, block, key (binary: block, digest of what stands before, the turns' digests), sizes and more (the conversation goes on)."""
    block = F.floor(F.greatest("place", F.lit(0)) / WIDTH)
    lane = lambda i: F.xxhash64(F.lit(i), "place", "digest")
    real = F.col("place") >= 0
    each = stored(
        turns.withColumns({"block": block, "x1": lane(1), "x2": lane(2)}).groupBy("conv_id", "n_turns", "block").agg(
            F.array_sort(F.collect_list(F.when(real, F.struct("place", "x1", "x2", "size")))).alias("turns"),
            *(F.coalesce(F.bit_xor(F.when(real, F.col(x))), F.lit(0)).alias(x) for x in ("x1", "x2")),
        )
    )
    zero = F.lit(0).cast("long")
    by = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("n_turns") > WIDTH
    before = lambda x: F.coalesce(F.bit_xor(x).over(by), zero)
    every = each.where(~long).withColumns({"p1": zero, "p2": zero}).unionByName(each.where(long).withColumns({"p1": before("x1"), "p2": before("x2")}))
    text = F.array_join(F.transform("turns", lambda t: F.concat(_hex(t["x1"]), _hex(t["x2"]))), "")
    return every.select(
        "conv_id", "n_turns", "block", F.unhex(F.concat(_hex(F.col("block")), _hex(F.col("p1")), _hex(F.col("p2")), text)).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"), (F.col("n_turns") > (F.col("block") + 1) * WIDTH).alias("more"),
    )


def _shared(a: bytes | None, b: bytes) -> int:
    """Columns (the front is column 0) that two rows share from the start."""
    if a is None or a[:24] != b[:24]:
        return 0
    n = 0
    while n < min(len(a), len(b)) // 16 - 1 and a[24 + 16 * n : 40 + 16 * n] == b[24 + 16 * n : 40 + 16 * n]:
        n += 1
    return n + 1


def _dense(*lanes: np.ndarray) -> np.ndarray:
    """Ids from 0 in the order of the lanes."""
    order = np.lexsort(lanes[::-1])
    change = np.zeros(len(order), dtype=np.int64)
    if len(order):
        change[1:] = np.any([x[order][1:] != x[order][:-1] for x in lanes], axis=0)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(change)
    return out


class Matrix:
    """The rows of one range, sorted, with their marks."""

    def __init__(self, table: pa.Table, before: bytes | None, after: bytes | None):
        key = table.column("key").combine_chunks().cast(pa.large_binary())
        n = len(key)
        bounds = np.frombuffer(key.buffers()[1], dtype=np.int64)[key.offset : key.offset + n + 1]
        words = np.frombuffer(key.buffers()[2], dtype=">u8")
        at = bounds[:-1] // 8
        size = (bounds[1:] - bounds[:-1] - 24) // 16
        row, column = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(at + 3, size) + 2 * column
        x1, x2 = words[place].astype(np.uint64), words[place + 1].astype(np.uint64)
        block, p1, p2 = (words[at + i].astype(np.uint64) for i in range(3))
        ids = np.full((n, WIDTH), -1, dtype=np.int64)
        ids[row, column] = _dense(x1, x2)
        front = _dense(block, p1, p2)
        conv, more = (np.asarray(table.column(c).combine_chunks()) for c in ("conv_id", "more"))
        order = np.lexsort((conv, more, *ids.T[::-1], front))
        self.order, self.conv, self.more, self.size, self.block = order, conv[order], more[order], size[order], block[order].astype(np.int64)
        ids, front = ids[order], front[order]
        change = np.ones((n, WIDTH + 1), dtype=bool)
        change[1:, 0] = front[1:] != front[:-1]
        change[1:, 1:] = ids[1:] != ids[:-1]
        self.change = np.logical_or.accumulate(change, axis=1)
        self.before, self.after = _shared(before, key[int(order[0])].as_py()), _shared(after, key[int(order[-1])].as_py())
        there = np.arange(WIDTH + 1) <= self.size[:, None]
        #: Where a node of the whole trie starts.
        self.new = self.change & there
        self.new[0] &= np.arange(WIDTH + 1) >= self.before
        length = np.zeros((n, WIDTH + 1), dtype=np.int64)
        length[row, column + 1] = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.length = length[order]
        nodes = np.zeros((2, n, WIDTH + 1), dtype=np.uint64)
        for lane, (front_lane, x) in enumerate(((p1, x1), (p2, x2))):
            nodes[lane, :, 0] = front_lane
            nodes[lane, row, column + 1] = x
        self.nodes = np.bitwise_xor.accumulate(nodes[:, order], axis=2).view(np.int64)
        #: Is the row the last that has the node where it ends, and does nothing go on there?
        goes_on = np.empty(n, dtype=bool)
        goes_on[:-1] = ~self.change[1:][np.arange(n - 1), self.size[:-1]]
        goes_on[-1] = self.after > self.size[-1]
        self.leaf = (~goes_on & ~self.more).astype(np.int64)


def _each_range(dealt: DataFrame, edges: dict, work, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            part = TaskContext.get().partitionId()
            yield from work(pa.Table.from_batches(batches), part, *edges[part])

    return dealt.mapInArrow(run, schema)


def _dealt(rows: DataFrame) -> tuple[DataFrame, dict]:
    """rows by ranges of about RANGE_ROWS, and of each range the last key before it and the first after it."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = _checkpoint(rows.repartitionByRange(ranges, "key", "more", "conv_id"))
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect()
    keys = [None, *ends, None]  # two keys of at most 24 + 16 * WIDTH bytes for each range
    return dealt, {
        b.part: (a and bytes(a.high), c and bytes(c.low)) for a, b, c in zip(keys, keys[1:], keys[2:], strict=False) if b
    }


def with_tails(rows: DataFrame) -> DataFrame:
    """rows of blocks() and what their conversation's later blocks add: tail_all (sizes), tail_new (sizes of nodes that start there), tail_leaf."""
    zero = F.lit(0).cast("long")
    names = ("tail_all", "tail_new", "tail_leaf")
    short = rows.where(f"n_turns <= {WIDTH}").select("*", *(zero.alias(x) for x in names))
    long = rows.where(f"n_turns > {WIDTH}")
    if long.isEmpty():
        return short
    dealt, edges = _dealt(long)

    def work(table: pa.Table, part: int, before, after) -> Iterator[pa.RecordBatch]:
        m = Matrix(table, before, after)
        sums = (m.length.sum(axis=1), (m.length * m.new).sum(axis=1), m.leaf)
        yield from table.take(pa.array(m.order)).append_column("a", pa.array(sums[0])).append_column("b", pa.array(sums[1])).append_column("c", pa.array(sums[2])).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", a long, b long, c long"
    by = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = _each_range(dealt, edges, work, schema)
    tails = {x: F.coalesce(F.sum(c).over(by), zero) for x, c in zip(names, "abc", strict=True)}
    return short.unionByName(sums.withColumns(tails).drop("a", "b", "c"))


_NODE = (
    "id1 long, id2 long, depth long, open boolean, conv_id long, up1 long, up2 long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, chunk string, part int"
)


def _nodes(table: pa.Table, part: int, before, after) -> Iterator[pa.RecordBatch]:
    m = Matrix(table, before, after)
    n = len(m.conv)
    tail_all, tail_new, tail_leaf = (np.asarray(table.column(c).combine_chunks())[m.order] for c in ("tail_all", "tail_new", "tail_leaf"))
    leaves = m.leaf + tail_leaf
    # from each column to the end of the row: every member's sizes less those of the nodes themselves
    saved = np.cumsum((m.length * ~m.new)[:, ::-1], axis=1)[:, ::-1] + (tail_all - tail_new)[:, None]
    up_open, up_conv, up_first = None, None, None
    for j in range(WIDTH + 1):
        first = np.flatnonzero(m.change[:, j])
        count = np.diff(np.r_[first, n])
        conv = np.minimum.reduceat(m.conv, first)
        last = first + count - 1
        is_open = ((first == 0) & (m.before > j)) | ((last == n - 1) & (m.after > j)) | (j == 0)
        if j == WIDTH:
            is_open |= np.logical_or.reduceat(m.more, first)
        children = np.add.reduceat(m.new[:, j + 1].astype(np.int64), first) if j < WIDTH else np.zeros(len(first), np.int64)
        ended = (m.size == j) & ~m.more
        n_ended = np.add.reduceat(ended.astype(np.int64), first)
        there = m.size[first] >= j
        below = (j == 0) & (m.block[first] > 0)  # the node itself is in the block before; only its children are known here
        if j:
            up = np.searchsorted(up_first, first, side="right") - 1
            parent, hidden = up_conv[up], up_open[up]
        else:
            parent, hidden = conv, np.ones(len(first), dtype=bool)
        ends, chunks = [EMPTY] * len(first), [None] * len(first)
        for i in np.flatnonzero((n_ended > 0) & there):
            joined = ",".join(map(str, m.conv[first[i] : first[i] + n_ended[i]]))  # those that end here come first, by conv_id
            if is_open[i]:
                chunks[i] = joined
            else:
                ends[i] = hashlib.sha256(joined.encode()).hexdigest()
        own = ~below
        columns = [
            pa.array(m.nodes[0][first, j]), pa.array(m.nodes[1][first, j]), pa.array(m.block[first] * WIDTH + j), pa.array(is_open),
            pa.array(conv, mask=below), pa.array(m.nodes[0][first, max(j - 1, 0)], mask=np.full(len(first), j == 0)),
            pa.array(m.nodes[1][first, max(j - 1, 0)], mask=np.full(len(first), j == 0)), pa.array(parent, mask=hidden),
            pa.array(count * own), pa.array(children), pa.array(np.add.reduceat(leaves, first) * own),
            pa.array(np.add.reduceat(saved[:, j], first) * own), pa.array(ends, pa.string()), pa.array(chunks, pa.string()),
            pa.array(np.full(len(first), part, np.int32)),
        ]
        names = [x.split()[0] for x in _NODE.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(there))
        up_open, up_conv, up_first = is_open, conv, first


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come one after another: one node's state at a time."""
    node, state = None, None
    for b in batches:
        out = []
        for a, c, chunk in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, c) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, c), hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["id1", "id2", "sha"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["id1", "id2", "sha"])


def trie(turns: DataFrame) -> DataFrame:
    """One row a node of the prefix trie of rebuilt() turns; see query()."""
    dealt, edges = _dealt(stored(with_tails(blocks(turns))))
    rows = stored(_each_range(dealt, edges, _nodes, _NODE))
    chunks = rows.where("chunk is not null").select("id1", "id2", "chunk", "part")
    shas = chunks.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "part").select("id1", "id2", "chunk").mapInArrow(_hashed, "id1 long, id2 long, sha string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ids = ["id1", "id2"]
    opened = stored(
        rows.where("open").groupBy(*ids).agg(
            F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("up1").alias("up1"), F.max("up2").alias("up2"),
            F.max("parent_conv_id").alias("parent_conv_id"), *sums,
        ).join(shas, ids, "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")
    )
    above = opened.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("above"))
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    shut = rows.where("not open")
    every = shut.where("parent_conv_id is null").select(*out, "up1", "up2").unionByName(opened.select(*out, "up1", "up2"))
    found = every.join(above, ["up1", "up2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return shut.where("parent_conv_id is not null").select(*out).unionByName(found.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(ordered(read_table(spark, sf_dir, "conversations"))))


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, g, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS place
  FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', role, text)) AS g, length(coalesce(text, '')) AS size FROM conversations)
  WHERE conv_id IS NOT NULL
),
bytes AS (SELECT DISTINCT c, [ascii(substr(CAST(c AS VARCHAR), i, 1)) FOR i IN range(1, length(CAST(c AS VARCHAR)) + 1)] AS b FROM t),
hashed AS (
  SELECT c, c - c % {GROUP} AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % {HEADS} AS h
  FROM bytes
),
v AS (SELECT h.*, least(h, coalesce(n, 0)) AS k FROM hashed h LEFT JOIN (SELECT c AS base, count(*) AS n FROM t GROUP BY c) USING (base)),
r AS (
  SELECT v.c, place AS d, g, size FROM v JOIN t ON t.c = v.base AND place < h
  UNION ALL SELECT v.c, place - h + k, g, size FROM v JOIN t ON t.c = v.c AND place >= h
),
paths AS (SELECT v.c, coalesce(string_agg(g, '' ORDER BY d), '') AS path, count(d) AS len FROM v LEFT JOIN r ON r.c = v.c GROUP BY v.c),
members AS (SELECT c, len, d, substr(path, 1, 32 * d) AS node FROM (SELECT *, unnest(range(0, len + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, m.d, min(m.c) AS conv_id, count(*) AS n_convs, coalesce(max(size), 0) AS size,
    coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE m.d = len), '') AS ends
  FROM members m LEFT JOIN r ON r.c = m.c AND r.d = m.d - 1 GROUP BY node, m.d
),
children AS (SELECT substr(node, 1, 32 * (d - 1)) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
flat AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
sums AS (
  SELECT substr(node, 1, 32 * e) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM flat) GROUP BY 1
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flat f JOIN sums USING (node) LEFT JOIN nodes p ON f.d > 0 AND p.node = substr(f.node, 1, 32 * (f.d - 1))
"""
