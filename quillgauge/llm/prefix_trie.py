"""The trie of conversation prefixes, from sorted sequences and their common prefix lengths.

Each conversation is the sequence of its turns' hashes. All sequences are sorted over the cluster;
in each partition the lengths of the prefixes that neighbours share (LCPs) go into a sparse table of
range minima. A node of the trie is a prefix of depth d first met at position i; its members are
the positions around i with no LCP below d between, and both extents are found on their own by
binary search in the table, for all prefixes of a partition at once. Sums over members and
subtrees are then differences of running sums over positions.

A node whose members lie in one partition is finished there. Only nodes that reach over a border
of partitions (at most one path of the trie a border) are put together afterwards from their
pieces. So a prefix that a third of all conversations share costs one row a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.arrays import mix, powers, ranges, running
from quillgauge.session import materialize

_PREFIX_BASE = 0x9E3779B97F4A7C15
#: Ids in one row of the table of ends.
CHUNK = 4096
#: Rows of the table of border nodes up to which it is broadcast.
BROADCAST_ROWS = 500_000


def rebuilt(conversations: DataFrame, families: int = 5, heads: int = 9) -> DataFrame:
    """Sequences that share openings: (conv_id, turns), turns an array of (a, b, bytes) in order.

    Conversation c gets the first h turns of c - c % ``families`` (h = crc32(c) % ``heads``), then its
    own after its first h. Turns are ordered by turn, nulls first, ties by role and text; null
    roles and texts are empty. Rows without conversation id are left out. ``a`` and ``b`` are two
    64-bit hashes of role and text, ``bytes`` the text's length in UTF-8.
    """
    own = turn_sequences(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(families))).alias("_base")
    opening = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_opening"))
    given = own.select("conv_id", base, h.alias("_h"), "turns").join(opening, "_base", "left")
    head = F.coalesce(F.slice("_opening", F.lit(1), F.col("_h")), F.array().cast(own.schema["turns"].dataType))
    return given.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of each conversation; see ``rebuilt`` for their order and hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    hashed = F.struct(
        place.alias("n"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(13), "text", "role").alias("b"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    grouped = turns.select("conv_id", hashed.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    return grouped.select("conv_id", F.transform("_t", lambda t: F.struct(t["a"], t["b"], t["bytes"])).alias("turns"))


def prefix_trie(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of (conv_id, turns), and the conversations that end in each.

    Nodes: (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) as
    in the operator's contract; ``node`` is a struct that names it. Ends: (node, first, ids), up to
    ``CHUNK`` ascending ids a row; the rows of a node, ordered by ``first``, give all of them. Without
    conversations there is no node. A conversation's turns are one row of 24 bytes a turn.
    """
    spark = sequences.sparkSession
    key = [F.col("turns.a"), F.col("turns.b")]
    flat = sequences.select(
        F.col("conv_id").cast("long").alias("conv_id"), *[c.alias(n) for c, n in zip(key, ("a", "b"))], F.col("turns.bytes").alias("bytes")
    )
    # a checkpoint keeps partitions and their order, so positions mean the same in every pass over it;
    # shorter sequences come before those they open, equal ones by id
    ordered = materialize(
        flat.withColumn("_ab", F.arrays_zip("a", "b")).repartitionByRange("_ab", "conv_id").sortWithinPartitions("_ab", "conv_id").drop("_ab")
    )
    edges = ordered.mapInArrow(_edges, "part int, first_a array<long>, first_b array<long>, last_a array<long>, last_b array<long>")
    # one row a partition that has rows
    order = Window.orderBy("part")
    borders = edges.select(
        "part",
        _common("first_a", "first_b", F.lag("last_a").over(order), F.lag("last_b").over(order)).alias("before"),
        _common("last_a", "last_b", F.lead("first_a").over(order), F.lead("first_b").over(order)).alias("after"),
    )
    known = ordered.withColumn("part", F.spark_partition_id()).join(F.broadcast(borders), "part", "left")
    node = "struct<depth:long,a:long,b:long>"
    pieces = materialize(known.mapInArrow(
        _pieces,
        f"kind string, node {node}, parent {node}, conv_id long, parent_conv_id long, n_convs long, n_children long,"
        " n_leaves long, saved_tokens long, first long, ids array<long>",
    ))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_nodes = materialize(
        pieces.filter("kind = 'open'").groupBy("node", "parent").agg(F.min("conv_id").alias("conv_id"), *sums)
    )
    few = open_nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    columns = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    owners = open_nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_owner"))

    def owned(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(owners) if few else owners, "parent", "left")

    closed = pieces.filter("kind = 'closed'")
    # most nodes know their parent's least member already; those right below a border node look it up
    below = owned(closed.filter("parent is not null")).withColumn("parent_conv_id", F.col("_owner"))
    shared = owned(open_nodes).withColumn("parent_conv_id", F.col("_owner"))
    found = [t.withColumn("depth", F.col("node.depth")).select(*columns) for t in (closed.filter("parent is null"), below, shared)]
    ends = pieces.filter("kind = 'ends'").select("node", "first", "ids")
    return found[0].unionByName(found[1]).unionByName(found[2]), ends


def _common(a: str, b: str, other_a: Column, other_b: Column) -> Column:
    """Length of the prefix that two sequences share; -1 where the other one is missing."""
    pairs = F.zip_with(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), F.arrays_zip(other_a.alias("x"), other_b.alias("y")), lambda s, t: s.eqNullSafe(t) & s.isNotNull() & t.isNotNull())
    shared = F.when(F.forall(pairs, lambda e: e), F.least(F.size(a), F.size(other_a))).otherwise(F.array_position(pairs, False) - 1)
    return F.when(other_a.isNull(), F.lit(-1)).otherwise(shared).cast("int")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays(
            [pa.array([context.partitionId() if context else 0], pa.int32()), first.column("a"), first.column("b"), last.column("a"), last.column("b")],
            names=["part", "first_a", "first_b", "last_a", "last_b"],
        )


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64), lengths


class SparseTable:
    """Minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def right(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The last position up to which the values after each start are at least its floor."""
        at, n = start.copy(), len(self.rows[0])
        for k in reversed(range(len(self.rows))):
            inside = at + (1 << k) < n
            ok = np.zeros(len(at), bool)
            ok[inside] = self.rows[k][at[inside] + 1] >= floor[inside]
            at[ok] += 1 << k
        return at

    def left(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first position from which the values up to each start are at least its floor."""
        at = start.copy()
        for k in reversed(range(len(self.rows))):
            inside = at - (1 << k) >= 0
            ok = np.zeros(len(at), bool)
            ok[inside] = self.rows[k][at[inside] - (1 << k) + 1] >= floor[inside]
            at[ok] -= 1 << k
        return at


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one partition of sorted sequences, and the pieces of those that reach beyond it."""
    table = pa.Table.from_batches(list(batches))
    n = table.num_rows
    if not n:
        return
    conv = np.asarray(table.column("conv_id").combine_chunks()).astype(np.int64)
    before, after = (table.column(c)[0].as_py() for c in ("before", "after"))
    (a, lengths), (b, _), (size, _) = (_flat(table.column(c)) for c in ("a", "b", "bytes"))
    offsets = running(lengths)
    lcp = _neighbours(a, b, offsets, lengths)
    lcp[0] = before  # -1 for the very first sequence
    following = np.append(lcp[1:], after)

    # every prefix that no earlier sequence of the partition has; those that the row before the
    # partition has are pieces of nodes that began earlier
    new_from = lcp + 1
    new_from[0] = 0
    owner = np.repeat(np.arange(n), lengths + 1 - new_from)
    depth = ranges(new_from, lengths + 1 - new_from)
    inside = lcp.copy()
    inside[0] = -1  # searches stay in the partition
    minima = SparseTable(inside)
    left, right = minima.left(owner, depth), minima.right(owner, depth)
    begins = depth > lcp[owner]
    opened = (left == 0) & (depth <= before) | (right == n - 1) & (depth <= after)

    # sums over subtrees: prefixes lie in order of position and depth
    last_bytes = np.where(depth > 0, size[np.minimum(offsets[owner] + depth - 1, max(len(size) - 1, 0))] if len(size) else 0, 0)
    convs = right - left + 1
    saved = running(convs * last_bytes - np.where(begins, last_bytes, 0))
    first_row = running(lengths + 1 - new_from)
    own = np.arange(len(depth))
    saved_tokens = saved[first_row[right + 1]] - saved[own]
    leaf = running((following < lengths).astype(np.int64))
    n_leaves = leaf[right + 1] - leaf[left]
    # a child begins at a position within the members with its depth; (depth, position) is one number
    children = np.sort((depth * (n + 1) + owner)[begins])
    low, high = (depth + 1) * (n + 1) + left, (depth + 1) * (n + 1) + right
    n_children = np.searchsorted(children, high, "right") - np.searchsorted(children, low)
    least = SparseTable(conv)
    level = np.floor(np.log2(convs)).astype(np.int64)
    smallest = np.empty(len(depth), np.int64)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        smallest[at] = np.minimum(least.rows[k][left[at]], least.rows[k][right[at] - (1 << k) + 1])

    # the parent of a node is the node one less deep that has its first member
    names = _names(a, b, offsets, owner, depth)
    parent_names = _names(a, b, offsets, owner, np.maximum(depth - 1, 0))
    order = np.lexsort((left, depth))
    sorted_key = depth[order] * (n + 1) + left[order]
    up = np.searchsorted(sorted_key, np.maximum(depth - 1, 0) * (n + 1) + owner, "right") - 1
    up = order[np.maximum(up, 0)]
    root = depth == 0
    far = ~root & opened[up]  # the parent is open: its least member is known later

    def struct(names: tuple[np.ndarray, np.ndarray], d: np.ndarray, mask: np.ndarray | None) -> pa.Array:
        fields = [pa.array(d), pa.array(names[0]), pa.array(names[1])]
        return pa.StructArray.from_arrays(fields, names=["depth", "a", "b"], mask=None if mask is None else pa.array(mask))

    # an open node always names its parent (null for the root); a closed one only if that is open
    nodes = pa.Table.from_arrays(
        [
            pa.array(np.where(opened, "open", "closed")), struct(names, depth, None),
            struct(parent_names, depth - 1, root | ~(opened | far)), pa.array(smallest),
            pa.array(smallest[up], mask=root | far | opened), *[pa.array(x.astype(np.int64)) for x in (convs, n_children, n_leaves, saved_tokens)],
            pa.nulls(len(depth), pa.int64()), pa.nulls(len(depth), pa.list_(pa.int64())),
        ],
        names=["kind", "node", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first", "ids"],
    )
    yield from nodes.to_batches(max_chunksize=10_000)

    # conversations that end in a node: the first of its members, in order of their ids
    start = np.ones(n, bool)
    start[1:] = (lcp[1:] < lengths[1:]) | (lengths[:-1] != lengths[1:])
    chunk = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    heads = np.flatnonzero(chunk % CHUNK == 0)
    ids = pa.ListArray.from_arrays(pa.array(np.append(heads, n), pa.int32()), pa.array(conv))
    ended = _names(a, b, offsets, heads, lengths[heads])
    empty = {c: pa.nulls(len(heads), nodes.schema.field(c).type) for c in nodes.schema.names}
    empty |= {"kind": pa.array(["ends"] * len(heads)), "node": struct(ended, lengths[heads], None), "first": pa.array(conv[heads]), "ids": ids}
    yield from pa.Table.from_pydict(empty, schema=nodes.schema).to_batches(max_chunksize=1_000)


def _neighbours(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each sequence but the first, how many turns it shares with the one before it."""
    n = len(lengths)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        common = np.minimum(lengths[1:], lengths[:-1])
        x, y = ranges(offsets[1:-1], common), ranges(offsets[:-2], common)
        differs = (a[x] != a[y]) | (b[x] != b[y])
        starts = running(common)
        spots = np.append(np.flatnonzero(differs), len(differs))
        lcp[1:] = np.minimum(spots[np.searchsorted(spots, starts[:-1])] - starts[:-1], common)
    return lcp


def _names(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, owner: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the first ``depth`` turns of each owner."""
    up, down = powers(_PREFIX_BASE, len(a) + 1)
    start = offsets[owner]
    out = []
    for turns in (a, b):
        total = running(mix(turns.view(np.uint64)) * up[: len(turns)])
        out.append(mix((total[start + depth] - total[start]) * down[start] + depth.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def ends_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Add ``ends_sha256``: the hash of the comma-joined ids of the conversations that end in each node.

    Chunks of ids are hashed as they pass, sorted by Spark, so a node of very many is never held.
    """
    rows = nodes.select("node", F.lit(None).cast("long").alias("first"), F.lit(None).cast("array<long>").alias("ids"), F.struct(
        *[c for c in nodes.columns if c != "node"]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    both = rows.unionByName(ends.withColumn("row", F.lit(None).cast(kind)))
    dealt = both.repartition("node").sortWithinPartitions("node", F.col("row").isNotNull(), "first")
    return dealt.mapInArrow(partial(_hash_ends), f"row {kind}, ends_sha256 string").select("row.*", "ends_sha256")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, some = hashlib.sha256(), False
    for batch in batches:
        done, at = [], []
        for i, ids in enumerate(batch.column("ids").to_pylist()):
            if ids is not None:
                digest.update((("," if some else "") + ",".join(map(str, ids))).encode())
                some = True
            else:  # the node itself comes after its ends
                done.append(digest.hexdigest())
                at.append(i)
                digest, some = hashlib.sha256(), False
        if done:
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array(done)], names=["row", "ends_sha256"])
