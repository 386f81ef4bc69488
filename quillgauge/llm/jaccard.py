"""Jaccard join of word shingle sets by PartEnum signatures, and the classes it links.

Two sets of sizes a <= b with Jaccard similarity s or more differ in at most
(1 - s) / (1 + s) * (a + b) elements. Sets are put into bands of similar size; within a band
that number has a bound ``k``. The hashed feature domain is partitioned and subsets of the
partitions are enumerated so that two sets that differ in ``k`` elements or fewer agree on all
partitions of some subset. A signature is the content of such a subset.

Signatures of nothing but empty partitions would link unrelated sets, so they are left out. A set
for which that may lose a partner is signed again under another partitioning of the domain, and in
the last round the empty signatures stay; two sets can only miss each other where both are signed
again, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.arrays import SMALL_SLICE, Texts, distinct_per_text, forget_lasting, mix, mix_one, release_memory, slices, whole_hashes
from quillgauge.llm.components import components
from quillgauge.llm.files import partition_number, stored
from quillgauge.session import materialize

BAND_RATIO = 1.5
#: Partitionings that a set with too many empty partitions goes through.
ROUNDS = 4
#: Sets with one signature that are compared with one another at once; larger groups take another exact way.
GROUP = 16
#: Documents whose texts are picked by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: About as many sets of a component are compared with as many others at once.
TILE = 64


def text_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their owners, ordered by owner and hash.

    A text of fewer words is one shingle, a text without words has none.
    """
    firsts, hashes = texts.windows(words)
    owner = texts.text_of_words()[firsts]
    n_words = np.diff(texts.word_offsets)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        whole = whole_hashes(texts.word_hashes, texts.word_offsets)[short]
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    return distinct_per_text(hashes, owner)


def set_nodes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit name for each whole set; sets are laid out one after the other."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    return mix((total[ends] - total[ends - sizes]) + mix(sizes.astype(np.uint64)))


def bands(top: int) -> list[int]:
    """Upper ends (exclusive) of the size bands up to ``top``."""
    out = [2]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def differences(percent: int, size: int) -> int:
    """Most elements in which two sets of at most ``size`` elements differ at that similarity."""
    return (100 - percent) * 2 * size // (100 + percent)


def shape(k: int) -> tuple[int, int, int]:
    """First-level partitions, second-level partitions and how many of the latter may differ.

    Some first-level partition has at most ``may`` of the ``k`` differences; more than
    ``spare`` of them have, so that a few may be empty.
    """
    may = k if k <= 2 else 1 if k <= 12 else 0
    second = 1 if may == 0 else may + 2
    spare = 0 if k <= 2 else 2 + k // 4
    return k // (may + 1) + 1 + spare, second, may


def signatures(keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets laid out one after the other: (signature, number of its set).

    Also how many signatures each set surely shares with any similar set that is not equal to it.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sure = np.full(len(sizes), 1 << 20)
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), sure
    edges = np.array(bands(int(sizes.max()) * 2))
    own = np.searchsorted(edges, sizes, "right")
    # a larger partner has at most size / similarity elements
    reach = np.searchsorted(edges, sizes * 100 // percent, "right")
    starts = np.cumsum(sizes) - sizes
    for shift in range(int((reach - own).max()) + 1):
        sets = np.flatnonzero((sizes > 0) & (own + shift <= reach))
        for band in np.unique(own[sets] + shift):
            part = sets[own[sets] + shift == band]
            k = differences(percent, int(edges[band]) - 1)
            for turn in range(ROUNDS if k else 0):  # where nothing may differ, equal sets already share their name
                if not len(part):
                    break
                shared = _sign(found, keys, starts, sizes, part, int(band), k, turn)
                sure[part] = np.minimum(sure[part], np.maximum(shared, 0))
                part = part[shared <= 0]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), sure
    return np.concatenate([s for s, _ in found]), np.concatenate([o for _, o in found]), sure


def _sign(found, keys, starts, sizes, part, band: int, k: int, turn: int) -> np.ndarray:
    """Sign sets ``part`` for a band; returns how many signatures each surely shares with a similar set."""
    n_first, second, may = shape(k)
    lengths = sizes[part]
    ends = np.cumsum(lengths)
    rows = np.repeat(starts[part] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
    cells_per_set = n_first * second
    salted = mix(keys[rows] ^ mix_one(7919 * (turn + 1) + 31 * band))
    cell = ((salted >> np.uint64(32)) * np.uint64(cells_per_set) >> np.uint64(32)).astype(np.int64)
    at = np.repeat(np.arange(len(part)) * cells_per_set, lengths) + cell
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.zeros(len(part) * cells_per_set, np.uint64)
    sums[at[first]] = np.add.reduceat(mix(salted[order]), first)
    sums = sums.reshape(len(part), n_first, second)
    filled = sums != 0
    last = turn == ROUNDS - 1
    for number, subset in enumerate(combinations(range(second), second - may)):
        names = mix_one((turn << 56) ^ (band << 40) ^ number) + mix(np.arange(1, n_first + 1).astype(np.uint64) << np.uint64(20))
        values = np.broadcast_to(names, (len(part), n_first)).copy()
        some = np.zeros((len(part), n_first), bool)
        for c in subset:
            values = mix(values + sums[:, :, c])
            some |= filled[:, :, c]
        if last:
            some[:] = True
        owner, which = np.nonzero(some)
        found.append((values[owner, which], part[owner]))
    # a good partition agrees on a filled subset if more than ``may`` of its cells are filled
    thin = (filled.sum(2) <= may).sum(1)
    return n_first - k // (may + 1) - thin



def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _named(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles and the name of the set (null for the empty set)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_lasting()
        for batch in batches:
            for texts in slices(batch.column(1), lower=True, limit=SMALL_SLICE):
                keys, owners = text_sets(texts, words)
                sizes = np.bincount(owners, minlength=len(texts))
                nodes = pa.array(set_nodes(keys, sizes).view(np.int64), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(sizes, pa.int64()), nodes], names=["id", "n_shingles", "node"]
                )
            release_memory()

    id_type = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(name, f"id {id_type}, n_shingles long, node long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _shared_signatures(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n): the sets, by name, with a signature ``key`` that ``n`` sets have, two or more.

    Sets of a signature that meet within a slice of texts need no look at others; only the first of
    them is compared with those of other slices, so a signature that many sets share meets in one
    place as a row for each slice. In the shuffle a set goes by a running number of its task, which
    packs well; ``other`` is -1 for those first ones, a number for sets that met, -2 and less where
    a number gets its name. The second table has (node, sure): how many signatures a set surely
    shares with any similar one.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_lasting()
        seen: set[int] = set()
        number = partition_number() << 32
        for batch in batches:
            for texts in slices(batch.column(0), lower=True, limit=SMALL_SLICE):
                keys, owners = text_sets(texts, words)
                sizes = np.bincount(owners, minlength=len(texts))
                nodes = set_nodes(keys, sizes)
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                fresh &= np.fromiter((x not in seen for x in nodes.tolist()), bool, len(nodes)) & (sizes > 0)
                seen = set() if len(seen) > 500_000 else seen
                seen.update(nodes.tolist())
                keys, sizes, nodes = keys[np.repeat(fresh, sizes)], sizes[fresh], nodes[fresh]
                numbers = number + np.arange(len(nodes))
                number += len(nodes)
                signature, owner, sure = signatures(keys, sizes, percent)
                order = np.lexsort((owner, signature))
                signature, mine = signature[order], numbers[owner[order]]
                more = np.zeros(len(order), bool)
                more[1:] = signature[1:] == signature[:-1]
                other = np.where(more, mine, -1)
                met = np.flatnonzero(more[1:] & ~more[:-1])  # the first of several: also a row of its own
                key, mine = np.concatenate([signature, signature[met], nodes]), np.concatenate([mine, mine[met], numbers])
                other = np.concatenate([other, mine[met], -2 - sure])
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(mine), pa.array(other)], names=["key", "number", "other"])
            release_memory()

    rows = _texts(docs, id_col, text_col).select("text").mapInArrow(sign, "key long, number long, other long")
    times = F.count(F.lit(1)).over(Window.partitionBy("key", "other"))
    kept = stored(rows.select("key", "number", "other", times.alias("times")).filter("other <> -1 or times > 1").drop("times"), "shared")
    names = kept.filter("other <= -2").select("number", F.col("key").alias("node"), (-2 - F.col("other")).alias("sure"))
    shared = kept.filter("other >= -1").select("key", "number").join(names.select("number", "node"), "number").select("key", "node")
    # one shuffle for both: equal sets of several tasks become one, then a signature's sets are counted
    shared = shared.repartition("key").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    return shared, names.groupBy("node").agg(F.min("sure").alias("sure"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The sorted shingle hashes (packed) of the sets ``wanted`` (id of a document with it, node)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_lasting()
        for batch in batches:
            for texts in slices(batch.column(0), lower=True, limit=SMALL_SLICE):
                keys, owners = text_sets(texts, words)
                sizes = np.bincount(owners, minlength=len(texts))
                nodes = set_nodes(keys, sizes)
                right = np.flatnonzero(nodes.view(np.int64) == batch.column(1).to_numpy()[texts.first : texts.first + len(texts)])
                ends = np.cumsum(sizes)
                packed = [keys[ends[i] - sizes[i] : ends[i]].tobytes() for i in right.tolist()]
                yield pa.RecordBatch.from_arrays([_long(nodes[right]), pa.array(packed, pa.binary())], names=["node", "shingles"])
            release_memory()

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = _texts(docs, id_col, text_col).join(F.broadcast(wanted) if few else wanted, "id").select("text", "node")
    return picked.mapInArrow(pack, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sizes alone rule out some."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_lasting()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, two = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, two]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(one) + len(two) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))
            del batch, x, y
            release_memory()

    a, b = sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    near = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    with_sets = (
        near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    )
    return with_sets.mapInArrow(check, "a long, b long")


def _small_group_pairs(members: DataFrame, need: DataFrame) -> DataFrame:
    """Pairs of sets that share enough signatures of small groups.

    ``members`` has (key, node) of groups of at most ``GROUP`` sets. A similar pair shares at least
    ``sure`` signatures, of which at most ``n_large`` are of large groups.
    """
    left, right = members.toDF("key", "a"), members.toDF("key", "b")
    pairs = left.join(right, "key").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(need.select(F.col("node").alias(side), F.col("need").alias(f"need_{side}")), side)
    return pairs.filter("n >= need_a and n >= need_b").select("a", "b")


def _rare_shingles(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, size, at): the rarest shingles of the sets ``nodes``, ``at`` counts the rarer ones.

    The finest partition of the feature domain, a shingle in each part, for sets whose signatures
    are mostly those of large groups. Ordered from rare to frequent, the first shingle that two
    similar sets share leaves enough others in both. Shingles of one set alone are counted only.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                arrays = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                sizes = np.array([len(x) for x in arrays])
                owner = pa.array(np.repeat(np.arange(len(arrays)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), pa.array(np.concatenate(arrays)), pa.array(np.repeat(sizes, sizes).astype(np.int32))],
                    names=["node", "shingle", "size"],
                )

    rows = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(spread, "node long, shingle long, size int")
    rows = stored(rows, "rare")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    of_set = Window.partitionBy("node")
    ranked = rows.join(often, "shingle").withColumn(
        "at", F.col("size") - F.count(F.lit(1)).over(of_set) + F.row_number().over(of_set.orderBy("times", "shingle")) - 1
    )
    return ranked.filter((100 * (F.col("size") - F.col("at"))) >= percent * F.col("size")).select("shingle", "node", "size", "at")


def _may_be_similar(percent: int):
    """Of rows (na, ia) and (nb, ib) that share a shingle: what follows it in both may be enough."""
    return (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb"))


def _hub_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Each set with one other of each of its rare shingles: that with the fewest rarer ones.

    Of the sets with a shingle it may be similar to most. So a large family of near copies is joined
    by a pair or so for each set, before the sets that are still apart are compared.
    """
    hub = rare.groupBy("shingle").agg(F.min(F.struct("at", "node", "size")).alias("hub"))
    hub = hub.select("shingle", F.col("hub.node").alias("b"), F.col("hub.size").alias("nb"), F.col("hub.at").alias("ib"))
    pairs = rare.toDF("shingle", "a", "na", "ia").join(hub, "shingle").filter("a <> b").filter(_may_be_similar(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs_across(rare: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may be similar, by their rarest shingles.

    Of each shingle the component with the most sets is not compared within itself.
    """
    placed = rare.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.select("shingle", "node", "size", "at", "component"), "placed")
    parts = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    mixed = placed.join(main.filter("parts > 1").select("shingle", F.col("most.component").alias("main")), "shingle")
    mixed = stored(mixed.select("shingle", "node", "size", "at", "component", (F.col("component") == F.col("main")).alias("most")), "mixed")
    left = mixed.filter("not most").drop("most").toDF("shingle", "a", "na", "ia", "ca")
    right = mixed.toDF("shingle", "b", "nb", "ib", "cb", "most")
    pairs = left.join(right, "shingle").filter("most or ca < cb").filter(_may_be_similar(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """Number of shared shingles of each left with each right set, some shingles at a time."""
    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    keys, owner = placed(left)
    others, owner_of_other = placed(right)
    names = np.intersect1d(keys, others)
    out = np.zeros((len(left), len(right)), np.int64)
    for i in range(0, len(names), columns):
        part = names[i : i + columns]
        matrices = []
        for values, rows, n in ((keys, owner, len(left)), (others, owner_of_other, len(right))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[hit], at[hit]] = 1
            matrices.append(matrix)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def _link_counts(labels: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, n): the documents of other sets that are similar to a set.

    Links lie within components, all of whose pairs are compared: a component's sets are dealt
    into tiles of some ``TILE`` sets, and each pair of tiles is one row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            nodes, times, packed = (cell.values.field(c) for c in ("node", "times", "shingles"))
            return nodes.to_numpy(), times.to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in packed]

        for batch in batches:
            for i in range(batch.num_rows):
                nodes, times, left = side(batch.column(0)[i])
                same = not batch.column(1)[i].is_valid
                other_nodes, other_times, right = (nodes, times, left) if same else side(batch.column(1)[i])
                common = _common(left, right)
                whole = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - common
                linked = 100 * common >= percent * whole
                if same:
                    np.fill_diagonal(linked, False)
                    found, n = nodes, linked @ times
                else:
                    found, n = np.concatenate([nodes, other_nodes]), np.concatenate([linked @ other_times, times @ linked])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["node", "n"])

    tiles = labels.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("n_tiles"))
    tiles = materialize(tiles)
    few = tiles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = labels.join(F.broadcast(tiles) if few else tiles, "component").withColumn("tile", F.pmod(F.xxhash64("node"), "n_tiles"))
    members = placed.join(sizes.select("node", "times"), "node").join(sets, "node")
    grouped = members.groupBy("component", "n_tiles", "tile").agg(F.collect_list(F.struct("node", "times", "shingles")).alias("x"))
    grouped = stored(grouped, "tiles")
    left = grouped.filter("tile + 1 < n_tiles").withColumn("other", F.explode(F.expr("sequence(tile + 1, n_tiles - 1)")))
    right = grouped.filter("n_tiles > 1").select("component", F.col("tile").alias("other"), F.col("x").alias("y"))
    across = left.join(right, ["component", "other"]).select("x", "y")
    within = grouped.select("x", F.lit(None).cast(grouped.schema["x"].dataType).alias("y"))
    return within.union(across).mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def similar_classes(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_links: bool = True
) -> DataFrame:
    """One row per document: id, n_shingles, component_id and its number of links.

    Two documents link when 100 times the shared shingles are at least ``percent`` times all
    shingles of both; A-Z count as a-z. ``component_id`` is the smallest id that links reach.
    ``n_links`` is the number of all other documents that link with it, those of equal sets too;
    without ``with_links`` the column is left out. Null and empty texts link with nothing and stand for
    themselves; rows of a repeated id are documents of their own; an empty table gives no rows.
    Equality of shingles is that of 64-bit hashes.
    """
    named = materialize(_named(docs, words, id_col, text_col))
    sizes = materialize(
        named.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("times"))
    )
    members, sure = _shared_signatures(docs, words, percent, id_col, text_col)
    members = stored(members, "members")
    in_large = members.filter(F.col("n") > GROUP)
    n_large = in_large.groupBy("node").agg(F.count(F.lit(1)).alias("n_large"))
    need = materialize(
        members.select("node").distinct().join(sure, "node").join(n_large, "node", "left")
        .select("node", (F.col("sure") - F.coalesce("n_large", F.lit(0))).alias("need"))
    )
    # sets with need <= 0 may share nothing but signatures of large groups with a similar set
    stubborn = need.filter("need <= 0").join(in_large.select("node").distinct(), "node", "left_semi").select("node")
    pairs = stored(_small_group_pairs(members.filter(F.col("n") <= GROUP).select("key", "node"), need), "pairs")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(stubborn).distinct()
    sets = stored(_sets(docs, materialize(involved.join(sizes, "node").select("id", "node")), words, id_col, text_col), "sets")
    rare = stored(_rare_shingles(sets, stubborn, percent), "first")
    pairs = stored(pairs.union(_hub_pairs(rare, percent)).distinct(), "pairs")
    links = materialize(_verified(pairs, sets, sizes, percent))
    labels = components(links)
    # stubborn sets that have a rare shingle in common and are still apart
    more = _pairs_across(rare, labels, percent).join(pairs, ["a", "b"], "left_anti")
    more = materialize(_verified(more, sets, sizes, percent))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    counts = _link_counts(labels, sets, sizes, percent) if with_links else labels.select("node", F.lit(0).cast("long").alias("n"))
    tops = labels.join(sizes, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    reached = labels.join(tops, "component").join(counts, "node", "left").select("node", "component_id", "n")
    own = sizes.select("node", F.col("id").alias("smallest"), (F.col("times") - 1).alias("equal"))
    reached = materialize(own.join(reached, "node", "left").select("node", F.coalesce("component_id", "smallest").alias("component_id"), (F.col("equal") + F.coalesce("n", F.lit(0))).alias("n_links")))
    out = named.join(reached, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return out if with_links else out.drop("n_links")


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each class the one of the smallest id, columns as they were.

    Documents without words have no copies and stay, as do those without an id. Of rows that share
    id and text one stays.
    """
    found = similar_classes(docs, words, percent, id_col, text_col, with_links=False)
    gone = materialize(found.filter(F.col(id_col) > F.col("component_id")).select(id_col).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    again = materialize(found.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col(id_col).isNotNull()).select(id_col))
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col).select(*docs.columns).dropDuplicates([id_col, text_col])
    return kept.join(again, id_col, "left_anti").select(*docs.columns).union(once)
