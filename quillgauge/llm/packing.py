"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

The planner sees only how many pieces have each length. It walks the lengths from long to short
and fills, for all pieces of a length at once, the open sequences with the least room that still
takes them; equal sequences are one group, so its work depends on the capacity and not on the
number of documents. The plan says, for each length, which ranks take which places. Documents get
a rank within their length and take the place of that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgauge.llm.arrays import slices
from quillgauge.llm.tokens import encoder
from quillgauge.session import materialize

#: Pieces of one length that are numbered together, about.
RANK_GROUP = 100_000


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Best-fit over counts: places for the pieces of each length, and the number of sequences.

    A row of the plan gives ``n`` pieces of a length, from ``rank`` on, the sequences
    ``sequence``, ``sequence + 1``, ... at the same ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, how many)
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        for free in sorted(k for k in room if k >= length):
            each = free // length
            groups = room[free]
            while groups and left:
                first, count = groups.pop()
                rank, left = _fill(rows, room, length, first, count, free, each, rank, left, capacity)
            if not groups:
                room.pop(free, None)
            if not left:
                break
        if left:
            each = capacity // length
            count = -(-left // each)
            rank, left = _fill(rows, room, length, opened, count, capacity, each, rank, left, capacity)
            opened += count
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "sequence", "offset"), columns)), opened


def _fill(rows, room, length, first, count, free, each, rank, left, capacity):
    """Put up to ``each`` pieces into each of ``count`` equal sequences; returns the next rank and what is left."""
    whole = min(count, left // each)
    if whole:
        for i in range(each):
            rows.append((length, rank, whole, first, capacity - free + i * length))
            rank += whole
        left -= whole * each
        if free - each * length:
            room.setdefault(free - each * length, []).append((first, whole))
    if whole < count:
        if left:
            for i in range(left):
                rows.append((length, rank, 1, first + whole, capacity - free + i * length))
                rank += 1
            if free - left * length:
                room.setdefault(free - left * length, []).append((first + whole, 1))
            left, whole = 0, whole + 1
        if whole < count:
            room.setdefault(free, []).append((first + whole, count - whole))
    return rank, left


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length and the CRC-32 of its ids.

    A document is its ids and ``end_id``; only one of more than ``capacity`` ids is cut, into full
    pieces and a last one that may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for texts in slices(batch.column(1)):
                ids, counts = encode.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                starts = np.cumsum(counts) - counts
                n_pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[owner] - start)
                raw, at = memoryview(ids.tobytes()), (starts[owner] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)).take(pa.array(owner)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)])
    schema = schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns the rows of ``token_pieces`` with ``sequence_id`` and ``offset``; the pieces of a
    sequence lie without gaps from offset 0. Null and empty texts are one end id; repeated rows
    are packed as often as they occur; an empty table gives no rows. The driver holds the length
    histogram (at most ``capacity`` rows) and the plan, whose size depends on the lengths alone.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_slots(histogram, capacity)
    groups = max(256, sum(histogram.values()) // RANK_GROUP)

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(groups)))
    sizes = grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_group").orderBy(id_col, "piece")
    ranked = (
        grouped.withColumn("_row", F.row_number().over(within) - 1).join(firsts, ["length", "_group"])
        .withColumn("_rank", F.col("_first") + F.col("_row")).drop("_group", "_row", "_first")
    )
    order = np.lexsort((plan["rank"], plan["length"]))
    length, rank, sequence, offset = (plan[k][order] for k in ("length", "rank", "sequence", "offset"))
    span = max(histogram.values(), default=0) + 1
    keys = length * span + rank

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("_rank").to_numpy()
            row = np.searchsorted(keys, batch.column("length").to_numpy() * span + ranks, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence[row] + ranks - rank[row]), pa.array(offset[row])],
                names=[*names, "sequence_id", "offset"],
            )

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = StructType([ranked.schema[c] for c in names]).add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "_rank").mapInArrow(take, schema)
