"""Token ids in files of fixed-width packed integers, with random access by document.

Every id takes the fewest bits that hold the vocabulary, lowest bit first. A shard is

    magic | blocks of BLOCK_IDS ids | index (Arrow stream: id, n_tokens) | trailer

and the trailer gives the number of ids, the bits per id, where the index is, and the magic again.
All blocks but the last have one size, so block ``b`` begins at ``8 + b * block_bytes``; a reader
fetches the blocks that a range of documents covers and unpacks them with numpy.
Shards follow one another in ascending document id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgauge.llm.arrays import slices
from quillgauge.llm.files import partition_number, place, task_file
from quillgauge.llm.tokens import encoder
from quillgauge.session import materialize

MAGIC = b"QGTOKEN1"
BLOCK_IDS = 1 << 16
#: Ranges of documents are read by at most so many tasks; more ranges mean more for each.
MOST_TASKS = 100_000
_TRAILER = "<QIQQ8s"  # ids, bits, index position, index bytes, magic
MANIFEST = "shard int, path string, n_docs long, n_ids long, bits int"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids into ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.zeros((n, 32), np.uint8)
    spread[:, :bits] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, ids: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> None:
        self.ids.append(ids)
        self.counts.append(counts)
        self.waiting.append(tokens)
        self.n_waiting += len(tokens)
        self.n_ids += len(tokens)
        if self.n_waiting >= BLOCK_IDS:
            tokens = np.concatenate(self.waiting)
            whole = len(tokens) // BLOCK_IDS * BLOCK_IDS
            self.out.write(pack(tokens[:whole], self.bits))  # BLOCK_IDS is a multiple of 8: blocks end at a byte
            self.waiting, self.n_waiting = [tokens[whole:]], len(tokens) - whole

    def close(self) -> tuple[int, int]:
        if self.n_waiting:
            self.out.write(pack(np.concatenate(self.waiting), self.bits))
        index = pa.table({"id": pa.chunked_array(self.ids), "n_tokens": pa.array(np.concatenate(self.counts), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        raw = sink.getvalue()
        at = len(MAGIC) + (self.n_ids * self.bits + 7) // 8
        self.out.write(raw)
        self.out.write(struct.pack(_TRAILER, self.n_ids, self.bits, at, raw.size, MAGIC))
        return index.num_rows, self.n_ids


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the shards; returns their manifest.

    Texts are dealt by ranges of the id; a shard is one range in ascending order (null ids first,
    rows of one id ordered by text). A null or empty text is the end id alone; an empty table
    writes no shard. Other columns are not looked at.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bits = bits_for(max(encode.vocabulary, end_id + 1))
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        shard = partition_number()
        name = f"shard-{shard:06d}.bin"
        with task_file(folder, name) as out:
            writer = ShardWriter(out, bits)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for texts in slices(batch.column(1)):
                    ids, counts = encode.encode(texts)
                    ends = np.cumsum(counts)
                    writer.add(batch.column(0).slice(texts.first, len(texts)), counts + 1, np.insert(ids, ends, end_id))
                batch = next(batches, None)
            n_docs, n_ids = writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": f"{folder}/{name}", "n_docs": n_docs, "n_ids": n_ids, "bits": bits}],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32())]),
        )

    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST))


def read_index(path: str) -> tuple[pa.Table, int]:
    """Index of a shard and its bits per id."""
    system, place_ = place(path)
    with system.open_input_file(place_) as file:
        size, trailer = file.size(), struct.calcsize(_TRAILER)
        _, bits, at, length, magic = struct.unpack(_TRAILER, file.read_at(trailer, size - trailer))
        if magic != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        return pa.ipc.open_stream(file.read_at(length, at)).read_all(), bits


def read_ids(file, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard, from the blocks that hold them."""
    first = start // BLOCK_IDS
    block_bytes = BLOCK_IDS * bits // 8
    last = (stop * bits + 7) // 8
    raw = file.read_at(last - first * block_bytes, len(MAGIC) + first * block_bytes)
    return unpack(raw, bits, stop - first * BLOCK_IDS)[start - first * BLOCK_IDS :]


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type, docs_per_task: int = 20_000) -> DataFrame:
    """Documents of the shards: id, start (ids of all documents before), n_tokens and the ids.

    ``ids`` is a binary of little-endian unsigned 32-bit integers. A task reads a range of
    documents of a shard. The running total goes over the manifest, one row for a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        manifest.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("first_doc", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(docs_per_task))))
        .select("path", "shard_start", "first_doc", "bits")
    )
    parts = parts.repartition(max(1, min(parts.count(), MOST_TASKS)), "path", "first_doc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, bits = read_index(row["path"])
                counts = index["n_tokens"].to_numpy()
                starts = np.cumsum(counts) - counts
                a, b = row["first_doc"], min(row["first_doc"] + docs_per_task, len(counts))
                system, path = place(row["path"])
                with system.open_input_file(path) as file:
                    while a < b:  # about four megabytes of ids at a time
                        c = max(a + 1, min(b, int(np.searchsorted(starts, starts[a] + (1 << 20)))))
                        stop = int(starts[c - 1] + counts[c - 1])
                        ids = read_ids(file, bits, int(starts[a]), stop).astype("<u4")
                        offsets = np.append(starts[a:c] - starts[a], stop - starts[a]).astype(np.int32) * 4
                        blobs = pa.Array.from_buffers(pa.binary(), c - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [index["id"].slice(a, c - a).combine_chunks(), pa.array(starts[a:c] + row["shard_start"]), pa.array(counts[a:c]), blobs],
                            names=["id", "start", "n_tokens", "ids"],
                        )
                        a = c

    schema = StructType([StructField("id", id_type)]).add("start", "long").add("n_tokens", "long").add("ids", "binary")
    return parts.mapInArrow(read, schema)
