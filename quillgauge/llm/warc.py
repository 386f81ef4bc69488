"""WARC archives: write records as gzip members, read them back by byte ranges.

The reader deals byte ranges of the files out to tasks. A task looks for the gzip magic in its
range, tries to decode each candidate member and accepts it only if a WARC header follows; it owns
the records that start in its range and reads on past the range to finish the last one. A magic
that occurs inside a compressed member fails the test, and members are then walked one by one. (A
payload that holds a whole gzipped WARC record, stored without compression, would pass it; text
payloads cannot, as UTF-8 has no byte 0x8b after 0x1f.)
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.llm.files import partition_number, place, task_file

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Ranges are dealt out to at most so many tasks; more ranges mean more for each.
MOST_TASKS = 100_000
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_name(key: object) -> str:
    """The record id of a key; the key can be read from it again."""
    return f"<urn:x-record:{key}>"


def record_key(name: str) -> str:
    return name[len("<urn:x-record:") : -1]


def _clean(value: object) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def encode_record(name: str, kind: str, uri: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """One gzip member. A revisit has the HTTP head of its response, whose length stays known, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write rows (key, uri, payload binary, kind, digest, refers_to) as one archive per partition.

    Returns the manifest (path, n_records, n_bytes), computed by the write. A null payload is
    empty, a null uri gives no target header. A repeated task replaces its file by an equal one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        name, n, size = f"part-{partition_number():06d}.warc.gz", 0, 0
        with task_file(folder, name) as out:
            while batch is not None:
                keys, uris, kinds, digests, refers = (batch.column(c).to_pylist() for c in ("key", "uri", "kind", "digest", "refers_to"))
                payloads = batch.column("payload")
                for i, key in enumerate(keys):
                    payload = payloads[i].as_py() or b""
                    member = encode_record(
                        record_name(key), kinds[i], uris[i], payload, digests[i], len(payload), None if refers[i] is None else record_name(refers[i])
                    )
                    out.write(member)
                    n, size = n + 1, size + len(member)
                batch = next(batches, None)
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": n, "n_bytes": size}])

    columns = records.select(F.col("key").cast("string").alias("key"), "uri", F.col("payload").cast("binary").alias("payload"), "kind", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return columns.mapInArrow(write, "path string, n_records long, n_bytes long")


class Window:
    """Bytes of a file, fetched in chunks as they are asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.base, self.size, self.data = file, at, size, b""

    def upto(self, end: int) -> None:
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.data += self.file.read_at(min(max(CHUNK, end - have), self.size - have), have)

    def drop(self, before: int) -> None:
        if before - self.base >= CHUNK:
            self.data, self.base = self.data[before - self.base :], before

    def find(self, what: bytes, at: int, end: int) -> int:
        """Position of ``what`` that starts in [at, end), or -1."""
        while at < end:
            self.upto(min(self.size, at + CHUNK))
            have = self.base + len(self.data)
            found = self.data.find(what, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            if have >= self.size:
                return -1
            at = max(at, have - len(what) + 1)
            self.drop(at)
        return -1


def decode_member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The content of a gzip member at ``at`` and where it ends; None if there is no WARC record."""
    unpack, out, n, position = zlib.decompressobj(31), [], 0, at
    try:
        while not unpack.eof:
            window.upto(position + 1)
            part = window.data[position - window.base : position - window.base + CHUNK]
            if not part:
                return None
            piece = unpack.decompress(part)
            position += len(part) - len(unpack.unused_data)
            out.append(piece)
            n += len(piece)
            if len(out) == 1 and not b"WARC/".startswith(piece[:5]):
                return None
    except zlib.error:
        return None
    content = b"".join(out)
    head = content.find(b"\r\n\r\n")
    return (content, position) if content[:5] == b"WARC/" and head > 0 else None


def headers(block: bytes) -> dict[str, str]:
    rows = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in rows}


def decode_record(content: bytes) -> dict[str, object] | None:
    """Fields of a record; None if its length does not fit what its header says."""
    end = content.find(b"\r\n\r\n")
    head = headers(content[:end])
    length = head.get("content-length", "")
    if "warc-type" not in head or not length.isdigit() or end + 4 + int(length) > len(content):
        return None
    block = content[end + 4 : end + 4 + int(length)]
    kind = head["warc-type"]
    payload: bytes | None = block
    size, digest = len(block), head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if head.get("content-type", "").startswith("application/http"):
        split = block.find(b"\r\n\r\n")
        http = headers(block[:split]) if split >= 0 else {}
        payload = block[split + 4 :] if split >= 0 else block
        size = len(payload)
        if kind == "revisit":
            payload, size = None, int(http.get("content-length", 0))
    if payload is not None:
        digest = hashlib.sha256(payload).hexdigest()
    return {
        "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload,
    }


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, object]]]:
    """The records that start in bytes [start, end) of a file, with their positions."""
    window = Window(file, start, size)
    at = window.find(MAGIC, start, end)
    while 0 <= at < end:
        member = decode_member(window, at)
        record = decode_record(member[0]) if member else None
        if record is None:
            at = window.find(MAGIC, at + 1, end)
            continue
        yield at, record
        at = member[1]
        window.drop(at)
        if at < end and not _magic_at(window, at):
            at = window.find(MAGIC, at, end)


def _magic_at(window: Window, at: int) -> bool:
    window.upto(at + len(MAGIC))
    return window.data[at - window.base : at - window.base + len(MAGIC)] == MAGIC


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of archives: ``files`` has their path and n_bytes, one row each.

    Digest and length are computed from the payload of a response; those of a revisit are what its
    head says, and its payload is null. Damaged members are passed over. No file gives no rows.
    ``with_payload=False`` leaves the payload null, for callers that only want its digest.
    """
    ranges = files.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                 ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
        for batch in batches:
            for row in batch.to_pylist():
                system, path = place(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for at, record in records_in(file, row["n_bytes"], row["start"], min(row["start"] + range_bytes, row["n_bytes"])):
                        if not with_payload:
                            record["payload"] = None
                        rows.append({**record, "file": row["path"], "offset": at})
                        held += len(record["payload"] or b"") + 500
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(types))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    return ranges.mapInArrow(read, FIELDS)


def revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Decide for each page whether it is the response for its payload or revisits another page.

    Among payloads of at least ``LEAST_REVISIT`` bytes that are equal (by SHA-256), the smallest id
    is the response; rows that repeat that id are responses too. A null page is an empty payload;
    a null id never refers and is never referred to. The payloads themselves go through one shuffle
    at most; the decision joins digests, whose hot groups Spark can split.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter((F.length("payload") >= LEAST_REVISIT) & F.col("key").isNotNull()).groupBy("digest")
        .agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("digest", "first")
    )
    later = F.coalesce(F.col("first") < F.col("key"), F.lit(False))
    return rows.join(first, "digest", "left").select(
        "key", "uri", "payload", "digest", F.when(later, "revisit").otherwise("response").alias("kind"), F.when(later, F.col("first")).alias("refers_to")
    )
