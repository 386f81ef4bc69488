"""Records of quoted CSV files whose fields may hold line breaks, read by many tasks a file.

Spark's multi-line reader gives a whole file to one task. Here the files are read as lines, in
Spark's usual splits. Whether a split begins inside a quoted field follows from the parity of the
quotes before it, which one small aggregate over the splits gives. Each task then puts its lines
together to records; only the pieces at the borders of splits, at most two a split, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
WHOLE, TAIL, HEAD = 0, 1, 2


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text): the records of CSV files in order of file, block and n, headers included.

    Quotes stand around whole fields and are doubled inside (RFC 4180); a lone quote within a field
    without quotes would count as opening one. Records may end in LF or CRLF; line breaks inside
    fields stay as they are. Empty lines outside quotes and a byte order mark are dropped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'))))
    splits = lines.groupBy("file", "block").agg(quotes.alias("_q"))
    before = F.sum("_q").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = splits.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    # one row a split: bounded by what Spark itself lists to plan the scan; a broadcast keeps the lines' order
    pieces = lines.join(F.broadcast(inside), ["file", "block"]).mapInArrow(
        _records, "file string, block long, n long, kind int, text string"
    )
    return assembled(pieces).filter(F.length("text") > 0)


def assembled(pieces: DataFrame) -> DataFrame:
    """Whole records as they are, and those put together of a tail and the heads of later splits."""
    cut = pieces.filter(F.col("kind") != WHOLE)
    # in a split the piece that ends an earlier record comes first
    order = Window.partitionBy("file").orderBy("block", F.col("kind").desc())
    grouped = cut.withColumn("record", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    joined = grouped.groupBy("file", "record").agg(
        F.min(F.struct("block", "n")).alias("at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "block", "n", "text")
    both = whole.unionByName(joined.select("file", "at.block", "at.n", "text"))
    return both.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, inside, n, kind, held = None, False, 0, WHOLE, []
    for batch in batches:
        out: list[tuple] = []
        for file, block, value, began_inside in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "inside"))):
            if (file, block) != at:
                if held:
                    out.append((*at, n, TAIL if kind == WHOLE else HEAD, "\n".join(held)))
                at, inside, n, held = (file, block), began_inside, 0, []
                kind = HEAD if inside else WHOLE  # the first piece may end a record of an earlier split
                if block == 0:
                    value = value.removeprefix("﻿")
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                out.append((*at, n, kind, "\n".join(held)))
                n, kind, held = n + 1, WHOLE, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
    if held:
        last = [(*at, n, TAIL if kind == WHOLE else HEAD, "\n".join(held))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), _SCHEMA)], schema=_SCHEMA)
