"""Duplicate passages by relative Lempel-Ziv parsing of every document against all others.

Documents are factored greedily into copies of reference text: a factor is a place in a document,
a place in a reference and a length, and it grows word by word while both places go on together.
A factor has to be long enough to hold a whole window of ``window`` words. The reference index is
built in two steps. First it keeps, for every window of every document, the least hash of the word
groups in it: documents that share a window share that hash, and one document in about twenty words
has a new one. Windows whose hash only one document has can begin no factor. The others enter the
index in full, each with the smallest document that has its word sequence and the place there.
Where a factor ends, the copies that begin inside it or at its end are checked as well, since a
window across the border may be a copy of other text; the one that reaches farthest is the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillgauge.llm.arrays import Texts, distinct_per_text, sequence_windows, slices, whole_hashes
from quillgauge.session import materialize

#: Words of a group whose least hash stands for a window.
GROUP = 16


def block_marks(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the text it is in, and the least group hash in it."""
    group = min(GROUP, window)
    n = len(texts.word_hashes)
    whole = np.array([0, n])  # groups over a text's end are never part of a window
    _, least = sequence_windows(texts.word_hashes, whole, group)
    span, width = window - group + 1, 1
    while 2 * width <= span and len(least) > width:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width and len(least) > span - width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts, _ = texts.windows(window)
    return starts, texts.text_of_words()[starts], least[starts] if len(starts) else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def duplicate_factors(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its words in factors removed.

    Returns id, n_words, n_removed, kept (the words that stay, joined by one space) and factors:
    first word, number of words, reference id and the word there at which the copied text begins.
    Factors may overlap at their borders, each is a whole copy of its reference. A word goes if a window of ``window`` words over
    it also starts in a document of a smaller id; windows are judged on the input. Null and empty
    texts have no words. Rows of one id do not count against each other, each is factored by its own
    text, and as a reference the id stands for any of them; a row without an id stays whole and is
    nobody's reference; an empty table gives no rows. Words are compared by 64-bit hashes.
    """
    id_type = docs.schema[id_col].dataType
    body = F.col(text_col).cast("string")
    # rows are told apart by id and text, as an id may repeat; new names: the shuffle of texts is then used again
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("row"), body.alias("body"))
    known = base.filter("id is not null")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                long_enough = np.flatnonzero(np.diff(texts.word_offsets) >= window)
                whole = whole_hashes(texts.word_hashes, texts.word_offsets)[long_enough]
                ids, rows = (batch.column(i).take(pa.array(long_enough + texts.first)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(_signed(whole))], names=["id", "row", "whole"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                _, owner, least = block_marks(texts, window)
                marks, owner = distinct_per_text(least, owner)
                whole = whole_hashes(texts.word_hashes, texts.word_offsets)[owner]
                ids, rows = (batch.column(i).take(pa.array(owner + texts.first)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(_signed(marks)), pa.array(_signed(whole))], names=["id", "row", "mark", "whole"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3)
            for texts in slices(batch.column(2)):
                starts, owner, least = block_marks(texts, window)
                _, hashes = texts.windows(window)
                lists = shared.slice(texts.first, len(texts))
                marks = lists.flatten().to_numpy(zero_copy_only=False)
                mark_owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                pick = np.isin(_pair(owner, _signed(least)), _pair(mark_owner, marks))
                starts, owner, hashes = starts[pick], owner[pick], hashes[pick]
                _, first = np.unique(_pair(owner, _signed(hashes)), return_index=True)  # once for each document
                starts, owner, hashes = starts[first], owner[first], hashes[first]
                ids, rows = (batch.column(i).take(pa.array(owner + texts.first)) for i in (0, 1))
                places = (starts - texts.word_offsets[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), ids, rows, pa.array(places)], names=["hash", "id", "row", "start"])

    id_name = id_type.simpleString()
    # a document whose whole word sequence a smaller one has is one factor; only the smallest is looked into
    named = known.mapInArrow(name, f"id {id_name}, row long, whole long")
    same = named.groupBy("whole").agg(F.min("id").alias("copy_of"), F.max("id").alias("high")).filter("copy_of < high").select("whole", "copy_of")
    copies = materialize(named.join(same, "whole").filter("copy_of < id").groupBy("id", "row").agg(F.min("copy_of").alias("copy_of")))
    marks = known.mapInArrow(mark, f"id {id_name}, row long, mark long, whole long")
    several = marks.groupBy("mark").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).filter("low < high").select("mark")
    shared = marks.select("id", "row", "mark").join(several, "mark").groupBy("id", "row").agg(F.collect_set("mark").alias("marks"))
    marked = materialize(shared.join(copies, ["id", "row"], "left_anti"))

    windows = known.join(marked, ["id", "row"]).select("id", "row", "body", "marks").mapInArrow(look, f"hash long, id {id_name}, row long, start int")
    index = windows.groupBy("hash").agg(F.min("id").alias("reference"), F.max("id").alias("high"), F.min_by("start", "id").alias("place"))
    index = index.filter("reference < high").select("hash", "reference", "place")
    repeats = windows.join(index, "hash").filter("reference < id")
    repeats = repeats.groupBy("id", "row").agg(F.collect_set(F.struct("start", "reference", "place")).alias("repeats"))
    repeats = repeats.join(copies, ["id", "row"], "full")

    factor = StructType().add("first_word", "long").add("n_words", "long").add(StructField("reference", id_type)).add("reference_word", "long")
    schema = StructType([StructField("id", id_type)]).add("n_words", "long").add("n_removed", "long")
    schema = schema.add(StructField("kept", StringType())).add(StructField("factors", ArrayType(factor)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                lists = batch.column(3).slice(texts.first, len(texts))
                copy_of = batch.column(4).slice(texts.first, len(texts)).to_pylist()
                firsts, lasts = texts.words
                n_words, n_removed, kept, factors = np.diff(texts.word_offsets), np.zeros(len(texts), np.int64), [], []
                starts, hashes = texts.windows(window)
                per_text = np.searchsorted(starts, texts.word_offsets)
                raw = texts.data.tobytes()
                for i in range(len(texts)):
                    a, b = int(texts.word_offsets[i]), int(texts.word_offsets[i + 1])
                    stay, found = np.ones(b - a, bool), []
                    if copy_of[i] is not None and b - a >= window:
                        found = [(0, b - a, copy_of[i], 0)]
                    elif lists[i].is_valid:
                        found = _factors(lists[i].values, starts[per_text[i] : per_text[i + 1]] - a, hashes[per_text[i] : per_text[i + 1]], window)
                    for start, length, _, _ in found:
                        stay[start : start + length] = False
                    n_removed[i] = (b - a) - int(stay.sum())
                    kept.append(_join(raw, firsts[a:b], lasts[a:b], stay))
                    factors.append([{"first_word": s, "n_words": n, "reference": r, "reference_word": p} for s, n, r, p in found])
                columns = [batch.column(0).slice(texts.first, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_removed),
                           pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, _arrow_factors(batch.schema.field(0).type))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "kept", "factors"])

    with_repeats = known.join(repeats, ["id", "row"], "left").select("id", "row", "body", "repeats", "copy_of")
    nothing = [F.lit(None).cast(repeats.schema[c].dataType).alias(c) for c in ("repeats", "copy_of")]
    without_id = base.filter("id is null").select("id", "row", "body", *nothing)
    return with_repeats.union(without_id).mapInArrow(parse, schema).withColumnRenamed("id", id_col)


def _arrow_factors(id_type: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("reference", id_type), ("reference_word", pa.int64())]))


def _pair(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One key for (text of the slice, hash)."""
    return value.astype(np.int64).view(np.uint64) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _factors(repeats: pa.StructArray, starts: np.ndarray, hashes: np.ndarray, window: int) -> list[tuple[int, int, object, int]]:
    """Greedy parse: a factor grows while its place here and its place in the reference go on together."""
    first = repeats.field("start").to_numpy(zero_copy_only=False)
    values = hashes[np.searchsorted(starts, first)]
    order = np.argsort(values)
    at = np.minimum(np.searchsorted(values[order], hashes), len(order) - 1)
    hit = values[order][at] == hashes
    begins, source = starts[hit], order[at][hit]
    reference = repeats.field("reference")
    code = reference.dictionary_encode().indices.to_numpy()[source]
    place = repeats.field("place").to_numpy(zero_copy_only=False)[source].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(begins) != 1) | (np.diff(code) != 0) | (np.diff(place) != 1)]))
    heads = begins[cut]
    tails = begins[np.append(cut[1:], len(begins)) - 1] + window  # the word after each grown copy; ascending as heads are
    out, i = [], 0
    while i < len(cut):
        k = cut[i]
        out.append((int(heads[i]), int(tails[i] - heads[i]), reference[int(source[k])].as_py(), int(place[k])))
        # of the copies that begin in this factor or at its end the farthest; else the next one
        i = max(int(np.searchsorted(heads, tails[i], side="right")) - 1, i + 1)
    return out


def _join(raw: bytes, firsts: np.ndarray, lasts: np.ndarray, stay: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(firsts[stay].tolist(), lasts[stay].tolist())])
