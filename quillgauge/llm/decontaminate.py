"""Benchmark leaks by pigeonhole edit matching.

An item of ``m`` words may occur with up to ``k`` word edits (replaced, inserted or left out). It
is cut into ``k + 1`` pieces; whatever the edits, one piece is untouched. Documents are searched
for exact hits of pieces, and each hit is verified with Myers' bit-parallel edit distance around
the place where the whole item would lie. Words are compared without case and punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgauge.llm.arrays import Texts, slices
from quillgauge.llm.names import fresh, quoted

#: Words of a piece that are looked up; a piece that occurs has its first words there too.
SEED = 4
#: Benchmark text that one scan of the documents carries along; more items take more scans.
BLOCK_BYTES = 16 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 0x20


def plain(texts: Texts) -> Texts:
    """The same texts with a space for each ASCII character that is no letter or digit."""
    return Texts(_PLAIN[texts.data], texts.offsets, texts.first)


def pieces(n_words: int, percent: int) -> tuple[int, list[tuple[int, int]]]:
    """The error budget of an item and its pieces as (first word, number of words)."""
    budget = n_words * percent // 100
    edges = [n_words * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, b - a) for a, b in zip(edges, edges[1:])]


class Items:
    """Benchmark items of one block with the table of their piece seeds."""

    def __init__(self, ids: list, texts: list[str], percent: int):
        self.ids, self.words, self.budget = [], [], []
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for part in slices(pa.array(texts, pa.string())):
            part = plain(part)
            for i in range(len(part)):
                a, b = part.word_offsets[i], part.word_offsets[i + 1]
                if a == b:
                    continue
                number = len(self.ids)
                self.ids.append(ids[part.first + i])
                self.words.append(part.word_hashes[a:b].tolist())
                budget, cut = pieces(b - a, percent)
                self.budget.append(budget)
                for first, length in cut:
                    seeds.setdefault(min(length, SEED), []).append((int(a + first), number, first))
            for length, rows in seeds.items():
                for k, row in enumerate(rows):
                    if len(row) == 3:
                        starts, hashes = part.windows(length)
                        rows[k] = (*row[1:], int(hashes[np.searchsorted(starts, row[0])]), length)
        self.seeds = {}
        for length, rows in seeds.items():
            rows.sort(key=lambda r: r[2])
            hashes = np.array([r[2] for r in rows], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[hashes & np.uint64((1 << 20) - 1)] = True
            self.seeds[length] = hashes, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), bits


def myers(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least distance of the pattern to a stretch of the text and where the first such stretch ends.

    (most + 1, -1) if every stretch is farther away than ``most``.
    """
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    positive, negative, score = full, 0, m
    best, at = most + 1, -1
    if m <= most:
        best, at = m, 0
    for j, word in enumerate(text):
        equal = masks.get(word, 0)
        vertical = equal | negative
        horizontal = (((equal & positive) + positive) ^ positive) | equal
        up = negative | ~(horizontal | positive) & full
        down = positive & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        positive = (down | ~(vertical | up) & full) & full
        negative = up & vertical
        if score < best:
            best, at = score, j + 1
    return best, at


def leaks(texts: Texts, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, number of words, distance) of the occurrences in a few texts."""
    words, offsets = texts.word_hashes, texts.word_offsets
    spots: dict[tuple[int, int], list[int]] = {}
    for length, (hashes, number, first, bits) in items.seeds.items():
        starts, found = texts.windows(length)
        near = np.flatnonzero(bits[found & np.uint64((1 << 20) - 1)])
        low, high = np.searchsorted(hashes, found[near], "left"), np.searchsorted(hashes, found[near], "right")
        for w, a, b in zip(starts[near[high > low]].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            owner = int(np.searchsorted(offsets, w, "right")) - 1
            for s in range(a, b):
                spots.setdefault((owner, int(number[s])), []).append(w - int(first[s]))
    out = []
    for (owner, item), begins in spots.items():
        pattern, budget = items.words[item], items.budget[item]
        begin, end = int(offsets[owner]), int(offsets[owner + 1])
        begins.sort()
        regions: list[list[int]] = []
        for at in begins:
            a, b = max(begin, at - budget), min(end, at + len(pattern) + budget)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(b, regions[-1][1])
            else:
                regions.append([a, b])
        for a, b in regions:
            region = words[a:b].tolist()
            distance, stop = myers(pattern, region, budget)
            if distance <= budget:
                _, back = myers(pattern[::-1], region[:stop][::-1], distance)
                out.append((owner, item, a - begin + stop - back, back, distance))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, percent: int) -> Iterator[Items]:
    """Items in blocks of bounded text; the driver holds a block at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(item_col, F.lower(F.col(text_col).cast("string"))).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        held += len(texts[-1]) + 100
        if held > BLOCK_BYTES:
            yield Items(ids, texts, percent)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts, percent)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Occurrences of benchmark items with at most ``percent`` of their words edited.

    Returns id, item, first word, number of words (in words without punctuation) and distance.
    Overlapping hits of an item give its best occurrence. Null and empty texts and items match
    nothing; repeated rows are searched like others; empty tables give no rows.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField(item_col, benchmark.schema[item_col].dataType)])
    schema = schema.add("first_word", "long").add("n_words", "long").add("distance", "long")
    rows = docs.select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("_text_"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, percent):
        part = rows.mapInArrow(_search(items, id_col, item_col), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _search(items: Items, id_col: str, item_col: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                found = leaks(plain(texts), items)
                if found:
                    numbers = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)]
                    owners = pa.array([texts.first + f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(owners), pa.array([items.ids[f[1]] for f in found]), *numbers],
                        names=[id_col, item_col, "first_word", "n_words", "distance"],
                    )

    return search


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, percent: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were; no shuffle."""
    out, columns = docs, docs.columns
    extra = fresh("_lowered_text_", columns)
    for items in _blocks(benchmark, item_col, item_text_col, percent):
        lowered = out.select(*quoted(columns), F.lower(F.col(text_col).cast("string")).alias(extra))
        out = lowered.mapInArrow(_keep(items), StructType([*docs.schema.fields, StructField(extra, lowered.schema[-1].dataType)])).select(*quoted(columns))
    return out


def _keep(items: Items):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for texts in slices(batch.column(batch.num_columns - 1)):
                for found in leaks(plain(texts), items):
                    good[texts.first + found[0]] = False
            yield batch.filter(pa.array(good))

    return keep
