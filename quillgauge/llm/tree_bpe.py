"""Token ids of whole texts and back, long texts encoded in parallel halves.

Short texts go through the ``tokenizers`` library as they are. A long one is normalised, cut at
fixed places into leaves, inside words too, and the leaves are dealt out and encoded in parallel.
Then neighbours are joined in a tree: a window around the join, some tokens to each side, is
encoded again, and doubled until it agrees with both sides at its ends. A window's text is spelled
from its tokens, with a space between words, so that only ids travel.

Why agreement proves the whole: words are runs of one kind of character or contractions, and no
leaf ends near an apostrophe, so a join can only change the words that touch it; from a word on
which both agree, words are equal. Inside a word a sequence of tokens is its encoding if each two
neighbours are what their text encodes to, and every pair of the joined sequence stands together in
the left half, the window or the right half.

This holds for vocabularies of words (a splitter of character runs, an end-of-word mark in the BPE
model), not for splitters that look ahead; others are refused.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgauge.llm.arrays import SMALL_SLICE, ranges, release_memory, slices
from quillgauge.llm.tokens import PieceEncoder

#: Characters of a leaf; texts of up to twice as many are not cut.
LEAF = 8192
#: Windows may end inside a word only if it has more tokens than this, and that far from its start.
LONG_WORD = 64
#: Characters given to the library at once.
BLOCK = 1 << 18


def _bytes_of_marks() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class NormalisedPieces(PieceEncoder):
    """Encodes normalised text, each distinct piece of it once."""

    def __init__(self, plain: Tokenizer):
        self.tokenizer, self.drops_space = plain, True
        self.vocabulary = plain.get_vocab_size()
        self.forget()


class Vocabulary:
    """The tokenizer of a file, with variants for normalised text and for the inside of a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, mark = json.dumps(spec["pre_tokenizer"]), spec["model"].get("end_of_word_suffix")
        if not mark or spec["decoder"] is not None or "ByteLevel" not in splitter or "(?" in splitter or "\\\\b" in splitter:
            raise ValueError(f"{path} is not a vocabulary of words with end marks")
        self.path, self.mark = path, mark
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        size = max(vocabulary.values()) + 1
        self.spelling, self.closes, self.splits = [b""] * size, np.zeros(size, bool), np.zeros(size, bool)
        byte = _bytes_of_marks()
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith(mark)
            raw = token.removesuffix(mark)
            if all(c in byte for c in raw):
                self.spelling[i] = bytes(byte[c] for c in raw)
            # inside a word no window starts within a character or at what may seem a contraction
            self.splits[i] = not 0x80 <= (self.spelling[i] or b"\x80")[0] < 0xC0 and self.spelling[i][:1] != b"'"

    @cached_property
    def whole(self) -> Tokenizer:
        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def _variant(self, mark: str | None) -> Tokenizer:
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
        spec["model"]["end_of_word_suffix"] = mark
        return Tokenizer.from_str(json.dumps(spec))

    @cached_property
    def plain(self) -> Tokenizer:
        return self._variant(self.mark)

    @cached_property
    def inner(self) -> Tokenizer:
        return self._variant(None)

    @cached_property
    def pieces(self) -> NormalisedPieces:
        return NormalisedPieces(self.plain)

    def sections(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text's stretches between special tokens, normalised, and the ids of those."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.special_ids:
                yield "", self.special_ids[part]
            elif part:
                yield self.whole.normalizer.normalize_str(part), None

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of normalised texts, one after the other, and their number in each, in runs of texts."""
        for part in slices(pa.array(texts, pa.large_string()), limit=SMALL_SLICE):
            yield self.pieces.encode(part)

    def halves(self, texts: list[str]) -> list[Half]:
        """Encode stretches of normalised text."""
        ids = [x for flat, counts in self.encoded(texts) for x in np.split(flat, np.cumsum(counts)[:-1])]
        return [Half(x, t[:1] == " ", t[-1:] == " ") for x, t in zip(ids, texts)]

    def spelled(self, ids: np.ndarray) -> bytes:
        """The words of some tokens with a space between."""
        return b"".join(self.spelling[i] + b" " if self.closes[i] else self.spelling[i] for i in ids.tolist()).removesuffix(b" ")

    def window(self, text: bytes, goes_on: bool) -> np.ndarray:
        """Encode again; ``goes_on`` says that the last word does, so it gets no end mark."""
        ids = np.array(self.plain.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        if goes_on:
            start = self.word(ids, len(ids) - 1)[0]
            last = self.spelled(ids[start:]).decode("utf-8")
            ids = np.concatenate([ids[:start], np.array(self.inner.encode(last, add_special_tokens=False).ids, np.uint32)])
        return ids

    def word(self, ids: np.ndarray, token: int) -> tuple[int, int]:
        """First and last token of the word of a token."""
        a = b = token
        while a > 0 and not self.closes[ids[a - 1]]:
            a -= 1
        while b + 1 < len(ids) and not self.closes[ids[b]]:
            b += 1
        return a, b


@dataclass
class Half:
    """The ids of a stretch of normalised text, and whether it begins and ends with a space."""

    ids: np.ndarray
    lead: bool
    trail: bool


def cuts(text: str, leaf: int) -> list[str]:
    """Leaves of a text; none ends or begins within three characters of an apostrophe."""
    out, at = [], 0
    while at < len(text):
        end = at + leaf
        while end < len(text):
            near = text.rfind("'", max(end - 3, 0), end + 3)
            if near < 0:
                break
            end = near + 4
        out.append(text[at:end])
        at = end
    return out


def _left_end(words: Vocabulary, ids: np.ndarray, tokens: int) -> tuple[int, bool]:
    """The token where a window of about so many tokens of the left half starts; whether inside a word."""
    k = len(ids) - tokens
    if k <= 0:
        return 0, False
    begin, last = words.word(ids, k)
    if last - begin >= LONG_WORD:
        while k >= begin + LONG_WORD // 2 and not words.splits[ids[k]]:
            k -= 1
        if k >= begin + LONG_WORD // 2:
            return k, True
    return begin, False


def _right_end(words: Vocabulary, ids: np.ndarray, tokens: int) -> tuple[int, bool]:
    """The last token of the right half's part of the window; whether its word goes on."""
    j = tokens - 1
    if j >= len(ids) - 1:
        return len(ids) - 1, False
    begin, last = words.word(ids, j)
    if last - begin >= LONG_WORD:
        j = max(j, begin + LONG_WORD // 2)
        while j < last and not words.splits[ids[j + 1]]:
            j += 1
        if j < last:
            return j, True
    return last, False


def concatenated(words: Vocabulary, left: Half, right: Half, window: int = 4) -> Half:
    """The encoding of both stretches together."""
    a, b = left.ids, right.ids
    lead = left.lead if len(a) else left.lead or right.lead
    trail = right.trail if len(b) else right.trail or left.trail
    if not len(a) or not len(b) or left.trail or right.lead:  # nothing touches
        return Half(np.concatenate([a, b]), lead, trail)
    while True:
        k, inside_left = _left_end(words, a, window)
        j, inside_right = _right_end(words, b, window)
        w = words.window(words.spelled(a[k:]) + words.spelled(b[: j + 1]), inside_right)
        if _agree_left(words, a, w, k, inside_left) and _agree_right(words, b, w, j, inside_right):
            return Half(np.concatenate([a[:k], w, b[j + 1 :]]), lead, trail)
        window *= 2


def _agree_left(words: Vocabulary, a: np.ndarray, w: np.ndarray, k: int, inside: bool) -> bool:
    if k == 0:
        return True
    if inside:
        return bool(w[0] == a[k])
    return np.array_equal(w[: words.word(w, 0)[1] + 1], a[k : words.word(a, k)[1] + 1])


def _agree_right(words: Vocabulary, b: np.ndarray, w: np.ndarray, j: int, inside: bool) -> bool:
    if j == len(b) - 1:
        return True
    if inside:
        return bool(w[-1] == b[j])
    return np.array_equal(w[words.word(w, len(w) - 1)[0] :], b[words.word(b, j)[0] : j + 1])


def tree(words: Vocabulary, halves: list[Half]) -> Half:
    """Join neighbours, then their joins, up to the whole."""
    while len(halves) > 1:
        pairs = [concatenated(words, *halves[i : i + 2]) for i in range(0, len(halves) - 1, 2)]
        halves = pairs + halves[len(halves) - len(halves) % 2 :]
    return halves[0]


class Decoder:
    """The tokens' texts of a vocabulary in one table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        raw = [tokens.get(i, "").encode() + b" " for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of sequences of ids that stand one after the other: the tokens with one space between."""
        take, ends = self.lengths[ids], np.cumsum(counts)
        take[ends[counts > 0] - 1] -= 1  # no space after the last one
        offsets = np.concatenate([[0], np.cumsum(take)])[np.concatenate([[0], ends])]
        data = self.flat[ranges(self.starts[ids], take)]
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def lasting(kind: type, path: str):
    """The vocabulary or decoder of this Python worker, read once."""
    kept = sys.modules.setdefault("_quillgauge_words", types.ModuleType("_quillgauge_words")).__dict__
    name = f"{kind.__name__} {path}"
    if name not in kept:
        kept[name] = kind(path)
    return kept[name]


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """(row, ids, n_tokens): for each row its columns ``keep`` (all but the text) and the text's ids.

    ``ids`` are little-endian unsigned 32-bit integers, equal to ``encode(text,
    add_special_tokens=False).ids`` of the library's tokenizer without truncation and padding;
    strings of special tokens count as those, as they do there. Null texts are empty and have no
    ids. Repeated rows each give a row. Column names cannot clash: the caller's are in ``row``.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"), body.alias("body"))
    # texts with special tokens are cut at them, which the short way does not do
    special = [F.contains("body", F.lit(t)) for t in special_tokens(path)]
    long = reduce(lambda a, b: a | b, special, F.length("body") > 2 * leaf)
    short = rows.filter(~long)
    row_type = rows.schema["row"].dataType.simpleString()
    done = short.mapInArrow(partial(_encode_short, path=path), f"row {row_type}, ids binary")
    whole = _encode_long(rows.filter(long), row_type, path, leaf)
    return done.union(whole).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def _encode_long(rows: DataFrame, row_type: str, path: str, leaf: int) -> DataFrame:
    keyed = rows.withColumn("key", F.sha2("body", 256))
    leaves = keyed.mapInArrow(
        partial(_cut, path=path, leaf=leaf), f"row {row_type}, key string, section int, leaf int, special int, part string"
    )
    # equal rows have equal leaves: each is encoded once, the result stands as often as the row does
    once = leaves.groupBy("row", "key", "section", "leaf").agg(
        F.count(F.lit(1)).alias("copies"), F.first("special").alias("special"), F.first("part").alias("part")
    )
    halves = once.mapInArrow(
        partial(_encode_leaf, path=path), f"row {row_type}, key string, copies long, half struct<section:int,leaf:int,special:int,ids:binary,lead:boolean,trail:boolean>"
    )
    gathered = halves.groupBy("row", "key").agg(
        F.max("copies").alias("copies"), F.sort_array(F.collect_list("half")).alias("parts")
    )
    joined = gathered.mapInArrow(partial(_join_tree, path=path), f"row {row_type}, copies long, ids binary")
    return joined.select("row", "ids", F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BLOCK`` characters."""
    start = size = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        size += n
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode_short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = lasting(Vocabulary, path)
    normalised = words.whole.normalizer.normalize_str
    for batch in batches:
        for a, b in _blocks(batch.column("body")):
            row = batch.column("row").slice(a, b - a)
            for ids, counts in words.encoded([normalised(t) for t in batch.column("body").slice(a, b - a).to_pylist()]):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
                made = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays([row.slice(0, len(counts)), made.cast(pa.binary())], names=["row", "ids"])
                row = row.slice(len(counts))
        release_memory()


def _cut(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    words = lasting(Vocabulary, path)
    for batch in batches:
        for i in range(batch.num_rows):
            text, out = batch.column("body")[i].as_py(), []
            for section, (part, special) in enumerate(words.sections(text)):
                if special is not None:
                    out.append((section, 0, special, ""))
                out += [(section, n, None, piece) for n, piece in enumerate(cuts(part, leaf))]
            if not out:  # a text that the normaliser leaves nothing of
                out = [(0, 0, None, "")]
            one = pa.array([i] * len(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(one), batch.column("key").take(one),
                 *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string()))]],
                names=["row", "key", "section", "leaf", "special", "part"],
            )
        release_memory()


HALF = pa.struct([
    ("section", pa.int32()), ("leaf", pa.int32()), ("special", pa.int32()), ("ids", pa.binary()), ("lead", pa.bool_()), ("trail", pa.bool_()),
])


def _width(words: Vocabulary) -> str:
    """Ids between tasks take two bytes where the vocabulary allows it."""
    return "<u2" if len(words.closes) <= 1 << 16 else "<u4"


def _encode_leaf(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = lasting(Vocabulary, path)
    for batch in batches:
        for a, b in _blocks(batch.column("part")):
            rows = batch.slice(a, b - a)
            halves = words.halves(rows.column("part").to_pylist())
            made = [
                {"section": section, "leaf": leaf, "special": special, "ids": h.ids.astype(_width(words)).tobytes(), "lead": h.lead, "trail": h.trail}
                for h, section, leaf, special in zip(halves, *[rows.column(c).to_pylist() for c in ("section", "leaf", "special")])
            ]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in ("row", "key", "copies")], pa.array(made, HALF)], names=["row", "key", "copies", "half"]
            )
        release_memory()


def _join_tree(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = lasting(Vocabulary, path)
    for batch in batches:
        for i in range(batch.num_rows):
            ids, run, before = [], [], None
            for part in [*batch.column("parts")[i].as_py(), None]:
                if run and (part is None or part["section"] != before):
                    ids.append(tree(words, run).ids)
                    run = []
                if part is None:
                    break
                before = part["section"]
                if part["special"] is not None:
                    ids.append(np.array([part["special"]], np.uint32))
                else:
                    run.append(Half(np.frombuffer(part["ids"], _width(words)).astype(np.uint32), part["lead"], part["trail"]))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(i, 1), batch.column("copies").slice(i, 1), pa.array([flat.astype("<u4").tobytes()], pa.binary())],
                names=["row", "copies", "ids"],
            )
        release_memory()


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the library's ``decode(ids, skip_special_tokens=False)``; null ids are none, an empty text.

    These vocabularies have no decoder of their own: the library puts one space between tokens. ``into`` replaces a column of that name.
    """
    kept = [c for c in encoded.columns if c != into]
    rows = encoded.select((F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))).alias("row"), F.coalesce(F.col(ids), F.lit(b"")).alias("seq"))
    row_type = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(partial(_decode, path=path), f"row {row_type}, made string")

    def column(c: str) -> Column:
        return F.col("row").getField(c).alias(c)

    return made.select(*[column(c) for c in kept], F.col("made").alias(into))


#: Ids decoded at once.
DECODE_BLOCK = 1 << 16


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = lasting(Decoder, path)
    for batch in batches:
        seqs = [np.frombuffer(raw.as_buffer(), "<u4") if len(raw.as_buffer()) else np.zeros(0, "<u4") for raw in batch.column("seq")]
        counts = np.array([len(x) for x in seqs], np.int64)
        start = 0
        while start < len(seqs):
            end = max(start + 1, start + int(np.searchsorted(np.cumsum(counts[start:]), DECODE_BLOCK)))
            if counts[start] > DECODE_BLOCK:  # one long sequence, a block at a time
                end, blocks = start + 1, range(0, len(seqs[start]), DECODE_BLOCK)
                parts = [words.decoded(x, np.array([len(x)])) for x in (seqs[start][at : at + DECODE_BLOCK] for at in blocks)]
                made = pa.array([" ".join(part[0].as_py() for part in parts)], pa.string())
            else:
                made = words.decoded(np.concatenate(seqs[start:end]), counts[start:end])
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, end - start), made], names=["row", "made"])
            start = end
        release_memory()
