"""Token ids of whole texts through the ``tokenizers`` library, once per distinct piece of text.

Both supported vocabularies (byte-level BPE with the usual split pattern, and lower-casing BPE
with word ends) never let a token reach over the end of a word. Texts are therefore cut at places
where each of the patterns cuts: before ASCII white space that follows a character which is surely
not white space, and between a Latin letter and ASCII punctuation. The library encodes each
distinct piece once per Python worker; equal pieces are found by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from quillgauge.llm.arrays import Texts, lasting, ranges

#: Distinct pieces a worker remembers before it starts anew; bounds its memory, not the results.
REMEMBERED = 600_000

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0D]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_PUNCTUATION = _VISIBLE & ~_LETTER
_PUNCTUATION[ord("0") : ord("9") + 1] = False


class PieceEncoder:
    """Encodes texts; ``drops_space`` says that the vocabulary ignores white space and case."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a vocabulary whose normaliser lower-cases drops white space before its pre-tokeniser sees it
        self.drops_space = self.tokenizer.normalizer is not None
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # in order, with the number of each piece
        self.numbers = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the pieces are cut, and the span of each that the vocabulary looks at."""
        data, n = texts.data, len(texts.data)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        previous = np.zeros(n, np.uint8)
        previous[1:] = data[:-1]
        lead = np.zeros(n, np.uint8)
        lead[2:] = data[:-2]
        two_bytes = (previous >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)  # no white space among them
        latin = (previous >= 0x80) & (lead == 0xC3) & (previous != 0x97) & (previous != 0xB7)
        cut = _BREAK[data] & (_VISIBLE[previous] | two_bytes)
        cut |= _PUNCTUATION[data] & (_LETTER[previous] | latin)
        cut[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
        cuts = starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if self.drops_space:
            solid = np.flatnonzero(~_BREAK[data])
            at = np.searchsorted(solid, starts)
            starts = np.minimum(np.append(solid, n)[at], ends)
        return cuts, starts, ends

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        if self.drops_space and len(texts.data):
            following = np.zeros(len(texts.data), np.uint8)
            following[:-1] = texts.data[1:]
            upper = (texts.data >= ord("A")) & (texts.data <= ord("Z")) & (following < 0x80)
            texts = Texts(texts.data + upper.astype(np.uint8) * np.uint8(32), texts.offsets, texts.first)
        cuts, starts, ends = self.pieces(texts)
        hashes, first, inverse = np.unique(texts.span_hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = texts.data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            numbers = self.learn([raw[a:b].decode("utf-8", "replace") for a, b in spans])
            self.hashes, self.numbers = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.numbers, at[new], numbers)
        codes = self.numbers[np.searchsorted(self.hashes, hashes)][inverse] if len(hashes) else np.zeros(0, np.int64)
        lengths = self.lengths[codes]
        ids = self.flat[ranges(self.starts[codes], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(cuts, texts.offsets)
        return ids, np.diff(total[at])

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Encode new pieces; returns their numbers."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum()))
        n = len(self.hashes)
        while len(self.starts) < n + len(pieces):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.lengths[n : n + len(pieces)] = lengths
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.arange(n, n + len(pieces))


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; what it has learned serves all its tasks."""
    kept = lasting()
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]
