"""Vectorised word and window hashing over the UTF-8 bytes of an Arrow text column.

Small numpy helpers that run inside Spark tasks. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D. Hashes are 64-bit polynomial sums with a final mixing step.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: For work that needs some hundred bytes for each byte of text: a slice takes a few ten MB at most.
SMALL_SLICE = 1 << 18
_WORD_BASE, _SEQUENCE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A fixed random 64-bit value for each byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> np.uint64:
    return mix(np.array([x & (2**64 - 1)], np.uint64))[0]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least ``n`` of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, (SMALL_SLICE if n <= SMALL_SLICE + 4096 else SLICE_BYTES) + 4096)
        up, down = np.full(size, np.uint64(base)), np.full(size, np.uint64(pow(base, -1, 2**64)))
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= SLICE_BYTES + 4096:  # a worker lives on: what one long text needs is not kept
            _powers[base] = have
    return have


def lasting() -> dict[str, object]:
    """What this Python worker keeps between tasks.

    Code of this library travels to the workers by value, so a worker's lasting state is kept
    in a module of its own.
    """
    return sys.modules.setdefault("_quillgauge_worker", types.ModuleType("_quillgauge_worker")).__dict__


def forget_lasting() -> None:
    """For tasks that need none of it: what other operators left in this worker is dropped."""
    kept = lasting()
    for name in [k for k in kept if not k.startswith("__")]:
        del kept[name]


def release_memory() -> None:
    """Give what numpy and Arrow have freed back to the system: a Python worker lives on beside the
    JVM between tasks and stages, and keeps some 200 MB otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    out = np.zeros(len(x) + 1, np.uint64 if x.dtype == np.uint64 else np.int64)
    np.cumsum(x, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


@dataclass
class Texts:
    """A few whole texts: their bytes, one after the other, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # the row of the batch that the first text came from

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte for each text."""
        total = running(flags)
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def solid(self) -> np.ndarray:
        return ~SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end."""
        solid, n = self.solid, len(self.data)
        before = np.zeros(n + 1, bool)
        before[1:] = solid
        before[self.offsets] = False
        after = np.zeros(n + 1, bool)
        after[:n] = solid
        after[self.offsets] = False
        return np.flatnonzero(solid & ~before[:n]), np.flatnonzero(solid & ~after[1:]) + 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def byte_hashes(self) -> np.ndarray:
        up, _ = powers(_WORD_BASE, len(self.data) + 1)
        return running(BYTE_VALUES[self.data] * up[: len(self.data)])

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        _, down = powers(_WORD_BASE, len(self.data) + 1)
        return mix((self.byte_hashes[ends] - self.byte_hashes[starts]) * down[starts])

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(*self.words)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_offsets))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words within a text, and their hashes."""
        return sequence_windows(self.word_hashes, self.word_offsets, size)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def window_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    return ranges(offsets[:-1], counts)


def sequence_windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts = window_starts(offsets, size)
    up, down = powers(_SEQUENCE_BASE, len(hashes) + 1)
    total = running(hashes * up[: len(hashes)])
    return starts, mix((total[starts + size] - total[starts]) * down[starts])


def whole_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence; its length takes part."""
    up, down = powers(_SEQUENCE_BASE, len(hashes) + 1)
    total = running(hashes * up[: len(hashes)])
    lengths = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + lengths * np.uint64(_WORD_BASE))


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a text column into runs of whole texts of about ``limit`` bytes; nulls are empty texts.

    ``lower`` turns A-Z into a-z; other letters stay as they are.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        data = raw[offsets[i] : offsets[j]]
        yield Texts(LOWER[data] if lower else data, offsets[i : j + 1] - offsets[i], i)
        i = j


def distinct_per_text(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, key) pairs, ordered by owner then key."""
    if not len(keys):
        return keys, owners
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[first], owners[first]
