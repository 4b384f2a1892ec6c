"""Whole Arrow batches of texts as flat code-point arrays, for vectorised text statistics.

A batch's UTF-8 value buffer is decoded once; every text is then a slice of one array, and
folding, filtering, window hashing and duplicate search run over all texts of the batch in numpy.
Nulls count as empty texts. Batches are cut into chunks of bounded size, so very long texts
(one text is never split) and wide batches stay within memory.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points processed at once, unless a single text is longer.
CHUNK_CHARS = 1_000_000

SKIP, LETTER, DIGIT, CJK = 0, 1, 2, 3


def is_cjk(c: int) -> bool:
    return 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x323AF


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """fold: code point -> lower-case half-width code point; kind: SKIP, LETTER, DIGIT or CJK."""
    n = 0x110000
    fold = np.arange(n, dtype=np.uint32)
    kind = np.zeros(n, dtype=np.uint8)
    for c in range(0x32400):
        if 0xD800 <= c < 0xE000:
            continue
        if 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c:
            kind[c] = CJK if is_cjk(c) else LETTER if chr(c).isalnum() else SKIP
            continue
        ch = chr(c)
        if ch.isalnum():
            kind[c] = CJK if is_cjk(c) else DIGIT if unicodedata.category(ch)[0] == "N" else LETTER
        low = ch.lower()
        if 0xFF01 <= c <= 0xFF5E:
            low = chr(c - 0xFEE0).lower()
        if len(low) == 1:
            fold[c] = ord(low)
    return fold, kind


class TextBatch:
    """cps: code points of all texts in a row; off: where each text starts, with the end last."""

    __slots__ = ("cps", "off")

    def __init__(self, cps: np.ndarray, off: np.ndarray):
        self.cps, self.off = cps, off

    def __len__(self) -> int:
        return len(self.off) - 1

    @classmethod
    def of(cls, texts: pa.Array | list) -> "TextBatch":
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        arr = arr.cast(pa.large_string())
        n = len(arr)
        if n == 0:
            return cls(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if arr.null_count:
            arr = arr.fill_null("")
        bufs = arr.buffers()
        boff = np.frombuffer(bufs[1], np.int64, n + 1 + arr.offset)[arr.offset :]
        if bufs[2] is None or boff[-1] == boff[0]:
            return cls(np.zeros(0, np.uint32), np.zeros(n + 1, np.int64))
        raw = memoryview(bufs[2])[boff[0] : boff[-1]]
        cps = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        return cls(cps, lead[boff - boff[0]].astype(np.int64))

    def owner(self) -> np.ndarray:
        """The index of its text, for each code point."""
        return np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.off))

    def folded(self) -> "TextBatch":
        return TextBatch(tables()[0][self.cps], self.off)

    def kept(self, mask: np.ndarray) -> "TextBatch":
        run = np.concatenate(([0], np.cumsum(mask)))
        return TextBatch(self.cps[mask], run[self.off])

    def letters(self) -> "TextBatch":
        """Letters and digits only, folded."""
        fold, kind = tables()
        return TextBatch(fold[self.cps], self.off).kept(kind[self.cps] != SKIP)

    def squeezed(self, gap: int) -> "TextBatch":
        """Neighbouring gaps of a text are one."""
        empty = self.cps == gap
        keep = np.ones(len(self.cps), bool)
        keep[1:] = ~(empty[1:] & empty[:-1])
        keep[self.off[:-1][np.diff(self.off) > 0]] = True
        return self.kept(keep)

    def begins(self, size: int) -> np.ndarray:
        """For each place but the last size - 1 of all, whether a window of that size lies within the place's text."""
        some = self.off[:-1] < self.off[1:]
        start, end = self.off[:-1][some], self.off[1:][some]
        out = np.ones(len(self.cps), bool)
        for j in range(1, size):  # the last size - 1 places of a text begin none
            out[np.maximum(end - j, start)] = False
        return out[: len(self.cps) - size + 1]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of one value per code point, by text."""
        run = np.concatenate(([0], np.cumsum(values)))
        return run[self.off[1:]] - run[self.off[:-1]]


MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser over 64-bit words (xor-shift-multiply)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(BASE, -1, 1 << 64)
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, inv, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    return _powers(size)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of mixed values times powers of an odd base, modulo 2^64."""
    up, _ = powers(len(values))
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values) * up[: len(values)], dtype=np.uint64)))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same for equal spans wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * down[start] + MIX * (end - start).astype(np.uint64))


def window_starts(batch: TextBatch, size: int) -> np.ndarray:
    """Starts of all windows of that size that lie within one text."""
    n = len(batch.cps)
    if n < size:
        return np.zeros(0, np.int64)
    room = np.repeat(batch.off[1:], np.diff(batch.off)) - np.arange(n)
    return np.flatnonzero(room >= size)


def chunks(arr: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array holding at most about limit bytes each, at least one row."""
    n = len(arr)
    if n == 0:
        return
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + 3 * limit, "right")) - 1)
        yield at, min(to, n)
        at = to
