"""Words and word shingles of Arrow text batches, as numpy arrays.

A word is a maximal run of digits, ASCII letters and characters beyond ASCII; ASCII capitals are
lower-cased first. Because every byte of a character beyond ASCII is 0x80 or more in UTF-8, words can
be found on bytes, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Texts are handled in slices of about so many bytes, which bounds the memory of a task.
SLICE_BYTES = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte places in ``data``, and the first word of each text in ``first``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, lo: int, hi: int) -> str:
        """Words lo to hi - 1, with single spaces between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True)).decode("utf-8", "replace")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from differences of one running polynomial hash."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        lo = 0
        while lo < len(out):
            at = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + SLICE_BYTES, side="right")))
            end = int(self.ends[hi - 1])
            powers = _powers(_BASE, end - at + 1)
            run = np.zeros(end - at + 1, dtype=np.uint64)
            np.cumsum(_CODES[self.data[at:end]] * powers[: end - at], out=run[1:])
            s, e = self.starts[lo:hi] - at, self.ends[lo:hi] - at
            out[lo:hi] = (run[e] - run[s]) * _powers(_BASE_INVERSE, end - at + 1)[s]
            lo = hi
        return mix(out)


def words_of(texts: pa.Array) -> Words:
    """Words of all texts; a null text has none."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    if values is None or bounds[-1] == bounds[0]:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    data = _FOLD[np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = _IS_WORD[data]
    begins, stops = inside.copy(), np.append(inside, False)
    edge = bounds[:-1][bounds[:-1] < len(data)]
    before = np.concatenate([[False], inside[:-1]])
    before[edge] = False
    begins &= ~before
    after = np.append(inside[1:], False)
    after[edge[edge > 0] - 1] = False
    stops = inside & ~after
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the k words that start there, and whether those k lie in its text."""
    n = len(hashes)
    if n < k:
        return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[j : n - k + 1 + j]
    out = np.concatenate([mix(out), np.zeros(k - 1, dtype=np.uint64)])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return out, room >= k


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text, at least a row each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
