"""Words of many texts at once: one numpy pass over the UTF-8 bytes of an Arrow column.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Each gets a 64-bit
hash that depends on its bytes alone, so equal words have equal hashes in every task. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are scanned in runs of about this size, which bounds memory

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEPS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if _powers.size < n:
        size = max(n, CHUNK_BYTES)
        for name, step in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            globals()[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers, _inverses


class RunHashes:
    """Hashes of byte runs of one buffer, each found from two prefix sums."""

    def __init__(self, values: np.ndarray):
        powers, self._inverse = _tables(values.size)
        self._sum = np.zeros(values.size + 1, np.uint64)
        np.cumsum(values * powers[: values.size], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        run = (self._sum[end] - self._sum[start]) * self._inverse[np.minimum(start, self._inverse.size - 1)]
        return mix(run + (end - start).astype(np.uint64) * _STEPS[4])


def byte_runs(data: np.ndarray) -> RunHashes:
    return RunHashes(_BYTE[data])


@dataclass
class Scan:
    """Words of a run of texts. Word i is data[start[i]:end[i]]; text t has words bounds[t]:bounds[t + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    runs: RunHashes
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.bounds.size - 1), self.n_words)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(mask.size + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def n_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and their bounds by text."""
        counts = np.maximum(self.n_words - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], counts)
        h = np.zeros(first.size, np.uint64)
        for j in range(k):
            h += self.hashes[first + j] * _STEPS[j % 5] + np.uint64(j)
            if k > 2:
                h = mix(h)
        return mix(h + np.uint64(k)), bounds


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes of text, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool, inside: np.ndarray = ~_SPACE) -> Scan:
    """The words of one run of texts; `lower` folds A-Z, `inside` marks the bytes that words are made of."""
    if lower:
        data = _LOWER[data]
    word = inside[data]
    full = offsets[:-1] < offsets[1:]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], ends[last] = word[first], word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    runs = byte_runs(data)
    return Scan(data, offsets, start, end, np.searchsorted(start, offsets), runs, runs.of(start, end))


def scans(texts: pa.Array | pa.ChunkedArray, lower: bool, inside: np.ndarray = ~_SPACE) -> Iterator[tuple[int, int, Scan]]:
    for at, end, data, offsets in chunks(texts):
        yield at, end, scan(data, offsets, lower, inside)


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z folded.

    A text of fewer than k words has its whole sequence as one shingle; a text without words has none.
    """
    for _, _, s in scans(texts, lower=True):
        grams, bounds = s.n_grams(k)
        for t, n in enumerate(s.n_words):
            if n >= k:
                yield np.unique(grams[bounds[t] : bounds[t + 1]])
            elif n:
                h = np.array([n], np.uint64)
                for word in s.hashes[s.bounds[t] : s.bounds[t + 1]]:
                    h = mix(h * _STEPS[0] + word)
                yield h
            else:
                yield np.zeros(0, np.uint64)
