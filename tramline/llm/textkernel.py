"""Vectorised word, line and shingle hashing over batches of UTF-8 text.

A batch is one flat byte array with document offsets, as Arrow stores it, so
no Python object is made per word. Words are maximal runs of bytes other than
space and 0x09-0x0D, which in UTF-8 is the same as runs of such code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
SLICE_BYTES = 1 << 20

#: glibc's way to return freed heap; elsewhere none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that scatters all bits."""
    z = x + GOLDEN
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> U64(shift)
        z *= U64(factor)
    z ^= z >> U64(31)
    return z


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1)."""
    u = (h >> U64(11)).astype(np.float64)
    u += 0.5
    u *= 1.0 / (1 << 53)
    return u


_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _BASE, dtype=U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(p, dtype=U64)
    return _powers[:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    text = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(edges, edges[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def flat(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and their offsets; null is empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if lower:
        text = pc.utf8_lower(text)
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pa.concat_arrays([text])
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(text) + 1 + text.offset)[text.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch: ``start``, ``end`` (bytes), ``doc``, ``hash``, and per document ``first`` (offsets into words)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, hashes: bool = True):
        self.raw, self.off, self.n_docs = raw, off, len(off) - 1
        solid = ~SPACE[raw]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        inner = off[1:-1]
        before[inner[inner < len(raw)]] = False
        begins = solid & ~before
        self.start = np.flatnonzero(begins)
        after = np.empty_like(solid)
        if len(raw):
            after[:-1] = solid[1:]
            after[-1] = False
            cut = inner[(inner > 0) & (inner <= len(raw))] - 1
            after[cut] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.hash = span_hashes(raw[solid], self.end - self.start) if hashes else None

    def at(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)


def span_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive spans (lengths of 1 at least) that fill ``data``."""
    if not len(lengths):
        return np.zeros(0, U64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        terms = (data.astype(U64) + U64(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, begin) + lengths.astype(U64))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every window of ``size`` words; a shorter document with words has one window, all of it."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U64)
        for k in range(size):
            part = h[k:] * mix(np.array([k + 1], U64))[0]
            total[: n - k] += np.where(doc[k:] == doc[: n - k], part, U64(0))
        at = words.at()
        whole = at + size <= words.count[doc]
        keep = whole | ((at == 0) & (words.count[doc] < size))
        return mix(total[keep]), doc[keep]


def sequence_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each document's word sequence; equal sequences have equal keys."""
    out = []
    at = words.at().astype(U64)
    with np.errstate(over="ignore"):
        for seed in (U64(0x51ED270B), U64(0xC2B2AE35)):
            terms = mix(words.hash ^ mix(at + seed))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
            out.append(mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(U64) * seed))
    return out[0], out[1]


PUNCT = np.zeros(256, dtype=bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(raw: np.ndarray) -> np.ndarray:
    """Lower case of the same length: ASCII, and Latin letters of two bytes that start with 0xC3."""
    out = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    big = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
    out[big] += 0x20
    return out


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in the given disjoint spans, each longer than 0."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[begin] += 1
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:-1]) > 0


class Cores:
    """Words without outer punctuation, case folded; words of punctuation alone are left out.

    ``begin``, ``end`` (bytes), ``doc``, ``hash``, and ``first``: each document's offset into them.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, outer: np.ndarray = PUNCT):
        words = Words(raw, off, hashes=False)
        core = np.flatnonzero(~SPACE[raw] & ~outer[raw])
        lo, hi = np.searchsorted(core, words.start), np.searchsorted(core, words.end)
        some = hi > lo
        self.begin, self.end = core[lo[some]], core[hi[some] - 1] + 1
        self.doc = words.doc[some]
        self.first = np.searchsorted(self.doc, np.arange(len(off)))
        self.low = fold_case(raw)
        self.hash = span_hashes(self.low[covered(len(raw), self.begin, self.end)], self.end - self.begin)


def code_points(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions as code point positions inside their documents."""
    total = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return total[at] - total[off[doc]]
