"""Vectorised text kernels on Arrow batches: words, hashes and n-grams of many documents at once.

A chunk is a run of whole documents of about ``max_bytes`` bytes (a longer
document is a chunk of its own), so temporary arrays stay small at any text
length. Words are maximal runs of bytes other than ASCII white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  where the C library is another one, it keeps its own counsel
except (OSError, AttributeError):
    _libc = None
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Base of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Give memory that the last batch needed back to the system: a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _INVERSE**i for i in 0..n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Chunk:
    """Whole documents: ``buf`` their bytes, ``off`` their n + 1 offsets, ``row`` the first one's row in the batch."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, row: int):
        self.buf, self.off, self.row, self.n = buf, off, row, len(off) - 1


def chunks(texts: pa.Array, lower: str = "", max_bytes: int = 1 << 20, max_docs: int = 1000) -> Iterator[Chunk]:
    """lower: "unicode", "ascii" (A-Z only) or "". Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, min(i + max_docs, int(np.searchsorted(ends, before + max_bytes, "right"))))
        part = texts.slice(i, j - i)
        if lower == "unicode":
            part = pc.utf8_lower(part)
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
        if lower == "ascii":
            buf = _FOLD[buf]
        yield Chunk(buf, off - off[0], i)
        i = j
    release()


class Words:
    """Words of a chunk: byte spans, 64-bit hashes, and ``off``: the n + 1 offsets of documents in them."""

    def __init__(self, c: Chunk):
        ink = ~_SPACE[c.buf]
        edge = np.zeros(len(ink) + 1, bool)
        edge[:-1] |= ink
        edge[1:] ^= ink  # where ink begins or ends
        cuts = c.off[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(ink))])
        both = cuts[ink[cuts] & ink[cuts - 1]]  # a word ends and another begins between documents
        if len(ink):
            at = np.flatnonzero(edge)
            self.start = np.sort(np.concatenate([at[::2], both])) if len(both) else at[::2]
            self.end = np.sort(np.concatenate([at[1::2], both])) if len(both) else at[1::2]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.off = np.searchsorted(self.start, c.off)
        self.hash = span_hash(c.buf, self.start, self.end)
        self.n = len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def prefix(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=h[1:])
    return h


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes, equal hashes."""
    h = prefix(buf) if h is None else h
    _, down = powers(len(buf) + 1)
    return mix((h[end] - h[start]) * down[start] ^ ((end - start).astype(U64) << U64(56)))


def ngrams(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside each document and the document of each; order counts."""
    total = len(words)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    up, _ = powers(n)
    m = total - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h += words[k : k + m] * up[k]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = doc[:m] == doc[n - 1 :]
    return mix(h[inside]), doc[:m][inside]


def by_doc(doc: np.ndarray, keys: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document, sorted: keys (their top 54 bits), offsets of documents, counts."""
    assert n_docs < 1024
    x = np.sort((doc.astype(U64) << U64(54)) | (keys >> U64(10)))
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(x)))
    x = x[at]
    off = np.searchsorted(x, np.arange(n_docs + 1, dtype=U64) << U64(54))
    return x & U64((1 << 54) - 1), off, count


def rows_to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=False) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
