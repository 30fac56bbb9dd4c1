"""Vectorised byte-level text kernels shared by the operators.

All of them work on a run of documents as Arrow hands them over: one byte
buffer plus offsets.  Byte ranges are hashed eight bytes at a step, all ranges
at once, each step through a bijective finaliser; long ranges by BLAKE2b.  No
hash is a polynomial of the bytes, so texts of no shape collide by construction,
and nothing is kept between batches.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LANES = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))
#: Ranges of more bytes are digested one by one.
LONG = 512
#: Numbers worked on at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15
#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words: everything but space and \t \n \v \f \r
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: bytes of words: digits, lower-case letters and all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(n_bytes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    ends = np.cumsum(n_bytes)
    i, n = 0, len(n_bytes)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        i = j


def give_back() -> None:
    """Returns freed memory to the system: workers stay alive between stages, and what one has freed another may need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches with at most `limit` text bytes (or one row)."""
    for b in it:
        if not b.num_rows:
            continue
        data, offs = buffers(b.column(b.schema.get_field_index(column)))
        for i, j in pieces(np.diff(offs), limit):
            yield b.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
    b = data = offs = None
    give_back()


def _loader(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, zero beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
    size = end - start
    at = _loader(data)
    out = [np.empty(len(size), np.uint64) for _ in range(lanes)]
    for i in range(0, len(size), BLOCK):
        first, n = start[i : i + BLOCK], size[i : i + BLOCK]
        # most ranges are words of eight bytes at most: the first step is made for all
        w = at[first] & _MASK[np.minimum(n, 8)]
        own = []
        for k, lane in enumerate(LANES[:lanes]):
            h = mix(n.astype(np.uint64) + lane)
            own.append(np.where(n > 0, mix(h ^ (w if k == 0 else mix(w + lane))), h))
        live = np.flatnonzero((n > 8) & (n <= LONG))
        p, left = first[live] + 8, n[live] - 8
        while len(live):
            w = at[p] & _MASK[np.minimum(left, 8)]
            for k, h in enumerate(own):
                h[live] = mix(h[live] ^ (w if k == 0 else mix(w + LANES[k])))
            go = left > 8
            live, p, left = live[go], p[go] + 8, left[go] - 8
        for k, h in enumerate(own):
            out[k][i : i + BLOCK] = h
    for i in np.flatnonzero(size > LONG).tolist():
        d = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), np.uint64)
        for k, h in enumerate(out):
            h[i] = d[k]
    return out


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]."""
    return _hash(data, start, end, 1)[0]


def range_digest(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each data[start:end], as two halves."""
    a, b = _hash(data, start, end, 2)
    return a, b


def equal_ranges(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from xs in x are those from ys in y, size of them."""
    ok = np.ones(len(size), bool)
    a, b = _loader(x), _loader(y)
    live = np.flatnonzero(size > 0)
    p, q, left = xs[live], ys[live], size[live]
    while len(live):
        same = ((a[p] ^ b[q]) & _MASK[np.minimum(left, 8)]) == 0
        ok[live[~same]] = False
        go = same & (left > 8)
        live, p, q, left = live[go], p[go] + 8, q[go] + 8, left[go] - 8
    return ok


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document its first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    edge = inside[1:] != inside[:-1]
    cut = np.unique(offs[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    split = cut[inside[cut] & inside[cut + 1]]  # a word on either side of a document's end
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    if len(split):
        starts, ends = np.sort(np.append(starts, split)), np.sort(np.append(ends, split))
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = True):
    """(starts, ends, first word of each document, 64-bit word hashes)."""
    if lower:
        data = LOWER[data]
    s, e, ptr = spans(data, offs, table)
    return s, e, ptr, range_hash(data, s, e)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(hashes) - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(0, m, BLOCK):
        part = out[j : j + BLOCK]
        for i in range(n):
            part *= U64(0x9E3779B97F4A7C15)
            part ^= part >> U64(29)
            part += hashes[i + j : i + j + len(part)]
        part[:] = mix(part)
    return out


def shingles(hashes: np.ndarray, ptr: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document, sorted within it.

    A document with fewer words, but not none, has its whole sequence as one.
    Returns (shingle hashes, document row of each, first shingle of each document).
    """
    n_docs = len(ptr) - 1
    counts = np.diff(ptr)
    all_ = combine(hashes, n)
    doc_of = np.repeat(np.arange(n_docs), np.maximum(counts - n + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(counts - n + 1, 0))])[:-1]
    at = np.arange(len(doc_of)) - first[doc_of] + ptr[:-1][doc_of]
    vals = all_[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            extra[i] = combine(hashes[ptr[d] : ptr[d + 1]], int(counts[d]))[0]
        extra = mix(extra + counts[short].astype(np.uint64))
        vals, doc_of = np.concatenate([vals, extra]), np.concatenate([doc_of, short])
    # sort by document, then hash: documents are few per piece, so their number fits the top bits of a second key
    order = np.argsort(vals, kind="stable")
    order = order[np.argsort(doc_of[order], kind="stable")]
    vals, doc_of = vals[order], doc_of[order]
    keep = np.ones(len(vals), bool)
    keep[1:] = (vals[1:] != vals[:-1]) | (doc_of[1:] != doc_of[:-1])
    vals, doc_of = vals[keep], doc_of[keep]
    return vals, doc_of, np.searchsorted(doc_of, np.arange(n_docs + 1))
