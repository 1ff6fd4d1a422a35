"""Vectorised words and shingles of Arrow string columns.

Every function works on one slice of a record batch (a few MB of text), so memory is bounded by the slice
and the longest single text.  A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 3 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KEY = np.uint64(0xD6E8FEB86659FD93)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection that spreads every input bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_STEP = mix(np.arange(301, 365, dtype=np.uint64) * _P) | np.uint64(1)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0, nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, off - (off[0] if len(off) else 0)


def pack(body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(body)


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Gives memory that the allocators have freed back to the system, where that is known how."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in row ranges whose texts have about ``most`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
        yield batch.slice(int(at[0]), len(at))


class Words:
    """The words of a slice: ``hash``, ``doc`` (row of each), ``start``/``end`` (byte range in ``raw``), ``first`` (offsets of each row's words)."""

    def __init__(self, texts: pa.Array):
        self.raw, off = string_buffers(texts)
        self.off, self.rows, n = off, len(texts), len(self.raw)
        solid = ~_SPACE[self.raw]
        begins, ends = solid.copy(), solid.copy()
        edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        inner = np.zeros(n + 1, dtype=bool)
        inner[edge] = True
        begins[1:] &= ~solid[:-1] | inner[1:n]
        ends[:-1] &= ~solid[1:] | inner[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, off)
        size = self.end - self.start
        if len(size):
            kept = _LOWER[self.raw[solid]]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, size)
            begin = np.flatnonzero(place & 7 == 0)  # each word in blocks of eight bytes, mixed with their place in the word
            block = np.add.reduceat(kept.astype(np.uint64) << ((place & 7) << 3).astype(np.uint64), begin)
            value = mix(block ^ mix(place[begin].astype(np.uint64) * _P + _KEY))
            self.hash = mix(np.add.reduceat(value, np.searchsorted(begin, at)) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(sums, factors): the words i .. j - 1 have the digest (sums[j] - sums[i]) * factors[i], before mixing."""
        n = len(self.hash)
        power, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_P, _INVERSE))
        return np.append(np.uint64(0), np.cumsum(self.hash * power[:n], dtype=np.uint64)), back

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, offsets): the k-word shingles of each row in text order; a row of 1 to k-1 words gives its whole sequence as one."""
        n, h = len(self.hash), self.hash
        count = np.diff(self.first)
        if n >= k:
            if k > len(_STEP) // 8:
                total, factor = self.prefixes()
                run = (total[k:] - total[:-k]) * factor[: n - k + 1]
            else:
                run = np.zeros(n - k + 1, np.uint64)
                for j in range(k):
                    run += h[j : n - k + 1 + j] * _STEP[j]
            run = mix(run)[self.doc[: n - k + 1] == self.doc[k - 1 :]]
        else:
            run = np.zeros(0, np.uint64)
        made = np.where(count >= k, count - k + 1, 0)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            whole = np.array([mix(np.array([(h[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], np.uint64))[0] for a, b in zip(self.first[few], self.first[few + 1], strict=True)], np.uint64)
            run = np.insert(run, np.concatenate(([0], np.cumsum(made)))[few], whole)
            made[few] = 1
        return run, np.concatenate(([0], np.cumsum(made)))

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """The sorted distinct shingles of each row."""
        run, off = self.shingles(k)
        return [np.unique(run[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
