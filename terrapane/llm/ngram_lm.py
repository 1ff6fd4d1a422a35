"""LM scoring with an Elias-Fano n-gram trie.

The first level of the trie is the vocabulary: the sorted 64-bit digests of all training words and the end token, coded as an
Elias-Fano sequence.  The second level holds the successors of each word: ids made monotone by the context's offset, coded by
Elias-Fano, with quantised smoothed probabilities, and a monotone pointer sequence from contexts to their successors.  A lookup
is a successor search inside the context's range.

Counting covers every training token.  Words are counted by a shuffle; bigrams are packed, sorted and delta-coded by tasks and
merged by shards of the bigram space; frequent contexts span several shards, so no context gathers in one task.
Each shard writes its levels as files to the shared folder, and scoring tasks map them into memory: pages are read on demand, so
the heap does not grow with the model.  The shared folder must be a file system that tasks can map (file:); others are refused.

p(w | h) = (c(h, w) + m p(w)) / (c(h) + m), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); a text's first word is conditioned on the end token.
Both c(h, w) / (c(h) + m) and m / (c(h) + m) are kept as 16-bit codes on a logarithmic scale down to 1e-20, below 1 / (c(h) + m) of any count of 64 bits
(relative error below 0.04 %).

Defined cases: null or empty texts are one end token; no training texts: N = V = 0 and every token has p = 1.
"""

from __future__ import annotations

import math
import mmap
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import Words, slices

END = np.uint64(0x5EED0FE2D0000001)
MASS = 4.0
_ONE, _6 = np.uint64(1), np.uint64(6)
_U = np.uint64


def as_file_dir(url: str) -> str:
    path = url.removeprefix("file://").removeprefix("file:")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"the model's folder must be a file system that tasks can map, not {url}")
    return path


# ---- Elias-Fano -------------------------------------------------------------------------------------------------


_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _found = [i for i in range(8) if _byte >> i & 1]
    _PLACE[_byte, : len(_found)] = _found
_PLACE = _PLACE.ravel()


def nth_one(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) one in each 64-bit word: byte sums side by side, then a table."""
    x = word - ((word >> _ONE) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    upto = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    k = k.astype(_U)
    byte = np.bitwise_count(((k * _ONES | _TOPS) - upto) & _TOPS).astype(_U) << _U(3)
    before = (upto << _U(8)) >> byte & _U(255)
    return byte.astype(np.int64) + _PLACE[((word >> byte & _U(255)) << _U(3) | (k - before)).astype(np.int64)]


def before(count: np.ndarray) -> np.ndarray:
    """The ones before each word, from the ones in each word."""
    out = np.cumsum(count, dtype=np.uint32)
    return out - count.astype(np.uint32)


def select(high: np.ndarray, ranks: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """The place of the k-th one (flip: zero) of a bit sequence with the ones (zeros) before each word."""
    word = np.searchsorted(ranks, k.astype(np.uint32), side="right") - 1
    bits = ~high[word] if flip else high[word]
    return word * 64 + nth_one(bits, k - ranks[word].astype(np.int64))


class EliasFano:
    """A sorted sequence of 64-bit numbers below ``universe``: low bits packed, high bits in unary, with the ones and zeros before each word."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.bits = low, high, ones, zeros, n, bits
        self.top = int(self.get(np.array([n - 1]))[0]) >> bits if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            part, at = values & _U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, part << shift)
            spill = (shift.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (_U(64) - shift[spill]))
        up = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(up[-1]) if n else 0) // 64 + 2, _U)
        np.bitwise_or.at(high, up >> 6, _ONE << (up & 63).astype(_U))
        count = np.bitwise_count(high).astype(np.int64)
        return cls(low, high, before(count), before(64 - count), n, bits)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        up = (select(self.high, self.ones, i, False) - i).astype(_U)
        return up << _U(self.bits) | self.low_bits(i)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at places i."""
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        w, shift = at >> 6, (at & 63).astype(_U)
        low = self.low[w] >> shift
        over = np.flatnonzero(shift > _U(64 - self.bits))
        low[over] |= self.low[w[over] + 1] << (_U(64) - shift[over])
        return low & _U((1 << self.bits) - 1)

    def find(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number that is not below value in first .. end - 1, else end; is it value?): successor search in ranges.

        The zeros around a high part bound the numbers that share it; a binary search over their low bits goes on among those.
        """
        part = np.minimum(value >> _U(self.bits), _U(self.top + 1)).astype(np.int64)
        hi = select(self.high, self.zeros, part, True) - part
        lo = np.where(part > 0, select(self.high, self.zeros, np.maximum(part - 1, 0), True) + 1 - part, 0)
        lo, hi = np.clip(lo, first, end), np.clip(hi, first, end)
        want, stop = value & _U((1 << self.bits) - 1), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_bits(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        same = lo < stop
        same[same] = self.low_bits(lo[same]) == want[same]
        return lo, same

    def parts(self) -> list[np.ndarray]:
        even = lambda a: np.concatenate([a, np.zeros(len(a) % 2, np.uint32)])
        return [np.array([self.n, self.bits, len(self.low), len(self.high), len(self.ones), len(self.zeros)], _U), self.low, self.high, even(self.ones), even(self.zeros)]

    @classmethod
    def mapped(cls, blob: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = (int(x) for x in blob[at : at + 6])
        at, found = at + 6, []
        for k, size in enumerate(sizes):
            words = size if k < 2 else (size + 1) // 2
            found.append(blob[at : at + words] if k < 2 else blob[at : at + words].view(np.uint32)[:size])
            at += words
        return cls(*found, n, bits), at


# ---- quantised probabilities -------------------------------------------------------------------------------------

CODES = np.concatenate(([0.0], np.exp(np.linspace(math.log(1e-20), 0.0, 65535))))
_EDGES = np.concatenate(([1e-300], np.sqrt(CODES[1:-1] * CODES[2:])))


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: 0 for none, 1-65535 even steps of log p from 1e-20 to 1."""
    return np.searchsorted(_EDGES, p, side="right").astype(np.uint16)


# ---- tokens ------------------------------------------------------------------------------------------------------


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word digests with one end token after each row, offsets)."""
    w = Words(column)
    return np.insert(w.hash, w.first[1:], END), w.first + np.arange(len(w.first))


def contexts(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The token before each token; the end token before the first of a row."""
    out = np.concatenate(([END], flat[:-1]))[: len(flat)]
    out[off[:-1]] = END
    return out


# ---- files -------------------------------------------------------------------------------------------------------


def write_file(path: str, arrays: list[np.ndarray]) -> None:
    """Written aside and renamed, so a task that runs again replaces the same file."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(aside, path)


@lru_cache(maxsize=4096)
def mapped_file(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ), _U)


class Vocabulary:
    """The first level: shards of the digest space, each an Elias-Fano sequence of digests and the counts; ids are global ranks."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.shards = folder, len(sizes)
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def ids(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of distinct sorted digests."""
        out, count = np.full(len(digests), -1, np.int64), np.zeros(len(digests), np.int64)
        shard = ((digests >> _U(32)) * _U(self.shards) >> _U(32)).astype(np.int64)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            if self.base[s + 1] == self.base[s]:
                continue
            ef, counts = vocabulary_shard(f"{self.folder}/words-{s}")
            want = digests[cut[s] : cut[s + 1]]
            at, hit = ef.find(want, np.zeros(len(want), np.int64), np.full(len(want), ef.n, np.int64))
            safe = np.minimum(at, ef.n - 1)
            out[cut[s] : cut[s + 1]] = np.where(hit, self.base[s] + at, -1)
            count[cut[s] : cut[s + 1]] = np.where(hit, counts[safe].astype(np.int64), 0)
        return out, count


@lru_cache(maxsize=4096)
def vocabulary_shard(path: str) -> tuple[EliasFano, np.ndarray]:
    blob = mapped_file(path)
    ef, at = EliasFano.mapped(blob, 0)
    return ef, blob[at : at + ef.n]


class SuccessorShard:
    """The second level in one range of the bigram space: contexts, pointers, successors and codes."""

    def __init__(self, path: str):
        blob = mapped_file(path)
        self.context, at = EliasFano.mapped(blob, 0)
        self.pointer, at = EliasFano.mapped(blob, at)
        self.successor, at = EliasFano.mapped(blob, at)
        self.code = blob[at:].view(np.uint16)

    @staticmethod
    def arrays(h: np.ndarray, w: np.ndarray, p: np.ndarray, vocabulary: int) -> list[np.ndarray]:
        """The level of distinct sorted bigrams: successor ids are made monotone by adding the context's number times the vocabulary."""
        ctx, first = np.unique(h, return_index=True)
        number = np.repeat(np.arange(len(ctx)), np.diff(np.append(first, len(h))))
        code = quantised(p)
        code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint16)])
        parts = [EliasFano.encode(ctx.astype(_U), vocabulary), EliasFano.encode(np.append(first, len(h)).astype(_U), len(h) + 1), EliasFano.encode(number.astype(_U) * _U(vocabulary) + w.astype(_U), max(1, len(ctx)) * vocabulary)]
        return [a for e in parts for a in e.parts()] + [code]

    def lookup(self, h: np.ndarray, w: np.ndarray, vocabulary: int) -> np.ndarray:
        """The probability kept for each bigram (0: not there)."""
        n, out = self.context.n, np.zeros(len(h))
        each, back = np.unique(h, return_inverse=True)
        number, there = self.context.find(each.astype(_U), np.zeros(len(each), np.int64), np.full(len(each), n, np.int64))
        number = np.minimum(number, n - 1)
        first, end = self.pointer.get(number).astype(np.int64), self.pointer.get(number + 1).astype(np.int64)
        known = np.flatnonzero(there[back])
        number, first, end = number[back[known]], first[back[known]], end[back[known]]
        want = number.astype(_U) * _U(vocabulary) + w[known].astype(_U)
        at, hit = self.successor.find(want, first, end)
        out[known[hit]] = CODES[self.code[at[hit]]]
        return out


@lru_cache(maxsize=4096)
def successor_shard(path: str) -> SuccessorShard:
    return SuccessorShard(path)


# ---- training ----------------------------------------------------------------------------------------------------


def word_shards(rows: DataFrame, folder: str, shards: int) -> list[int]:
    """Counts the training words, writes the first level, and returns the number of words in each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.zeros(0, _U), np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            shard = ((word >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cut))
            for few in np.array_split(full, max(1, len(full) // 64)):
                yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array([word[cut[s] : cut[s + 1]].tobytes() for s in few], pa.binary()), pa.array([n[cut[s] : cut[s + 1]].astype(np.uint32).tobytes() for s in few], pa.binary())], names=["shard", "words", "counts"])

        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(tokens(part.column(1))[0])
                if sum(map(len, held)) > 1_000_000:
                    word, n = merged(word, n, held)
                    held = []
            if len(word) > 3_000_000:
                yield from flush()
                word, n = np.zeros(0, _U), np.zeros(0, np.int64)
        if held:
            word, n = merged(word, n, held)
        if len(word):
            yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        word = np.concatenate([np.frombuffer(b.as_py(), _U) for b in table.column("words")])
        n = np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in table.column("counts")])
        word, at = np.unique(word, return_inverse=True)
        n = np.bincount(at, n).astype(_U)
        write_file(f"{folder}/words-{key[0].as_py()}", [*EliasFano.encode(word, 1 << 64).parts(), n])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(word)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    made = rows.mapInArrow(count, "shard int, words binary, counts binary").groupBy("shard").applyInArrow(merge, "shard int, size long, total long").collect()
    sizes = [0] * shards
    for r in made:
        sizes[r["shard"]] = r["size"]
    return sizes + [sum(r["total"] for r in made)]


def merged(word: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    more, count = np.unique(np.concatenate(held), return_counts=True)
    both, at = np.unique(np.concatenate([word, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([n, count])).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences: near-empty high planes compress away in the shuffle."""
    step = np.diff(values, prepend=_U(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(_U).ravel().cumsum(dtype=_U)


def bigram_shards(rows: DataFrame, folder: str, vocabulary: Vocabulary, shards: int, splits: np.ndarray) -> frozenset[int]:
    """Counts the training bigrams and writes the second level; the shards that have any.  splits: the first packed bigram of each shard but the first."""
    import zlib

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.concatenate(([0], np.searchsorted(pair, splits), [len(pair)]))
            full = np.flatnonzero(np.diff(cut))
            for few in np.array_split(full, max(1, len(full) // 64)):
                yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array([zlib.compress(packed(pair[cut[s] : cut[s + 1]]), 1) for s in few], pa.binary()), pa.array([zlib.compress(n[cut[s] : cut[s + 1]].astype(np.uint32).tobytes(), 1) for s in few], pa.binary())], names=["shard", "pairs", "counts"])

        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = tokens(part.column(1))
                held.append(pair_ids(flat, off, vocabulary)[0])
            if sum(map(len, held)) > 3_000_000:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pair = np.concatenate([unpacked(zlib.decompress(b.as_py())) for b in table.column("pairs")])
        n = np.concatenate([np.frombuffer(zlib.decompress(b.as_py()), np.uint32) for b in table.column("counts")])
        pair, at = np.unique(pair, return_inverse=True)
        n = np.bincount(at, n)
        h, w = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        ctx, back = np.unique(h, return_inverse=True)
        total = context_counts(ctx, vocabulary)
        write_file(f"{folder}/pairs-{key[0].as_py()}", SuccessorShard.arrays(h, w, n / (total[back] + MASS), int(vocabulary.base[-1])))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(pair)], pa.int64())})

    made = rows.mapInArrow(count, "shard int, pairs binary, counts binary").groupBy("shard").applyInArrow(merge, "shard int, size long")
    return frozenset(r["shard"] for r in made.collect())


def context_counts(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The counts of words by id (sorted): each word is a context as often as it occurs."""
    shard = np.searchsorted(vocabulary.base, ids, side="right") - 1
    out = np.zeros(len(ids))
    for s in np.unique(shard):
        mine = shard == s
        out[mine] = vocabulary_shard(f"{vocabulary.folder}/words-{s}")[1][ids[mine] - vocabulary.base[s]]
    return out


def pair_ids(flat: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed bigram of known words, count of each token, place of each token's word among the distinct ones, known bigram?)."""
    word, at = np.unique(np.append(flat, END), return_inverse=True)
    ids, count = vocabulary.ids(word)
    h, w = ids[np.searchsorted(word, contexts(flat, off))], ids[at[:-1]]
    known = (h >= 0) & (w >= 0)
    return (h[known].astype(_U) << _U(32)) | w[known].astype(_U), count[at[:-1]], at[:-1], known


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, vocabulary, base_score, score (log10) of every row of docs by a model of training."""
    spark = docs.sparkSession
    folder = f"{as_file_dir(shared.shared_dir(spark))}/terrapane-lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    shards = shared.parts(spark)
    *sizes, total = word_shards(shared.texts(training, id_col, text_col), folder, shards)
    vocabulary = Vocabulary(folder, sizes)
    distinct = int(vocabulary.base[-1])
    if distinct >= 1 << 32:
        raise ValueError("more words than the 32 bits of an id in a packed bigram can tell apart")
    splits = even_splits(vocabulary, total, shards)
    written = bigram_shards(shared.texts(training, id_col, text_col), folder, vocabulary, shards, splits) if total else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = math.log10(total + 0.5 * (distinct + 1)) if total else math.log10(0.5)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                flat, off = tokens(part.column(1))
                pair, count, _, known = pair_ids(flat, off, vocabulary)
                base = np.log10(count + 0.5) - scale
                before = np.concatenate(([0], count[:-1]))
                before[off[:-1]] = count[off[1:] - 1]  # the end token's count
                context = before + 0.0
                uniq, at = np.unique(pair, return_inverse=True)
                kept = np.zeros(len(uniq))
                cut = np.concatenate(([0], np.searchsorted(uniq, splits), [len(uniq)]))
                for s in np.flatnonzero(np.diff(cut)):
                    if int(s) in written:  # a file that was written and is gone is an error
                        mine = uniq[cut[s] : cut[s + 1]]
                        kept[cut[s] : cut[s + 1]] = successor_shard(f"{folder}/pairs-{s}").lookup((mine >> _U(32)).astype(np.int64), (mine & _U(0xFFFFFFFF)).astype(np.int64), distinct)
                p = CODES[quantised(MASS / (context + MASS))] * 10.0**base
                p[known] += kept[at]
                cells = [np.add.reduceat(x, off[:-1]) for x in (base, np.log10(np.minimum(p, 1.0)), (count > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(cells[2]), pa.array(cells[0]), pa.array(cells[1])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = shared.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.lit(distinct).cast("long").alias("vocabulary"), "base_score", "score")


def even_splits(vocabulary: Vocabulary, total: int, shards: int) -> np.ndarray:
    """Packed bigrams at which shards begin: contexts in id order share the tokens evenly; a context of more than a share is cut by its successors' ids."""
    if not total:
        return np.zeros(0, _U)
    share, have, out = max(1.0, total / shards), 0.0, []
    size = int(vocabulary.base[-1])
    for s in range(vocabulary.shards):
        if vocabulary.base[s + 1] == vocabulary.base[s]:
            continue
        counts = vocabulary_shard(f"{vocabulary.folder}/words-{s}")[1].astype(np.float64)
        reach = have + np.cumsum(counts)
        for k in range(len(out) + 1, shards):
            if k * share > reach[-1]:
                break
            i = int(np.searchsorted(reach, k * share))
            part = (k * share - (reach[i] - counts[i])) / counts[i]
            out.append((int(vocabulary.base[s]) + i) << 32 | int(part * size))
        have = float(reach[-1])
    return np.array(sorted(out), _U)
