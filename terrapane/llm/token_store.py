"""Token ids of whole texts in binary shards, with document boundaries and ids as Elias-Fano sequences.

A shard file holds, in ascending order of document id, the concatenated token ids (little endian, two bytes each if the
vocabulary allows it, else four), each document closed by an end id; then the boundaries and the document ids, both
Elias-Fano coded; then a footer.  A boundary costs about 2 + log2(mean length) bits: low bits are packed, high bits are unary, and
only the place of every 256th one is kept, as 32-bit numbers, so ``select`` finds any offset by a short scan of words without a
table of 64-bit offsets.  Offsets count from the shard's start; the shards' own starts are in the table of shards.

Work flow: one scan finds quantiles of the ids, so that shards are ranges of ids of about equal size; texts are encoded and
only their ids are shuffled; a task sorts its range and streams it to a file, which gets its final name when it is complete.
The table of shards names the files of the tasks that succeeded; files of lost attempts are never read.

Encoding is the library's.  A byte-level BPE never merges across a space that follows another character, so each worker remembers the ids of
such runs (a bounded memo) and asks the library for those that it has not met; other tokenizers, and texts with added tokens,
are encoded whole.

Defined cases: null or empty text: the end id alone.  Null ids come first.  Rows that share an id are next to each other, in an order fixed by
the files; a very frequent id, or many nulls, span several shards.  Empty tables: no shard.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .ngram_lm import nth_one
from .token_counts import PATTERN, RUN, byte_letters
from .words import slices

MEMO = 300_000
SAMPLE = 256
BLOCK = 1 << 22
SHARD_BYTES = 256 << 20
MAGIC = b"TPTOKEN1"
NULL = -(1 << 63)
_FOOT = struct.Struct("<8sHHqqqqqqqqq")
_U, _ONE = np.uint64, np.uint64(1)


# ---- Elias-Fano with sampled select --------------------------------------------------------------------------------


class Monotone:
    """n sorted numbers from 0 on: ``low`` (bits of each, packed), ``high`` (unary), ``samples`` (place of every 256th one)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int, bits: int):
        self.low, self.high, self.samples, self.n, self.bits = low, high, samples, n, bits

    @classmethod
    def encode(cls, values: np.ndarray) -> Monotone:
        values, n = values.astype(_U), len(values)
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        place = np.arange(n, dtype=np.int64)
        low = np.zeros(n * bits // 64 + 1 if bits and n else 0, _U)
        if len(low):
            part, at = values & _U((1 << bits) - 1), place * bits
            word, shift = at >> 6, at & 63
            np.bitwise_or.at(low, word, part << shift.astype(_U))
            over = np.flatnonzero(shift + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (64 - shift[over]).astype(_U))
        up = (values >> _U(bits)).astype(np.int64) + place
        high = np.zeros((int(up[-1]) >> 6) + 1 if n else 0, _U)
        np.bitwise_or.at(high, up >> 6, _ONE << (up & 63).astype(_U))
        return cls(low, high, up[::SAMPLE].astype(np.uint32), n, bits)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, at & 63
        out = self.low[word] >> shift.astype(_U)
        over = np.flatnonzero(shift + self.bits > 64)
        out[over] |= self.low[word[over] + 1] << (64 - shift[over]).astype(_U)
        return out & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i: from the sample before each, over the words up to its one."""
        i = np.asarray(i, np.int64)
        begin = self.samples[i // SAMPLE].astype(np.int64)
        word, left = begin >> 6, i % SAMPLE
        bits = self.high[word] & (~_U(0) << (begin & 63).astype(_U))
        ones = np.bitwise_count(bits).astype(np.int64)
        while (far := np.flatnonzero(left >= ones)).size:
            left[far] -= ones[far]
            word[far] += 1
            bits[far] = self.high[word[far]]
            ones[far] = np.bitwise_count(bits[far])
        up = word * 64 + nth_one(bits, left) - i
        return up.astype(_U) << _U(self.bits) | self.low_bits(i)

    def all(self) -> np.ndarray:
        place = np.arange(self.n, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return (ones - place).astype(_U) << _U(self.bits) | self.low_bits(place)

    def buffers(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]


# ---- encoding --------------------------------------------------------------------------------------------------------


class Memo(dict):
    """Strings and what ``make`` gave for them, in two generations: a full one becomes the old one, and what was old is forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:  # emptied in place: callers hold this dictionary
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Text -> ids as bytes, by the tokenizers library."""

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_str(spec), "<u2" if width == 2 else "<u4"
        form = json.loads(spec)
        pre = form["pre_tokenizer"] or {}
        self.by_runs = form["model"]["type"] == "BPE" and not form["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_runs = self.by_runs and not form["model"].get("dropout") and not form["truncation"] and not form["padding"]
        added = [t["content"] for t in form["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.by_runs = self.by_runs and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in form["added_tokens"])
        self.model, self.split = self.tok.model.tokenize, regex.compile(PATTERN).findall
        self.letters, self.code = dict(enumerate(byte_letters())), "H" if width == 2 else "I"
        self.pieces = Memo(self.piece)
        self.runs = Memo(self.after_space)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        ids = array(self.code, [t.id for t in self.model(piece.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def run(self, run: str) -> bytes:
        """The ids of a text by its pre-tokens."""
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.split(run)])

    def after_space(self, run: str) -> bytes | None:
        """The ids of a space and what follows it up to the next space; None where white space follows, as pre-tokens may then reach further back."""
        word = run.rstrip(".,")
        if word.isalpha():  # one pre-token of letters, and one of what was cut off
            return self.pieces[" " + word] if len(word) == len(run) else self.pieces[" " + word] + self.pieces[run[len(word) :]]
        return None if not run or run[0].isspace() else self.run(" " + run)

    def encode(self, text: str) -> bytes:
        if not self.by_runs or self.added(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        ids = [self.run(first), *map(self.runs.__getitem__, rest)]
        if None in ids:
            return b"".join(map(self.run, RUN.findall(text)))
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder(spec: str, width: int) -> Encoder:
    return Encoder(spec, width)


# ---- shards ----------------------------------------------------------------------------------------------------------


def filesystem(url: str) -> tuple[pfs.FileSystem, str]:
    """Any store that pyarrow opens (file, s3, gs, abfs, hdfs) and the path in it."""
    return pfs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))


def write_shard(url: str, rows: Iterator[tuple[int | None, bytes]], width: int, end_id: int) -> tuple[str, int, int]:
    """Streams rows (id, ids as bytes) in order to a new file; (its url, documents, ids)."""
    fs, path = filesystem(url)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary, end = f"{path}.{uuid.uuid4().hex}.part", end_id.to_bytes(width, "little")
    ends, names, nulls, n = [], [], 0, 0
    with fs.open_output_stream(temporary) as out:
        pending, size = [], 0
        for name, ids in rows:
            pending += (ids, end)
            size += len(ids) + width
            n += len(ids) // width + 1
            ends.append(n)
            if name is None:
                nulls += 1
            else:
                names.append(name)
            if size >= BLOCK:
                out.write(b"".join(pending))
                pending, size = [], 0
        out.write(b"".join(pending))
        least = names[0] if names else 0
        marks = Monotone.encode(np.array(ends, np.int64))
        ids_of = Monotone.encode(np.array(names, np.int64).astype(_U) - np.array([least], np.int64).astype(_U))
        sizes = []
        for part in (marks, ids_of):
            for b in part.buffers():
                out.write(b)
                sizes.append(len(b))
        out.write(_FOOT.pack(MAGIC, width, marks.bits << 8 | ids_of.bits, n, len(ends), nulls, least, *(x // 8 for x in (sizes[0], sizes[1], sizes[3], sizes[4])), end_id))
    fs.move(temporary, path)
    return url, len(ends), n


class Shard:
    """A shard file: boundaries and ids in memory as Elias-Fano, token ids read by range."""

    def __init__(self, url: str):
        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, bits, self.n_ids, self.n, self.nulls, self.least, *words, self.end_id = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{url} is not a token shard")
        self.kind, at = np.dtype(f"<u{self.width}"), self.n_ids * self.width
        parts = []
        for low, high, n, b in ((words[0], words[1], self.n, bits >> 8), (words[2], words[3], self.n - self.nulls, bits & 255)):
            samples = -(-n // SAMPLE)
            raw = self.file.read_at(low * 8 + high * 8 + samples * 4, at)
            at += len(raw)
            parts.append(Monotone(np.frombuffer(raw, _U, low), np.frombuffer(raw, _U, high, low * 8), np.frombuffer(raw, np.uint32, samples, (low + high) * 8), n, b))
        self.ends, self.names = parts

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place of the documents i."""
        i = np.asarray(i, np.int64)
        return np.where(i > 0, self.ends.get(np.maximum(i - 1, 0)), _U(0)).astype(np.int64), self.ends.get(i).astype(np.int64)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all() + np.array([self.least], np.int64).astype(_U)).astype(np.int64).tolist()

    def tokens(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, begin * self.width), self.kind)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(np.array([i]))
        return self.tokens(int(begin[0]), int(end[0]))

    def blocks(self, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, boundaries, token ids) of runs of documents with about so many bytes; one document at least."""
        ends = np.concatenate(([0], self.ends.all().astype(np.int64)))
        first = 0
        while first < self.n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most // self.width, side="right")) - 1)
            yield first, ends[first : last + 1], self.tokens(int(ends[first]), int(ends[last]))
            first = last


def id_width(spec: str) -> int:
    form = json.loads(spec)
    top = max([*form["model"]["vocab"].values(), *(t["id"] for t in form["added_tokens"])]) if isinstance(form["model"]["vocab"], dict) else len(form["model"]["vocab"]) + len(form["added_tokens"])
    return 2 if top < 1 << 16 else 4


def write_tokens(docs: DataFrame, tokenizer_json: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the token ids of all texts to shard files; shard, path, base (ids in the shards before), n_docs, n_ids of each.

    A shard has about ``shard_bytes`` of text, and there are spark.sql.shuffle.partitions of them at least.
    The table of shards has one row a file, and is all that passes through the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        body = f.read()
    width, folder = id_width(body), folder or f"{shared.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"the end id {end_id} does not fit {width} bytes")
    spec = spark.sparkContext.broadcast(body)
    rows = shared.texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(shared.parts(spark), -(-size // shard_bytes))
    cuts = rows.agg(F.percentile_approx(F.coalesce("id", F.lit(NULL)), [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = np.array(cuts or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids, seen = encoder(spec.value, width).encode, 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0)
                known = ids.fill_null(NULL).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
                spread = (np.arange(seen, seen + len(ids), dtype=np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64)
                seen += len(ids)
                least = (known == NULL) & ids.is_valid().to_numpy(zero_copy_only=False)  # the least id there is comes after the nulls
                shard = np.where(least, high, low + spread % (high - low + 1))
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(map(text_ids, part.column(1).to_pylist()), pa.binary())], names=["shard", "id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = first.column(0)[0].as_py()

        def each() -> Iterator[tuple[int | None, bytes]]:
            for batch in chain([first], batches):
                yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        path, n_docs, n_ids = write_shard(f"{folder}/{shard:06d}-{uuid.uuid4().hex[:8]}.tok", each(), width, end_id)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    dealt = rows.mapInArrow(encode, "shard long, id long, ids binary").repartitionById(n, F.col("shard").cast("int"))
    made = shared.saved(dealt.sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), "ids").mapInArrow(write, "shard long, path string, n_docs long, n_ids long"))
    base, out = 0, []
    for r in sorted(made.collect()):
        out.append((r["shard"], r["path"], base, r["n_docs"], r["n_ids"]))
        base += r["n_ids"]
    return spark.createDataFrame(out, "shard long, path string, base long, n_docs long, n_ids long")


def _read(shards: DataFrame, schema: str, columns) -> DataFrame:
    """columns(names, starts, ends, ids of a block) -> the arrays after doc_id, start and n_tokens."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(path)
                docs = pa.array(shard.doc_ids(), pa.int64())
                for first, ends, ids in shard.blocks():
                    at = ends - ends[0]
                    head = [docs[first : first + len(at) - 1], pa.array(ends[:-1] + base), pa.array(np.diff(ends))]
                    yield pa.RecordBatch.from_arrays([*head, *columns(at, ids)], names=names)

    n = max(1, shards.count())
    return shards.select("shard", "path", "base").withColumn("place", F.col("shard").cast("int")).repartitionById(n, "place").drop("place").mapInArrow(run, schema)


def boundaries(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as 32-bit numbers), read from the files."""

    def crc(at: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        raw = memoryview(ids.astype("<u4").tobytes())
        return [pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())]

    return _read(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", crc)


def token_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the ids themselves, read from the files."""

    def lists(at: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]

    return _read(shards, "doc_id long, start long, n_tokens long, ids array<int>", lists)
