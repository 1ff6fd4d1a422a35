"""How filters interact: which of them removes what in which order, and what each costs.

A table-driven transducer reads each text's bytes once.  Its table gives the class of a byte (white space, capital letter, marked
symbol, continuation byte, other); its two states are inside and outside a word.  It counts words, capitals, code points and
symbols, and where it enters and leaves a word it hands the word's span to a hash table that counts distinct words: spans whose
digests agree are compared byte by byte, and those that differ stay apart.  Bytes of a slice of texts are read side by side (numpy);
texts end words, so no state crosses from one to the next.

The rest is Spark: exact copies by a 128-bit digest of the whole text and the least id of each, found by one aggregation and one join by (digest, id),
so a text with a million copies is no hot key; labels joined by id; then counts by part, set of failed filters and labels.  Everything in the result
depends on those counts alone: 31 sets of failed filters at most, 80 (filters before, filter) pairs and 600 steps a part.

Filters: A under ``min_words`` words; B distinct words under ``min_distinct`` percent of the words; C capitals over ``most_capitals``
percent of the code points; D any of ``symbols``; E the text of a smaller id.

Defined cases: null text: empty (fails A; all empty texts are copies of each other).  A null id is no smaller and no larger
than another, so such rows never fail E.  Rows that share an id are audited each; they don't make each other fail E, and a label counts for each.  Several
labels of one id: it is good (toxic) if one says so.  A label without an id belongs to no row.  Null source: the part is the empty string, as for an empty one.  Empty
table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import mix, slices, string_buffers

FILTERS = "ABCDE"
SPACE, CAPITAL, SYMBOL, CONTINUED = 1, 2, 4, 8
_U, _STEP = np.uint64, np.uint64(0x9E3779B97F4A7C15)


def byte_table(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The class of each byte, as a set of bits."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= SPACE
    table[ord("A") : ord("Z") + 1] |= CAPITAL
    table[list(symbols)] |= SYMBOL
    table[0x80:0xC0] |= CONTINUED
    return table


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return upto[off[1:]] - upto[off[:-1]]


def span_digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span: its bytes in blocks of eight, mixed with their place."""
    blocks = (size + 7) >> 3
    first = np.concatenate(([0], np.cumsum(blocks)[:-1])) if len(blocks) else np.zeros(0, np.int64)
    span = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(int(blocks.sum()), dtype=np.int64) - first[span]
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = start[span] + (place << 3)
    value = np.ascontiguousarray(wide[at]).view("<u8").ravel()
    left = np.minimum(size[span] - (place << 3), 8).astype(_U)
    value &= ~_U(0) >> (_U(64) - (left << _U(3)))
    value = mix(value ^ mix((place.astype(_U) + _U(1)) * _STEP))
    return mix(np.add.reduceat(value, first) + size.astype(_U)) if len(size) else np.zeros(0, _U)


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans at a and at b, of the same sizes, have the same bytes."""
    same = np.ones(len(a), bool)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live, at = np.arange(len(a)), 0
    while live.size:
        left = np.minimum(size[live] - at, 8).astype(_U)
        keep = ~_U(0) >> (_U(64) - (left << _U(3)))
        x, y = (np.ascontiguousarray(wide[p[live] + at]).view("<u8").ravel() & keep for p in (a, b))
        same[live] = x == y
        at += 8
        live = live[(x == y) & (size[live] > at)]
    return same


def distinct_spans(raw: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, texts: int, digest: np.ndarray | None = None) -> np.ndarray:
    """How many different spans each text has: a table of (text, digest) whose entries are verified.

    The first span of an entry stands for it; others of the entry are compared with it, and those that differ go on to a round of their own.
    """
    digest = span_digests(raw, start, size) if digest is None else digest
    out = np.zeros(texts, np.int64)
    rest = np.arange(len(start))
    key = mix(digest + mix(doc.astype(_U) * _STEP))
    while rest.size:
        order = rest[np.argsort(key[rest], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        out += np.bincount(doc[order[new]], minlength=texts)
        other = np.flatnonzero(~new)
        other = other[~same_spans(raw, start[order[other]], start[head[other]], size[order[other]])]
        rest = np.sort(order[other])
    return out


def transduce(texts: pa.Array, table: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text."""
    raw, off = string_buffers(texts)
    kind, n = table[raw], len(raw)
    inside = (kind & SPACE) == 0
    enter, leave = inside.copy(), inside.copy()
    text_start = np.zeros(n + 1, bool)
    text_start[off[:-1]] = True
    enter[1:] &= ~inside[:-1] | text_start[1:n]
    leave[:-1] &= ~inside[1:] | text_start[1:n]
    start, end = np.flatnonzero(enter), np.flatnonzero(leave) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return {
        "words": np.bincount(doc, minlength=len(texts)).astype(np.int64),
        "distinct": distinct_spans(raw, doc, start, end - start, len(texts)),
        "capitals": per_text((kind & CAPITAL) != 0, off),
        "points": per_text((kind & CONTINUED) == 0, off),
        "symbols": per_text((kind & SYMBOL) != 0, off),
    }


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", symbols: bytes = b"#$%&*|") -> DataFrame:
    """id, part, words, distinct, capitals, points, symbols, digest_a, digest_b (128 bits of the text) of every row."""
    table = byte_table(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = transduce(part.column(2), table)
                raw, off = string_buffers(part.column(2))
                view = memoryview(np.ascontiguousarray(raw))
                digest = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                pair = np.frombuffer(digest, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, found.values()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=[*names])

    names = ["id", "part", "words", "distinct", "capitals", "points", "symbols", "digest_a", "digest_b"]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, part string, words long, distinct long, capitals long, points long, symbols long, digest_a long, digest_b long")


def failed_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", min_words: int = 200, min_distinct: int = 50, most_capitals: int = 2, symbols: bytes = b"#$%&*|") -> DataFrame:
    """part, failed (bit i: the i-th filter), n, good, toxic: the counts on which all audits rest, one row for each set of a part."""
    found = text_features(docs, id_col, symbols=symbols)
    bit = lambda i, c: F.when(c, 1 << i).otherwise(0)
    own = bit(0, F.col("words") < min_words) + bit(1, 100 * F.col("distinct") < min_distinct * F.col("words")) + bit(2, 100 * F.col("capitals") > most_capitals * F.col("points")) + bit(3, F.col("symbols") > 0)
    rows = shared.saved(found.select("id", "part", "digest_a", "digest_b", own.alias("failed")).groupBy("id", "part", "digest_a", "digest_b", "failed").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest_a", "digest_b").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copies = rows.join(first, ["digest_a", "digest_b", "id"], "left")
    copies = copies.select("id", "part", "n", (F.col("failed") + bit(4, F.col("id").isNotNull() & F.col("first").isNull())).alias("failed"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(flag("quality"), flag("toxic"))
    n = F.col("n")
    return copies.join(marks, "id", "left").groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(n * F.coalesce("quality", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders of the five filters."""
    sets = failed_sets(docs, labels, **limits)
    pair = sets.select("part", "failed", "n", "good", "toxic", F.explode(F.array(*[F.struct(F.lit(sum(before)).alias("before"), F.lit(own).alias("own")) for own in (1, 2, 4, 8, 16) for k in range(5) for before in combinations([x for x in (1, 2, 4, 8, 16) if x != own], k)])).alias("p"))
    failed, before, own = F.col("failed"), F.col("p.before"), F.col("p.own")
    hit, gone = failed.bitwiseAND(own) != 0, failed.bitwiseAND(before) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    orders = F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.greatest(F.lit(1), F.bit_count(failed)))  # of 120, those in which one of the failed filters comes first
    counts = pair.groupBy("part", before.alias("before"), own.alias("own")).agg(
        total("n", ~hit & ~gone)("kept"), total("n", hit & ~gone)("removed"), total("n", hit & gone)("redundant"), total("n", failed == own)("unique_fails"),
        total("good", hit & ~gone)("good_lost"), total("toxic", hit & ~gone)("toxic_lost"), F.sum(F.when(hit, F.col("n") * orders).otherwise(0)).alias("shapley"),
    )
    steps = {}
    for order in permutations(FILTERS):
        for k, letter in enumerate(order):
            steps.setdefault((sum(1 << FILTERS.index(x) for x in order[:k]), 1 << FILTERS.index(letter)), []).append("".join(order))
    names = F.create_map(*[x for (b, o), orders_ in steps.items() for x in (F.lit(b * 32 + o), F.array(*map(F.lit, orders_)))])
    out = counts.select("*", F.explode(F.element_at(names, F.col("before") * 32 + F.col("own"))).alias("filter_order"))
    return out.select("part", "filter_order", (F.bit_count("before") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
