"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short and a document long, so containment |item & document| / |item| is sought, not similarity.  Items are
partitioned by the size of their shingle sets (powers of two).  The MinHash sketch of an item is its least shingle hashes; in
the partition of sizes up to u it has floor((1 - t) * u) + 1 of them, so that an item of which a share t is in a document has
at least one of them there: no match is lost, at any document length.  Sketch hashes are looked up for every shingle of
every whole document; each candidate is verified by counting the item's shingles in the document's set.

Items of fewer than k words are searched by shingles of their own word count.  The items are the stated query set: their
index is sent to the tasks in blocks of at most ``BLOCK_SHINGLES`` shingles (64-bit, so 16 MB), a pass over the documents each.

Defined cases: items or documents that are null or empty match nothing; equal items match alike; repeated documents give a
row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import Words, release, slices

BLOCK_SHINGLES = 2_000_000
PAIRS = "doc_id long, item_id long, shared long, n_item long"


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """id, width (words in a shingle), shingles (sorted, distinct) of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, sets = [], [], []
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column(1))
                count = np.diff(w.first)
                for width in np.unique(np.minimum(count, k)):
                    if width:
                        all_sets = w.shingle_sets(int(width))
                        for i in np.flatnonzero(np.minimum(count, k) == width):
                            ids.append(part.column(0)[int(i)].as_py())
                            widths.append(int(width))
                            sets.append(all_sets[i].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "width", "shingles"])

    return items.mapInArrow(run, "id long, width int, shingles array<long>")


class Index:
    """The sketches of one block of items, by shingle width."""

    def __init__(self, rows: list[tuple[int, int, list[int]]], percent: int):
        self.percent, self.widths = percent, {}
        for width in sorted({r[1] for r in rows}):
            mine = [(i, np.sort(np.array(s, np.int64).view(np.uint64))) for i, w, s in rows if w == width]
            bound = [1 << int(len(s) - 1).bit_length() for _, s in mine]
            sketch = [s[: (100 - percent) * u // 100 + 1] for (_, s), u in zip(mine, bound, strict=True)]
            value, owner = np.concatenate(sketch), np.repeat(np.arange(len(mine)), [len(s) for s in sketch])
            order = np.argsort(value, kind="stable")
            keys, first = np.unique(value[order], return_index=True)
            self.widths[width] = (mine, keys, np.append(first, len(value)), owner[order])

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, shared, size of the item's set) of every match."""
        words, out = Words(column), []
        for width, (items, keys, first, owner) in self.widths.items():
            run, off = words.shingles(width)
            at = np.searchsorted(keys, run)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == run)
            if not len(hit):
                continue
            key, row = at[hit], np.searchsorted(off, hit, side="right") - 1
            size = first[key + 1] - first[key]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs = np.unique(np.stack([np.repeat(row, size), owner[np.repeat(first[key], size) + step]], axis=1), axis=0)
            for r in np.unique(pairs[:, 0]):
                body = np.unique(run[off[r] : off[r + 1]])
                for i in pairs[pairs[:, 0] == r, 1]:
                    want = items[i][1]
                    n = int((body[np.minimum(np.searchsorted(body, want), len(body) - 1)] == want).sum())
                    if 100 * n >= self.percent * len(want):
                        out.append((int(r), items[i][0], n, len(want)))
        return out


def index_blocks(items: DataFrame, k: int, percent: int, item_col: str, text_col: str) -> Iterator:
    """The broadcast indexes of all items, block by block."""
    sc = items.sparkSession.sparkContext
    sets = shared.saved(item_sets(shared.texts(items, item_col, text_col), k))
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for b in range(blocks):
        mine = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = [(r["id"], r["width"], r["shingles"]) for r in mine.toLocalIterator()]
        if rows:
            yield sc.broadcast(Index(rows, percent))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shared, n_item: every document in which at least percent/100 of an item's k-word shingles occur."""
    rows, out = shared.texts(docs, id_col, text_col), None
    for index in index_blocks(items, k, percent, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    found = index.value.search(part.column(1))
                    ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[n] for f in found], pa.int64()) for n in (1, 2, 3))], names=["doc_id", "item_id", "shared", "n_item"])

        found = rows.mapInArrow(run, PAIRS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], PAIRS)


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    for index in index_blocks(items, k, percent, item_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, 1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[f[0] for f in index.value.search(part.column(part.schema.get_field_index(text_col)))]] = False
                    yield part.filter(pa.array(keep))
                release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
