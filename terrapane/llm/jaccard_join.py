"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles.  Hashing each shingle to a bit of a sketch and XORing gives a parity
sketch: the Hamming distance of two sketches never exceeds the symmetric difference of the sets.  A set of size s that links at
percent/100 differs from a partner in at most reach(s) shingles, so within a size band whose sketches have ``chunks`` chunks, the
two have at least chunks - reach(s) chunks with the same shingles (pigeonhole).  Chunks are 2**20 bits wide and sparse, so a chunk
is joined by a 64-bit digest of its odd bits.  Chunks of no or one shingle are light and are left out; a document whose light chunks could be
all that it shares adds its single shingles as keys, so no link is lost.  A set joins the band of its own size and those lower bands whose partners can reach it.

Equal sets are one class from the start (named by a 64-bit digest; a second digest tells sets apart whose first ones clash, see
``renamed``).  Buckets of up to SMALL classes give all their pairs.  Keys of larger buckets are frequent, and count as light too: a class that has fewer
frequent chunks than its slack, chunks - reach(s) less its light chunks, shares another chunk with each partner, and leaves those buckets.
What stays there is compared by components: TRIALS rounds try pairs that would join components, then one exact round compares
every pair that is still in different components.  Candidates whose folded sketches (FOLD bits) already differ by too much are
ruled out; the others are compared exactly, on the shingles of their whole texts.  So components are exact, while a bucket of n linked copies costs n comparisons, not n * n.

No bucket has to fit a task: a task sends a key that is frequent in it once and its members apart from it, and buckets of more than BLOCK members are dealt to blocks
(the exact round: to pairs of blocks).

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than k words
make one shingle; repeated ids are rows of their own with the same component; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .words import Words, mix, pack, slices, unpack

RATIO = 1.6
SMALL = 6
BLOCK = 2048
TRIALS = 3
FOLD = 1024
MARK = 255  # the slack of a row that only says that its key is frequent
SHARD_KEYS = 1_000_000
BROADCAST_CLASSES = 500_000
FLUSH = 2_000_000
PACKED_BYTES = 1 << 19
_BITS = np.uint64((1 << 20) - 1)
_32, _BAND, _CHECK = np.uint64(32), np.uint64(63), np.uint64(0xC2B2AE3D27D4EB4F)


def reach(s, percent: int):
    """The largest symmetric difference of a set of size s and a linked partner."""
    return (s + s * 100 // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4)
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(low, high, largest partner, chunks) for sizes low <= s < high, up to 2**40; the number of chunks is the one that needs the fewest keys (0: only equal sets link)."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, math.ceil(low * RATIO))
        most = 100 * (high - 1) // percent
        d = reach(high - 1, percent)
        chunks = d + 1 + np.unique(np.linspace(0, 2 * d + 8, 400).astype(np.int64))
        keys = np.zeros(len(chunks))
        for n in np.linspace(low, most, 6):
            light = chunks * (1 + n / chunks) * np.exp(-n / chunks)
            room = chunks - min(reach(int(n), percent), d) - light
            over = np.array([0.5 * math.erfc((r - 3) / math.sqrt(2 * m + 1e-9)) for r, m in zip(room.tolist(), light.tolist(), strict=True)])
            keys += chunks - light + over * n
        out.append((low, high, most, int(chunks[keys.argmin()]) if d else 0))
        low = high
    return out


def class_ids(run: np.ndarray, off: np.ndarray, renamed: dict[tuple[int, int], int] | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sets, digests, second digests): the distinct shingles of each row, and two digests of the set; those in renamed have a new first one."""
    sets = [np.unique(run[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    flat, cut = np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])
    total = [np.append(np.uint64(0), np.cumsum(mix(x), dtype=np.uint64)) for x in (flat, flat ^ _CHECK)]
    ids, check = (mix(t[cut[1:]] - t[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64) for t in total)
    if renamed:
        ids = np.array([renamed.get(x, x[0]) for x in zip(ids.tolist(), check.tolist(), strict=True)], np.int64)
    return sets, ids, check


def sketch_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each key, slack) of the chunks of all sketches; the last 6 bits of a key are the band, the slack is 0 .. 254."""
    table, keys, rows, slacks = bands(percent), [], [], []
    size = np.array([len(s) for s in sets])
    for b, (low, high, most, chunks) in enumerate(table):
        if not len(size) or low > size.max():
            break
        mine = np.flatnonzero((size >= low) & (size <= max(high - 1, most)))
        if not chunks or not len(mine):
            continue
        flat = np.concatenate([sets[i] for i in mine])
        owner = np.repeat(np.arange(len(mine)), size[mine])
        salted = mix(flat ^ np.uint64(b * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        chunk = ((salted >> _32) * np.uint64(chunks) >> _32).astype(np.int64)
        sketch = np.zeros(len(mine) * chunks, np.uint64)
        np.bitwise_xor.at(sketch, owner * chunks + chunk, mix((salted & _BITS) + np.uint64(1)))
        found = np.flatnonzero((sketch != 0) & (np.bincount(owner * chunks + chunk, minlength=len(sketch)) > 1))
        who = found // chunks
        differ = np.minimum(reach(size[mine], percent), reach(high - 1, percent))  # the smaller of two partners is below high
        slack = np.bincount(who, minlength=len(mine)) - differ  # chunks - differ, less the light ones
        left = np.clip(slack, 0, MARK - 1).astype(np.uint8)
        keys.append(mix(sketch[found] ^ mix((found % chunks).astype(np.uint64) + np.uint64((b + 1) << 40))) & ~_BAND | np.uint64(b))
        rows.append(mine[who])
        slacks.append(left[who])
        if (slack <= 0).any():
            single = (slack <= 0)[owner]
            keys.append(mix(salted[single] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & ~_BAND | np.uint64(b))
            rows.append(mine[owner[single]])
            slacks.append(np.zeros(int(single.sum()), np.uint8))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(slacks)


def folded(sets: list[np.ndarray]) -> list[bytes]:
    """The parity sketch of each set, FOLD bits."""
    size = np.array([len(s) for s in sets])
    bit = (mix(np.concatenate([np.zeros(0, np.uint64), *sets]) ^ np.uint64(0x50A1)) % np.uint64(FOLD)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sets)), size) * FOLD + bit, minlength=len(sets) * FOLD) & 1
    return [r.tobytes() for r in np.packbits(odd.astype(np.uint8).reshape(-1, FOLD), axis=1)]


def sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, FOLD // 64)


def possible(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray, percent: int) -> np.ndarray:
    """False where the sketches (rows of 64-bit words) differ in more bits than linked sets of these sizes can."""
    apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
    return apart * (100 + percent) <= (n_one + n_two) * (100 - percent)


def members(rows: DataFrame, k: int) -> DataFrame:
    """id, class (null for an empty set), check (the second digest), n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ids, check = class_ids(*Words(part.column(1)).shingles(k))
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, mask=n == 0), pa.array(check), pa.array(n), pa.array(folded(sets), pa.binary())], names=["id", "class", "check", "n_shingles", "sketch"])

    return rows.mapInArrow(run, "id long, class long, check long, n_shingles long, sketch binary")


def sharded_keys(rows: DataFrame, k: int, percent: int, shards: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """shard, keys, classes, slack (packed numbers): the sketch keys of all classes, by shard; a task sends each class once.

    Shards from ``shards`` on have the members of keys that are frequent within a task; their own shard gets only a mark of such a key.
    """

    def rows_of(shard: np.ndarray, key: np.ndarray, cls: np.ndarray, slack: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.searchsorted(shard, np.arange(2 * shards + 1))
        full = np.flatnonzero(np.diff(cut))
        for few in np.array_split(full, max(1, len(full) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), *(pa.array([a[cut[s] : cut[s + 1]].tobytes() for s in few], pa.binary()) for a in (key, cls, slack))], names=["shard", "keys", "classes", "slack"])

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if held:
            key, cls, slack = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, cls, slack = key[order], cls[order], slack[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            often = np.repeat(size > SMALL, size)
            marks = start[size > SMALL]
            send = np.concatenate((np.flatnonzero(~often), marks))
            send = send[np.argsort(key[send], kind="stable")]
            sent = slack.copy()
            sent[marks] = MARK
            yield from rows_of(((key[send] >> _32) * np.uint64(shards) >> _32).astype(np.int64), key[send], cls[send], sent[send])
            if len(marks):
                yield from rows_of(np.full(int(often.sum()), shards + uuid.uuid4().int % shards), key[often], cls[often], slack[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ids, _ = class_ids(*Words(part.column(1)).shingles(k), renamed)
                _, first = np.unique(ids, return_index=True)
                first = first[~np.isin(ids[first], seen)]
                seen = np.union1d(seen, ids[first])[-FLUSH:]
                key, row, slack = sketch_keys([sets[i] for i in first], percent)
                held.append((key, ids[first][row], slack))
                count += len(key)
                if count >= FLUSH:
                    yield from flush(held)
                    held, count = [], 0
        yield from flush(held)

    return rows.mapInArrow(run, "shard int, keys binary, classes binary, slack binary")


FOUND = "pair boolean, a long, b long, slack short"


def _found(pairs: list[np.ndarray], rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of FOUND: distinct pairs of classes, and (key, class, slack) rows of frequent keys."""
    two = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    key, cls, slack = (np.concatenate([np.zeros(0, t), *(r[c] for r in rest)]) for c, t in enumerate((np.int64, np.int64, np.int16)))
    none = np.zeros(len(two), np.int16)
    return pa.table({"pair": pa.array(np.arange(len(two) + len(key)) < len(two)), "a": np.concatenate([two[:, 0], key]), "b": np.concatenate([two[:, 1], cls]), "slack": np.concatenate([none, slack])})


def bucket_pairs(table: pa.Table, shards: int) -> pa.Table:
    """The pairs of one shard: all of small buckets; of the others the members."""
    read = lambda c, t: np.concatenate([np.frombuffer(b.as_py(), t) for b in table.column(c)])
    key, cls, slack = read("keys", np.uint64), read("classes", np.int64), read("slack", np.uint8)
    if table.column("shard")[0].as_py() >= shards:
        return _found([], [(key.view(np.int64), cls, slack.astype(np.int16))])
    order = np.lexsort((slack, cls, key))
    key, cls, slack = key[order], cls[order], slack[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (slack[1:] == MARK)
    key, cls, slack = key[new], cls[new], slack[new]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    often = (size > SMALL) | (np.maximum.reduceat(slack, start) == MARK)
    pairs = []
    for n in range(2, SMALL + 1):
        at = start[(size == n) & ~often]
        pairs += [np.stack([cls[at + i], cls[at + j]], axis=1) for j in range(n) for i in range(j) if len(at)]
    rest = np.repeat(often, size) & (slack < MARK)
    return _found(pairs, [(key[rest].view(np.int64), cls[rest], slack[rest].astype(np.int16))])


def unsafe(rest: DataFrame) -> DataFrame:
    """key, class of the frequent rows (key, class, slack) whose class has no slack left for all of its frequent chunks in the band."""
    rest = rest.withColumn("band", F.col("key").bitwiseAND(63)).dropDuplicates(["key", "class"])
    bound = rest.groupBy("class", "band").agg(F.count("*").alias("n"), F.min("slack").alias("slack")).where("n >= slack").select("class", "band")
    return rest.join(bound, ["class", "band"], "left_semi").select("key", "class")


def cell_pairs(table: pa.Table, percent: int, trial: int | None) -> pa.Table:
    """The pairs to compare in cells (cell, class, component, n, sketch, side) between different components, as far as sketches allow.

    In a trial round, components that a pair could join count as joined from then on, so a cell gives fewer pairs than it has components.
    In an exact round (trial: None) all pairs of different components are given, and of different sides, if the cell has two.
    """
    cell, cls, comp, n, side = (table.column(c).to_numpy() for c in ("cell", "class", "component", "n", "side"))
    sketch = sketches(table.column("sketch"))
    order = np.lexsort((cls, comp, cell))
    cell, cls, comp, n, side, sketch = cell[order], cls[order], comp[order], n[order], side[order], sketch[order]
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else np.zeros(1, int)
    pairs = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        c, at = np.unique(comp[a:b], return_inverse=True)
        if len(c) < 2:
            continue
        turn = np.arange(b - a) if trial is None else np.argsort(mix(cls[a:b].view(np.uint64) + np.uint64(trial)))
        mine, at, size, bits, half = cls[a:b][turn], at[turn], n[a:b][turn], sketch[a:b][turn], side[a:b][turn]
        two = trial is None and half.min() < half.max()
        for p in range(b - a - 1):
            other = p + 1 + np.flatnonzero((at[p + 1 :] != at[p]) & (half[p + 1 :] != half[p]) if two else at[p + 1 :] != at[p])
            other = other[possible(bits[other], size[other], bits[p], size[p], percent)]
            if trial is not None and len(other):
                joined, first = np.unique(at[other], return_index=True)
                other = other[first]
                at[np.isin(at, joined)] = at[p]
            if len(other):
                one = np.full(len(other), mine[p])
                pairs.append(np.stack([np.minimum(one, mine[other]), np.maximum(one, mine[other])], axis=1))
    two = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    return pa.table({"a": two[:, 0], "b": two[:, 1]})


def cells(held: DataFrame, trial: int | None) -> DataFrame:
    """held (key, class, component, n, sketch), with cell and side: buckets of more than BLOCK members are dealt to blocks, in an exact round to pairs of blocks.

    The members of a bucket's largest component are not compared with each other, so only the other ones go to many cells.
    """
    each = held.groupBy("key", "component").agg(F.count("*").alias("m"))
    sizes = each.groupBy("key").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    if trial is not None:
        return held.join(sizes, "key").withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("class", F.lit(trial)), blocks(F.col("all"))))).withColumn("side", F.lit(0))
    block = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    few = held.join(sizes.select("key", "main", blocks(F.col("most")).alias("first"), blocks(F.col("all") - F.col("most")).alias("rest")), "key")
    main = F.col("component") == F.col("main")
    few = few.withColumn("mine", F.when(main, block(F.col("first"))).otherwise(F.col("first") + block(F.col("rest"))))
    few = few.withColumn("other", F.explode(F.sequence(F.when(main, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)))
    return few.withColumn("cell", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", F.when(F.col("mine") > F.col("other"), 1).otherwise(0))


def _paired(percent: int, trial: int | None):
    return lambda table: cell_pairs(table, percent, trial)


def class_texts(rows: DataFrame, k: int, wanted: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """class, body (packed text of one member) of the wanted classes; a task sends each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ids, _ = class_ids(*Words(part.column(1)).shingles(k), renamed)
                _, first = np.unique(ids, return_index=True)
                first = np.array([i for i in first[~np.isin(ids[first], seen)] if len(sets[i])], np.int64)
                seen = np.union1d(seen, ids[first])[-FLUSH:]
                body = [pack(part.column(1)[int(i)].as_py().encode("utf-8", "replace")) for i in first]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), pa.array(body, pa.binary())], names=["class", "body"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
    return rows.mapInArrow(run, "class long, body binary").join(wanted, "class", "left_semi").groupBy("class").agg(F.first("body").alias("body"))


def verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body_a", PACKED_BYTES):
                one, two = (Words(pa.array([unpack(b.as_py()) for b in part.column(c)], pa.binary())).shingle_sets(k) for c in (2, 3))
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)], np.int64)
                total = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * total))

    left, right = bodies.select(F.col("class").alias("a"), F.col("body").alias("body_a")), bodies.select(F.col("class").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the folded sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = possible(sketches(batch.column(3)), batch.column(2).to_numpy(), sketches(batch.column(5)), batch.column(4).to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one, two = (classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long")


def linked_classes(rows: DataFrame, classes: DataFrame, k: int, percent: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(node, label): the components of the classes (class, n, sketch) that have links."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    shards = max(4 * shared.parts(rows.sparkSession), -(-total // SHARD_KEYS))
    found = shared.saved(sharded_keys(rows, k, percent, shards, renamed).groupBy("shard").applyInArrow(lambda t: bucket_pairs(t, shards), FOUND))
    rest = shared.saved(unsafe(found.where("not pair").select(F.col("a").alias("key"), F.col("b").alias("class"), "slack")))
    pairs = shared.saved(close(found.where("pair").select("a", "b").distinct(), classes, percent))
    shared.dropped(found)
    wanted = shared.saved(pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(rest.select("class")).distinct())
    bodies = shared.saved(class_texts(rows, k, wanted, renamed))
    links = shared.saved(verified(pairs, bodies, k, percent))
    label = components(links)
    for trial in (*range(TRIALS), None):
        held = rest.join(label, rest["class"] == label["node"], "left").select("key", "class", F.coalesce("label", "class").alias("component"))
        several = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        held = shared.saved(held.join(several, "key", "left_semi").join(classes.select("class", "n", "sketch"), "class"))
        if held.isEmpty():
            break
        dealt = cells(held, trial).select("cell", "class", "component", "n", "sketch", "side", F.pmod("cell", F.lit(shards)).alias("part"))
        tried = dealt.groupBy("part").applyInArrow(_paired(percent, trial), "a long, b long")
        more = shared.saved(tried.distinct().join(pairs, ["a", "b"], "left_anti"))
        shared.dropped(held)
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            links = links.unionByName(shared.saved(verified(more, bodies, k, percent)))
            label = components(links)
    return label


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row."""
    rows = shared.texts(docs, id_col, text_col)
    mine = shared.saved(members(rows, k))
    by_class = lambda m: m.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high"))
    classes = shared.saved(by_class(mine))
    if renamed := shared.clashes(mine, classes):
        mine = shared.renamed_classes(mine, renamed)
        classes = shared.saved(by_class(mine))
    label = linked_classes(rows, classes, k, percent, renamed)
    some = mine.where("class is not null").join(label, F.col("class") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("label", "class").alias("component"))
    some = shared.saved(some)
    least = some.groupBy("component").agg(F.min("id").alias("component_id"))
    none = mine.where("class is null").select(F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id"))
    return some.join(least, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id").unionByName(none)
