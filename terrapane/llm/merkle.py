"""A manifest of a table as a Merkle tree, with proofs that are folded from kept hash states.

Each row is a leaf: the SHA-256 of its fields, computed by Spark's own functions.  The leaves of a group ascend by id; runs of
``arity`` nodes become the hash of their digests (hex text) until one node remains, the group's subroot; the subroots, by group, likewise give the root.

A parent keeps a copy of its hash state from before each child slot.  To fold a leaf (a changed one, or the original) up to the
root, each parent resumes the state of the leaf's slot with the replacement and takes in its right siblings only; what lies to the left
is in the state already.  No parent is hashed from its start again.

Work flow: leaves are dealt by ranges of (group, id) and sorted; a row's place in its group follows from its place in its partition
and the sizes of the partitions before.  Blocks of about 4,096 neighbouring nodes are reduced together, tier by tier, so no task holds a group; a
table of n leaves has log(n) / 12 tiers for pairs.  Then paths go down: a block learns the siblings above it from the tier above, makes the states of
its upper parents once, and folds its own leaves.  Tiers are written to the shared folder, so a lost executor costs a block.

Defined cases: null fields have a mark of their own, so they differ from empty ones.  Null ids come first in their group and are
never tampered with; rows that share an id follow each other by their digests.  Null groups come first.  A lone leaf is its group's subroot, a lone subroot
the root; their proofs have no sibling.  Empty tables: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "path array<struct<left string, right string>>"


# ---- trees in a task -------------------------------------------------------------------------------------------------


class Tree:
    """A block of nodes and the levels above them.  ``states[level][parent]``: the parent's hash state before each child slot."""

    def __init__(self, digests: Sequence[str], arity: int, levels: int):
        self.arity, self.nodes, self.states = arity, [list(digests)], []
        for _ in range(levels):
            below, above, kept = self.nodes[-1], [], []
            for at in range(0, len(below), arity):
                state, before = sha256(), []
                for child in below[at : at + arity]:
                    before.append(state.copy())
                    state.update(child.encode())
                kept.append(before)
                above.append(state.hexdigest())
            self.nodes.append(above)
            self.states.append(kept)

    @property
    def top(self) -> str:
        return self.nodes[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """(left, right) of node i and of its ancestors in the block, joined."""
        out = []
        for below in self.nodes[:-1]:
            at = i - i % self.arity
            out.append(("".join(below[at:i]), "".join(below[i + 1 : at + self.arity])))
            i //= self.arity
        return out

    def fold(self, i: int, value: str) -> str:
        """What the top would be with ``value`` in the place of node i."""
        for below, kept in zip(self.nodes[:-1], self.states, strict=True):
            parent, slot = divmod(i, self.arity)
            state = kept[parent][slot].copy()
            state.update(value.encode())
            for right in below[i + 1 : (parent + 1) * self.arity]:
                state.update(right.encode())
            value, i = state.hexdigest(), parent
        return value


class Upper:
    """The parents above a block: each one's state before the slot on the way, and what is to the right of it."""

    def __init__(self, path: Sequence[tuple[str, str]]):
        self.parents = [(sha256(left.encode()), right.encode()) for left, right in path]
        self.siblings = "".join(left + right for left, right in path)
        self.known: dict[str, str] = {}

    def fold(self, value: str) -> str:
        """The root with ``value`` in the block's place; a block's unchanged leaves all come with the same value."""
        found = self.known.get(value)
        if found is None:
            found = value
            for state, right in self.parents:
                resumed = state.copy()
                resumed.update(found.encode() + right)
                found = resumed.hexdigest()
            self.known[value] = found
        return found


def levels_of(total: int, arity: int, depth: int) -> int:
    """Levels above the nodes of a block, when their tier has ``total`` nodes: ``depth``, or up to the one that remains."""
    levels = 0
    while total > 1 and levels < depth:
        total, levels = -(-total // arity), levels + 1
    return levels


# ---- tiers -----------------------------------------------------------------------------------------------------------


def _depth(arity: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos").combine_chunks()


def reduced(nodes: DataFrame, arity: int) -> DataFrame:
    """The tier above nodes (grp, pos, total, digest): one node a block."""
    depth = _depth(arity)
    size = arity**depth

    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        grp, block, total = (rows.column(c)[0].as_py() for c in ("grp", "block", "total"))
        tree = Tree([d.hex() for d in rows.column("digest").to_pylist()], arity, levels_of(total, arity, depth))
        return pa.table({"grp": [grp], "pos": [block], "total": [-(-total // size)], "digest": [bytes.fromhex(tree.top)]})

    return _blocks(nodes.select("grp", "pos", "total", "digest"), size).groupBy("grp", "block").applyInArrow(run, "grp long, pos long, total long, digest binary")


def with_paths(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """grp, pos, path of each node, from those of the tier above (grp, pos, path): siblings in the block, then those of the block."""
    depth = _depth(arity)

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        if not rows.num_rows or not up.num_rows:
            return pa.table({"grp": pa.array([], pa.int64()), "pos": pa.array([], pa.int64()), "path": pa.array([], pa.list_(pa.struct({"left": pa.string(), "right": pa.string()})))})
        rows, rest = _sorted(rows), up.column("path")[0].as_py()
        tree = Tree([d.hex() for d in rows.column("digest").to_pylist()], arity, levels_of(rows.column("total")[0].as_py(), arity, depth))
        path = [[{"left": a, "right": b} for a, b in tree.siblings(i)] + rest for i in range(rows.num_rows)]
        return pa.table({"grp": rows.column("grp"), "pos": rows.column("pos"), "path": pa.array(path, pa.list_(pa.struct({"left": pa.string(), "right": pa.string()})))})

    blocks = _blocks(nodes.select("grp", "pos", "total", "digest"), arity**depth).groupBy("grp", "block")
    return blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(run, f"grp long, pos long, {_PATH}")


def tiers(nodes: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The nodes, and the tiers above them up to one node a group; ``most``: nodes of the largest group."""
    out, size = [nodes], arity ** _depth(arity)
    while most > 1:
        out.append(shared.saved(reduced(out[-1], arity)))
        most = -(-most // size)
    return out


# ---- places ----------------------------------------------------------------------------------------------------------


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the leaves with grp, pos and total, the groups: grp, total), from leaves (key, id, digest, changed, spread).

    Rows are dealt by ranges and sorted, then written with their number (partition and place in it); all that is counted are the
    runs of a group in a partition, and the partitions.
    """
    spark = leaves.sparkSession
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("spread")]
    rows = shared.saved(leaves.repartitionByRange(shared.parts(spark), *order).sortWithinPartitions(*order).drop("spread").withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("row", 33))
    runs = rows.groupBy("key", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of_key, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = shared.saved(runs.select("key", "part", "first", F.min("first").over(of_key).alias("start"), F.sum("n").over(of_key).alias("total"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    begun = runs.where("first = start").select("key", "total", "start", "part")
    n, firsts = 0, []
    for r in sorted(begun.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        firsts.append((r["part"], n))
        n += r["n"]
    base = spark.createDataFrame(firsts, "part long, base long")
    groups = begun.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1).join(base, "part")
    groups = shared.saved(groups.select("key", (F.col("base") + F.col("place")).alias("grp"), "total"))
    where = runs.select("key", "part", "first", "before").join(groups, "key")
    out = rows.join(where, ["key", "part"]).select("grp", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "total", "id", "digest", "changed")
    return out, groups.select("grp", "total")


# ---- the manifest ----------------------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A null is ``-``; a value is its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", arity: int = 2, changed: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``changed`` gives other values for fields of the rows where ``where`` holds; their leaves are folded in place of the
    originals, with the original siblings, so ``verified`` tells whether the row still belongs to the root.
    """
    if arity < 2:
        raise ValueError("a parent needs two children at least")
    spark = docs.sparkSession
    own = {c: F.col(f"`{c}`") for c in fields}
    other = F.when(where, leaf([(changed or {}).get(c, own[c]) for c in fields])) if changed and where is not None else F.lit(None).cast("binary")
    group = F.col(f"`{group_col}`").cast("string")
    leaves = shared.saved(docs.select(F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf(list(own.values())).alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("spread")))
    nodes, groups = placed(leaves)
    size = groups.agg(F.coalesce(F.max("total"), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
    low = tiers(nodes, size["most"], arity)
    subroots = low[-1].select("grp", F.col("digest").alias("subroot")) if len(low) > 1 else nodes.select("grp", F.col("digest").alias("subroot"))
    high = tiers(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(size["n"]).cast("long").alias("total"), F.col("subroot").alias("digest")), size["n"], arity)
    top = high[-1].select("digest").first()
    root = bytes(top[0]).hex() if top else ""
    none = F.from_json(F.lit("[]"), "array<struct<left string, right string>>").alias("path")
    path = high[-1].select("grp", "pos", none)
    for tier in reversed(high[:-1]):
        path = shared.saved(with_paths(tier, path, arity))
    path = path.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
    for tier in reversed(low[1:-1]):
        path = shared.saved(with_paths(tier, path, arity))
    return _folded(nodes, path.join(subroots, "grp"), root, arity)


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(nodes: DataFrame, above: DataFrame, root: str, arity: int) -> DataFrame:
    depth = _depth(arity)

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.bool_() if c.endswith("boolean") else pa.int64() if c.endswith("long") else pa.string()) for c in _RESULT.split(", ")})
        rows = _sorted(rows)
        leaves = [d.hex() for d in rows.column("digest").to_pylist()]
        tree = Tree(leaves, arity, levels_of(rows.column("total")[0].as_py(), arity, depth))
        upper = Upper([(p["left"], p["right"]) for p in up.column("path")[0].as_py()])
        proofs, folded = [], []
        for i, (value, new) in enumerate(zip(leaves, rows.column("changed").to_pylist(), strict=True)):
            proofs.append(sha256(("".join(a + b for a, b in tree.siblings(i)) + upper.siblings).encode()).hexdigest())
            folded.append(upper.fold(tree.fold(i, value if new is None else new.hex())))
        n, subroot = len(leaves), up.column("subroot")[0].as_py().hex()
        return pa.table({"doc_id": rows.column("id"), "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": np.array([f == root for f in folded])})

    blocks = _blocks(nodes, arity**depth).groupBy("grp", "block")
    return blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(run, _RESULT)
