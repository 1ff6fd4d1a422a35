"""Connected components: edges are contracted to stars inside tasks, then labels spread by rounds with pointer jumping.

Every round is written to the shared folder.  Where all edges fit one bounded task, its stars are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TASK_EDGES = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable from each) of the undirected edges a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != (deeper := new[new])).any():
            new = deeper
        new = new[label]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(a, b)], names=["node", "label"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TASK_EDGES:
            yield flush()
            held = []
    if held:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that is reachable from each node of edges (a, b: long).  Undirected; no rows for no edges."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    one_task = edges.count() <= TASK_EDGES
    star = shared.saved((edges.coalesce(1) if one_task else edges).mapInArrow(_stars, "node long, label long"))
    if one_task:
        return star
    both = shared.saved(star.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(star.select(F.col("label").alias("a"), F.col("node").alias("b"))).distinct())
    label = shared.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        told = label.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        above = label.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = shared.saved(told.join(above, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return label
