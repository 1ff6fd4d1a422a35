"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, form blocks; one block runs in a slot.  In the ideal (fluid) mixture every source that is not used up gets its
weight's share of each slot, and when a source is used up the others go on with their shares scaled up.  Block j (from 1) of a source
is released in the slot in which the fluid mixture begins it, floor((j-1)/w) while all sources last, and its deadline is the slot in
which that has ended it, ceil(j/w).  Earliest deadline first over the released blocks meets every deadline (unit jobs with whole
windows that a fluid schedule fits), so every source stays within less than one block of its share of the given weights in every prefix.

The driver schedules blocks, never documents: blocks have ``block`` documents, or as many as make ``slots`` of them in all, so the
schedule is of bounded size (slots and one partly filled block a source) at any size of the corpus.  A document's slot follows from
its rank in its source.

Ranks are counted without gathering a source: a source is split into hashed buckets of a few hundred rows, ranked inside
the bucket, and bucket sizes are summed up.

Defined cases: a null source is a source of its own; repeated ids rank by turns; empty tables give no rows; null ids rank last
in their bucket; more than MOST_SOURCES sources are an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 512
MOST_SOURCES = 200_000
SLACK = 1e-6  # for the rounding of floats


def windows(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, number from 0, release, deadline) of each block: the slots in which the fluid mixture begins and has ended it.

    At virtual time v source s has had min(v * weight, blocks), so slot(v) is the sum of these, linear between the ends blocks / weight of the sources.
    """
    weights = weights / weights.sum()
    ends = blocks / weights
    order = np.argsort(ends)
    rest = weights.sum() - np.concatenate(([0.0], np.cumsum(weights[order])[:-1]))  # the weight that is still there before each end
    at = np.concatenate(([0.0], ends[order]))
    slot = np.concatenate(([0.0], np.cumsum(np.maximum(rest, 0.0) * np.diff(at))))
    slot *= blocks.sum() / max(slot[-1], 1e-300)
    source = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin, end = (np.interp((number + k) / weights[source], at, slot) for k in (0, 1))
    return source, number, np.floor(begin + SLACK).astype(np.int64), np.ceil(end - SLACK).astype(np.int64)


def schedule(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, number, slot) of all blocks by earliest deadline first."""
    source, number, release, deadline = windows(blocks, weights)
    order = np.argsort(release, kind="stable")
    opens, due = release[order].tolist(), deadline[order].tolist()
    slots, ready, nxt = np.zeros(len(source), np.int64), [], 0
    for slot in range(len(source)):
        while nxt < len(opens) and opens[nxt] <= slot:
            heapq.heappush(ready, (due[nxt], nxt))
            nxt += 1
        end, i = heapq.heappop(ready)
        assert slot < end, "earliest deadline first missed a deadline"
        slots[order[i]] = slot
    return source, number, slots


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block: int = 64, slots: int = 1 << 20, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, source_rank, block, slot, position, target_weight; position orders the mixture.

    weights: by source; None: rows to the power ``temper``.  A source without a weight gets the least one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    total = rows.groupBy("key").count().limit(MOST_SOURCES + 1).collect()
    if len(total) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    count = {r["key"]: r["count"] for r in sorted(total)}
    given = {("n" if s is None else f"s{s}"): float(w) for s, w in weights.items()} if weights else {s: n**temper for s, n in count.items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    share = np.array([given.get(s, min(given.values())) for s in count])
    block = max(block, -(-sum(count.values()) // slots))
    source, number, slot = schedule(np.array([-(-n // block) for n in count.values()], np.int64), share) if count else (np.zeros(0, np.int64),) * 3
    names, share = np.array(list(count), object), share / max(share.sum(), 1e-300)
    plan = spark.createDataFrame(pd.DataFrame({"key": names[source], "block": number, "slot": slot, "target_weight": share[source]}), "key string, block long, slot long, target_weight double")

    buckets = max(1, -(-max(count.values(), default=0) // BUCKET_ROWS))
    rows = rows.withColumn("mixed", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("mixed", F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("key", "bucket").count()
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("mixed", F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("at", F.row_number().over(inside)).join(starts, ["key", "bucket"]).withColumn("source_rank", (F.col("start") + F.col("at") - 1).cast("long"))
    out = ranked.withColumn("block", F.floor(F.col("source_rank") / block)).join(F.broadcast(plan), ["key", "block"])
    return out.select("doc_id", "source", "source_rank", "block", "slot", (F.col("slot") * block + F.col("source_rank") % block).alias("position"), "target_weight")
