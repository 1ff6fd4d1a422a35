"""Whittaker smoothing of many series at once (Eilers 2003), with the V-curve choice of the penalty and asymmetric weights.

Minimises sum w (y - z)^2 + lambda sum (second difference of z)^2.  Rows are shuffled once, by series, and sorted; a task takes some series
at a time and solves them together: the pentadiagonal recurrences run over time once, for all series and all penalties as vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

DETECTOR_GRID = tuple(round(1.0 + 0.2 * i, 1) for i in range(20))
GENERIC_GRID = tuple(round(-1.0 + 0.2 * i, 1) for i in range(30))
BLOCK_SERIES = 64


def solve(y: np.ndarray, w: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """z of (W + lambda D'D) z = W y along the first axis; y, w and lam broadcast over the others.  Series need three steps; those without weight give zeros."""
    shape = np.broadcast_shapes(y.shape, w.shape)
    y, w, n = np.broadcast_to(y, shape), np.broadcast_to(w, shape), shape[0]
    main, one = np.full(n, 6.0), np.full(n - 1, -4.0)
    main[[0, -1]], one[[0, -1]] = 1.0, -2.0
    if n > 3:
        main[[1, -2]] = 5.0
    else:
        main[1] = 4.0
    d, e, f, z = (np.empty(shape) for _ in range(4))
    idle = 1e-12 + 1.0 - w.any(axis=0)  # keeps the system of a series without weight regular
    for i in range(n):
        a, b = w[i] + lam * main[i] + idle, lam * one[i] if i < n - 1 else 0.0
        rhs = w[i] * y[i]
        if i:
            a -= d[i - 1] * e[i - 1] ** 2
            b = b - d[i - 1] * e[i - 1] * f[i - 1]
            rhs -= e[i - 1] * z[i - 1]
        if i > 1:
            a -= d[i - 2] * f[i - 2] ** 2
            rhs -= f[i - 2] * z[i - 2]
        d[i], e[i], z[i] = a, b / a, rhs
        f[i] = lam / a if i < n - 2 else 0.0
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1]
        if i < n - 2:
            z[i] -= f[i] * z[i + 2]
    return z


def smooth(y: np.ndarray, w: np.ndarray, grid: tuple[float, ...] = DETECTOR_GRID, p: float | None = 0.99, rounds: int = 10, limits: tuple[float, float] = (-1.0, 1.0)) -> np.ndarray:
    """(series, steps): the smoothed series at the best penalty of the grid (log10), cut to limits; series without weight are nan.

    Inside, arrays are (steps, penalties, series), so each step of the recurrences is a contiguous block; series that have converged leave the later rounds.
    """
    y = np.where(np.isfinite(y) & (w > 0), y, 0.0).T[:, None, :]
    base = np.ascontiguousarray(w.T, float)[:, None, :]
    lam = 10.0 ** np.array(grid)[:, None]
    weight = np.repeat(base, len(grid), axis=1)
    z = solve(y, weight, lam)
    live = np.arange(y.shape[2])
    for _ in range(rounds if p is not None else 0):
        sided = np.where(y[:, :, live] > z[:, :, live], p, 1 - p) * base[:, :, live]
        new = solve(y[:, :, live], sided, lam)
        moved = np.abs(new - z[:, :, live]).max(axis=(0, 1), initial=0.0) >= 1e-8
        z[:, :, live], weight[:, :, live] = new, sided
        live = live[moved]
        if not len(live):
            break
    if len(grid) > 1:
        tiny = 1e-30
        fit, rough = np.log(np.maximum((weight * (y - z) ** 2).sum(axis=0), tiny)), np.log(np.maximum((np.diff(z, 2, axis=0) ** 2).sum(axis=0), tiny))
        best = np.sqrt(np.diff(fit, axis=0) ** 2 + np.diff(rough, axis=0) ** 2).argmin(axis=0)
        middle = 10.0 ** ((np.array(grid)[best] + np.array(grid)[best + 1]) / 2)
        z = solve(y[:, 0], np.take_along_axis(weight, best[None, None, :], axis=1)[:, 0], middle)
    else:
        z = z[:, 0]
    return np.where((w > 0).any(axis=-1)[:, None], np.clip(z.T, *limits), np.nan)


def whittaker(rows: DataFrame, grid: tuple[float, ...] = DETECTOR_GRID, p: float | None = 0.99, limits: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """rows (pixel_id, day_no, y, weight, ...) with z, smoothed along the steps of each pixel; null for pixels without weight.

    The default is the detector's upper envelope.  p = None weighs both sides alike; one penalty in the grid is taken as it is.
    One shuffle by pixel; a task holds BLOCK_SERIES series at a time, so memory doesn't grow with the data.
    """
    kept = [c for c in rows.columns if c != "z"]

    def solved(table: pa.Table) -> pa.Table:
        ids = table.column("pixel_id").combine_chunks().dictionary_encode()
        at = (ids if isinstance(ids, pa.Array) else ids.combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        n = np.bincount(at + 1)
        n, at = (n, at + 1) if n[0] else (n[1:], at)  # a null is a pixel too
        place = np.arange(len(at)) - np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))[np.concatenate(([0], np.cumsum(np.diff(at) != 0)))]
        steps = max(3, n.max(initial=0))
        y, w = np.full((len(n), steps), np.nan), np.zeros((len(n), steps))
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        y[at, place], w[at, place] = number("y"), np.nan_to_num(number("weight"))
        w[~np.isfinite(y)] = 0.0
        return table.append_column("z", pa.array(smooth(y, w, grid, p, limits=limits)[at, place], from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        series, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            begins = [i for i, k in enumerate(ids) if k != (ids[i - 1] if i else last)] if series else [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            at = 0
            for i in begins:
                if series and series % BLOCK_SERIES == 0:  # the held series are whole
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield from solved(pa.Table.from_batches(held)).to_batches()
                    held, at = [], i
                series += 1
            held.append(batch.slice(at))
            last = ids[-1]
        if held:
            yield from solved(pa.Table.from_batches(held)).to_batches()

    ordered = rows.select("pixel_id", *[c for c in kept if c != "pixel_id"]).repartition("pixel_id").sortWithinPartitions("pixel_id", "day_no")
    schema = StructType([*ordered.schema, StructField("z", DoubleType())])
    return ordered.mapInArrow(run, schema).select(*kept, "z")


def smoothed_series(rows: DataFrame, p: float | None = None, grid: tuple[float, ...] = GENERIC_GRID) -> DataFrame:
    """Any series (pixel_id, day_no, y, ...) with z, smoothed along its steps; null values of y are missing and have no weight.

    p over a half gives an upper envelope, under a half a lower one; None (both sides alike) is the default.  Values are not cut.
    """
    found = whittaker(rows.withColumn("weight", F.col("y").isNotNull().cast("double")), grid, p, (-np.inf, np.inf))
    return found if "weight" in rows.columns else found.drop("weight")
