"""Operators against numpy on small inputs, and properties they must have."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapane.operators import aggregate, grid, morphology, resample, smooth, store, temporal
from terrapane.plans.ingest import ingest

C = F.col


def mask_frame(spark, mask):
    return spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)] or [], "k int, r int, c int")


def as_mask(df, n):
    out = np.zeros((n, n), bool)
    for r in df.collect():
        out[r["r"], r["c"]] = True
    return out


def brute_dilate(m, reach=2):
    n, out = len(m), np.zeros_like(m)
    for r, c in zip(*np.nonzero(m), strict=True):
        out[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1] = True
    return out[:n, :n]


def brute_erode(m, reach=2):
    n, out = len(m), np.zeros_like(m)
    for r in range(reach, n - reach):
        for c in range(reach, n - reach):
            out[r, c] = m[r - reach : r + reach + 1, c - reach : c + reach + 1].all()
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_morphology(spark, seed):
    m = np.random.default_rng(seed).random((12, 12)) > 0.85
    m[0, 0] = True
    df = mask_frame(spark, m)
    dilated = as_mask(morphology.dilated(df, ["k"], 12), 12)
    closed = as_mask(morphology.closed(df, ["k"], 12), 12)
    assert (dilated == brute_dilate(m)).all() and (dilated | m == dilated).all()
    assert (closed == brute_erode(brute_dilate(m))).all()
    assert not closed[:2].any() and not closed[:, -2:].any()


def test_upsample_and_flip(spark):
    px = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)], "k int, r int, c int, v double")
    up = {(r["r"], r["c"]): r["v"] for r in morphology.upsampled(px, 3, 5).collect()}
    assert len(up) == 25 and up[(0, 0)] == up[(2, 2)] == 1.0 and up[(4, 4)] == 4.0
    twice = morphology.flipped(morphology.flipped(px, 2), 2)
    assert sorted(map(tuple, twice.select(px.columns).collect())) == sorted(map(tuple, px.collect()))


def test_boxes_cover_the_area_once(spark):
    boxes = grid.fixed_boxes(spark, (-70.0, 70.0), (-60.0, 80.0), 7, 5).collect()
    assert len(boxes) == 35 and sum((b["lon_max"] - b["lon_min"]) * (b["lat_max"] - b["lat_min"]) for b in boxes) == pytest.approx(140 * 140)
    assert [boxes[0]["lon_min"], boxes[0]["lat_min"]] == [-60.0, -70.0] and boxes[1]["lat_min"] == -70.0


def test_points_in_boxes_like_a_plain_range_join(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-80, 80, (200, 2)))] + [(999, 10.0, 20.0)], "cell_id int, lat double, lon double")
    boxes = spark.createDataFrame([(j, float(x), float(y), float(x + w), float(y + w)) for j, (x, y, w) in enumerate(zip(rng.uniform(-90, 60, 30), rng.uniform(-90, 60, 30), rng.uniform(0.1, 35, 30), strict=True))] + [(77, 20.0, 10.0, 30.0, 20.0)], "box_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    near = C("lat").between(C("lat_min"), C("lat_max")) & C("lon").between(C("lon_min"), C("lon_max"))
    want = {tuple(r) for r in points.join(boxes, near).select("cell_id", "box_id").collect()}
    got = [tuple(r) for r in grid.points_in_boxes(points, boxes).select("cell_id", "box_id").collect()]
    assert set(got) == want and len(got) == len(want) and (999, 77) in want


def test_nearest_across_the_date_line_and_pole(spark):
    targets = spark.createDataFrame([(1, 0.0, 179.999), (2, 89.999, 10.0), (3, 40.0, 0.0)], "t long, lat double, lon double")
    samples = spark.createDataFrame([(10, 0.0, -179.999), (11, 89.999, -170.0), (12, 41.0, 0.0), (13, 0.0, 179.99)], "s long, lat double, lon double")
    got = {r["t"]: r["s"] for r in resample.nearest_within(targets, samples, 1500.0, "t", "s").collect()}
    assert got == {1: 10, 2: 11}


def test_bilinear_reproduces_a_plane(spark):
    raster = spark.createDataFrame([(1, r, c, 2.0 * r - 3.0 * c) for r in range(5) for c in range(6)], "k int, r int, c int, v double")
    points = spark.createDataFrame([(1, i, float(fr), float(fc)) for i, (fr, fc) in enumerate([(0, 0), (4, 5), (1.25, 3.5), (3.999, 0.001), (4.1, 2.0)])], "k int, p int, fr double, fc double")
    got = {r["p"]: r["v"] for r in resample.bilinear(points, raster, ["k"], "p", 5, 6).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.0, -7.0, -8.0, 7.995, 0.0])


def test_windows_that_leave_the_tile_are_rejected(spark):
    px = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(8) for c in range(8)], "t int, r int, c int, v double")
    centres = spark.createDataFrame([(1, 100, 4, 4), (1, 101, 1, 4), (1, 102, 6, 6), (1, 103, 7, 2)], "t int, cell_id int, row int, col int")
    got = grid.extract_windows(px, centres, ["t"], 2, 8).collect()
    assert {r["cell_id"] for r in got} == {100, 102} and len(got) == 32
    assert {(r["pr"], r["pc"]): r["v"] for r in got if r["cell_id"] == 100}[(0, 0)] == 22.0


def test_missing_ranges_and_batches(spark):
    day = lambda d: dt.date(2024, 1, d)
    wanted = store.calendar(spark, day(1), day(10)).withColumn("k", F.lit(1))
    done = spark.createDataFrame([(1, day(d)) for d in (3, 4, 9)], "k int, obs_date date")
    ranges = store.missing_ranges(wanted, done, ["k"])
    assert sorted((r["start"].day, r["end"].day, r["n_days"]) for r in ranges.collect()) == [(1, 2, 2), (5, 8, 4), (10, 10, 1)]
    assert sorted((r["batch_start"].day, r["batch_end"].day) for r in store.day_batches(ranges, 3).collect()) == [(1, 2), (5, 7), (8, 8), (10, 10)]
    assert store.missing_ranges(wanted, wanted, ["k"]).count() == 0


def test_upsert_and_latest(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, store.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 5, "y")], "k int, t int, v string")
    assert sorted(map(tuple, store.keep_latest(rows, ["k"], ["t"]).collect())) == [(1, 2, None), (2, 5, "y")]


def series(spark, y, days=None, weight=None):
    days = days or range(len(y))
    return spark.createDataFrame([(1, float(d), int(d % 360 + 1), v, 1.0 if weight is None else weight[i]) for i, (d, v) in enumerate(zip(days, y, strict=True))], "pixel_id int, day_no double, doy int, y double, weight double")


def test_runs_and_gaps(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 1]
    df = series(spark, [0.0] * 9).withColumn("s", F.get(F.array(*map(F.lit, flags)), C("day_no").cast("int")))
    out = sorted(temporal.gaps(temporal.run_lengths(df)).collect(), key=lambda r: r["day_no"])
    assert [r["run_length"] for r in out] == [0, 2, 2, 0, 3, 3, 3, 0, 1]
    assert [r["gap_back"] for r in out] == [0, 1, 2, 0, 1, 2, 3, 0, 1]
    assert [r["gap_forward"] for r in out] == [0, 2, 1, 0, 3, 2, 1, 0, None]


def test_slope_of_a_line(spark):
    df = series(spark, [0.0] * 6, days=[0, 1, 2, 3, 20, 40]).withColumn("z", 3.0 * C("day_no"))
    got = [r["slope"] for r in temporal.slopes(df).orderBy("day_no").collect()]
    assert got == pytest.approx([3, 3, 3, 3, 0, 0])


def test_detection_needs_clear_steps_and_weights(spark):
    z = [0.5] * 8
    y = [0.5, 0.51, 0.52, 0.3, 0.5, 0.505, None, 0.495]
    df = series(spark, y).withColumn("z", F.lit(z[0]))
    assert [r["cloud"] for r in temporal.detected(df).orderBy("day_no").collect()] == [False, False, False, True, False, False, False, False]
    none = temporal.detected(series(spark, y, weight=[0.0] * 8).withColumn("z", F.lit(0.5))).collect()
    assert all(r["uncertain"] and not r["cloud"] for r in none)


def dense(y, w, lam):
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)


@pytest.mark.parametrize("n", [3, 4, 5, 40])
def test_smoother_solves_the_system(n):
    rng = np.random.default_rng(n)
    y, w = rng.normal(size=(6, n)), rng.integers(0, 2, (6, n)).astype(float)
    w[:, [0, -1]] = 1
    for lam in (0.1, 10.0, 1e4):
        got = smooth.solve(y.T, w.T, np.full(6, lam)).T
        assert np.allclose(got, [dense(a, b, lam) for a, b in zip(y, w, strict=True)], atol=1e-5)


def test_smoother_keeps_lines_and_drops_empty_series(spark):
    line = np.linspace(-0.5, 0.5, 30)
    z = smooth.smooth(np.stack([line, line]), np.stack([np.ones(30), np.zeros(30)]))
    assert np.allclose(z[0], line, atol=1e-4) and np.isnan(z[1]).all()
    out = smooth.whittaker(series(spark, [float(v) for v in line])).orderBy("day_no").collect()
    assert [r["z"] for r in out] == pytest.approx(list(line), abs=1e-4)


def test_asymmetric_envelope_lies_above_dips():
    rng = np.random.default_rng(0)
    t = np.arange(120)
    clean = 0.5 + 0.3 * np.sin(t / 20)
    y = clean - (rng.random(120) < 0.2) * 0.4
    z = smooth.smooth(y[None], np.ones((1, 120)))[0]
    assert np.abs(z - clean).max() < 0.15


def test_ingest_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d), d) for d in range(1, 11)], "variable string, obs_date date, v int")
    where = str(tmp_path / "store"), str(tmp_path / "log")
    assert ingest(rows, dt.date(2024, 1, 1), dt.date(2024, 1, 5), *where, days=3) == 2
    assert ingest(rows, dt.date(2024, 1, 1), dt.date(2024, 1, 10), *where, days=3) == 2
    assert ingest(rows, dt.date(2024, 1, 1), dt.date(2024, 1, 10), *where, days=3) == 0
    assert sorted(r["v"] for r in spark.read.parquet(where[0]).collect()) == list(range(1, 11))


def test_days_whose_data_arrive_late_are_ingested(spark, tmp_path):
    where = str(tmp_path / "store"), str(tmp_path / "log")
    day = lambda n: dt.date(2024, 1, n)
    first = spark.createDataFrame([("a", day(1), 1.0), ("a", day(4), 2.0)], "variable string, obs_date date, v double")
    late = first.unionByName(spark.createDataFrame([("a", day(2), 3.0)], first.schema))
    ingest(first, day(1), day(5), *where, days=7)
    ingest(late, day(1), day(5), *where, days=7)
    assert sorted(r["obs_date"].day for r in spark.read.parquet(where[0]).collect()) == [1, 2, 4]
    assert sorted(r["obs_date"].day for r in spark.read.parquet(where[1]).collect()) == [1, 2, 4]


def test_clear_steps_have_more_than_half_a_weight(spark):
    rows = [(1, float(d), 20, 0.5, 0.5, 0.3 if d < 2 else 0.6) for d in range(4)]
    df = spark.createDataFrame(rows, "pixel_id int, day_no double, doy int, y double, z double, weight double")
    assert {r["uncertain"] for r in temporal.detected(df).collect()} == {True}  # two clear steps of four


def test_five_slots_are_padded_with_zeros(spark):
    from terrapane.operators import aggregate

    df = spark.createDataFrame([(1, 0.5, 0.4), (1, 0.7, 0.4), (1, None, 0.4)], "k int, ndvi double, red double")
    got = aggregate.reliability(df, ["k"], "ndvi", "red").first()
    index, band = np.array([0.5, 0.7, 0, 0, 0]), np.array([0.4, 0.4, 0.4, 0, 0])
    off = np.abs(band - np.median(band))
    assert got["ndvi_p75"] == pytest.approx(np.percentile(index, 75)) and got["ndvi_std"] == pytest.approx(index.std())
    assert got["flagged"] == pytest.approx((off / (np.median(off) + 1e-6) > 3).mean())


def test_dense_store_modes(spark, tmp_path):
    path, schema = str(tmp_path / "dense"), "time date, y int, x int, ndvi double"
    day = lambda n: dt.date(2024, 1, n)
    store.write_dense(spark.createDataFrame([(day(1), 0, 0, 0.1), (day(1), 0, 1, 0.2)], schema), path, "time", ["y", "x"], "overwrite")
    store.write_dense(spark.createDataFrame([(day(1), 0, 0, 9.0), (day(2), 0, 0, 0.3)], schema), path, "time", ["y", "x"])
    store.write_dense(spark.createDataFrame([(day(2), 0, 0, 0.7)], "time date, y int, x int, evi double"), path, "time", ["y", "x"], "variables")
    got = sorted((r["time"].day, r["x"], r["ndvi"], r["evi"]) for r in spark.read.option("mergeSchema", "true").parquet(path).collect())
    assert got == [(1, 0, 0.1, None), (1, 1, 0.2, None), (2, 0, 0.3, 0.7)]


def test_projections_invert_and_match_published_extents(spark):
    from terrapane.functions import geo

    df = spark.createDataFrame([(45.0, 10.0), (-33.3, 151.2), (0.0, -70.0), (71.0, 25.0)], "lat double, lon double")
    x, y = geo.equal_area(F.col("lat"), F.col("lon"))
    u, w = geo.sinusoidal(F.col("lat"), F.col("lon"))
    back = df.select("lat", "lon", *geo.equal_area_inverse(x, y), *geo.sinusoidal_inverse(u, w))
    for r in back.collect():
        assert list(r[2:]) == pytest.approx([r[0], r[1]] * 2, abs=1e-6)
    own = df.withColumns({"lat0": F.col("lat") + 0.5, "lon0": F.col("lon") - 0.5, "epsg": geo.utm_epsg(F.col("lat"), F.col("lon"))})
    for kind in ("degrees", "sinusoidal", "equal_area", "azimuthal", "utm"):
        for r in geo.unprojected(geo.projected(own, kind, F.col("lat"), F.col("lon")), kind, F.col("x"), F.col("y"), "p", "q").collect():
            assert (r["p"], r["q"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-6 if kind == "equal_area" else 1e-9)
    edge = spark.range(1).select(*geo.equal_area(F.lit(85.0445664), F.lit(180.0))).first()  # the corner of the published global grid
    assert (edge[0], edge[1]) == pytest.approx((17367530.45, 7314540.83), abs=0.5)


def test_clip_keeps_what_would_collapse_and_shapes_are_strict(spark):
    rows = [(k, r, c, 10.0 + r, 20.0 + c + 50 * k, 1.0) for k in (0, 1) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "k int, r int, c int, lat double, lon double, v double")
    got = resample.clipped(df, ["k"], (20.5, 10.5, 60.0, 13.0)).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {0: 4, 1: 9}
    assert resample.of_shape(df, ["k"], 3, 3).count() == 18
    with pytest.raises(Exception, match="not 3 x 4"):
        resample.of_shape(df, ["k"], 3, 4).count()


def test_polygons_with_holes_like_a_plain_ray_cast(spark):
    rng = np.random.default_rng(5)
    rings = [[(0.0, 0.0), (30.0, 2.0), (25.0, 31.0), (4.0, 24.0)], [(10.0, 8.0), (20.0, 9.0), (15.0, 18.0)], [(-20.0, -5.0), (-8.0, -5.0), (-14.0, 7.0)]]
    pts = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(-25, 35, (400, 2)))] + [(400, 0.0, 0.0), (401, None, 3.0)]
    inside = set()
    for i, y, x in pts[:401]:
        odd = False
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
                odd ^= (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        if odd:
            inside.add(i)
    points = spark.createDataFrame(pts, "k int, lat double, lon double")
    regions = spark.createDataFrame([("a", rings), ("b", rings[2:])], "name string, rings array<array<struct<lon: double, lat: double>>>")
    assert {r.k for r in grid.in_regions(points, grid.selected(regions, ["a"], "name")).collect()} == inside
    assert {r.k for r in grid.clipped_to_regions(points, regions, ["k"]).collect()} == inside  # in both regions: once
    assert {r.k for r in grid.clipped_to_regions(points, regions, ["k"], invert=True).collect()} == set(range(402)) - inside
    assert tuple(grid.bounds(regions).first()) == (-20.0, -5.0, 30.0, 31.0)
    with pytest.raises(Exception, match="no region is selected"):
        grid.bounds(grid.selected(regions, ["c"], "name")).collect()
    with pytest.raises(ValueError, match="no column"):
        grid.selected(regions, ["a"], "country")


def test_swath_patches_point_north_and_fill_gaps(spark):
    # Sample rows run north to south, a hundredth of a degree apart; one is missing, another has no value.
    rows = [(1, "d", 20 * i + j, 10.0 - 0.01 * i, 5.0 + 0.01 * j, 0 if i < 10 else 3) for i in range(20) for j in range(20)]
    rows = [r for r in rows if r[2] != 20 * 8 + 10] + [(2, "d", 0, 60.0, 60.0, None), (2, "d", 1, None, None, 1)]
    samples = spark.createDataFrame(rows, "swath_id int, obs_date string, sample_id int, lat double, lon double, level int")
    cells = spark.createDataFrame([(1, 9.9049, 5.0949), (2, 10.0, 5.0), (3, 40.0, 40.0)], "cell_id int, lat double, lon double")
    out = {(r.cell_id, r.r, r.c): r.level for r in resample.swath_patches(samples, cells, 4, 20, metres=400.0).collect()}
    assert {k[0] for k in out} == {1} and len(out) == 400  # the second cell's patch is mostly empty, the third has no swath
    assert out[1, 0, 0] == 0 and out[1, 19, 0] == 3
    gaps = [k for k, v in out.items() if v == 99]
    assert len(gaps) == 9 and {v for v in out.values()} == {0, 3, 99}
    assert not resample.swath_patches(samples.limit(0), cells, 4, 20).collect()
    more = samples.union(samples.where("swath_id = 1").withColumn("swath_id", F.lit(7)).withColumn("level", F.lit(2)))
    assert {r.level for r in resample.swath_patches(more, cells, 4, 20, metres=400.0).collect()} == {2, 99}  # the later swath stays


def test_daily_mosaic_takes_the_commonest_kind_and_the_last_piece(spark):
    rows = [("d", "a", 1, "f", 0, 0, 9.0), ("d", "a", 2, "i", 0, 0, 5.0), ("d", "a", 3, "i", 0, 0, None), ("d", "a", 4, "i", 0, 1, 7.0), ("d", "b", 5, "f", 0, 1, 1.0), ("d", "b", 6, "i", 0, 1, 2.0), ("d", "c", 7, "i", 0, 1, 2.0), ("e", "b", 8, "i", 4, 4, None)]
    pieces = spark.createDataFrame(rows, "obs_date string, variable string, piece int, dtype string, y int, x int, raw double")
    out = resample.daily_mosaic(pieces, {"a": lambda x: x * 10, "b": lambda x: x})
    assert {tuple(r) for r in out.collect()} == {("d", 0, 0, 50.0, None), ("d", 0, 1, 70.0, 1.0)}


def test_geometry_of_a_raster_of_one_column(spark):
    pixels = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 5.0)], "k int, x double, y double")
    assert tuple(aggregate.raster_geometry(pixels, ["k"]).first()) == (1, 1, 2, None, 2.0, None, 2.0, None, 6.0)


def test_windows_of_blocked_tiles(spark):
    size, block, half = 12, 4, 3
    tile = {k: [None if (i * 7 + k) % 11 == 0 else float(i + 1000 * k) for i in range(size * size)] for k in (1, 2)}
    tiles = spark.createDataFrame([(k, v) for k, v in tile.items()], "t int, data array<double>")
    centres = [(100 * k + r * 12 + c, k, r, c) for k in (1, 2) for r in range(13) for c in range(13)]
    blocks = grid.blocked(tiles, ["t"], size, block)
    assert blocks.count() == 18
    got = {r["cell_id"]: r["data"] for r in grid.extract_block_windows(blocks, spark.createDataFrame(centres, "cell_id int, t int, row int, col int").where("t = 1 or row > 2"), ["t"], half, size, block, 0.12).collect()}
    want = {}
    for i, k, r, c in centres:
        if r >= half and c >= half and r + half <= size and c + half <= size:
            window = [tile[k][y * size + x] for y in range(r - half, r + half) for x in range(c - half, c + half)]
            if window.count(None) <= 0.12 * len(window):
                want[i] = window
    assert got == want and 0 < len(want) < 98
    with pytest.raises(ValueError, match="whole number"):
        grid.blocked(tiles, ["t"], size, 5)


def test_grid_points_in_boxes(spark):
    boxes = spark.createDataFrame([(1, -10.0, -5.0, 10.0, 5.0), (2, 170.0, 50.0, -170.0, 60.0), (3, 0.1, 0.1, 0.2, 0.2), (4, -180.0, -90.0, 180.0, 90.0)], "box int, lon_min double, lat_min double, lon_max double, lat_max double")
    got = grid.grid_points_in_boxes(boxes, 500.0).collect()
    every = [r for r in got if r["box"] == 4]
    assert len({r["grid_id"] for r in every}) == len(every) > 2000
    for b in (1, 2, 3):
        box = boxes.where(f"box = {b}").first()
        inside = {r["grid_id"] for r in every if box["lat_min"] <= r["lat"] <= box["lat_max"] and ((box["lon_min"] <= r["lon"] <= box["lon_max"]) if b != 2 else (r["lon"] >= 170 or r["lon"] <= -170))}
        assert {r["grid_id"] for r in got if r["box"] == b} == inside and bool(inside) == (b != 3)


def test_clip_to_projected_boxes(spark):
    from terrapane.functions import geo

    frames = geo.projected(spark.createDataFrame([(1, 47.0, 11.0, 32632, 10.99, 46.99, 11.01, 47.01), (2, 47.0, 11.0, 32632, 11.0, 47.0, 11.0, 47.0), (3, 47.0, 11.0, 32632, None, None, None, None)], "k int, la double, lo double, epsg int, lon_min double, lat_min double, lon_max double, lat_max double"), "utm", F.col("la"), F.col("lo"))
    frames = frames.withColumns({"west": F.col("x") - 3000, "north": F.col("y") + 3000})
    pixels = frames.select("k", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("p")).select("k", F.floor(F.col("p") / 6).alias("r"), (F.col("p") % 6).alias("c"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    got = {r["k"]: r["count"] for r in resample.clipped_to_boxes(pixels, frames, ["k"], "utm", 1000.0).groupBy("k").count().collect()}
    assert got[3] == 36 and got[2] == 4 and got[1] == 8  # 1.52 km x 2.22 km around the middle: two columns and four rows of 1 km touch it


def dense_v_curve(y, grid, p=None):
    """The V-curve by dense matrices, for one series without nans but with missing values as None."""
    n = len(y)
    base = np.array([0.0 if v is None else 1.0 for v in y])
    v = np.array([0.0 if x is None else x for x in y])
    d2 = np.diff(np.eye(n), 2, axis=0)
    at = lambda lam, w: np.linalg.solve(np.diag(w) + lam * d2.T @ d2, w * v)
    fit, rough, weights = [], [], []
    for g in grid:
        w = base
        z = at(10.0**g, w)
        for _ in range(10 if p is not None else 0):
            w = np.where(v > z, p, 1 - p) * base
            new = at(10.0**g, w)
            moved, z = np.abs(new - z).max() >= 1e-8, new
            if not moved:
                break
        fit.append(np.log((w * (v - z) ** 2).sum()))
        rough.append(np.log(((d2 @ z) ** 2).sum()))
        weights.append(w)
    k = int(np.hypot(np.diff(fit), np.diff(rough)).argmin())
    return at(10.0 ** ((grid[k] + grid[k + 1]) / 2), weights[k])


@pytest.mark.parametrize("p", [None, 0.9])
def test_generic_smoother_against_dense_matrices(spark, p):
    rng = np.random.default_rng(6)
    made = {k: [None if rng.random() < 0.15 else float(3 * np.sin(t / (3 + k)) + rng.normal(0, 0.4)) for t in range(40 + k % 7)] for k in range(150)}
    made[150] = [None] * 5
    rows = [(k, float(10 * t), v, f"{k}-{t}") for k, y in made.items() for t, v in enumerate(y)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pixel_id long, day_no double, y double, note string")
    got = {}
    for r in smooth.smoothed_series(df.repartition(5), p).orderBy("pixel_id", "day_no").collect():
        assert r["note"] == f"{r['pixel_id']}-{int(r['day_no'] / 10)}"
        got.setdefault(r["pixel_id"], []).append(r["z"])
    assert got[150] == [None] * 5 and len(got) == 151 and len(smooth.GENERIC_GRID) == 30 and smooth.GENERIC_GRID[-1] == 4.8
    for k in range(150):
        assert got[k] == pytest.approx(dense_v_curve(made[k], smooth.GENERIC_GRID, p).tolist(), abs=1e-6)


def test_smoother_takes_null_pixels_and_long_series(spark):
    rows = [(None, float(t), 0.5) for t in range(4)] + [(1, float(t), 0.001 * (t % 3)) for t in range(30_000)] + [(2, 0.0, 0.1), (2, 1.0, 0.2)]
    out = smooth.smoothed_series(spark.createDataFrame(rows, "pixel_id long, day_no double, y double"), None, (2.0,)).groupBy("pixel_id").agg(F.count("z").alias("n"), F.avg("z").alias("z")).collect()
    assert {(r["pixel_id"], r["n"]) for r in out} == {(None, 4), (1, 30_000), (2, 2)} and {r["pixel_id"]: r["z"] for r in out}[None] == pytest.approx(0.5)


def test_a_swath_across_the_date_line_has_a_short_box(spark):
    """Samples a hundredth of a degree apart around 180; the same swath 90 degrees further west gives the same patches."""
    def patches(shift):
        turn = lambda lon: (lon + shift + 180.0) % 360.0 - 180.0
        samples = [(1, dt.date(2024, 1, 1), i * 40 + j, 10.0 + i * 0.01, turn(179.8 + j * 0.01), (i * 7 + j) % 4) for i in range(40) for j in range(40)]
        cells = [(k, 10.2 + dy, turn(180.0 + dx)) for k, (dy, dx) in enumerate([(0.0, 0.0), (0.05, 0.05), (-0.05, -0.05), (0.0, 90.0), (0.0, 179.0)])]
        out = resample.swath_patches(spark.createDataFrame(samples, "swath_id int, obs_date date, sample_id int, lat double, lon double, level int"), spark.createDataFrame(cells, "cell_id int, lat double, lon double"), 3, 6, 0.01, 900.0)
        return sorted((r["cell_id"], r["r"], r["c"], r["level"]) for r in out.collect())

    got = patches(0.0)
    assert {r[0] for r in got} == {0, 1, 2} and len(got) == 3 * 36
    assert {r[:3] for r in got} == {r[:3] for r in patches(-90.0)}


def test_boxes_of_regions(spark):
    regions = spark.createDataFrame([(1, -10.0, 0.0, 10.0, 20.0), (2, 5.0, 59.0, 6.0, 60.0), (3, 5.0, 5.0, 5.0, 5.0)], "k int, lon_min double, lat_min double, lon_max double, lat_max double")
    cut = {(r["k"], r["box_id"]): tuple(r)[2:] for r in grid.region_boxes(regions, 2, 4).collect()}
    assert len(cut) == 24 and cut[1, 5] == (-5.0, 10.0, 0.0, 20.0)
    rows = grid.region_boxes_by_resolution(regions, 1000.0, 50).collect()
    assert {r["k"] for r in rows} == {1, 2} and max(r["col"] for r in rows if r["k"] == 2) == 1 and max(r["row"] for r in rows if r["k"] == 2) == 2


def test_patches_take_the_coarse_pixel_they_are_in(spark):
    from terrapane.sources import training

    fine = spark.createDataFrame([(1, r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "p int, r int, c int, observed double")
    coarse = spark.createDataFrame([(1, 0, 0, 0.5, 0.0, 0.0), (1, 0, 1, None, 0.0, 0.0), (1, 1, 0, 0.7, 9.0, 9.0)], "p int, r int, c int, z double, gap_back double, gap_forward double")
    got = {(r["r"], r["c"]): (r["observed"], r["envelope"], r["soft"]) for r in training.processed_patch_source(fine, coarse, ["p"], 3.0).collect()}
    assert got[1, 1] == (11.0, 0.5, 1.0) and got[0, 2] == (2.0, None, 0.0) and got[3, 0] == (30.0, 0.7, 0.0) and got[3, 3] == (33.0, None, 0.0) and len(got) == 16


def test_month_before_across_years_and_gaps(spark):
    from terrapane.sources import training

    days = [(1, dt.date(2023, 12, 5), 0.2), (1, dt.date(2023, 12, 6), 0.4), (1, dt.date(2024, 1, 1), 0.6), (1, dt.date(2024, 3, 1), 0.9), (2, dt.date(2024, 1, 1), 5.0), (2, dt.date(2024, 2, 1), None)]
    got = {(r["k"], r["obs_date"]): r["prior"] for r in training.previous_month_mean(spark.createDataFrame(days, "k int, obs_date date, v double"), "k", "v").collect()}
    assert [got[k, d] for k, d, _ in days] == pytest.approx([0.0, 0.0, 0.3, 0.0, 0.0, 1.0])


def test_assembled_rows_count_up(spark):
    out = temporal.assembled(spark.createDataFrame([(0, 3, dt.date(2000, 1, 11), 0.5)], "r int, c int, obs_date date, soft double"), height=4).first()
    assert (out["y"], out["x"], out["day_no"]) == (3, 3, 10)


def test_windows_grow_and_close_like_sets_of_pixels(spark):
    rng = np.random.default_rng(8)
    masks = {k: rng.random((9, 9)) < 0.04 * k for k in range(4)}
    rows = [(k, r, c, bool(m[r, c])) for k, m in masks.items() for r in range(9) for c in range(9)]
    df = spark.createDataFrame(rows, "k int, r int, c int, on boolean")
    sets = morphology.closed(morphology.dilated(df.where("on").select("k", "r", "c"), ["k"], 9), ["k"], 9)
    got = {tuple(r) for r in morphology.grown_and_closed(df, ["k"], F.col("on"), "cloud").where("cloud").select("k", "r", "c").collect()}
    assert got == {tuple(r) for r in sets.collect()} and got


@pytest.mark.parametrize("name", ["g14_reproject_nearest", "g14_reproject_clip", "g14_reproject_utm", "g15_regrid", "g19_reproject_patch", "g14_bilinear"])
def test_pixels_and_corners_are_never_broadcast(spark, sf_dir, name):
    from terrapane import catalog

    # By their files these tables look small; their pixels and corners are hundreds of times as many rows.
    assert "Broadcast" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_bilinear_outside_and_without_a_raster(spark):
    raster = spark.createDataFrame([(1, r, c, None if (r, c) == (2, 2) else float(r)) for r in range(3) for c in range(3)], "k int, r int, c int, v double")
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 1.5, 1.5), (1, 2, 5.0, 0.0), (1, 3, None, 0.0), (2, 4, 0.5, 0.5)], "k int, p int, fr double, fc double")
    got = {r["p"]: r["v"] for r in resample.bilinear(points, raster, ["k"], "p", 3, 3, outside=-1.0).collect()}
    assert got == {0: 0.5, 1: -1.0, 2: -1.0, 3: -1.0, 4: -1.0}


def test_pairs_by_tile_makes_no_pairs(spark):
    left = spark.createDataFrame([(0, 0, i) for i in range(50_000)] + [(1, 0, 0), (None, 0, 0)], "h int, v int, id int")
    right = spark.createDataFrame([(0, 0)] * 40_000 + [(2, 0), (None, 0)], "h int, v int")
    assert [tuple(r) for r in grid.pairs_by_tile(left, right).collect()] == [(0, 0, 2_000_000_000)]


def test_closing_holds_no_table_of_pixels(spark):
    # The pixels were a hash table in each of four steps of one task, five times as many as came in.
    true = mask_frame(spark, np.eye(12, dtype=bool))
    for step in (morphology.dilated, morphology.eroded, morphology.closed):
        plan = step(true, ["k"], 12)._jdf.queryExecution().executedPlan().toString()
        assert " HashAggregate" not in plan and plan.count("Exchange") == 1


def test_windows_along_time_share_their_sorts(spark):
    rows = series(spark, [0.0] * 9).withColumn("z", C("y")).withColumn("s", F.lit(1))
    plan = temporal.high_risk(temporal.run_lengths(temporal.slopes(temporal.window_share(rows))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") <= 2  # by day, and by the runs of a pixel; they were four
