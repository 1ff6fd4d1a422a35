"""Training-sample sources and whole flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import bands, geo
from ..operators import resample, temporal
from ..sources import training
from .registry import query, r6
from .spatial import on_ellipsoid
from .timeline import _GAP, flagged

C = F.col


@query("t02_processed_source", f"select pixel_id, obs_date, round(y,6) as observed, round(z,6) as envelope, case when z is null then 0.0 when coalesce(gap_forward, 1e18) >= 3 and coalesce(gap_back, 1e18) >= 3 then 0.0 else 1.0 end::double as soft from {_GAP}")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.gaps(flagged(spark, sf_dir))
    key = ["pixel_id", "obs_date"]
    out = training.processed_source(rows.select(*key, C("y").alias("observed")), rows.select(*key, "z"), rows.select(*key, "gap_forward", "gap_back"), key, 3.0)
    return out.select(*key, r6(C("observed")).alias("observed"), r6(C("z")).alias("envelope"), "soft")


@query(
    "t02_upsampled",
    """with o as (select patch_id // 4 as patch_id, r + 8 * (patch_id % 4 // 2) as r, c + 8 * (patch_id % 2) as c, v as observed from f_patch), z as (select patch_id, r, c, case when v >= -0.12 then v end as z, floor(abs(v) * 50) as back, floor(abs(v) * 30) as forward from f_patch)
 select o.patch_id, cast(o.r as int) as r, cast(o.c as int) as c, round(observed, 6) as observed, round(z, 6) as envelope, case when z is null then 0.0 when forward >= 3 and back >= 3 then 0.0 else 1.0 end::double as soft from o left join z on z.patch_id = o.patch_id and z.r = o.r // 2 and z.c = o.c // 2""",
)
def t02u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed patches of 16 x 16 with an envelope and gaps of half the resolution."""
    k, rows = C("patch_id"), fixtures.patch(spark, sf_dir)
    fine = rows.select(F.floor(k / 4).alias("patch_id"), (C("r") + 8 * F.floor(k % 4 / 2)).cast("int").alias("r"), (C("c") + 8 * (k % 2)).cast("int").alias("c"), C("v").alias("observed"))
    coarse = rows.select("patch_id", "r", "c", F.when(C("v") >= -0.12, C("v")).alias("z"), F.floor(F.abs("v") * 50).cast("double").alias("gap_back"), F.floor(F.abs("v") * 30).cast("double").alias("gap_forward"))
    out = training.processed_patch_source(fine, coarse, ["patch_id"], 3.0)
    return out.select("patch_id", "r", "c", r6(C("observed")).alias("observed"), r6(C("envelope")).alias("envelope"), "soft")


_NDVI = "case when red >= -0.05 and nir >= -0.05 and nir+red <> 0 then greatest(-1.0, least(1.0, (nir-red)/(nir+red))) end"


@query("t03_raw_source", f"select obs_id, round({_NDVI},6) as observed, round({_NDVI},6) as envelope, cast(case when (qa & 3) = 0 then 1 else 0 end as double) as soft from f_obs")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.raw_source(fixtures.obs(spark, sf_dir))
    return out.select("obs_id", r6(C("observed")).alias("observed"), r6(C("envelope")).alias("envelope"), "soft")


@query("t04_monthly_prior", "with m as (select pixel_id, cast(date_trunc('month', obs_date) as date) as month, avg((nir-red)/nullif(nir+red,0)) as ndvi from f_series group by 1,2) select s.pixel_id, s.obs_date, round(coalesce(case when m.ndvi is not null then greatest(-0.2, least(1.0, m.ndvi)) end, 0.0),6) as prior from f_series s left join m on m.pixel_id = s.pixel_id and m.month = cast(date_trunc('month', s.obs_date) - interval 1 month as date)")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.series(spark, sf_dir).withColumn("ndvi", bands.ndvi(red=C("red"), nir=C("nir")))
    return training.previous_month_mean(rows, "pixel_id", "ndvi").withColumn("prior", r6(C("prior")))


@query("t04_stored_prior", "with m as (select pixel_id, cast(date_trunc('month', obs_date) as date) as month, max((nir-red)/nullif(nir+red,0)) as ndvi from f_series group by 1,2) select s.pixel_id, s.obs_date, round(coalesce(case when m.ndvi is not null then greatest(-0.2, least(1.0, m.ndvi)) end, 0.0),6) as prior from f_series s left join m on m.pixel_id = s.pixel_id and m.month = cast(date_trunc('month', s.obs_date) - interval 1 month as date)")
def t04s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with stored composites (here, the best value of each month), joined by the month before."""
    rows = fixtures.series(spark, sf_dir)
    monthly = rows.groupBy("pixel_id", F.trunc("obs_date", "MM").alias("month")).agg(F.max(bands.ndvi(red=C("red"), nir=C("nir"))).alias("ndvi"))
    return training.previous_month_source(rows.select("pixel_id", "obs_date"), monthly, "pixel_id").withColumn("prior", r6(C("prior")))


@query("j09_previous_month", "with m as (select distinct pixel_id, cast(date_trunc('month', obs_date) as date) as month from f_series) select a.pixel_id, a.month, b.month is not null as has_previous from m a left join m b on b.pixel_id = a.pixel_id and b.month = cast(a.month - interval 1 month as date)")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.series(spark, sf_dir).select("pixel_id", F.trunc("obs_date", "MM").alias("month")).distinct()
    before = m.select("pixel_id", F.add_months("month", 1).alias("month"), F.lit(True).alias("found"))
    return m.join(before, ["pixel_id", "month"], "left").select("pixel_id", "month", F.coalesce("found", F.lit(False)).alias("has_previous"))


@query("t05_reanalysis_source", "with days as (select cast(unnest(range(timestamp '2024-01-10', timestamp '2024-01-13', interval 1 day)) as date) as obs_date), v as (select pixel_id, obs_date, max(nir) as x from f_obs group by 1,2), l as (select c.pixel_id, d.obs_date, coalesce(x, 0.0) as x from (select distinct pixel_id from f_obs) c cross join days d left join v on v.pixel_id = c.pixel_id and v.obs_date = d.obs_date) select obs_date, round(avg(x),6) as mean, count(*) as n from l group by 1")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.obs(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("x"))
    return training.lookback(rows, "pixel_id", "2024-01-12", 3, "x").groupBy("obs_date").agg(r6(F.avg("x")).alias("mean"), F.count("*").alias("n"))


@query("t06_sparse_lai", "with l as (select pixel_id, obs_date, max(nir) as lai, max(qa) as qc from f_obs where obs_id % 3 = 0 group by 1,2) select d.pixel_id, d.obs_date, round(coalesce(lai, 0.0),6) as lai, cast(case when lai is null or (qc & 1) <> 0 or ((qc >> 4) & 3) <> 0 then 0 else 1 end as double) as weight from (select distinct pixel_id, obs_date from f_obs) d left join l using (pixel_id, obs_date)")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.obs(spark, sf_dir)
    leaf = rows.where(C("obs_id") % 3 == 0).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("lai"), F.max("qa").alias("qc"))
    return training.sparse_leaf_source(rows.select("pixel_id", "obs_date").distinct(), leaf, ["pixel_id", "obs_date"]).withColumn("lai", r6(C("lai")))


@query("t07_land_cover_source", "select c.cell_id, coalesce(e.label, 0) as lc_class from f_cells c left join embeddings e on e.vec_id = c.cell_id")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("cell_id"), C("label").alias("lc_class"))
    return training.land_cover_source(fixtures.cells(spark, sf_dir).select("cell_id"), classes, "cell_id")


@query(
    "t08_sync_sample",
    "select grid_id, obs_date, len(composite) as n, round(list_sum(composite),5) as composite_sum, round(composite[1],6) as first, round(patch[64],6) as last from (select vec_id % 100 as grid_id, cast(date '2024-01-01' + cast(vec_id % 3 as int) as date) as obs_date, first(embedding order by vec_id)::double[] as patch, list(m order by p) as composite from (select vec_id, embedding, p, max(v) over (partition by vec_id % 100, vec_id % 3, p) as m from (select vec_id, embedding, unnest(range(64)) p, cast(unnest(embedding) as double) v from embeddings) qualify vec_id = min(vec_id) over (partition by vec_id % 100, vec_id % 3)) group by 1,2)",
)
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.patch(spark, sf_dir).withColumn("grid_id", C("patch_id") % 100).withColumn("obs_date", F.date_add(F.lit("2024-01-01").cast("date"), (C("patch_id") % 3).cast("int")))
    composites = rows.groupBy("grid_id", "obs_date", "r", "c").agg(F.max("v").alias("v"))
    patches = rows.groupBy("grid_id", "obs_date", "r", "c").agg(F.min_by("v", "patch_id").alias("v"))
    samples = training.synchronous_samples(patches.select("grid_id", "obs_date").distinct(), composites, patches)
    total = F.aggregate("composite", F.lit(0.0), lambda a, v: a + v)
    return samples.select("grid_id", "obs_date", F.size("composite").cast("long").alias("n"), F.round(total, 5).alias("composite_sum"), r6(C("composite")[0]).alias("first"), r6(C("patch")[63]).alias("last"))


@query("t01_available_to_all", "select distinct pixel_id, obs_date from f_obs where variable = 'click' intersect select distinct pixel_id, obs_date from f_obs where variable = 'view'")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import TableSource

    rows = fixtures.obs(spark, sf_dir)
    click, view = (TableSource(rows.where(C("variable") == v), ["pixel_id", "obs_date"]) for v in ("click", "view"))
    return training.available_to_all(click.catalog(), [view, TableSource(rows, None)])


_FRAMES = "select c.cell_id as patch_id, lat as lat0, lon as lon0, 6371007.181*radians(lon)*cos(radians(lat)) as sx, 6371007.181*radians(lat) as sy from f_cells c join embeddings e on e.vec_id = c.cell_id"
_Q = f"(1-{geo.ECC2!r})*(s/(1-{geo.ECC2!r}*s*s) - ln((1-sqrt({geo.ECC2!r})*s)/(1+sqrt({geo.ECC2!r})*s))/(2*sqrt({geo.ECC2!r})))"
_GRID6 = "(select unnest(range(36)) as k)"


def _sampled(points: str, method: str) -> str:
    """SQL: points (patch_id, r, c, lat, lon, fr, fc) with the value of f_patch, null below -0.12, at (fr, fc)."""
    value = "(select patch_id, r, c, case when v >= -0.12 then v end as v from f_patch)"
    if method == "nearest":
        return f"{points} select p.patch_id, p.r, p.c, round(v, 6) as v from p left join {value} t on t.patch_id = p.patch_id and t.r = floor(fr + 0.5) and t.c = floor(fc + 0.5)"
    return f"""{points}, q as (select *, least(floor(fr), 6) as r0, least(floor(fc), 6) as c0 from p where fr between 0 and 7 and fc between 0 and 7),
 s as (select q.patch_id, q.r, q.c, case when count(t.v) = 4 then sum((case when t.r = r0 then 1 - (fr - r0) else fr - r0 end) * (case when t.c = c0 then 1 - (fc - c0) else fc - c0 end) * t.v) end as v from q join {value} t on t.patch_id = q.patch_id and t.r in (r0, r0 + 1) and t.c in (c0, c0 + 1) group by 1,2,3)
 select p.patch_id, p.r, p.c, round(s.v, 6) as v from p left join s using (patch_id, r, c)"""


_R = 6371007.181
_TO_SINUSOIDAL = f"(sy + 4000.0 - {_R}*radians(lat)) / 1000.0 - 0.5 as fr, ({_R}*radians(lon)*cos(radians(lat)) - (sx - 4000.0)) / 1000.0 - 0.5 as fc"
_BETA = " + ".join(["b", *(f"{k!r}*sin({n}*b)" for k, n in zip(geo.CEA_SERIES, (2, 4, 6), strict=True))])
_EQUAL_AREA = f"""with f as (select *, sin(radians(lat0)) as s from ({_FRAMES})), g as (select *, {geo.AXIS * geo.CEA_SCALE!r}*radians(lon0) - 3000.0 + (k % 6 + 0.5) * 1000.0 as x, {geo.AXIS / 2 / geo.CEA_SCALE!r}*({_Q}) + 3000.0 - (k // 6 + 0.5) * 1000.0 as y, cast(k // 6 as int) as r, cast(k % 6 as int) as c from f cross join {_GRID6}),
 h as (select *, asin(2*y*{geo.CEA_SCALE!r}/{geo.AXIS * geo.CEA_POLE!r}) as b, degrees(x/{geo.AXIS * geo.CEA_SCALE!r}) as lon from g), i as (select *, degrees({_BETA}) as lat from h), p as (select patch_id, r, c, lat, lon, {_TO_SINUSOIDAL} from i)"""
_AZIMUTHAL = f"""with f as ({_FRAMES}), g as (select *, (k % 6 - 3 + 0.5) * 1000.0 as x, (3 - k // 6 - 0.5) * 1000.0 as y, cast(k // 6 as int) as r, cast(k % 6 as int) as c from f cross join {_GRID6}),
 i as ({on_ellipsoid("select * from g", "patch_id, r, c, sx, sy")}), p as (select patch_id, r, c, lat, lon, {_TO_SINUSOIDAL} from i)"""
_sines = lambda at, factors, by="", f="sin": " + ".join(f"({k!r})*{f}({2 * j}*{at})" + (f"*{by[0]}({2 * j}*{by[1]})" if by else "") for j, k in enumerate(factors, 1))
_UTM_XY = f"""select *, 500000 + {geo.UTM_RADIUS!r}*(eta + {_sines("xi", geo.KRUEGER, ("sinh", "eta"), "cos")}) as x, south + {geo.UTM_RADIUS!r}*(xi + {_sines("xi", geo.KRUEGER, ("cosh", "eta"))}) as y
 from (select *, atan2(t, cos(turn)) as xi, asinh(sin(turn)/sqrt(t*t + cos(turn)*cos(turn))) as eta from (select *, sinh(atanh(s) - {geo._ECC!r}*atanh({geo._ECC!r}*s)) as t from (select *, sin(radians(lat)) as s, radians(lon - middle) as turn from"""
_UTM_END = ")))"
_UTM = f"""with z as (select *, cast(trunc((lon0 + 180) / 6) as int) * 6 - 177.0::double as middle, case when lat0 >= 0 then 0.0 else 10000000.0 end::double as south from ({_FRAMES})),
 corner as (select patch_id, which, x, y from ({_UTM_XY} (select patch_id, middle, south, k as which, lat0 + (k - 1) * 0.02 as lat, lon0 + (k - 1) * 0.02 as lon from z cross join (select unnest([0, 1, 2]) as k)) {_UTM_END})),
 f as (select z.*, a.x0, a.y0, b.x1, b.y1, m.mx - 3000.0 as west, m.my + 3000.0 as north from z join (select patch_id, x as x0, y as y0 from corner where which = 0) a using (patch_id) join (select patch_id, x as x1, y as y1 from corner where which = 2) b using (patch_id) join (select patch_id, x as mx, y as my from corner where which = 1) m using (patch_id)),
 g as (select *, cast(k // 6 as int) as r, cast(k % 6 as int) as c, west + (k % 6 + 0.5) * 1000.0 as x, north - (k // 6 + 0.5) * 1000.0 as y from f cross join {_GRID6}), h as (select *, (y - south)/{geo.UTM_RADIUS!r} as n, (x - 500000)/{geo.UTM_RADIUS!r} as e from g),
 i as (select *, n - ({_sines("n", geo.KRUEGER_INVERSE, ("cosh", "e"))}) as xi, e - ({_sines("n", geo.KRUEGER_INVERSE, ("sinh", "e"), "cos")}) as eta from h), j as (select *, asin(sin(xi)/cosh(eta)) as chi from i),
 l as (select *, degrees(chi + {_sines("chi", geo.CONFORMAL)}) as lat, middle + degrees(atan2(sinh(eta), cos(xi))) as lon, x between x0 - 500 and x1 + 500 and y between y0 - 500 and y1 + 500 as inside from j),
 o as (select *, max(case when inside then r end) over w > min(case when inside then r end) over w and max(case when inside then c end) over w > min(case when inside then c end) over w as clips from l window w as (partition by patch_id)),
 p as (select patch_id, r, c, lat, lon, {_TO_SINUSOIDAL} from o where inside or not coalesce(clips, false))"""
_FROM_EQUAL_AREA = f"""with f as (select *, sin(radians(lat0)) as s from ({_FRAMES})), e as (select *, {geo.AXIS * geo.CEA_SCALE!r}*radians(lon0) - 4000.0 as ex, {geo.AXIS / 2 / geo.CEA_SCALE!r}*({_Q}) + 4000.0 as ey from f),
 g as (select patch_id, ex, ey, cast(k // 6 as int) as r, cast(k % 6 as int) as c, lon0 - 0.03 + (k % 6 + 0.5) * 0.01 as lon, lat0 + 0.03 - (k // 6 + 0.5) * 0.01 as lat from e cross join {_GRID6}), h as (select *, sin(radians(lat)) as s from g),
 p as (select patch_id, r, c, lat, lon, (ey - {geo.AXIS / 2 / geo.CEA_SCALE!r}*({_Q})) / 1000.0 - 0.5 as fr, ({geo.AXIS * geo.CEA_SCALE!r}*radians(lon) - ex) / 1000.0 - 0.5 as fc from h)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"))
    rows = fixtures.cells(spark, sf_dir).select(C("cell_id").alias("patch_id"), C("lat").alias("lat0"), C("lon").alias("lon0")).join(ids.hint("merge"), "patch_id", "left_semi")
    x, y = geo.sinusoidal(C("lat0"), C("lon0"))
    ex, ey = geo.equal_area(C("lat0"), C("lon0"))
    return rows.withColumns({"source_west": x - 4000.0, "source_north": y + 4000.0, "west": ex - 3000.0, "north": ey + 3000.0})


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.patch(spark, sf_dir).withColumn("v", F.when(C("v") >= -0.12, C("v")))


def _rounded(pixels: DataFrame) -> DataFrame:
    return pixels.select("patch_id", "r", "c", r6(C("v")).alias("v"))


@query("g14_reproject_nearest", _sampled(_EQUAL_AREA, "nearest"))
def g14n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinusoidal patches on the global equal-area grid."""
    return _rounded(resample.reprojected(_valid(spark, sf_dir), _frames(spark, sf_dir), ["patch_id"], "sinusoidal", "equal_area", (6, 6), 1000.0, (8, 8), 1000.0, "nearest"))


@query("g14_reproject_clip", f"select patch_id, r, c, v from ({_sampled(_EQUAL_AREA, 'bilinear')}) join (select patch_id, r, c, lat, lon, count(distinct case when ok then r end) over w as nr, count(distinct case when ok then c end) over w as nc, ok from (select *, lon between -60 and 60 and lat between 0 and 60 as ok from ({_EQUAL_AREA} select * from p)) window w as (partition by patch_id)) using (patch_id, r, c) where ok or nr <= 1 or nc <= 1")
def g14c(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.reprojected(_valid(spark, sf_dir), _frames(spark, sf_dir), ["patch_id"], "sinusoidal", "equal_area", (6, 6), 1000.0, (8, 8), 1000.0)
    return _rounded(resample.clipped(out, ["patch_id"], (-60.0, 0.0, 60.0, 60.0)))


@query("g14_reproject_utm", _sampled(_UTM, "bilinear"))
def g14u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinusoidal patches on the grid of the UTM zone of their cell, clipped to the cell's box, which is projected first."""
    frames = _frames(spark, sf_dir).drop("west", "north").withColumn("epsg", geo.utm_epsg(C("lat0"), C("lon0")))
    frames = geo.projected(frames, "utm", C("lat0"), C("lon0")).withColumns({"west": C("x") - 3000.0, "north": C("y") + 3000.0}).drop("x", "y")
    frames = frames.withColumns({"lon_min": C("lon0") - 0.02, "lat_min": C("lat0") - 0.02, "lon_max": C("lon0") + 0.02, "lat_max": C("lat0") + 0.02})
    out = resample.reprojected(_valid(spark, sf_dir), frames, ["patch_id"], "sinusoidal", "utm", (6, 6), 1000.0, (8, 8), 1000.0)
    return _rounded(resample.clipped_to_boxes(out, frames, ["patch_id"], "utm", 1000.0))


@query("g15_regrid", _sampled(_FROM_EQUAL_AREA, "bilinear"))
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-area patches on a grid of degrees; null where a neighbour is."""
    frames = _frames(spark, sf_dir).select("patch_id", (C("west") - 1000.0).alias("source_west"), (C("north") + 1000.0).alias("source_north"), (C("lon0") - 0.03).alias("west"), (C("lat0") + 0.03).alias("north"))
    return _rounded(resample.reprojected(_valid(spark, sf_dir), frames, ["patch_id"], "equal_area", "degrees", (6, 6), 0.01, (8, 8), 1000.0))


@query("g19_reproject_patch", _sampled(_AZIMUTHAL, "bilinear"))
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinusoidal patches on the azimuthal grid around their cell, of a strict shape."""
    frames = _frames(spark, sf_dir).drop("west", "north").withColumns({"west": F.lit(-3000.0), "north": F.lit(3000.0)})
    out = resample.reprojected(_valid(spark, sf_dir), frames, ["patch_id"], "sinusoidal", "azimuthal", (6, 6), 1000.0, (8, 8), 1000.0)
    return _rounded(resample.of_shape(out, ["patch_id"], 6, 6))
