"""Features, smoothing and cloud detection along time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import bands, calendar
from ..operators import aggregate, smooth, temporal
from .registry import query, r6

C = F.col

_Y = "(select pixel_id, obs_date, day_no, doy, (nir-red)/nullif(nir+red,0) as y, case when cast(day_no as bigint) % 4 = 0 then 0.0 else 1.0 end as weight from f_series)"
_Z = f"(select *, avg(y) over (partition by pixel_id order by day_no range between 10 preceding and 10 following) as z from {_Y})"
_S = f"(select *, case when y is null or z is null or y < z then 1 else 0 end as s from {_Z})"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, its centred mean z as a stand-in for an envelope, and a weight."""
    rows = fixtures.series(spark, sf_dir).withColumn("y", bands.ndvi(red=C("red"), nir=C("nir"))).withColumn("weight", F.when(C("day_no").cast("long") % 4 == 0, 0.0).otherwise(1.0))
    return rows.withColumn("z", temporal.within("avg(y)", 10.0))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("s", temporal.suppressed(C("y"), C("z")))


@query("w01_suppressed", f"select pixel_id, obs_date, s from {_S}")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("pixel_id", "obs_date", "s")


_RUN = f"(select *, case when s = 1 then cast(sum(s) over (partition by pixel_id, island) as bigint) else 0 end as run_length from (select *, sum(1-s) over (partition by pixel_id order by day_no rows unbounded preceding) as island from {_S}))"


@query("w02_run_length", f"select pixel_id, obs_date, run_length from {_RUN}")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.run_lengths(flagged(spark, sf_dir)).select("pixel_id", "obs_date", "run_length")


@query("w03_fraction", f"select pixel_id, obs_date, round(avg(s) over (partition by pixel_id order by day_no range between 10 preceding and 10 following),6) as share from {_S}")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.window_share(flagged(spark, sf_dir)).select("pixel_id", "obs_date", r6(C("share")).alias("share"))


_GAP = f"(select *, day_no - last_value(case when s = 0 then day_no end ignore nulls) over (partition by pixel_id order by day_no rows between unbounded preceding and current row) as gap_back, first_value(case when s = 0 then day_no end ignore nulls) over (partition by pixel_id order by day_no rows between current row and unbounded following) - day_no as gap_forward from {_S})"


@query("w04_gaps", f"select pixel_id, obs_date, gap_back, gap_forward from {_GAP}")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.gaps(flagged(spark, sf_dir)).select("pixel_id", "obs_date", "gap_back", "gap_forward")


@query("p24_gap_mask", f"select pixel_id, obs_date, case when coalesce(gap_forward, 1e18) >= 3 and coalesce(gap_back, 1e18) >= 3 then 0 else 1 end as mask from {_GAP}")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.gaps(flagged(spark, sf_dir)).select("pixel_id", "obs_date", bands.gap_mask(C("gap_forward"), C("gap_back"), 3.0).alias("mask"))


_SLOPE = "coalesce(case when count(z) over w >= 2 then regr_slope(z, day_no) over w end, 0.0)"


@query("w05_slope", f"select pixel_id, obs_date, round({_SLOPE},6) as slope from {_Z} window w as (partition by pixel_id order by day_no range between 2.5 preceding and 2.5 following)")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.slopes(series(spark, sf_dir)).select("pixel_id", "obs_date", r6(C("slope")).alias("slope"))


@query(
    "w06_high_risk",
    f"""with a as (select *, round({_SLOPE},9) as slope from {_RUN} window w as (partition by pixel_id order by day_no range between 2.5 preceding and 2.5 following)),
 b as (select *, quantile_cont(case when slope > 0 then slope end, 0.9) over (partition by pixel_id) as up, quantile_cont(case when slope < 0 then slope end, 0.1) over (partition by pixel_id) as down from a)
 select pixel_id, obs_date, run_length > 4 and (coalesce(slope > up, false) or coalesce(slope < down, false)) as high_risk from b""",
)
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.run_lengths(temporal.slopes(flagged(spark, sf_dir)).withColumn("slope", F.round("slope", 9)))
    return temporal.high_risk(rows).select("pixel_id", "obs_date", "high_risk")


@query("w07_sequences", "select pixel_id, obs_date, a, b, c from (select pixel_id, obs_date, n_obs as a, lead(n_obs) over w as b, lead(n_obs, 2) over w as c, count(*) over (partition by pixel_id order by day_no rows between current row and 2 following) as k from f_series window w as (partition by pixel_id order by day_no)) where k = 3")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.series(spark, sf_dir)
    out = temporal.sequences(rows, 3, "n_obs").join(rows.select("pixel_id", "day_no", "obs_date"), ["pixel_id", "day_no"])
    return out.select("pixel_id", "obs_date", C("steps")[0].alias("a"), C("steps")[1].alias("b"), C("steps")[2].alias("c"))


_DETECT = f"""(with m as (select *, cast(least(floor((doy-1)/30), 11) + 1 as int) as month, y - z as r from {_Z}), u as (select *, case when r > 0 and r <= 0.1 then r end as pos from m),
 s as (select *, case when count(pos) over k > 1 then stddev_pop(pos) over k else 0.001 end * 1.2533141373155001 as sigma, (sum(case when weight > 0.5 then 1 else 0 end) over k < 3) or (sum(weight) over (partition by pixel_id) = 0) as uncertain from u window k as (partition by pixel_id, month))
 select *, not uncertain and coalesce((r < -2.0 * sigma and abs(r) >= 0.02) or r < -0.1, false) as cloud from s)"""


@query("w08_detect", f"select pixel_id, obs_date, month, round(sigma,6) as sigma, uncertain, cloud from {_DETECT}")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.detected(series(spark, sf_dir))
    return out.select("pixel_id", "obs_date", "month", r6(C("sigma")).alias("sigma"), "uncertain", "cloud")


@query("w13_soft", f"select pixel_id, obs_date, case when cloud then 0.0 when uncertain or cast(day_no as bigint) % 7 = 0 then 0.5 else 1.0 end::double as soft, cast(day_no as int) as day from {_DETECT}")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.detected(series(spark, sf_dir))
    mask = F.when(C("day_no").cast("long") % 7 != 0, 1)
    return out.select("pixel_id", "obs_date", temporal.soft_labels(C("cloud"), C("uncertain"), mask).alias("soft"), calendar.day_number(C("obs_date")).alias("day"))


@query("w13_assembled", f"select pixel_id // 100 as patch_id, 9 - cast(pixel_id % 100 // 10 as int) as y, cast(pixel_id % 10 as int) as x, obs_date, cast(day_no as int) as day_no, case when cloud then 0.0 when uncertain or cast(day_no as bigint) % 7 = 0 then 0.5 else 1.0 end::double as soft from {_DETECT}")
def w13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft labels of patches of 10 x 10 pixels, from the bottom row up."""
    k, out = C("pixel_id"), temporal.detected(series(spark, sf_dir))
    mask = F.when(C("day_no").cast("long") % 7 != 0, 1)
    soft = out.select(F.floor(k / 100).alias("patch_id"), F.floor(k % 100 / 10).cast("int").alias("r"), (k % 10).cast("int").alias("c"), "obs_date", temporal.soft_labels(C("cloud"), C("uncertain"), mask).alias("soft"))
    return temporal.assembled(soft).select("patch_id", "y", "x", "obs_date", "day_no", "soft")


@query("w09_class_factor", "select vec_id as patch_id, label as lc_class, cast(case label when 1 then 2.5 when 2 then 1.8 when 5 then 3.0 else 2.0 end as double) as k from embeddings")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"), C("label").alias("lc_class"))
    return rows.withColumn("k", temporal.class_factor(C("lc_class"), {5: 3.0}))


@query("a07_sigma", f"with u as (select pixel_id, cast(least(floor((doy-1)/30), 11) + 1 as int) as month, case when y-z > 0 and y-z <= 0.1 then y-z end as pos from {_Z}) select pixel_id, month, round(case when count(pos) > 1 then stddev_pop(pos) else 0.001 end * 1.2533141373155001,6) as sigma, count(pos) as n from u group by 1,2")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("residual", C("y") - C("z"))
    return aggregate.month_noise(rows).withColumn("sigma", r6(C("sigma")))


@query("a08_uncertain", "select pixel_id, cast(least(floor((doy-1)/30), 11) + 1 as int) as month, sum(case when cast(day_no as bigint) % 4 = 0 then 0 else 1 end) < 40 as uncertain from f_series group by 1,2")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.series(spark, sf_dir).withColumn("clear", (C("day_no").cast("long") % 4 != 0).cast("int"))
    return rows.groupBy("pixel_id", calendar.thirty_day_month(C("doy")).alias("month")).agg((F.sum("clear") < 40).alias("uncertain"))


@query("a10_signed_quantiles", f"select pixel_id, round(quantile_cont(case when y-z > 0 then y-z end, 0.9),6) as up, round(quantile_cont(case when y-z < 0 then y-z end, 0.1),6) as down from {_Z} group by 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C("y") - C("z")
    return series(spark, sf_dir).groupBy("pixel_id").agg(r6(F.percentile(F.when(d > 0, d), F.lit(0.9))).alias("up"), r6(F.percentile(F.when(d < 0, d), F.lit(0.1))).alias("down"))


@query("a11_longest_run", f"select pixel_id, max(run_length) as longest from {_RUN} group by 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.run_lengths(flagged(spark, sf_dir)).groupBy("pixel_id").agg(F.max("run_length").alias("longest"))


@query("w11_stack", "with d as (select distinct obs_date from f_series ), p as (select distinct pixel_id from f_series), v as (select pixel_id, obs_date, (nir-red)/nullif(nir+red,0) as y, n_obs % 2 = 0 as cloudy from f_series) select p.pixel_id, d.obs_date, round(y,6) as y, cast(case when y is not null and not coalesce(cloudy, false) then 1 else 0 end as double) as weight, round(case when y is not null and not coalesce(cloudy, false) then y end,6) as masked from p cross join d left join v on v.pixel_id = p.pixel_id and v.obs_date = d.obs_date")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.series(spark, sf_dir).select("pixel_id", "obs_date", bands.ndvi(red=C("red"), nir=C("nir")).alias("y"), (C("n_obs") % 2 == 0).alias("cloudy"))
    spine = rows.select("obs_date").distinct()
    out = temporal.stack(rows, spine, C("cloudy"))
    return out.select("pixel_id", "obs_date", r6(C("y")).alias("y"), "weight", r6(C("masked")).alias("masked"))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.whittaker(series(spark, sf_dir).drop("z"))


@query("w10_whittaker")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(spark, sf_dir).select("pixel_id", "obs_date", r6(C("z")).alias("z"))


@query("w12_smooth_and_detect")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.detected(smoothed(spark, sf_dir)).select("pixel_id", "obs_date", r6(C("z")).alias("z"), "cloud", "uncertain")


_NUMBERED = f"n as materialized (select pixel_id, day_no, y, cast(case when y is null then 0.0 else weight end as double) as w, row_number() over (partition by pixel_id order by day_no) as i, count(*) over (partition by pixel_id) as m, bool_or(y is not null and weight > 0) over (partition by pixel_id) as some from {_Z})"
_MAIN, _ONE = "(case when n.i in (1, n.m) then 1 when n.m = 3 then 4 when n.i in (2, n.m - 1) then 5 else 6 end)", "(case when n.i = n.m then 0 when n.i in (1, n.m - 1) then -2 else -4 end)"
#: The pentadiagonal elimination at a penalty of 100, one step of all series in each round of the recursion, then back.
_FIXED = f"""with recursive {_NUMBERED},
 f(pixel_id, i, d, e, g, u, d1, e1, g1, u1) as (
  select pixel_id, i, a, 100.0 * {_ONE} / a, 100.0 / a, w * coalesce(y, 0.0), 0.0::double, 0.0::double, 0.0::double, 0.0::double from (select *, w + 100.0 * {_MAIN} as a from n where i = 1) n
  union all
  select pixel_id, i, a, b / a, case when i < m - 1 then 100.0 / a else 0.0 end, r, d1, e1, g1, u1 from (
   select n.pixel_id, n.i, n.m, n.w + 100.0 * {_MAIN} - f.d * f.e * f.e - f.d1 * f.g1 * f.g1 as a, 100.0 * {_ONE} - f.d * f.e * f.g as b, n.w * coalesce(n.y, 0.0) - f.e * f.u - f.g1 * f.u1 as r, f.d as d1, f.e as e1, f.g as g1, f.u as u1 from f join n on n.pixel_id = f.pixel_id and n.i = f.i + 1)),
 z(pixel_id, i, z, z1) as (
  select f.pixel_id, f.i, f.u / f.d, 0.0::double from f join n using (pixel_id, i) where i = m
  union all
  select f.pixel_id, f.i, f.u / f.d - f.e * z.z - f.g * z.z1, z.z from z join f on f.pixel_id = z.pixel_id and f.i = z.i - 1)
 select n.pixel_id, n.day_no, case when n.some then round(greatest(-1.0, least(1.0, z.z)), 6) end as z from n join z using (pixel_id, i)"""


@query("w10_fixed_penalty", _FIXED)
def w10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.whittaker(series(spark, sf_dir).drop("z"), (2.0,), None).select("pixel_id", "day_no", r6(C("z")).alias("z"))


@query("w10_symmetric")
def w10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic smoother: both sides alike, at the penalty that the V-curve finds between 0.1 and 60,000."""
    return smooth.smoothed_series(series(spark, sf_dir).select("pixel_id", "day_no", "y")).select("pixel_id", "day_no", r6(C("z")).alias("z"))


