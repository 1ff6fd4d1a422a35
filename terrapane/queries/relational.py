"""Catalogs, joins, incremental state and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import bands, bits, names
from ..operators import aggregate, grid, store, temporal
from .registry import query, r6

C = F.col


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.obs(spark, sf_dir)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = names.granule_tile(C("fname"))
    return fixtures.granules(spark, sf_dir).select("obs_id", "fname", names.granule_date(C("fname")).alias("obs_date"), h.alias("h"), v.alias("v"))


_CATALOG = "(select obs_id, fname, cast(strptime(regexp_extract(fname, '\\.A(\\d{7})\\.', 1), '%Y%j') as date) as obs_date, cast(regexp_extract(fname, '\\.h(\\d{2})v', 1) as int) as h, cast(regexp_extract(fname, 'v(\\d{2})\\.', 1) as int) as v from f_granules)"


@query("s01_granule_search", f"select obs_id, fname from {_CATALOG} where obs_date between date '2024-01-05' and date '2024-01-15' and contains(fname, '.061.') and obs_date not in (date '2024-01-07', date '2024-01-09')")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.sql("select explode(array(date'2024-01-07', date'2024-01-09')) as obs_date")
    found = catalog(spark, sf_dir).where(C("obs_date").between("2024-01-05", "2024-01-15") & C("fname").contains(".061."))
    return found.join(done, "obs_date", "left_anti").select("obs_id", "fname")


@query("s08_swath_pairs", "select v.pixel_id, v.obs_date, v.n_values, g.production from (select pixel_id, obs_date, count(*) as n_values from f_obs where variable <> (select min(variable) from f_obs) group by 1,2) v join (select pixel_id, obs_date, max(obs_id) as production from f_obs where variable = (select min(variable) from f_obs) group by 1,2) g using (pixel_id, obs_date)")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    first = rows.agg(F.min("variable").alias("first"))
    marked = rows.crossJoin(F.broadcast(first)).withColumn("geo", C("variable") == C("first"))
    values = marked.where("not geo").groupBy("pixel_id", "obs_date").agg(F.count("*").alias("n_values"))
    newest = marked.where("geo").groupBy("pixel_id", "obs_date").agg(F.max_by("obs_id", "obs_id").alias("production"))
    return values.join(newest, ["pixel_id", "obs_date"])


@query("s09_store_listing", "with p as (select distinct variable, obs_date, cast(pixel_id as varchar) as grid_id from f_obs), f as (select variable, min(obs_date) as obs_date from p group by 1), n as (select p.*, cast(row_number() over (partition by variable order by grid_id) as int) as n from p join f using (variable, obs_date)) select variable, obs_date, grid_id, n from n where n <= 5")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_dates_and_cells(obs(spark, sf_dir).withColumn("grid_id", C("pixel_id").cast("string")), 5)


@query("s10_band_roles", "select variable, role, count(*) as n from f_obs join (values ('click','red'),('view','nir'),('purchase','blue')) as t(variable, role) using (variable) group by 1,2")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([("click", "red"), ("view", "nir"), ("purchase", "blue")], "variable string, role string")
    return obs(spark, sf_dir).join(F.broadcast(roles), "variable").groupBy("variable", "role").agg(F.count("*").alias("n"))


@query("s11_single_image", "with k as (select *, dense_rank() over (order by obs_date) as t, dense_rank() over (order by pixel_id) as g from f_obs) select obs_id, round(red,6) as red, round(nir,6) as nir, round((nir-red)/nullif(nir+red,0),6) as ndvi from k where t = 3 and g = 7")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    nth = lambda c, n: rows.select(c).distinct().orderBy(c).offset(n - 1).limit(1)
    one = rows.join(F.broadcast(nth("obs_date", 3)), "obs_date").join(F.broadcast(nth("pixel_id", 7)), "pixel_id")
    return one.select("obs_id", r6(C("red")).alias("red"), r6(C("nir")).alias("nir"), r6(bands.ndvi(red=C("red"), nir=C("nir"))).alias("ndvi"))


@query("s12_lookback", "with cells as (select distinct pixel_id from f_obs), days as (select cast(unnest(range(timestamp '2024-01-06', timestamp '2024-01-13', interval 1 day)) as date) as obs_date), v as (select pixel_id, obs_date, max(nir) as x from f_obs group by 1,2) select c.pixel_id, d.obs_date, round(coalesce(x, 0.0), 6) as x from cells c cross join days d left join v on v.pixel_id = c.pixel_id and v.obs_date = d.obs_date")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.training import lookback

    rows = obs(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("x"))
    return lookback(rows, "pixel_id", "2024-01-12", 7, "x").withColumn("x", r6(C("x")))


@query("s17_new_granules", f"select obs_id, fname from {_CATALOG} where obs_id % 3 <> 0")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return rows.join(rows.where(C("obs_id") % 3 == 0).select("fname"), "fname", "left_anti").select("obs_id", "fname")


@query("j01_granules_to_cells", f"with c as (select cell_id, cast(floor((6371007.181*radians(lon)*cos(radians(lat)) + 20015109)/1111950) as int) as h, cast(floor((10007555 - 6371007.181*radians(lat))/1111950) as int) as v from f_cells) select g.h, g.v, count(*) as n from {_CATALOG} g join c on c.h = g.h and c.v = g.v group by 1,2")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pairs_by_tile(catalog(spark, sf_dir), grid.with_tiles(fixtures.cells(spark, sf_dir)))


_DAYS = "(select distinct pixel_id, obs_date from f_obs where variable = '{}')"


def _available(spark: SparkSession, sf_dir: str, variable: str) -> DataFrame:
    return obs(spark, sf_dir).where(C("variable") == variable).select("pixel_id", "obs_date").distinct()


@query("j02_availability", " intersect ".join(f"select * from {_DAYS.format(v)}" for v in ("click", "view", "purchase")))
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("click", "view", "purchase")
    rows = obs(spark, sf_dir).where(C("variable").isin(*wanted)).groupBy("pixel_id", "obs_date").agg(F.count_distinct("variable").alias("n"))
    return rows.where(C("n") == len(wanted)).select("pixel_id", "obs_date")


@query("j03_sync_pairs", f"select * from (select * from {_DAYS.format('click')} union select * from {_DAYS.format('view')}) a join {_DAYS.format('purchase')} b using (pixel_id, obs_date)")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lambda *kinds: F.bool_or(C("variable").isin(*kinds))
    rows = obs(spark, sf_dir).where(C("variable").isin("click", "view", "purchase")).groupBy("pixel_id", "obs_date").agg(seen("click", "view").alias("either"), seen("purchase").alias("other"))
    return rows.where("either and other").select("pixel_id", "obs_date")


@query("j04_band_times", "select a.pixel_id, cast(a.ts as date) as obs_date, count(*) as n from f_obs a join f_obs b on a.pixel_id = b.pixel_id and date_trunc('hour', a.ts) = date_trunc('hour', b.ts) where a.variable = 'click' and b.variable = 'view' group by 1,2")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = obs(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    a, b = (hour.where(C("variable") == v).select("pixel_id", "hour", "obs_date") for v in ("click", "view"))
    return a.join(b.drop("obs_date"), ["pixel_id", "hour"]).groupBy("pixel_id", "obs_date").agg(F.count("*").alias("n"))


@query("j05_sparse_zero_fill", "select b.pixel_id, b.obs_date, round(coalesce(s.nir, 0.0), 6) as nir, s.nir is not null as present from (select distinct pixel_id, obs_date from f_obs) b left join (select pixel_id, obs_date, max(nir) as nir from f_obs where obs_id % 4 = 0 group by 1,2) s using (pixel_id, obs_date)")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    some = rows.where(C("obs_id") % 4 == 0).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("nir"))
    return rows.select("pixel_id", "obs_date").distinct().join(some, ["pixel_id", "obs_date"], "left").select("pixel_id", "obs_date", r6(F.coalesce("nir", F.lit(0.0))).alias("nir"), C("nir").isNotNull().alias("present"))


_BOXES = "(select i * 12 + j as box_id, -180 + j * 30.0::double as lon_min, -80 + i * 20.0::double as lat_min, -180 + j * 30.0::double + 30 as lon_max, -80 + i * 20.0::double + 20 as lat_max from (select unnest(range(8)) as i) cross join (select unnest(range(12)) as j))"


def _boxes(spark: SparkSession) -> DataFrame:
    return grid.fixed_boxes(spark, (-80.0, 80.0), (-180.0, 180.0), 8, 12)


@query("j06_points_in_boxes", f"select cell_id, box_id from f_cells join {_BOXES} b on lat between lat_min and lat_max and lon between lon_min and lon_max")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.points_in_boxes(fixtures.cells(spark, sf_dir), _boxes(spark)).select("cell_id", "box_id")


@query("j07_unprocessed", "select * from (select distinct pixel_id, obs_date from f_obs) except select distinct pixel_id, obs_date from f_obs where obs_id % 2 = 0")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    keys = rows.select("pixel_id", "obs_date").distinct()
    return keys.join(rows.where(C("obs_id") % 2 == 0).select("pixel_id", "obs_date"), ["pixel_id", "obs_date"], "left_anti")


@query("j10_union_dates", f"select * from {_DAYS.format('click')} union select * from {_DAYS.format('view')}")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, sf_dir, "click").unionByName(_available(spark, sf_dir, "view")).distinct()


@query("j11_date_spine", "with d as (select cast(unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as date) as obs_date), p as (select distinct pixel_id from f_obs), v as (select pixel_id, obs_date, max(nir) as y from f_obs group by 1,2) select p.pixel_id, d.obs_date, round(y, 6) as y, cast(case when y is null then 0 else 1 end as double) as weight from p cross join d left join v on v.pixel_id = p.pixel_id and v.obs_date = d.obs_date")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import date

    rows = obs(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("y"))
    return temporal.stack(rows, store.calendar(spark, date(2024, 1, 1), date(2024, 1, 30)), None).select("pixel_id", "obs_date", r6(C("y")).alias("y"), "weight")


@query("j12_no_constraint", "select distinct pixel_id, obs_date from f_obs")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.training import constrained

    keys = obs(spark, sf_dir).select("pixel_id", "obs_date").distinct()
    return constrained(keys, None)


@query("k02_upsert", "with c as (select pixel_id, obs_date, max(red) as v from f_obs where obs_id % 2 = 0 group by 1,2), u as (select pixel_id, obs_date, max(nir) as v from f_obs where obs_id % 3 = 0 group by 1,2) select pixel_id, obs_date, round(coalesce(u.v, c.v), 6) as v from c full join u using (pixel_id, obs_date)")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    current = rows.where(C("obs_id") % 2 == 0).groupBy("pixel_id", "obs_date").agg(F.max("red").alias("v"))
    update = rows.where(C("obs_id") % 3 == 0).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("v"))
    return store.upsert(current, update, ["pixel_id", "obs_date"]).withColumn("v", r6(C("v")))


@query("k02_keep_latest", "select pixel_id, obs_date, obs_id, round(nir,6) as nir from (select *, row_number() over (partition by pixel_id, obs_date order by ts desc, obs_id desc) as n from f_obs) where n = 1")
def k02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).select("pixel_id", "obs_date", "ts", "obs_id", "nir")
    return store.keep_latest(rows, ["pixel_id", "obs_date"], ["ts", "obs_id"]).select("pixel_id", "obs_date", "obs_id", r6(C("nir")).alias("nir"))


@query("k03_family_types", "select obs_id, cast(qa % 256 as int) as quality, cast(nir as float) as reflectance from f_obs where variable in ('click', 'view')")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([("click",), ("view",)], "variable string")
    return obs(spark, sf_dir).join(F.broadcast(families), "variable", "left_semi").select("obs_id", (C("qa") % 256).alias("quality"), C("nir").cast("float").alias("reflectance"))


@query("k05_processed_index", "select distinct pixel_id, obs_date from f_obs where obs_id % 2 = 0 or obs_id % 5 = 0")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..workdir import work_path

    path = work_path(spark, "index")
    for m in (2, 5):  # two runs whose days overlap
        store.merge_index(obs(spark, sf_dir).where(C("obs_id") % m == 0).select("pixel_id", "obs_date"), path)
    return store.read_index(spark, path, "pixel_id long, obs_date date")


@query("k06_processed_dates", "select variable, obs_date from f_obs where nir is not null group by 1,2 having count(*) > 0")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).groupBy("variable", "obs_date").agg(F.count("nir").alias("n")).where("n > 0").select("variable", "obs_date")


@query("k07_all_variables", "select pixel_id, obs_date from f_obs where variable in ('click','view','purchase') group by 1, 2 having count(distinct variable) = 3")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.complete_dates(obs(spark, sf_dir), ["click", "view", "purchase"], ["pixel_id", "obs_date"])


@query("k08_remaining_files", f"select obs_id, h, v from {_CATALOG} where obs_id % 4 <> 0")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    return rows.join(rows.where(C("obs_id") % 4 == 0).select("fname"), "fname", "left_anti").select("obs_id", "h", "v").orderBy("h", "v")


_MISSING = "with days as (select cast(unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as date) as obs_date), lack as (select p.pixel_id, d.obs_date from (select distinct pixel_id from f_obs) p cross join days d where not exists (select 1 from f_obs o where o.pixel_id = p.pixel_id and o.obs_date = d.obs_date)), isl as (select *, obs_date - cast(row_number() over (partition by pixel_id order by obs_date) as int) as g from lack), r as (select pixel_id, min(obs_date) as start, max(obs_date) as \"end\", count(*) as n_days from isl group by pixel_id, g)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import date

    rows = obs(spark, sf_dir).select("pixel_id", "obs_date").distinct()
    wanted = rows.select("pixel_id").distinct().crossJoin(store.calendar(spark, date(2024, 1, 1), date(2024, 1, 30)))
    return store.missing_ranges(wanted, rows, ["pixel_id"])


@query("k09_missing_ranges", f"{_MISSING} select pixel_id, start, \"end\", n_days from r")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@query("k10_day_batches", f"{_MISSING} select pixel_id, b as batch_start, cast(least(b + 2, \"end\") as date) as batch_end from (select pixel_id, \"end\", cast(unnest(range(cast(start as timestamp), cast(\"end\" as timestamp) + interval 1 second, interval 3 day)) as date) as b from r)")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.day_batches(_ranges(spark, sf_dir), 3).select("pixel_id", "batch_start", "batch_end")


@query("k12_derived_variables", "select obs_id, 'ndvi' as variable, round((nir-red)/nullif(nir+red,0),6) as value from f_obs union all select obs_id, 'nir', round(nir,6) from f_obs union all select obs_id, 'red', round(red,6) from f_obs")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = obs(spark, sf_dir).select("obs_id", r6(bands.ndvi(red=C("red"), nir=C("nir"))).alias("ndvi"), r6(C("nir")).alias("nir"), r6(C("red")).alias("red"))
    return wide.unpivot("obs_id", ["ndvi", "nir", "red"], "variable", "value")


@query("k13_remaining_cells", "select cell_id from f_cells where cell_id % 4 <> 1")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.cells(spark, sf_dir).select("cell_id")
    return rows.join(rows.where(C("cell_id") % 4 == 1), "cell_id", "left_anti")


_SCORE = "(select cast(pixel_id as varchar) as grid_id, obs_date, case when cloud_level <> 99 then cloud_level / cast(3 as double) end as score from f_obs)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select(C("pixel_id").cast("string").alias("grid_id"), "obs_date", F.when(C("cloud_level") != 99, C("cloud_level") / 3.0).alias("score"))


_FRACTION = f"select grid_id, obs_date, avg(case when score < 0.5 then 1.0 else 0.0 end) as cloud_fraction, cast(row_number() over (partition by grid_id order by obs_date) - 1 as int) as t, cast(month(obs_date) as int) as month from {_SCORE} group by 1,2"


@query("a01_clean_tiles", f"select grid_id, obs_date, round(cloud_fraction,6) as cloud_fraction, t, month from ({_FRACTION}) where cloud_fraction <= 0.3")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.clean_tiles(_scores(spark, sf_dir)).withColumn("cloud_fraction", r6(C("cloud_fraction")))


@query("a02_month_summary", "with f as (select pixel_id, obs_date, cast(month(obs_date) as int) as month, avg(case when red > 0.2 then 1.0 else 0.0 end) as x from f_series group by 1,2) select month, count(*) as total, sum(case when x <= 0.3 then 1 else 0 end)::bigint as passing, sum(case when x <= 0.3 then 0 else 1 end)::bigint as rejected, round(100.0 * sum(case when x <= 0.3 then 0 else 1 end) / count(*), 6) as reject_percent from f group by 1")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.series(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(F.avg((C("red") > 0.2).cast("int")).alias("cloud_fraction"), F.month("obs_date").alias("month"))
    return aggregate.month_summary(rows).withColumn("reject_percent", r6(C("reject_percent")))


@query("a03_max_composite", "select pixel_id, obs_date, variable, round(max(case when red >= -0.05 then red end),6) as red from f_obs group by 1,2,3")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).withColumn("red", bands.valid(C("red")))
    return aggregate.max_composite(rows, ["pixel_id", "obs_date", "variable"], "red").withColumn("red", r6(C("red")))


@query("a04_ndvi_composite", "select pixel_id, obs_date, round(max(case when nir+red > 0.01 then (nir-red)/(nir+red) end),6) as ndvi, count(*) as n_times from f_obs group by 1,2")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).select("pixel_id", "obs_id", "ts", "red", "nir")
    red, nir = (rows.select("pixel_id", "obs_id", "ts", C(b).alias("value")) for b in ("red", "nir"))
    daily = aggregate.ndvi_composite(red, nir, ["pixel_id", "obs_id"])
    return daily.groupBy("pixel_id", "obs_date").agg(r6(F.max("ndvi")).alias("ndvi"), F.sum("n_times").alias("n_times"))


@query("a04_monthly_ndvi", "with n as (select pixel_id, obs_date, max((nir-red)/nullif(nir+red,0)) as ndvi from f_obs group by 1,2) select pixel_id, cast(date_trunc('month', obs_date) as date) as month, round(avg(ndvi),6) as ndvi, count(*) as n_days from n group by 1,2")
def a04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = obs(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(F.max(bands.ndvi(red=C("red"), nir=C("nir"))).alias("ndvi"))
    return daily.groupBy("pixel_id", F.trunc("obs_date", "MM").alias("month")).agg(r6(F.avg("ndvi")).alias("ndvi"), F.count("*").alias("n_days"))


@query("a05_reliability", "with g as (select pixel_id, obs_date, list(coalesce(red, 0.0)) as reds, list(coalesce((nir-red)/nullif(nir+red,0), 0.0)) as indexes from f_obs group by 1,2), e as (select pixel_id, obs_date, unnest(list_concat(reds, list_transform(range(greatest(0, 5 - len(reds))), lambda x: 0.0::double))) as red, unnest(list_concat(indexes, list_transform(range(greatest(0, 5 - len(reds))), lambda x: 0.0::double))) as ndvi from g), a as (select *, median(red) over (partition by pixel_id, obs_date) as mid from e), b as (select *, abs(red-mid) as off from a), c as (select *, median(off) over (partition by pixel_id, obs_date) as mad from b) select pixel_id, obs_date, round(quantile_cont(ndvi, 0.75),6) as ndvi_p75, round(stddev_pop(ndvi),6) as ndvi_std, round(avg(case when off/(mad + 1e-6) > 3 then 1.0 else 0.0 end),6) as flagged from c group by 1,2")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).withColumn("ndvi", bands.ndvi(red=C("red"), nir=C("nir")))
    out = aggregate.reliability(rows, ["pixel_id", "obs_date"], "ndvi", "red")
    return out.select("pixel_id", "obs_date", *[r6(C(c)).alias(c) for c in ("ndvi_p75", "ndvi_std", "flagged")])


@query("a06_null_gate", "select pixel_id, obs_date, round(avg(case when red < -0.05 then 1.0 else 0.0 end),6) as null_share from f_obs group by 1,2 having avg(case when red < -0.05 then 1.0 else 0.0 end) <= 0.1")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).withColumn("red", bands.valid(C("red")))
    return grid.gated(rows, ["pixel_id", "obs_date"], "red", 0.1).withColumn("null_share", r6(C("null_share")))


@query("a09_presence", "with y as (select distinct year from f_presence), f as (select year, country from f_presence where s_res = 'Admin1' group by 1,2) select y.year, " + ", ".join(f"max(case when f.country = '{c}' then 1 else 0 end) as \"{c}\"" for c in ("NATION_1", "NATION_5", "NATION_9", "NATION_12")) + " from y left join f using (year) group by 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.yearly_presence(fixtures.presence(spark, sf_dir), ["NATION_1", "NATION_5", "NATION_9", "NATION_12"], "Admin1")


@query("a12_written_counts", "select obs_date, count(distinct pixel_id) as n from f_obs group by 1")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).groupBy("obs_date").agg(F.count_distinct("pixel_id").alias("n"))


@query("a13_dominant_type", "with n as (select obs_date, variable, count(*) as n, min(obs_id) as first from f_obs group by 1,2) select obs_date, variable, n from (select *, row_number() over (partition by obs_date order by n desc, first) as k from n) where k = 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resample import dominant

    return dominant(obs(spark, sf_dir), ["obs_date"], "variable", "obs_id")


@query("w14_lookback_availability", "select pixel_id, obs_date from (select *, row_number() over (partition by pixel_id order by obs_date) as n from (select distinct pixel_id, obs_date from f_obs)) where n >= 5")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = obs(spark, sf_dir).select("pixel_id", "obs_date").distinct()
    return days.withColumn("n", F.row_number().over(Window.partitionBy("pixel_id").orderBy("obs_date"))).where("n >= 5").drop("n")


@query("p33_patch_load", "select k.pixel_id, k.obs_date, round(v.red,6) as red from (select distinct pixel_id, obs_date from f_obs) k left join (select pixel_id, obs_date, max(case when red >= -0.05 then red end) as red from f_obs where obs_id % 2 = 0 group by 1,2) v using (pixel_id, obs_date)")
def p33(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    stored = rows.where(C("obs_id") % 2 == 0).groupBy("pixel_id", "obs_date").agg(F.max(bands.valid(C("red"))).alias("red"))
    return rows.select("pixel_id", "obs_date").distinct().join(stored, ["pixel_id", "obs_date"], "left").withColumn("red", r6(C("red")))


@query("p09_cloud_share", "select pixel_id, round(avg(case when cloud_level <> 99 and cloud_level < 2 then 1.0 else 0.0 end),6) as cloud_share from f_obs group by 1")
def p09_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).groupBy("pixel_id").agg(r6(F.avg(bits.level_cloud(C("cloud_level")).cast("int"))).alias("cloud_share"))
