"""Domain-shaped tables made from the driver's tables, in Spark and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import day_number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-pixel observations: red, nir, a quality word, a four-level flag; every 23rd red is fill."""
    e, day, n = table(spark, sf_dir, "events"), F.col("ts").cast("date"), F.col("event_id")
    return e.select(
        n.alias("obs_id"), F.col("user_id").alias("pixel_id"), day.alias("obs_date"), "ts", F.dayofyear("ts").alias("doy"), day_number(day).cast("double").alias("day_no"),
        F.when(n % 23 == 0, -0.2).otherwise(F.col("value") / 500.0).alias("red"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("nir"),
        ((n * 7919) % 65536).cast("int").alias("qa"), F.when(n % 5 == 4, 99).otherwise(n % 5).cast("int").alias("cloud_level"), F.col("event_type").alias("variable"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several years of one observation per pixel and day."""
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pixel_id"), day.alias("obs_date"), day_number(day).cast("double").alias("day_no"), F.dayofyear("l_shipdate").alias("doy"), (F.col("l_discount") + F.col("l_quantity") / 200.0).alias("red"), (F.col("l_extendedprice") / 105000.0).alias("nir"))
    return rows.groupBy("pixel_id", "obs_date", "day_no", "doy").agg(F.max("red").alias("red"), F.max("nir").alias("nir"), F.count("*").alias("n_obs"))


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 patches in pixel form with a land-cover class."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), F.col("label").alias("lc_class"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("patch_id", "lc_class", F.floor(F.col("p") / 8).cast("int").alias("r"), (F.col("p") % 8).alias("c"), F.col("v").cast("double").alias("v"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells with coordinates and an id that can be parsed."""
    k = F.col("c_custkey")
    lat, lon = (k * 37 % 16000).cast("double") / 100.0 - 80.0, (k * 9176 % 36000).cast("double") / 100.0 - 180.0
    grid = F.concat((k % 300).cast("string"), F.lit("D_"), (k % 977).cast("string"), F.lit("L"))
    return table(spark, sf_dir, "customer").select(k.alias("cell_id"), lat.alias("lat"), lon.alias("lon"), grid.alias("grid_id"), F.col("c_nationkey").alias("region_key"))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("user_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("MOD09GQ.A"), F.date_format("ts", "yyyyDDD"), F.lit(".h"), two(u % 36), F.lit("v"), two(n % 18), F.lit(".061."), (n + 2024000000000).cast("string"), F.lit(".hdf"))
    return table(spark, sf_dir, "events").select(n.alias("obs_id"), name.alias("fname"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "P", "Admin1").otherwise("Admin2").alias("s_res")).agg(F.count("*").alias("n"))


SQL = {
    "f_obs": """select event_id as obs_id, user_id as pixel_id, cast(ts as date) as obs_date, ts, cast(dayofyear(ts) as int) as doy,
 cast(date_diff('day', date '2000-01-01', cast(ts as date)) as double) as day_no, case when event_id % 23 = 0 then -0.2 else value/500.0 end as red,
 cast(json_extract_string(props,'$.k') as double)/100.0 as nir, cast((event_id*7919) % 65536 as int) as qa,
 cast(case event_id % 5 when 4 then 99 else event_id % 5 end as int) as cloud_level, event_type as variable from events""",
    "f_series": """select l_suppkey as pixel_id, cast(l_shipdate as date) as obs_date, cast(date_diff('day', date '2000-01-01', cast(l_shipdate as date)) as double) as day_no,
 cast(dayofyear(l_shipdate) as int) as doy, max(l_discount + l_quantity/200.0) as red, max(l_extendedprice/105000.0) as nir, count(*) as n_obs from lineitem group by 1,2,3,4""",
    "f_patch": """select vec_id as patch_id, label as lc_class, cast(floor(p/8) as int) as r, cast(p % 8 as int) as c, cast(v as double) as v
 from (select vec_id, label, unnest(range(64)) p, unnest(embedding) v from embeddings)""",
    "f_cells": """select c_custkey as cell_id, cast(c_custkey*37 % 16000 as double)/cast(100 as double) - cast(80 as double) as lat,
 cast(c_custkey*9176 % 36000 as double)/cast(100 as double) - cast(180 as double) as lon,
 concat(cast(c_custkey % 300 as string),'D_',cast(c_custkey % 977 as string),'L') as grid_id, c_nationkey as region_key from customer""",
    "f_granules": """select event_id as obs_id, concat('MOD09GQ.A', strftime(ts,'%Y%j'), '.h', lpad(cast(user_id % 36 as string),2,'0'), 'v', lpad(cast(event_id % 18 as string),2,'0'), '.061.', cast(2024000000000+event_id as string), '.hdf') as fname from events""",
    "f_presence": """select n_name as country, cast(year(o_orderdate) as int) as year, case when o_orderstatus='P' then 'Admin1' else 'Admin2' end as s_res, count(*) as n
 from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1,2,3""",
}


def sql(body: str) -> str:
    """The query, with the fixtures that it names in front."""
    used = [f"{k} as ({v})" for k, v in SQL.items() if k in body]
    if not used:
        return body
    head, rest = "with ", body
    if body.lstrip().startswith("with recursive "):
        return "with recursive " + ", ".join(used) + ", " + body.lstrip()[15:]
    if body.lstrip().startswith("with "):
        rest = body.lstrip()[5:]
        return head + ", ".join(used) + ", " + rest
    return head + ", ".join(used) + " " + rest
