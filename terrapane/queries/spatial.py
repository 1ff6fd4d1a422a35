"""Boxes, tiles, gridding, resampling and morphology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import bits, geo
from ..operators import aggregate, grid, morphology, resample
from .registry import query, r6
from .relational import _BOXES, _boxes

C = F.col


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.patch(spark, sf_dir)


_REGION_BOXES = "select region_key, min(lon) as lon_min, min(lat) as lat_min, max(lon) as lon_max, max(lat) as lat_max from f_cells group by 1"


def _region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).groupBy("region_key").agg(*[f(c).alias(f"{c}_{e}") for e, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")])


@query("g01_bboxes", f"select region_key, i * 12 + j as box_id, round(lon_min + j * ((lon_max - lon_min) / 12), 6) as lon_min, round(lat_min + i * ((lat_max - lat_min) / 8), 6) as lat_min, round(lon_min + j * ((lon_max - lon_min) / 12) + (lon_max - lon_min) / 12, 6) as lon_max, round(lat_min + i * ((lat_max - lat_min) / 8) + (lat_max - lat_min) / 8, 6) as lat_max from ({_REGION_BOXES}) cross join (select unnest(range(8)) as i) cross join (select unnest(range(12)) as j)")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each region in 8 x 12 boxes."""
    return grid.region_boxes(_region_boxes(spark, sf_dir), 8, 12).select("region_key", "box_id", *[r6(C(c)).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


_D = "(cast(100000 as double) * 7 / 111320.0)"


@query(
    "g02_bboxes_res",
    f"""with b as ({_REGION_BOXES}), r as (select *, lat_min + i * {_D} as south from (select *, unnest(range(cast(ceil((lat_max - lat_min) / {_D}) as int))) as i from b)), s as (select *, 700000.0 / (111320.0 * cos(radians(south))) as step from r),
 t as (select *, unnest(range(cast(ceil((lon_max - lon_min) / step) as int))) as j from s) select region_key, cast(i as int) as row, cast(j as int) as col, round(lon_min + j * step, 6) as lon_min, round(south, 6) as lat_min, round(lon_min + j * step + step, 6) as lon_max, round(south + {_D}, 6) as lat_max from t""",
)
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each region in boxes of 7 x 7 pixels of 100 km."""
    boxes = grid.region_boxes_by_resolution(_region_boxes(spark, sf_dir), 100000.0, 7)
    return boxes.select("region_key", "row", "col", *[r6(C(c)).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


_HV = "cast(floor((6371007.181*radians(lon)*cos(radians(lat)) + 20015109)/1111950) as int) as h, cast(floor((10007555 - 6371007.181*radians(lat))/1111950) as int) as v"


@query("g03_tile_lookup", f"select h, v, count(*) as n, min(cell_id) as first from (select cell_id, {_HV} from f_cells) group by 1,2")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = grid.tile_catalog(fixtures.cells(spark, sf_dir))
    return tiles.select("h", "v", F.size("cells").cast("long").alias("n"), F.get("cells", 0)["cell_id"].alias("first"))


@query("g04_global_aoi", "select cell_id, greatest(0, 5120 - spacing) as overlap, greatest(0, spacing - 5120) as gap from (select cell_id, cast(4000 + cell_id % 2500 as int) as spacing from f_cells)")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    spacing = (4000 + C("cell_id") % 2500).cast("int")
    return fixtures.cells(spark, sf_dir).select("cell_id", F.greatest(F.lit(0), 5120 - spacing).alias("overlap"), F.greatest(F.lit(0), spacing - 5120).alias("gap"))


_KM = 400.0
_ROWS = "cast(ceil(pi() * 6378.137 / 400.0) as bigint)"
_COLS = "cast(ceil(2 * pi() * 6378.137 * cos(radians(lat)) / 400.0) as bigint)"
_ROW_LINES = f"select i, i * 180.0::double / n as lat from (select {_ROWS} as n, unnest(range(-({_ROWS} // 2), {_ROWS} - {_ROWS} // 2)) as i)"
_POINTS = f"""select i, j, case when i < 0 then -i || 'D' else i || 'U' end || '_' || case when j < 0 then -j || 'L' else j || 'R' end as grid_id, lat, j * 360.0::double / m as lon, m
 from (select i, lat, m, unnest(range(-(m // 2), m - m // 2)) as j from (select *, {_COLS} as m from ({_ROW_LINES})))"""


@query("g04_global_grid", f"with b as ({_REGION_BOXES}), p as materialized ({_POINTS}) select region_key, grid_id, round(lat, 6) as lat, round(lon, 6) as lon from p join b on lat between lat_min and lat_max and lon between lon_min and lon_max")
def g04g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the grid of 400 km in the box of each region."""
    found = grid.grid_points_in_boxes(_region_boxes(spark, sf_dir), _KM)
    return found.select("region_key", "grid_id", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"))


@query(
    "g04_cell_of_point",
    f"""with p as materialized ({_POINTS}), r as materialized (select i, lat as south, lead(lat, 1, 91) over (order by i) as north from ({_ROW_LINES})), c as (select cell_id, f.lat, f.lon, r.i from f_cells f join r on f.lat >= south and f.lat < north),
 q as (select p.*, 360.0::double / m as width, row_number() over (partition by cell_id order by p.lon desc) as k, cell_id, c.lat as y, c.lon as x from c join p on p.i = c.i and (p.lon <= c.lon or p.j = m - m // 2 - 1) and (p.lon > c.lon - 2 * 360.0::double / m or p.j = m - m // 2 - 1)),
 s as (select *, case when lon <= x and x < lon + width then 0 when j = m - m // 2 - 1 and x + 360 >= lon then 1 end as how from q) select cell_id, grid_id, round(lat, 6) as lat, round(lon, 6) as lon from s where how is not null qualify row_number() over (partition by cell_id order by how) = 1""",
)
def g04c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that each point is in, by arithmetic alone, and the cell's own point from its id."""
    cells = grid.with_grid_cell(fixtures.cells(spark, sf_dir).select("cell_id", "lat", "lon"), _KM)
    lat, lon = geo.grid_point(*geo.grid_indices(C("grid_id")), _KM)
    return cells.select("cell_id", "grid_id", r6(lat).alias("lat"), r6(lon).alias("lon"))


_WINDOWS = "select patch_id * 3 + k as cell_id, patch_id, cast((patch_id + 3 * k) % 8 as int) as row, cast((patch_id // 8 + 2 * k) % 8 as int) as col from (select vec_id as patch_id, unnest([0, 1, 2]) as k from embeddings)"
_V = "case when v < -0.12 then null else v end"


@query(
    "g05_patch_extract",
    f"""with c as ({_WINDOWS}), w as (select c.cell_id, p.r - c.row + 2 as pr, p.c - c.col + 2 as pc, {_V} as v
 from c join f_patch p on p.patch_id = c.patch_id and p.r between c.row - 2 and c.row + 1 and p.c between c.col - 2 and c.col + 1 where c.row >= 2 and c.col >= 2 and c.row + 2 <= 8 and c.col + 2 <= 8),
 ok as (select cell_id from w group by 1 having avg(case when v is null then 1.0 else 0.0 end) <= 0.1) select cell_id, pr, pc, round(v,6) as v from w join ok using (cell_id)""",
)
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of 4 x 4 in each tile of 8 x 8, which is stored as four blocks."""
    k, p = C("k"), C("patch_id")
    ids = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    centres = ids.select((p * 3 + k).alias("cell_id"), "patch_id", ((p + 3 * k) % 8).cast("int").alias("row"), ((F.floor(p / 8) + 2 * k) % 8).cast("int").alias("col"))
    tiles = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"), F.transform("embedding", lambda v: F.when(v.cast("double") >= -0.12, v.cast("double"))).alias("data"))
    windows = grid.extract_block_windows(grid.blocked(tiles, ["patch_id"], 8, 4), centres, ["patch_id"], 2, 8, 4)
    place = windows.select("cell_id", F.posexplode("data").alias("place", "v"))
    return place.select("cell_id", F.floor(C("place") / 4).cast("int").alias("pr"), (C("place") % 4).alias("pc"), r6(C("v")).alias("v"))


_XYZ = "6371007.181*cos(radians(lat))*cos(radians(lon)) as x, 6371007.181*cos(radians(lat))*sin(radians(lon)) as y, 6371007.181*sin(radians(lat)) as z"


@query(
    "g06_swath_nearest",
    f"""with t as (select cell_id, {_XYZ} from f_cells), s as (select cell_id as sample_id, {_XYZ} from (select cell_id, lat + 0.01 * (cell_id % 9) as lat, lon from f_cells)),
 d as (select t.cell_id, s.sample_id, sqrt((t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z)) as d from t join s on abs(t.z - s.z) <= 150000 and abs(t.x - s.x) <= 150000 and abs(t.y - s.y) <= 150000)
 select cell_id, sample_id, round(d, 3) as metres from (select *, row_number() over (partition by cell_id order by d, sample_id) as k from d where d <= 150000) where k = 1""",
)
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.cells(spark, sf_dir)
    samples = rows.select(C("cell_id").alias("sample_id"), (C("lat") + 0.01 * (C("cell_id") % 9)).alias("lat"), "lon")
    return resample.nearest_within(rows, samples, 150000.0, "cell_id", "sample_id").withColumn("metres", F.round("metres", 3))


_SWATHS = """select patch_id as swath_id, cast(date '2024-01-01' + cast(patch_id % 3 as int) as date) as obs_date, r * 8 + c as sample_id, lat0 + (3.5 - r) * cast(0.012 as double) + (c % 3) * cast(0.001 as double) as lat,
 lon0 + (c - 3.5) * cast(0.013 as double) + (r % 2) * cast(0.001 as double) as lon, (cast(abs(floor(v * 1000)) as int) >> 1) & 3 as level from f_patch join (select cell_id, lat as lat0, lon as lon0 from f_cells) on cell_id = patch_id where v >= -0.12"""


@query(
    "g06_swath_patches",
    f"""with s as materialized ({_SWATHS}), b as (select swath_id, obs_date, min(lon) - 2 * cast(0.01 as double) as x0, max(lon) + 2 * cast(0.01 as double) as x1, min(lat) - 2 * cast(0.01 as double) as y0, max(lat) + 2 * cast(0.01 as double) as y1 from s group by 1,2),
 i as (select *, ceil((y1-y0)/0.01::double) as ny, ceil((x1-x0)/0.01::double) as nx from b join (select cell_id, lat, lon + k as lon from f_cells cross join (select unnest([0.0, 360.0, -360.0]::double[]) as k)) on lat between y0 and y1 and lon between x0 and x1),
 w as (select *, greatest(0, least(round_even((lat-y0)/0.01::double, 0), ny-1)) as row, greatest(0, least(round_even((lon-x0)/0.01::double, 0), nx-1)) as col from i),
 n as (select swath_id, obs_date, cell_id, k // 6 as pr, k % 6 as pc, y0 + (row - 3 + k // 6) * 0.01::double as lat, x0 + (col - 3 + k % 6) * 0.01::double as lon from w cross join (select unnest(range(36)) as k) where row >= 3 and row + 3 <= ny and col >= 3 and col + 3 <= nx),
 t as (select swath_id, obs_date, cell_id, pr, pc, {_XYZ} from n), q as (select swath_id, sample_id, level, {_XYZ} from s),
 d as (select t.swath_id, obs_date, cell_id, pr, pc, level, row_number() over (partition by t.swath_id, obs_date, cell_id, pr, pc order by case when far <= 900 then far end nulls last, sample_id) as k, far from (select t.*, q.sample_id, q.level, sqrt((t.x-q.x)*(t.x-q.x) + (t.y-q.y)*(t.y-q.y) + (t.z-q.z)*(t.z-q.z)) as far from t join q on q.swath_id = t.swath_id) t),
 p as (select swath_id, obs_date, cell_id, (5 - pr) * 3 + a as r, pc * 3 + b as c, case when far <= 900 then level end as level from d cross join (select unnest([0,1,2]) as a) cross join (select unnest([0,1,2]) as b) where k = 1 and (5 - pr) * 3 + a < 16 and pc * 3 + b < 16),
 o as (select obs_date, cell_id, swath_id from p group by 1,2,3 having sum(case when level is null then 1 else 0 end) / cast(256 as double) <= 0.1 qualify swath_id = max(swath_id) over (partition by obs_date, cell_id))
 select obs_date, cell_id, r, c, coalesce(level, 99) as level from p join o using (obs_date, cell_id, swath_id)""",
)
def g06p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaths of 8 x 8 samples with gaps; nodes a hundredth of a degree apart, a radius of 900 m, patches of 16 x 16."""
    centres = fixtures.cells(spark, sf_dir).select(C("cell_id").alias("patch_id"), C("lat").alias("lat0"), C("lon").alias("lon0"))
    rows = patch(spark, sf_dir).where("v >= -0.12").join(centres, "patch_id")
    lat, lon = C("lat0") + (3.5 - C("r")) * 0.012 + (C("c") % 3) * 0.001, C("lon0") + (C("c") - 3.5) * 0.013 + (C("r") % 2) * 0.001
    day = F.date_add(F.lit("2024-01-01").cast("date"), (C("patch_id") % 3).cast("int"))
    samples = rows.select(C("patch_id").alias("swath_id"), day.alias("obs_date"), (C("r") * 8 + C("c")).alias("sample_id"), lat.alias("lat"), lon.alias("lon"), bits.bit_field(F.abs(F.floor(C("v") * 1000)).cast("int"), 1, 2).alias("level"))
    return resample.swath_patches(samples, fixtures.cells(spark, sf_dir), 3, 16, 0.01, 900.0)


@query("g08_upsample", "select patch_id, r*2+i as r, c*2+j as c, round(v,6) as v from f_patch cross join (values (0),(1)) a(i) cross join (values (0),(1)) b(j)")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.upsampled(patch(spark, sf_dir), 2).select("patch_id", "r", "c", r6(C("v")).alias("v"))


@query("g08_upsample_crop", "select patch_id, r*5+i as r, c*5+j as c, round(v,6) as v from f_patch cross join (select unnest([0,1,2,3,4]) as i) cross join (select unnest([0,1,2,3,4]) as j) where r*5+i < 36 and c*5+j < 36")
def g08b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.upsampled(patch(spark, sf_dir), 5, 36).select("patch_id", "r", "c", r6(C("v")).alias("v"))


@query("g09_flip", "select patch_id, 7 - r as r, c, round(v,6) as v from f_patch")
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.flipped(patch(spark, sf_dir), 8).select("patch_id", "r", "c", r6(C("v")).alias("v"))


@query("g07_index_repeat", "select patch_id, r, c, round((r // 3) + v, 6) as lat from f_patch")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = spark.range(3).select(C("id").alias("k"))
    return patch(spark, sf_dir).withColumn("k", F.floor(C("r") / 3)).join(F.broadcast(coarse), "k").select("patch_id", "r", "c", r6(C("k") + C("v")).alias("lat"))


_T = "select patch_id, r, c from f_patch where v > 0.28"
_O = "(select unnest([-2,-1,0,1,2]) as dr) cross join (select unnest([-2,-1,0,1,2]) as dc)"
_DIL = f"select distinct patch_id, r+dr as r, c+dc as c from t cross join {_O} where r+dr between 0 and 7 and c+dc between 0 and 7"


@query("g10_dilate", f"with t as ({_T}) {_DIL}")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.dilated(patch(spark, sf_dir).where("v > 0.28").select("patch_id", "r", "c"), ["patch_id"], 8)


@query("g11_close", f"with t as ({_T}), d as ({_DIL}) select patch_id, r+dr as r, c+dc as c from d cross join {_O} where r+dr between 0 and 7 and c+dc between 0 and 7 group by 1,2,3 having count(*) = 25")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.closed(patch(spark, sf_dir).where("v > 0.28").select("patch_id", "r", "c"), ["patch_id"], 8)


_CLOUDY = "select patch_id, r, c, (qa & 3) in (1,2) as m09, level, level <= 1 as m35, blue from (select patch_id, r, c, cast(abs(floor(v * 1000)) as int) as qa, cast((abs(cast(floor(v * 777) as int)) + r) % 4 as int) as level, abs(v) as blue from f_patch)"


@query(
    "g12_cloud_mask",
    f"""with i as ({_CLOUDY}), w as (select *, m09 or ((m09 <> m35) and blue > 0.15) as one, m35 or ((m09 <> m35) and blue > 0.15) as two from i), t as (select patch_id, r, c from w where one or two), a as ({_DIL}),
 b as (select distinct patch_id, r+dr as r, c+dc as c from a cross join {_O} where r+dr between 0 and 7 and c+dc between 0 and 7), m as (select patch_id, r+dr as r, c+dc as c from b cross join {_O} where r+dr between 0 and 7 and c+dc between 0 and 7 group by 1,2,3 having count(*) = 25),
 s as (select w.patch_id, w.r, w.c, m.r is not null as cloud, 0.5 * level / cast(3 as double) + 0.3 * case when one then 0.0 else 1.0 end + 0.2 * (1.0 - greatest(0.0, least(0.3, blue)) / cast(0.3 as double)) as score from w left join m on m.patch_id = w.patch_id and m.r = w.r and m.c = w.c)
 select patch_id, r, c, cloud, round(score,6) as soft_score, round(case when cloud then 0.0 else score end,6) as meta from s""",
)
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C("v")
    rows = patch(spark, sf_dir).select("patch_id", "r", "c", bits.bit_field(F.abs(F.floor(v * 1000)).cast("int"), 0, 2).isin(1, 2).alias("reference"), ((F.abs(F.floor(v * 777).cast("int")) + C("r")) % 4).alias("level"), F.abs(v).alias("blue"))
    out = morphology.fused_cloud(rows, ["patch_id"])
    return out.select("patch_id", "r", "c", "cloud", r6(C("soft_score")).alias("soft_score"), r6(C("meta")).alias("meta"))


@query("g13_mosaic", "select lc_class, r, c, round(v,6) as v from (select *, row_number() over (partition by lc_class, r, c order by patch_id desc) as k from f_patch where v >= -0.12) where k = 1")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patch(spark, sf_dir).withColumn("v", F.when(C("v") >= -0.12, C("v")))
    return resample.mosaic(rows, ["lc_class", "r", "c"], "patch_id").withColumn("v", r6(C("v")))


@query(
    "g13_daily_mosaic",
    """with p as (select patch_id as piece, cast(date '2024-01-01' + cast(patch_id % 7 as int) as date) as obs_date, case when (patch_id // 7) % 2 = 0 then 'red' else 'nir' end as variable, case when patch_id % 5 < 2 then 'float' else 'int16' end as dtype, r as y, c + (lc_class % 4) * 6 as x, case when v >= -0.12 then floor(v * 10000) end as raw from f_patch),
 k as (select obs_date, variable, dtype from (select obs_date, variable, dtype, count(distinct piece) as n, min(piece) as first from p group by 1,2,3) qualify row_number() over (partition by obs_date, variable order by n desc, first) = 1),
 m as (select obs_date, variable, y, x, raw from p join k using (obs_date, variable, dtype) where raw is not null qualify row_number() over (partition by obs_date, variable, y, x order by piece desc) = 1)
 select obs_date, y, x, round(max(case when variable = 'red' then raw end) * 0.0001, 6)::double as red, round(case when count(case when variable = 'nir' then 1 end) > 0 then greatest(0.0, max(case when variable = 'nir' then raw end) * 0.0001 + 0.05) end, 6)::double as nir from m group by 1,2,3""",
)
def g13d(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("patch_id")
    pieces = patch(spark, sf_dir).select(
        k.alias("piece"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 7).cast("int")).alias("obs_date"), F.when(F.floor(k / 7) % 2 == 0, "red").otherwise("nir").alias("variable"),
        F.when(k % 5 < 2, "float").otherwise("int16").alias("dtype"), C("r").alias("y"), (C("c") + (C("lc_class") % 4) * 6).alias("x"), F.when(C("v") >= -0.12, F.floor(C("v") * 10000)).alias("raw"),
    )
    offset = F.lit(0.05)
    return resample.daily_mosaic(pieces, {"red": lambda x: r6(x * 0.0001), "nir": lambda x: r6(F.when(x.isNotNull(), F.greatest(F.lit(0.0), x * 0.0001 + offset)))})


_PTS = "select patch_id, k as point_id, (patch_id * 37 % 800) / 100.0::double - 0.5 + k as fr, (patch_id * 53 % 700) / 100.0::double as fc from (select distinct patch_id from f_patch) cross join (select unnest([0,1]) as k)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("point_id"))
    return ids.select("patch_id", "point_id", ((C("patch_id") * 37 % 800) / 100.0 - 0.5 + C("point_id")).alias("fr"), ((C("patch_id") * 53 % 700) / 100.0).alias("fc"))


_BILINEAR = f"""with p as ({_PTS}), q as (select *, fr between 0 and 7 and fc between 0 and 7 as inside, least(floor(fr), 6) as r0, least(floor(fc), 6) as c0 from p),
 s as (select q.patch_id, q.point_id, sum((case when t.r = r0 then 1 - (fr - r0) else fr - r0 end) * (case when t.c = c0 then 1 - (fc - c0) else fc - c0 end) * t.v) as v from q join f_patch t on t.patch_id = q.patch_id and t.r in (r0, r0 + 1) and t.c in (c0, c0 + 1) where inside group by 1,2)"""


@query("g14_bilinear", f"{_BILINEAR} select p.patch_id, p.point_id, round(s.v,6) as v from p left join s using (patch_id, point_id)")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bilinear(_points(spark, sf_dir), patch(spark, sf_dir), ["patch_id"], "point_id", 8, 8, outside=None).withColumn("v", r6(C("v")))


@query("g18_reanalysis", f"{_BILINEAR} select p.patch_id, p.point_id, round(coalesce(s.v, 0.0),6) as v from p left join s using (patch_id, point_id)")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bilinear(_points(spark, sf_dir), patch(spark, sf_dir), ["patch_id"], "point_id", 8, 8).withColumn("v", r6(C("v")))


_B, _FL, _E2 = geo._POLAR, geo._FLAT, geo.ECC2
_N3 = _FL / (2 - _FL)


def on_ellipsoid(rows: str, keep: str) -> str:
    """SQL: the latitude and longitude of points (x, y) around (lat0, lon0) in the azimuthal equidistant projection of WGS84."""
    wave = lambda at, *k: " + ".join(f"({c})*sin({2 * j}*{at})" for j, c in enumerate(k, 1))
    c3 = (f"({0.25 - _N3 / 4!r})*e + e*e/8", f"({1 / 16 - 3 * _N3 / 32!r})*e*e")
    for step in (
        f"*, atan2(x, y) as az, sqrt(x*x+y*y) as far, atan2({1 - _FL!r}*sin(radians(lat0)), cos(radians(lat0))) as b1",
        "*, sin(az)*cos(b1) as s0, sqrt(cos(az)*cos(az) + sin(az)*sin(az)*sin(b1)*sin(b1)) as c0, atan2(sin(b1), cos(az)*cos(b1)) as g1",
        f"*, {_E2 / (1 - _E2)!r}*c0*c0 as k2",
        "*, k2/(2*(1+sqrt(1+k2))+k2) as e",
        f"*, far/{_B!r}*(1-e)/(1+e*e/4) + g1 + {wave('g1', '-e/2 + 3*e*e*e/16', '-e*e/16', '-e*e*e/48')} as tau",
        f"*, tau + {wave('tau', 'e/2 - 9*e*e*e/32', '5*e*e/16', '29*e*e*e/96')} as g2",
        f"*, atan2(s0*sin(g2), cos(g2)) - atan2(s0*sin(g1), cos(g1)) - {_FL!r}*s0*(1 - {0.5 - _N3 / 2!r}*e - {0.25 + _N3 / 8!r}*e*e)*(g2 - g1 + {wave('g2', *c3)} - ({wave('g1', *c3)})) as turn",
        f"{keep}, degrees(atan2(c0*sin(g2), {1 - _FL!r}*sqrt(c0*c0*cos(g2)*cos(g2) + s0*s0))) as lat, lon0 + degrees(atan2(sin(turn), cos(turn))) as lon",
    ):
        rows = f"select {step} from ({rows})"
    return rows


_CENTRES = on_ellipsoid("select cell_id, lat as lat0, lon as lon0, k // 4 as r, k % 4 as c, ((k % 4) - 2 + 0.5) * 500.0 as x, (2 - (k // 4) - 0.5) * 500.0 as y from f_cells cross join (select unnest(range(16)) as k)", "cell_id, r, c")


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir).select("cell_id", "lat", "lon")
    return resample.azimuthal_centres(cells, 4, 500.0)


@query("g16_azimuthal_centres", f"select cell_id, cast(r as int) as r, cast(c as int) as c, round(lat,6) as lat, round(lon,6) as lon from ({_CENTRES})")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centres(spark, sf_dir).select("cell_id", "r", "c", r6(C("lat")).alias("lat"), r6(C("lon")).alias("lon"))


@query(
    "g17_landcover",
    f"""with p as (select *, 6371007.181*radians(lon)*cos(radians(lat)) as x, 6371007.181*radians(lat) as y from ({_CENTRES})), q as (select *, cast(floor((x + 20015109)/1111950) as int) as h, cast(floor((10007555 - y)/1111950) as int) as v from p),
 w as (select *, greatest(0, least(7, cast(trunc((10007555 - v*1111950 - y)/(1111950/8.0)) as int))) as row, greatest(0, least(7, cast(trunc((x + 20015109 - h*1111950)/(1111950/8.0)) as int))) as col from q),
 t as (select cast(patch_id % 36 as int) as h, cast((patch_id // 36) % 18 as int) as v, r as row, c as col, max(lc_class) as lc from f_patch group by 1,2,3,4)
 select w.cell_id, cast(w.r as int) as r, cast(w.c as int) as c, coalesce(t.lc, 0) as lc from w left join t on t.h = w.h and t.v = w.v and t.row = w.row and t.col = w.col""",
)
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("patch_id")
    tiles = patch(spark, sf_dir).groupBy((k % 36).cast("int").alias("h"), (F.floor(k / 36) % 18).cast("int").alias("v"), C("r").alias("row"), C("c").alias("col")).agg(F.max("lc_class").alias("lc"))
    return resample.lookup_tiles(_centres(spark, sf_dir), tiles, 8, 1111950.0 / 8, "lc").select("cell_id", "r", "c", "lc")


@query("g20_patch_origin", f"select cell_id, cast(trunc((10007555 - v*1111950 - y)/(cast(1111950 as double)/4800)) as int) - 256 as row0, cast(trunc((x + 20015109 - h*1111950)/(cast(1111950 as double)/4800)) as int) - 256 as col0 from (select cell_id, 6371007.181*radians(lon)*cos(radians(lat)) as x, 6371007.181*radians(lat) as y, {_HV} from f_cells)")
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.sinusoidal(C("lat"), C("lon"))
    row, col = geo.tile_pixel(x, y, C("h"), C("v"))
    return grid.with_tiles(fixtures.cells(spark, sf_dir)).select("cell_id", (row - 256).alias("row0"), (col - 256).alias("col0"))


@query("g21_region_clip", "with b as (select region_key, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from f_cells where region_key in (3, 7) group by 1) select b.region_key, count(*) as n from f_cells c join b on c.lon between x0 and x1 and c.lat between y0 and y1 group by 1")
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    boxes = cells.where("region_key in (3, 7)").groupBy(C("region_key").alias("box_region")).agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))
    return grid.points_in_boxes(cells, boxes).groupBy(C("box_region").alias("region_key")).agg(F.count("*").alias("n"))


_CORNERS = "select region_key, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from f_cells where region_key in (3, 7) group by 1"
_RINGS = """select region_key, [[(x0, y0), (x1, y0 + (y1-y0)/4), ((x0+x1)/2, y1)], [(x0 + (x1-x0)*0.375::double, y0 + (y1-y0)*0.3::double), (x0 + (x1-x0)*0.625::double, y0 + (y1-y0)*0.3::double), (x0 + (x1-x0)*0.5::double, y0 + (y1-y0)*0.6::double)]] as rings from c"""
_EDGES = """select region_key, ring[k][1] as x0, ring[k][2] as y0, ring[k % 3 + 1][1] as x1, ring[k % 3 + 1][2] as y1 from (select region_key, unnest(rings) as ring from g) cross join (select unnest([1,2,3]) as k)"""
_INSIDE = f"""with c as ({_CORNERS}), g as ({_RINGS}), e as ({_EDGES}), h as (select region_key, min(x0) as bx0, max(x0) as bx1, min(y0) as by0, max(y0) as by1 from e group by 1), i as (select cell_id, e.region_key from f_cells p join e on (e.y0 > lat) <> (e.y1 > lat) and lon < (e.x1-e.x0)*(lat-e.y0)/(e.y1-e.y0)+e.x0 group by 1,2 having count(*) % 2 = 1)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle with a triangular hole for each region."""
    box = fixtures.cells(spark, sf_dir).groupBy("region_key").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    x0, x1, y0, y1 = (C(c) for c in ("x0", "x1", "y0", "y1"))
    ring = lambda *corners: F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])
    outer = ring((x0, y0), (x1, y0 + (y1 - y0) / 4), ((x0 + x1) / 2, y1))
    hole = ring((x0 + (x1 - x0) * 0.375, y0 + (y1 - y0) * 0.3), (x0 + (x1 - x0) * 0.625, y0 + (y1 - y0) * 0.3), (x0 + (x1 - x0) * 0.5, y0 + (y1 - y0) * 0.6))
    return box.select("region_key", F.array(outer, hole).alias("rings"))


@query("g21_polygon_clip", f"{_INSIDE} select region_key, cell_id from i")
def g21p(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = grid.selected(_regions(spark, sf_dir), [3, 7], "region_key")
    return grid.in_regions(fixtures.cells(spark, sf_dir).select("cell_id", "lat", "lon"), regions).select("region_key", "cell_id")


@query("g21_polygon_invert", f"{_INSIDE} select cell_id, lat, lon from f_cells where cell_id not in (select cell_id from i)")
def g21i(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = grid.selected(_regions(spark, sf_dir), [3, 7], "region_key")
    return grid.clipped_to_regions(fixtures.cells(spark, sf_dir).select("cell_id", "lat", "lon"), regions, ["cell_id"], invert=True)


@query("g21_region_bounds", f"with c as ({_CORNERS}), g as ({_RINGS}), e as ({_EDGES}) select round(min(x0), 6) as lon_min, round(max(x0), 6) as lon_max, round(min(y0), 6) as lat_min, round(max(y0), 6) as lat_max from e")
def g21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = grid.bounds(grid.selected(_regions(spark, sf_dir), [3, 7], "region_key"))
    return box.select([r6(C(c)).alias(c) for c in box.columns])


@query("g22_land_fraction", f"select box_id, count(*) as n, round(avg(case when region_key % 3 = 0 then 1.0 else 0.0 end) * 100, 6) as land_percent from f_cells join {_BOXES} b on lat between lat_min and lat_max and lon between lon_min and lon_max group by 1 having avg(case when region_key % 3 = 0 then 1.0 else 0.0 end) * 100 >= 30")
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.cells(spark, sf_dir).withColumn("land", (C("region_key") % 3 == 0).cast("int"))
    return grid.land_share(points, _boxes(spark), 30.0).withColumn("land_percent", r6(C("land_percent")))


@query("g23_drop_empty", "with p as (select patch_id, r, c, case when v < 0.2 then null else v end as v from f_patch), a as (select patch_id, r from p group by 1,2 having count(v) > 0), b as (select patch_id, c from p group by 1,2 having count(v) > 0) select p.patch_id, p.r, p.c, round(v,6) as v from p join a using (patch_id, r) join b using (patch_id, c)")
def g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patch(spark, sf_dir).withColumn("v", F.when(C("v") >= 0.2, C("v")))
    return grid.without_empty_lines(rows, ["patch_id"]).select("patch_id", "r", "c", r6(C("v")).alias("v"))


@query("s06_pixel_centres", "select patch_id, r, c, round(100.0 + (c + 0.5) * cast(0.25 as double),6) as x, round(50.0 - (r + 0.5) * cast(0.25 as double),6) as y from f_patch")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch(spark, sf_dir).select("patch_id", "r", "c", r6(100.0 + (C("c") + 0.5) * 0.25).alias("x"), r6(50.0 - (C("r") + 0.5) * 0.25).alias("y"))


@query("s14_split_region", "select region_key, part, round(x0 + (part // 3) * (x1-x0)/2, 6) as lon_min, round(y0 + (part % 3) * (y1-y0)/3, 6) as lat_min from (select region_key, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from f_cells group by 1) cross join (select cast(unnest(range(6)) as int) as part)")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = fixtures.cells(spark, sf_dir).groupBy("region_key").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    parts = box.select("region_key", F.explode(grid.split_box(C("x0"), C("y0"), C("x1"), C("y1"), 2, 3)).alias("b"))
    return parts.select("region_key", C("b.part").alias("part"), r6(C("b.lon_min")).alias("lon_min"), r6(C("b.lat_min")).alias("lat_min"))


@query("s15_strided_tiles", "select patch_id, r0, c0, round(avg(case when v < -0.1 then 1.0 else 0.0 end),6) as null_share from f_patch join (select cast(a*4 as int) as r0, cast(b*4 as int) as c0 from (select unnest(range(2)) as a) cross join (select unnest(range(2)) as b)) on r between r0 and r0+3 and c between c0 and c0+3 group by 1,2,3 having avg(case when v < -0.1 then 1.0 else 0.0 end) <= 0.2")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patch(spark, sf_dir).withColumn("v", F.when(C("v") >= -0.1, C("v")))
    tiled = rows.join(F.broadcast(grid.strided_tiles(spark, 8, 4, 4)), C("r").between(C("r0"), C("r0") + 3) & C("c").between(C("c0"), C("c0") + 3))
    return grid.gated(tiled, ["patch_id", "r0", "c0"], "v", 0.2).withColumn("null_share", r6(C("null_share")))


@query("k16_coarsen", "select patch_id, cast(r // 4 as int) as r, cast(c // 4 as int) as c, round(avg(greatest(-1.0, least(1.0, v))),6) as v from f_patch group by 1,2,3")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.bands import clip

    rows = patch(spark, sf_dir).withColumn("v", clip(C("v"), -1.0, 1.0))
    return resample.block_means(rows, ["patch_id"], 4).withColumn("v", r6(C("v")))


@query("a14_raster_metadata", "select patch_id, max(r) - min(r) + 1 as height, max(c) - min(c) + 1 as width, count(distinct r) as n_rows, round(min(v),6) as low, round(max(v),6) as high from f_patch group by 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.raster_metadata(patch(spark, sf_dir), ["patch_id"]).withColumns({"low": r6(C("low")), "high": r6(C("high"))})


@query("a14_raster_geometry", "select patch_id, width, height, round(px,6) as pixel_size_x, round(py,6) as pixel_size_y, round(x0-px/2,6) as west, round(y0-py/2,6) as south, round(x1+px/2,6) as east, round(y1+py/2,6) as north from (select patch_id, count(distinct x) as width, count(distinct y) as height, (max(x)-min(x))/nullif(count(distinct x)-1,0) as px, (max(y)-min(y))/nullif(count(distinct y)-1,0) as py, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from (select patch_id, 100.0::double + (c + 0.5) * 0.25::double as x, 50.0::double - (r + 0.5) * 0.5::double as y from f_patch) group by 1)")
def a14g(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = patch(spark, sf_dir).select("patch_id", (100.0 + (C("c") + 0.5) * 0.25).alias("x"), (50.0 - (C("r") + 0.5) * 0.5).alias("y"))
    out = aggregate.raster_geometry(centres, ["patch_id"])
    return out.select(*["patch_id", "width", "height"], *[r6(C(c)).alias(c) for c in out.columns[3:]])
