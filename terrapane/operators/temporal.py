"""Features and cloud detection along the time axis of a pixel (columns pixel_id, day_no, doy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import day_number, thirty_day_month


def pixel() -> WindowSpec:
    return Window.partitionBy("pixel_id").orderBy("day_no")


def whole() -> WindowSpec:
    return Window.partitionBy("pixel_id")


def within(aggregate: str, days: float) -> Column:
    """An aggregate (SQL) over the steps within so many days on either side.  day_no is a double; its order is that of ``pixel``, so rows are sorted once for both."""
    return F.expr(f"{aggregate} over (partition by pixel_id order by day_no range between {float(days)!r}D preceding and {float(days)!r}D following)")


def suppressed(y: Column, z: Column, p: float = 0.99) -> Column:
    """1 where the asymmetric weight of y against the envelope z is below 0.1, or either is null."""
    weight = F.when(y.isNull() | z.isNull(), 0.0).when(y >= z, p).otherwise(1 - p)
    return (weight < 0.1).cast("int")


def run_lengths(rows: DataFrame, flag: str = "s") -> DataFrame:
    """run_length: the length of the run of set flags that a step belongs to, 0 where it is clear."""
    island = F.sum(1 - F.col(flag)).over(pixel().rowsBetween(Window.unboundedPreceding, 0))
    length = F.sum(flag).over(Window.partitionBy("pixel_id", "island"))
    return rows.withColumn("island", island).withColumn("run_length", F.when(F.col(flag) == 1, length).otherwise(0)).drop("island")


def window_share(rows: DataFrame, flag: str = "s", half: float = 10.0) -> DataFrame:
    """share: the mean flag over the calendar days within half of each step."""
    return rows.withColumn("share", within(f"avg(`{flag}`)", half))


def gaps(rows: DataFrame, flag: str = "s") -> DataFrame:
    """gap_back, gap_forward: days to the nearest clear step on either side, 0 on one, null where there is none."""
    clear = F.when(F.col(flag) == 0, F.col("day_no"))
    before, after = pixel().rowsBetween(Window.unboundedPreceding, 0), pixel().rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("gap_back", F.col("day_no") - F.last(clear, ignorenulls=True).over(before)).withColumn("gap_forward", F.first(clear, ignorenulls=True).over(after) - F.col("day_no"))


def slopes(rows: DataFrame, value: str = "z", half: float = 2.5) -> DataFrame:
    """slope: the least-squares slope of value a day, within half days; 0 for fewer than two points."""
    return rows.withColumn("slope", F.coalesce(within(f"regr_slope(`{value}`, day_no)", half), F.lit(0.0)))


def high_risk(rows: DataFrame, most_run: int = 4) -> DataFrame:
    """high_risk: a run longer than most_run with a slope beyond the 90th percentile of rises or the 10th of falls of its pixel."""
    up, down = F.percentile(F.when(F.col("slope") > 0, F.col("slope")), F.lit(0.9)).over(whole()), F.percentile(F.when(F.col("slope") < 0, F.col("slope")), F.lit(0.1)).over(whole())
    steep = F.coalesce(F.col("slope") > F.col("up"), F.lit(False)) | F.coalesce(F.col("slope") < F.col("down"), F.lit(False))
    return rows.withColumn("up", up).withColumn("down", down).withColumn("high_risk", (F.col("run_length") > most_run) & steep).drop("up", "down")


def sequences(rows: DataFrame, n: int, value: str) -> DataFrame:
    """pixel_id, day_no, steps: every run of n consecutive steps; runs that are null throughout are left out."""
    frame = pixel().rowsBetween(0, n - 1)
    out = rows.select("pixel_id", "day_no", F.collect_list(F.struct(F.col(value).alias("v"))).over(frame).alias("steps"))
    return out.where(F.size("steps") == n).select("pixel_id", "day_no", F.col("steps.v").alias("steps")).where(F.exists("steps", lambda v: v.isNotNull()))


def detected(rows: DataFrame, k: Column | float = 2.0, floor: float = 0.02, drop: float = 0.10, most: float = 0.1, least_clear: int = 3) -> DataFrame:
    """Cloud by residuals y - z: adds month, sigma, uncertain, cloud.  weight > 0.5 marks clear steps.

    A step is cloud below -k sigma of its month (and beyond floor), or below -drop.  Months with fewer than least_clear
    clear steps are uncertain and have no cloud; so is a pixel without any weight.
    """
    month = Window.partitionBy("pixel_id", "month")
    rows = rows.withColumn("month", thirty_day_month(F.col("doy"))).withColumn("residual", F.col("y") - F.col("z"))
    use = F.when((F.col("residual") > 0) & (F.col("residual") <= most), F.col("residual"))
    sigma = F.when(F.count(use).over(month) > 1, F.stddev_pop(use).over(month)).otherwise(0.001) * 1.2533141373155001
    uncertain = (F.sum((F.col("weight") > 0.5).cast("int")).over(month) < least_clear) | (F.sum("weight").over(whole()) == 0)
    r = F.col("residual")
    k = k if isinstance(k, Column) else F.lit(float(k))
    low = ((r < -k * F.col("sigma")) & (F.abs(r) >= floor)) | (r < -drop)
    return rows.withColumn("sigma", sigma).withColumn("uncertain", uncertain).withColumn("cloud", ~F.col("uncertain") & F.coalesce(low, F.lit(False)))


# Land-cover classes that need another factor than 2.
CLASS_FACTORS = {1: 2.5, 2: 1.8, 3: 2.0, 4: 2.0}


def class_factor(land_cover: Column, overrides: dict[int, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (CLASS_FACTORS | (overrides or {})).items() for x in kv])
    return F.coalesce(F.try_element_at(table, land_cover), F.lit(2.0))


def soft_labels(cloud: Column, uncertain: Column, mask: Column) -> Column:
    """0 cloud, 0.5 uncertain or without a mask, 1 clear."""
    return F.when(cloud, 0.0).when(uncertain | mask.isNull(), 0.5).otherwise(1.0)


def stack(observed: DataFrame, spine: DataFrame, cloud: Column | None) -> DataFrame:
    """Every day of the spine for every pixel: y, masked, weight (1 clear, 0 cloud or missing)."""
    days = observed.select("pixel_id").distinct().crossJoin(spine)
    full = days.join(observed, ["pixel_id", "obs_date"], "left")
    clear = F.col("y").isNotNull() & ~(F.coalesce(cloud, F.lit(False)) if cloud is not None else F.lit(False))
    return full.withColumn("weight", clear.cast("double")).withColumn("masked", F.when(clear, F.col("y")))


def assembled(rows: DataFrame, day: str = "obs_date", height: int = 10) -> DataFrame:
    """Pixels (r, c, a date, soft, ...) as they are handed on: y counts up from the last row, x is the column, day_no counts from 2000-01-01."""
    return rows.withColumns({"y": F.lit(height - 1) - F.col("r"), "x": F.col("c"), "day_no": day_number(F.col(day)).cast("int")}).drop("r", "c")
