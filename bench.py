"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame

from terrapane import catalog
from terrapane.session import session

HEADLINE = (
    "a04_monthly_ndvi", "p07_state_mask_strict", "p15_band_calibration", "a01_clean_tiles", "a05_reliability", "j03_sync_pairs", "k09_missing_ranges", "w02_run_length", "w03_fraction", "w04_gaps", "w05_slope",
    "w06_high_risk", "w08_detect", "w10_whittaker", "g05_patch_extract", "g06_swath_nearest", "g10_dilate", "g11_close", "g12_cloud_mask", "g14_bilinear", "g17_landcover", "t04_monthly_prior", "t08_sync_sample",
)


def seconds(make, runs: int) -> float:
    """The median of so many warm runs; the first run is not counted."""
    took = []
    for n in range(runs + 1):
        began = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        if n:
            took.append(time.perf_counter() - began)
    return statistics.median(took)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.entry(spark, sf_dir).count()  # start-up is not timed
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {q: round(seconds(lambda q=q: catalog.QUERIES[q](spark, sf_dir), runs), 3) for q in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
