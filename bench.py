"""Wall seconds of the headline queries, as one JSON line: each runs once to warm up and once for the figure."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from trackloom.catalogue import QUERIES

HEADLINE = {
    "entry_exit": "a07_t01_j07_entry_exit",
    "trajectories": "w01_w02_w03_trajectories",
    "track_metrics": "a03_p11_track_metrics",
    "speed_quantiles": "a06_speed_quantiles",
    "cleaning_split": "j02_u03_clean_points",
    "histogram_2d": "a16_histogram_2d",
    "features": "m14_m15_w04_features_revers",
    "labels": "j03_m17_labels",
    "exit_groups": "m03_exit_groups",
    "optics": "m01_w08_optics",
    "grid_search": "m13_f11_t08_grid_search",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for key, name in HEADLINE.items():
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall seconds after one warm-up", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cores": int(cpus)}))


if __name__ == "__main__":
    main()
