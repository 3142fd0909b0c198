"""Times of the headline queries, warm, as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from weblens import queries as core

HEADLINE = ("feature_vector", "sessionize", "session_features", "psi", "path_idf", "annotation_asof", "delivery", "score_windows")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, times = core.queries(), {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: code is compiled then
            start = time.perf_counter()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cores": int(cpus), "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
