"""Time the headline queries on the driver's tables and print one JSON line.

Each query is run whole (every output row is produced, none is kept): once to
warm up, then three times, of which the median counts. ``stage`` is the time to
write all tables between jobs and all published tables, once, after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wardcast.plans import catalog  # noqa: E402

# Queries of the blueprint: cleaning, patient counts, patient quality, unique
# patients, projection, published tables, change by service.
HEADLINE = {
    "q1_tidy_contacts": "tidy_contacts",
    "q7_patient_counts": "patient_counts",
    "q9_patients_dq": "patients_dq_national",
    "q11_unique_patients": "unique_patients_by_service_region",
    "q13_project": "project_contacts_region",
    "q15_mart": "mart_patients_region_exploded",
    "q24_change_by_service": "change_by_service",
}
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    catalog.Workspace(spark, sf_dir).all()
    space = catalog.workspace(spark, sf_dir)
    result = {"stage": round(timed(space.all), 3)}
    for label, name in HEADLINE.items():

        def run(name: str = name) -> None:
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        result[label] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    total = round(sum(result.values()), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": result,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
