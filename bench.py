"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query is
timed from building its plan to having all its rows computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "linear_screening",
    "radius_pairs",
    "canonical_latest",
    "selection_counts",
    "propagate_grid",
    "trajectory",
    "satcat_upsert",
    "gp_upsert",
    "element_insert",
    "classification_tags",
    "episodes",
    "events_with_objects",
    "grounding",
    "catalog_search",
    "operation_counters",
    "failure_streak",
    "failure_increase",
    "alert_hold",
    "log_levels",
    "brief_checks",
)


STREAMS = ("stream_canonical", "stream_failures", "stream_logs", "stream_episodes", "stream_alerts")

#: Name -> (horizon s, chunk s, copies of the catalogue). Three copies, turned about the
#: earth's axis and along their orbits, make a catalogue and a number of raw pairs as large
#: as those of the published runs.
RUNS = {
    "screening_15min_run": (900, 900, 1),
    "screening_15min_run_3_catalogues": (900, 900, 3),
    "screening_30min_run_1_chunk": (1800, 1800, 1),
    "screening_30min_run_2_chunks": (1800, 900, 1),
}
COPY = 10_000_000


def copied(elements, objects, copies: int):
    """The catalogue several times over, with new ids and turned orbits."""
    if copies == 1:
        return elements, objects
    number = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    elements, objects = elements.withColumn("_copy", number), objects.withColumn("_copy", number)
    shift = F.col("_copy") * COPY
    elements = elements.withColumns(
        {
            "object_id": F.col("object_id") + shift,
            "element_id": F.col("element_id") + shift,
            "ra_of_asc_node": (F.col("ra_of_asc_node") + F.col("_copy") * 97.3) % 360.0,
            "mean_anomaly": (F.col("mean_anomaly") + F.col("_copy") * 41.7) % 360.0,
        }
    )
    objects = objects.withColumns({"id": F.col("id") + shift, "norad_cat_id": F.col("norad_cat_id") + shift})
    return elements.drop("_copy"), objects.drop("_copy")


def screening(spark: SparkSession, folder: str, horizon: int, chunk: int, copies: int) -> dict[str, float]:
    """A whole screening run: samples of 60 s, 10 km; its counters, time and time per unit."""
    from skyframe.plans.screening_run import ScreeningOptions, run_screening
    from skyframe.session import materialize
    from skyframe.workload import views

    elements, objects = copied(views.elements(spark, folder), views.objects(spark, folder), copies)
    elements, objects = materialize(elements), materialize(objects)
    started = time.perf_counter()
    options = ScreeningOptions(start=views.NOW, horizon_seconds=horizon, chunk_seconds=chunk)
    counters = run_screening(elements, objects, options).counters.first().asDict()
    seconds = time.perf_counter() - started
    counters["seconds"] = round(seconds, 3)
    for unit in ("propagation_attempts", "raw_candidates", "refinement_attempts"):
        counters[f"us_per_{unit}"] = round(1e6 * seconds / max(counters[unit], 1), 2)
    return counters


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", work)
        .config("spark.checkpoint.dir", f"{work}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from skyframe.workload.registry import load

    registered = load()
    registered["object_coverage"].run(spark, folder).collect()  # start the engine
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    runs = {name: screening(spark, folder, *options) for name, options in RUNS.items()}
    seconds["screening_15min_run"] = runs["screening_15min_run"]["seconds"]
    # The total stays the sum of the same queries from round to round; the rest stands beside it.
    more = {name: run["seconds"] for name, run in runs.items() if name not in seconds}
    for name in STREAMS:
        started = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "more_queries": more,
                "screening_counters": runs["screening_15min_run"],
                "screening_runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
