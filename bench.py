"""Times the headline queries and full-size runs; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores. The log's table is landed in
one file per core first (not timed), as it comes on a cluster. Every query is timed three times
and counts with its median. The full ingest repeats the derived log until it has as many records
as the published full run, lands them as files (not timed) and times stream, five outputs,
ledger and merge, once. ``BENCH_RECORDS=0`` skips it.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from booklog.config import Ingest, Store  # noqa: E402
from booklog.plans.event_log import event_records, read_events  # noqa: E402
from booklog.registry import queries  # noqa: E402
from booklog.registry.queries import broker_records  # noqa: E402
from booklog.registry.stores import log_cube, published  # noqa: E402
from booklog.session import local_session  # noqa: E402
from booklog.sinks.cube import publish_metrics  # noqa: E402
from booklog.sinks.publication import publish  # noqa: E402
from booklog.sinks.snapshot import export_snapshot  # noqa: E402
from booklog.sources.broker import record_file_stream  # noqa: E402
from booklog.sources.serving import ServingPaths  # noqa: E402
from booklog.streaming.query import start_query  # noqa: E402

HEADLINE = (
    "rec_classify",
    "tok_explode",
    "agg_hourly_deltas",
    "agg_quality",
    "env_classify",
    "env_strict_check",
    "agg_topic_verify",
    "agg_profile_totals",
    "agg_fingerprints",
    "agg_pipeline_inspect",
    "win_contiguous_prefix",
    "join_reconcile",
    "q_overview",
    "q_timeline",
    "q_airline_ranking",
    "q_airline_timeline",
    "q_heatmap",
    "str_trigger_available_now",
)
TIMES = 3
# Records of the published full run.
FULL_RUN_RECORDS = 2_563_566


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def landed(spark: SparkSession, sf_dir: str, cpus: int) -> str:
    root = folder()
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(cpus).write.parquet(f"{root}/events.parquet")
    return root


def publishing(spark: SparkSession, sf_dir: str) -> dict[str, list[float]]:
    """The export of the cube, and a first, a repeated and a forced publication of it."""
    found: dict[str, list[float]] = {}
    cube_folder = f"{folder()}/cube"
    log_cube(spark, sf_dir).write.parquet(cube_folder)
    cube = spark.read.parquet(cube_folder)
    for _ in range(TIMES):
        root, made = folder(), []
        steps = {
            "export": lambda: made.append(export_snapshot(spark, cube, f"{root}/snapshot", "root", "v1")),
            "publish_first": lambda: publish(spark, made[0], ServingPaths(f"{root}/serving")),
            "publish_repeat": lambda: publish(spark, made[0], ServingPaths(f"{root}/serving")),
            "publish_forced": lambda: publish(spark, made[0], ServingPaths(f"{root}/serving"), force=True),
        }
        for name, step in steps.items():
            found.setdefault(name, []).append(timed(step))
    return found


def two_waves(spark: SparkSession, sf_dir: str) -> float:
    """40 and 60 records on one checkpoint, a merge after each."""
    root = folder()
    job = Ingest(Store(f"{root}/data"), f"{root}/checkpoint")
    records = broker_records(spark, sf_dir).limit(100).persist()
    waves = (records.limit(40), records.offset(40))

    def run():
        for wave in waves:
            wave.write.mode("append").parquet(f"{root}/records")
            start_query(record_file_stream(spark, f"{root}/records"), job).awaitTermination()
            publish_metrics(spark, job.store)

    seconds = timed(run)
    records.unpersist()
    return seconds


def full_run(spark: SparkSession, sf_dir: str, records: int) -> tuple[int, float]:
    root = folder()
    events = read_events(spark, sf_dir)
    count = events.count()
    copies = -(-records // count)
    repeated = events.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    shifted = repeated.withColumn("event_id", F.col("event_id") + F.col("copy") * count).drop("copy")
    limited = shifted.filter(F.col("event_id") < records).repartition(24)
    event_records(limited).write.parquet(f"{root}/records")
    job = Ingest(Store(f"{root}/data"), f"{root}/checkpoint")

    def ingest():
        start_query(record_file_stream(spark, f"{root}/records"), job).awaitTermination()
        publish_metrics(spark, job.store)

    return records, timed(ingest)


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session("booklog-bench", cpus)
    sf_dir = landed(spark, given, cpus)
    registered = queries()
    # Warm the JVM and store what the serving and audit queries read.
    timed(lambda: registered["rec_status"](spark, sf_dir).collect())
    published(spark, sf_dir)
    registered["agg_pipeline_inspect"](spark, sf_dir).collect()
    seconds = {
        name: median(
            timed(lambda: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
            for _ in range(TIMES)
        )
        for name in HEADLINE
    }
    seconds |= {name: median(values) for name, values in publishing(spark, sf_dir).items()}
    seconds["two_wave_restart"] = two_waves(spark, sf_dir)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(given).name.removeprefix("sf"),
    }
    records = int(os.environ.get("BENCH_RECORDS", FULL_RUN_RECORDS))
    if records:
        records, elapsed = full_run(spark, sf_dir, records)
        result["full_run"] = {
            "records": records,
            "sec": elapsed,
            "records_per_sec": round(records / elapsed),
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
