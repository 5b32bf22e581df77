"""Registered queries over stored outputs: the log is written, streamed, merged, published.

Every run writes to new folders below the shared checkpoint folder. Queries that only read
what one ingest stored share that ingest within a session.
"""

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.config import Ingest, Store
from booklog.operators.audit import broker_locations
from booklog.operators.metrics import event_metrics
from booklog.operators.snapshot_checks import to_snapshot
from booklog.plans.cycle import inspect_outputs, output_counts, refresh
from booklog.plans.reconcile import reconcile_by_ranges
from booklog.registry.queries import accepted_events, broker_records, query, spread_lines
from booklog.registry.stores import log_cube, log_lines, shared
from booklog.schema import (
    DIMENSIONS,
    HOURLY_METRIC,
    MEASURES,
    RAW_EVENT,
    RECORD_STAGE,
    SNAPSHOT_COLUMNS,
    SNAPSHOT_MANIFEST,
)
from booklog.session import scratch_folder
from booklog.sinks.batch import write_batch
from booklog.sinks.broker import broker_records as envelopes_of
from booklog.sinks.cube import publish_metrics
from booklog.sinks.dated import clean_events_between, file_by_date
from booklog.sinks.parts import PARTS, PARTS_SUMMARY, SUMMARY, export_parts
from booklog.sinks.profile import write_profile
from booklog.sinks.publication import publish
from booklog.sinks.seen_events import distinct_responses, first_batches, fold_batches, fresh_events, record_batch
from booklog.sinks.snapshot import MANIFEST_FILE, METRICS_FILE, export_snapshot
from booklog.sinks.runs import close_runs, merged_runs
from booklog.sources import batches, ledger, storage
from booklog.sources.broker import record_file_stream
from booklog.sources.lines import file_identity, log_lines as read_log_lines, stepwise_identity, tree_identity
from booklog.sources.serving import ServingPaths, publication_log, serving_table
from booklog.sources.snapshot import manifest_violation, snapshot_lines
from booklog.streaming.prefix import live_prefix, start_prefix
from booklog.streaming.query import RowCount, await_rows, start_query


def _settings_below(root: str) -> Ingest:
    return Ingest(Store(f"{root}/data"), f"{root}/checkpoint")


def _settings(spark: SparkSession, purpose: str) -> Ingest:
    return _settings_below(scratch_folder(spark, purpose))


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """The broker records as files, one per partition of the table they derive from."""
    folder = scratch_folder(spark, "records")
    broker_records(spark, sf_dir).write.parquet(folder)
    return folder


def ingested(spark: SparkSession, sf_dir: str) -> Ingest:
    """One ingest of the whole log, stored and merged."""

    def build(root: str) -> None:
        paths = _settings_below(root).store
        write_batch(broker_records(spark, sf_dir), 0, paths)
        publish_metrics(spark, paths)

    return _settings_below(shared(spark, sf_dir, "ingest", build))


def exported(spark: SparkSession, sf_dir: str) -> str:
    """One snapshot of the cube of the whole log."""

    def build(root: str) -> None:
        export_snapshot(spark, log_cube(spark, sf_dir), root, "events-root", "v1")

    return storage.current(spark, shared(spark, sf_dir, "snapshot", build))


def _stage_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("failure_stage", "failure_reason").agg(F.count(F.lit(1)).alias("records"))


# --- sources ---------------------------------------------------------------------------


def _log_text(spark: SparkSession, sf_dir: str) -> str:
    """The log as text files in line order."""
    folder = scratch_folder(spark, "text")
    ordered = log_lines(spark, sf_dir).repartitionByRange("line_number")
    ordered.sortWithinPartitions("line_number").select("raw_line").write.text(folder)
    return folder


@query("src_log_lines")
def _(spark, sf_dir):
    """The log as text files in line order, numbered across them again."""
    numbered = read_log_lines(spark, _log_text(spark, sf_dir), number_across_files=True)
    return numbered.select("line_number", "raw_line")


@query("src_tree_digest")
def tree_digest(spark, sf_dir):
    """The text files of the log as one source, digested by splits."""
    return tree_identity(spark, _log_text(spark, sf_dir), number_across_files=True).drop("source_file")


@query("src_file_identity")
def _(spark, sf_dir):
    """The written snapshot: the one file whose bytes SQL can build too."""
    identity = file_identity(spark, f"{exported(spark, sf_dir)}/{METRICS_FILE}")
    return identity.withColumn("path", F.element_at(F.split("path", "/"), -1))


def table_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the given tables, hashed in parallel; SQL cannot read their bytes."""
    identity = stepwise_identity(spark, f"{sf_dir}/*.parquet")
    return identity.withColumn("path", F.regexp_extract("path", r"([^/]+\.parquet(?:/.*)?)$", 1))


@query("sort_canonical")
def _(spark, sf_dir):
    """The digest of the written canonical file."""
    identity = file_identity(spark, f"{exported(spark, sf_dir)}/{METRICS_FILE}")
    return identity.select(F.col("sha256").alias("metrics_sha256"))


@query("src_parquet_batches")
def _(spark, sf_dir):
    raw = batches.raw_events(spark, ingested(spark, sf_dir).store)
    return raw.select(*RAW_EVENT.fieldNames(), "batch_id").drop("kafka_timestamp")


@query("src_snapshot_csv")
def _(spark, sf_dir):
    return snapshot_lines(spark, f"{exported(spark, sf_dir)}/{METRICS_FILE}")


@query("src_manifest")
def _(spark, sf_dir):
    path = f"{exported(spark, sf_dir)}/{MANIFEST_FILE}"
    return manifest_violation(spark.read.schema(SNAPSHOT_MANIFEST).json(path))


@query("src_kafka_stream")
def _(spark, sf_dir):
    """A stream of broker records, counted per partition by the query it feeds."""
    folder = scratch_folder(spark, "stream")
    records = record_file_stream(spark, _landed(spark, sf_dir)).select("partition", "offset")
    writer = records.writeStream.format("parquet").option("path", f"{folder}/out")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("partition int, offset bigint").parquet(f"{folder}/out")


# --- sinks -----------------------------------------------------------------------------


@query("sink_envelope_kafka")
def _(spark, sf_dir):
    """Messages as they are sent, less the clock reading inside them."""
    messages = envelopes_of(log_lines(spark, sf_dir), "events", "e" * 64)
    text = F.col("value").cast("string")
    fixed = F.regexp_replace(text, '"produced_at":"[^"]*"', '"produced_at":""')
    return messages.select(F.col("key").cast("string").alias("key"), fixed.alias("value"))


@query("sink_batch_outputs")
def _(spark, sf_dir):
    return _stage_counts(batches.dead_letters(spark, ingested(spark, sf_dir).store))


@query("sink_replace_batch")
def _(spark, sf_dir):
    """A batch written in full, then again with the envelope failures only."""
    settings = _settings(spark, "replace")
    records = broker_records(spark, sf_dir)
    write_batch(records, 3, settings.store)
    write_batch(records.filter(F.col("value") == F.lit("not-json").cast("binary")), 3, settings.store)
    return output_sizes(spark, settings)


@query("sink_commit_marker")
def _(spark, sf_dir):
    return batches.commits(spark, ingested(spark, sf_dir).store)


@query("sink_publish_metrics")
def publish_twice(spark, sf_dir):
    """Two batches merged twice; the second merge changes nothing."""
    settings = _settings(spark, "merge")
    records = broker_records(spark, sf_dir)
    for number in (0, 1):
        write_batch(records.filter(F.col("offset") % 2 == number), number, settings.store)
    publish_metrics(spark, settings.store)
    publish_metrics(spark, settings.store)
    return batches.hourly_metrics(spark, settings.store)


def _five_batches(spark: SparkSession, sf_dir: str, purpose: str) -> Ingest:
    """Five batches, the second of them written twice."""
    settings = _settings(spark, purpose)
    records = broker_records(spark, sf_dir)
    for number in (0, 1, 2, 3, 1, 4):
        write_batch(records.filter(F.col("offset") % 5 == number), number, settings.store)
    return settings


@query("agg_levelled_merge")
def levelled_merge(spark, sf_dir):
    """Five batches merged through runs of two and four."""
    paths = _five_batches(spark, sf_dir, "levels").store
    close_runs(spark, paths, fan=2)
    return merged_runs(spark, paths)


def overlapping_batches(spark: SparkSession, sf_dir: str) -> Store:
    """Three batches, each of which holds a quarter of the records again that the last one held."""
    paths = _settings(spark, "seen").store
    records = broker_records(spark, sf_dir)
    for number in (0, 1, 2, 1):
        write_batch(records.filter((F.col("offset") % 4).isin(number, number + 1)), number, paths)
        record_batch(spark, paths, number)
    return paths


@query("set_first_batches")
def first_seen(spark, sf_dir):
    """Every event with the first batch that held it; the first two batches are folded."""
    paths = overlapping_batches(spark, sf_dir)
    fold_batches(spark, paths, before=2)
    found = first_batches(spark, paths)
    return found.select(*DIMENSIONS, F.lower(F.hex("event_key")).alias("event_id"), "first_batch")


@query("set_fresh_events")
def fresh(spark, sf_dir):
    """The events of the second batch that the first one did not hold."""
    found = fresh_events(spark, overlapping_batches(spark, sf_dir), 1)
    return found.select(*DIMENSIONS, F.lower(F.hex("event_key")).alias("event_id"))


@query("agg_distinct_responses")
def distinct_over_batches(spark, sf_dir):
    """Responses over all batches, an event that several of them hold counting once."""
    return distinct_responses(spark, overlapping_batches(spark, sf_dir))


@query("sink_clean_by_date")
def clean_by_date(spark, sf_dir):
    """Two batches under their dates; the second is replayed with fewer records. Inner days."""
    paths = _settings(spark, "dated").store
    records = broker_records(spark, sf_dir)
    for number, kept in ((0, F.col("offset") % 2 == 0), (1, F.col("offset") % 2 == 1), (1, F.col("offset") % 4 == 1)):
        write_batch(records.filter(kept), number, paths)
        file_by_date(spark, paths, number)
    days = clean_events_between(spark, paths).agg(F.min("event_date"), F.max("event_date")).first()
    inner = [(datetime.strptime(day, "%Y%m%d") + timedelta(step)).strftime("%Y%m%d") for day, step in zip(days, (1, -1))]
    found = clean_events_between(spark, paths, *inner)
    return found.select("batch_id", "event_date", "event_hour", "event_id", "log_type")


@query("sink_ledger_snapshot")
def ledger_snapshot(spark, sf_dir):
    """The ledger after its tail became a snapshot, one batch hidden and committed again."""
    paths = _five_batches(spark, sf_dir, "ledger").store
    ledger.compact(spark, paths)
    write_batch(broker_records(spark, sf_dir).filter(F.col("offset") % 5 == 3), 3, paths)
    return batches.commits(spark, paths).select("batch_id", "input_count")


@query("sink_snapshot_csv")
def _(spark, sf_dir):
    path = f"{exported(spark, sf_dir)}/{MANIFEST_FILE}"
    return spark.read.schema(SNAPSHOT_MANIFEST).json(path)


def _stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of all lines, as a table of its own."""
    folder = shared(spark, sf_dir, "cube", lambda root: log_cube(spark, sf_dir).write.parquet(root))
    return spark.read.schema(HOURLY_METRIC).parquet(folder)


def ordered_parts(spark: SparkSession, sf_dir: str) -> str:
    """The snapshot of the whole log in parts of about 500 rows."""
    return export_parts(spark, _stored_cube(spark, sf_dir), scratch_folder(spark, "parts"), 500)


@query("sink_snapshot_parts")
def _(spark, sf_dir):
    """The lines of all parts in order, and the totals that the summary states."""
    folder = ordered_parts(spark, sf_dir)
    summary = spark.read.schema(PARTS_SUMMARY).json(f"{folder}/{SUMMARY}").first()
    lines = read_log_lines(spark, f"{folder}/{PARTS}", number_across_files=True, line_separator="\n")
    totals = [F.lit(summary[name]).alias(name) for name in ("byte_size", "row_count", *MEASURES)]
    return lines.select("line_number", "raw_line", *totals)


@query("join_reconcile_ranges")
def reconcile_ranges(spark, sf_dir):
    """The stored cube behind damaged envelopes against the stored cube of all lines."""
    folder = scratch_folder(spark, "accepted")
    event_metrics(accepted_events(spark, sf_dir)).write.parquet(folder)
    accepted = spark.read.schema(HOURLY_METRIC).parquet(folder)
    return reconcile_by_ranges(spark, accepted, _stored_cube(spark, sf_dir))


@query("sink_publication")
def _(spark, sf_dir):
    """Published, found unchanged, then forced: two log rows, the newest is served."""
    serving = ServingPaths(scratch_folder(spark, "serving"))
    cube = log_cube(spark, sf_dir)
    folder = f"{scratch_folder(spark, 'snapshot')}/current"
    snapshot = export_snapshot(spark, cube, folder, "events-root", "v1")
    for force in (False, False, True):
        publish(spark, snapshot, serving, force)
    served_id = serving_table(spark, serving).select("publication_id").distinct()
    log = publication_log(spark, serving)
    is_served = log.join(
        F.broadcast(served_id).withColumn("served", F.lit(True)), "publication_id", "left"
    )
    return is_served.select(
        "source_hdfs_root",
        "source_row_count",
        *MEASURES,
        "metrics_sha256",
        "status",
        F.coalesce("served", F.lit(False)).alias("served"),
    )


@query("sink_profile")
def _(spark, sf_dir):
    """The four artifacts of a text file of the log, reduced to one row."""
    folder = scratch_folder(spark, "profile")
    log_lines(spark, sf_dir).select("raw_line").write.text(f"{folder}/log")
    row = write_profile(spark, f"{folder}/log", f"{folder}/artifacts")
    return row.select(
        "physical_line_count",
        "blank_line_count",
        "valid_count",
        "invalid_count",
        "unsupported_count",
        "total_success_tokens",
        "successful_response_records",
        "duplicate_record_count",
        "duplicate_group_count",
    )


# --- streams ---------------------------------------------------------------------------


def output_sizes(spark: SparkSession, settings: Ingest) -> DataFrame:
    """Rows per stored dataset."""
    paths = settings.store
    sizes = {
        "raw_events": batches.raw_events(spark, paths),
        "clean_events": batches.clean_events(spark, paths),
        "dead_letter": batches.dead_letters(spark, paths),
        "hourly_airline_deltas": batches.hourly_deltas(spark, paths),
    }
    parts = [
        df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("records"))
        for name, df in sizes.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _streamed(spark: SparkSession, sf_dir: str) -> Ingest:
    settings = _settings(spark, "stream")
    stream = record_file_stream(spark, _landed(spark, sf_dir))
    start_query(stream, settings).awaitTermination()
    return settings


@query("str_start_query")
def _(spark, sf_dir):
    return inspect_outputs(spark, _streamed(spark, sf_dir).store)


@query("str_trigger_available_now")
def stream_and_merge(spark, sf_dir):
    settings = _streamed(spark, sf_dir)
    publish_metrics(spark, settings.store)
    return batches.hourly_metrics(spark, settings.store)


@query("str_trigger_processing_time")
def _(spark, sf_dir):
    """The same rows through the interval trigger, stopped once all were seen."""
    settings = replace(_settings(spark, "interval"), every="1 second")
    folder = _landed(spark, sf_dir)
    expected = spark.read.parquet(folder).count()
    await_rows(start_query(record_file_stream(spark, folder), settings), expected)
    return inspect_outputs(spark, settings.store)


@query("str_resume")
def _(spark, sf_dir):
    """Two waves of files on one checkpoint: the second start reads the second wave only."""
    settings, folder = _settings(spark, "resume"), scratch_folder(spark, "waves")
    records = broker_records(spark, sf_dir)
    for wave in (F.col("offset") % 5 < 2, F.col("offset") % 5 >= 2):
        records.filter(wave).write.mode("append").parquet(folder)
        start_query(record_file_stream(spark, folder), settings).awaitTermination()
    return batches.commits(spark, settings.store).select("batch_id", "input_count")


@query("str_persist_batch")
def _(spark, sf_dir):
    return output_sizes(spark, ingested(spark, sf_dir))


@query("str_single_scan")
def _(spark, sf_dir):
    """Records stamped at random as they are read: all outputs show the stamp of one reading."""
    settings = _settings(spark, "scan")
    moment = F.timestamp_micros((F.rand() * 10**15).cast("long"))
    write_batch(broker_records(spark, sf_dir).withColumn("timestamp", moment), 0, settings.store)
    key = ["partition", "offset", "kafka_timestamp"]
    raw = batches.raw_events(spark, settings.store).select(*key).withColumn("in_raw", F.lit(1))
    clean = batches.clean_events(spark, settings.store)
    dead = batches.dead_letters(spark, settings.store).filter(F.col("failure_stage") == RECORD_STAGE)
    outputs = clean.select(F.lit("clean_events").alias("dataset"), *key).unionByName(
        dead.select(F.lit("dead_letter").alias("dataset"), *key)
    )
    joined = outputs.join(raw, key, "left").groupBy("dataset")
    return joined.agg(F.count(F.lit(1)).alias("records"), F.count("in_raw").alias("same_reading"))


@query("str_progress")
def _(spark, sf_dir):
    """Three batches of a third of the files each, counted by a listener as they end."""
    settings, folder = _settings(spark, "progress"), _landed(spark, sf_dir)
    files = sum(name.startswith("part-") for name in storage.children(spark, folder))
    stream = record_file_stream(spark, folder, files_per_batch=max(1, -(-files // 3)))
    counted = RowCount()
    spark.streams.addListener(counted)
    try:
        start_query(stream, settings).awaitTermination()
        rows = counted.total()
    finally:
        spark.streams.removeListener(counted)
    dead = batches.commits(spark, settings.store).agg(F.sum("dead_letter_count").alias("dead_letter_count"))
    return dead.select(F.lit(rows).cast("long").alias("input_count"), "dead_letter_count")


@query("str_confirmed_prefix")
def streamed_prefix(spark, sf_dir):
    """The landed lines of ``win_contiguous_prefix`` as a stream of three batches."""
    folder, landed = scratch_folder(spark, "prefix"), scratch_folder(spark, "landed")
    spread_lines(spark, sf_dir).write.parquet(landed)
    files = sum(name.startswith("part-") for name in storage.children(spark, landed))
    reader = spark.readStream.schema("source_file string, source_line_number bigint")
    lines = reader.option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(landed)
    start_prefix(lines, f"{folder}/runs", f"{folder}/checkpoint").awaitTermination()
    return live_prefix(spark, f"{folder}/runs")


@query("agg_pipeline_inspect")
def _(spark, sf_dir):
    return inspect_outputs(spark, ingested(spark, sf_dir).store)


@query("set_kafka_locations")
def _(spark, sf_dir):
    paths = ingested(spark, sf_dir).store
    return broker_locations(batches.raw_events(spark, paths), batches.dead_letters(spark, paths))


@query("agg_validate_outputs")
def _(spark, sf_dir):
    return output_counts(spark, ingested(spark, sf_dir).store)


@query("str_refresh_cycle")
def _(spark, sf_dir):
    """The whole chain twice; nothing new arrives, so the second run changes nothing."""
    settings, serving = _settings(spark, "cycle"), ServingPaths(scratch_folder(spark, "serving"))
    landed, snapshots = _landed(spark, sf_dir), f"{scratch_folder(spark, 'snapshot')}/current"
    for _run in range(2):
        refresh(spark, settings, serving, snapshots, record_file_stream(spark, landed))
    rows = to_snapshot(
        serving_table(spark, serving).select(
            F.date_format("stat_date", "yyyyMMdd").alias("event_date"),
            F.col("stat_hour").alias("event_hour"),
            "airline_code",
            *MEASURES,
        )
    )
    return rows.select(*SNAPSHOT_COLUMNS)
