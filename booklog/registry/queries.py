"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.operators import (
    audit,
    classified,
    envelope,
    metrics,
    profile,
    records,
    serving,
    snapshot_checks,
)
from booklog.plans.event_log import dealt_events, event_envelopes, event_records, read_events
from booklog.registry.stores import log_cube, log_lines, published
from booklog.schema import MEASURES, SNAPSHOT_COLUMNS
from booklog.sources import serving as publications

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        _REGISTRY[name] = build
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published table, as the analytical queries read it."""
    return publications.serving_table(spark, published(spark, sf_dir))


def _iso(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- records ---------------------------------------------------------------------------


@query("rec_split_fields")
def _(spark, sf_dir):
    return records.split_fields(log_lines(spark, sf_dir)).drop("raw_line")


@query("rec_parse_hour")
def _(spark, sf_dir):
    fields = records.split_fields(log_lines(spark, sf_dir))
    hour = records.parse_hour(F.col("event_hour_text")).alias("event_hour")
    return fields.groupBy("event_hour_text", hour).agg(F.count(F.lit(1)).alias("records"))


@query("rec_parse_date")
def _(spark, sf_dir):
    fields = records.split_fields(log_lines(spark, sf_dir))
    counts = fields.groupBy("event_date").agg(F.count(F.lit(1)).alias("records"))
    parsed = F.date_format(records.parse_date(F.col("event_date")), "yyyy-MM-dd")
    return counts.withColumn("parsed_date", parsed)


@query("rec_classify")
def _(spark, sf_dir):
    classified = records.classify_records(log_lines(spark, sf_dir))
    return classified.select("line_number", "raw_line", "record_reason")


@query("rec_status")
def _(spark, sf_dir):
    parsed = records.parsed_records(log_lines(spark, sf_dir))
    return parsed.groupBy("parse_status").agg(F.count(F.lit(1)).alias("records"))


@query("rec_split_clean")
def _(spark, sf_dir):
    return records.clean_records(log_lines(spark, sf_dir))


@query("rec_split_dead")
def _(spark, sf_dir):
    return records.dead_records(log_lines(spark, sf_dir))


@query("tok_explode")
def _(spark, sf_dir):
    tokens = metrics.token_rows(records.clean_records(log_lines(spark, sf_dir)))
    place = F.col("place").alias("token_ordinal")
    return tokens.select("line_number", "event_date", "event_hour", place, "airline_code")


# --- serving ---------------------------------------------------------------------------


@query("q_overview")
def _(spark, sf_dir):
    result = serving.overview(served(spark, sf_dir))
    newest = publications.current_publication(spark, published(spark, sf_dir)).first()
    is_newest = F.col("publication_id") == newest.publication_id
    return result.withColumns(
        {
            "start_date": _iso("start_date"),
            "end_date": _iso("end_date"),
            # Ids are random, so the query tells whether it is the newest.
            "publication_id": F.when(is_newest, "current").otherwise("other"),
        }
    )


@query("q_timeline")
def _(spark, sf_dir):
    return serving.timeline(served(spark, sf_dir)).withColumn("stat_date", _iso("stat_date"))


def inner_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served rows without those of the first and the last day."""
    rows = served(spark, sf_dir)
    ends = rows.agg(F.date_add(F.min("stat_date"), 1), F.date_sub(F.max("stat_date"), 1)).first()
    return serving.in_dates(rows, *ends)


@query("q_timeline_range")
def _(spark, sf_dir):
    return serving.timeline(inner_days(spark, sf_dir)).withColumn("stat_date", _iso("stat_date"))


@query("q_heatmap_range")
def _(spark, sf_dir):
    return serving.heatmap(inner_days(spark, sf_dir), limit=4)


@query("q_ranking_by_tokens")
def _(spark, sf_dir):
    return serving.airline_ranking(served(spark, sf_dir), by=MEASURES[1])


@query("q_airline_share")
def _(spark, sf_dir):
    return serving.airline_shares(served(spark, sf_dir))


@query("q_airline_count")
def _(spark, sf_dir):
    return serving.airline_count(served(spark, sf_dir))


@query("q_airline_ranking")
def airline_ranking(spark, sf_dir):
    return serving.airline_ranking(served(spark, sf_dir))


@query("q_airline_timeline")
def _(spark, sf_dir):
    result = serving.airline_timeline(served(spark, sf_dir), "ca")
    return result.withColumn("stat_date", _iso("stat_date"))


@query("q_heatmap")
def _(spark, sf_dir):
    return serving.heatmap(served(spark, sf_dir), limit=4)


@query("set_heatmap_axes")
def _(spark, sf_dir):
    return serving.heatmap_axes(serving.heatmap(served(spark, sf_dir), limit=4))


@query("win_airline_rank")
def _(spark, sf_dir):
    return serving.ranked_airlines(served(spark, sf_dir), limit=4)


@query("join_ranked_airlines")
def _(spark, sf_dir):
    rows = served(spark, sf_dir)
    best = serving.ranked_airlines(rows, limit=4).select("airline_code", "airline_rank")
    return rows.join(F.broadcast(best), "airline_code").select(
        "airline_rank", "airline_code", _iso("stat_date"), "stat_hour", *MEASURES
    )


# --- envelopes -------------------------------------------------------------------------


def broker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(dealt_events(read_events(spark, sf_dir)))


def classified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified.classify_broker_records(broker_records(spark, sf_dir))


def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified.clean_events(classified_records(spark, sf_dir))


def _micros(df: DataFrame) -> DataFrame:
    """Broker time as a number, which compares alike in every engine."""
    return df.withColumn("kafka_timestamp", F.unix_micros("kafka_timestamp"))


@query("env_event_id")
def _(spark, sf_dir):
    return event_envelopes(read_events(spark, sf_dir)).select("source_line_number", "event_id")


@query("env_group_id")
def _(spark, sf_dir):
    return event_envelopes(read_events(spark, sf_dir)).select("source_line_number", "group_id")


@query("env_kafka_key")
def _(spark, sf_dir):
    encoded = envelope.encode_envelopes(event_envelopes(read_events(spark, sf_dir)))
    return encoded.select("partition", "offset", F.col("key").cast("string").alias("key"))


@query("env_build")
def _(spark, sf_dir):
    encoded = envelope.encode_envelopes(event_envelopes(read_events(spark, sf_dir)))
    return encoded.select(*[F.col(name).cast("string").alias(name) for name in ("key", "value")])


@query("env_decode")
def _(spark, sf_dir):
    return _micros(envelope.decode_records(broker_records(spark, sf_dir)))


@query("env_classify")
def _(spark, sf_dir):
    classes = envelope.classify_envelopes(broker_records(spark, sf_dir))
    return classes.select("partition", "offset", "envelope_reason")


@query("env_split_valid")
def _(spark, sf_dir):
    return _micros(envelope.valid_envelopes(broker_records(spark, sf_dir)))


@query("env_split_dead")
def _(spark, sf_dir):
    return _micros(envelope.dead_envelopes(broker_records(spark, sf_dir)))


@query("env_strict_check")
def _(spark, sf_dir):
    verdicts = envelope.verify_strictly(broker_records(spark, sf_dir))
    return verdicts.select("partition", "offset", "verified_id", "violation")


# --- metrics ---------------------------------------------------------------------------


def accepted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_rows(accepted_events(spark, sf_dir))


@query("agg_token_counts")
def _(spark, sf_dir):
    return metrics.token_counts(accepted_tokens(spark, sf_dir))


@query("set_dedupe_event_airline")
def _(spark, sf_dir):
    return metrics.distinct_event_airlines(accepted_tokens(spark, sf_dir))


@query("agg_response_counts")
def _(spark, sf_dir):
    return metrics.response_counts(accepted_tokens(spark, sf_dir))


@query("join_delta_metrics")
def _(spark, sf_dir):
    tokens = accepted_tokens(spark, sf_dir)
    return metrics.join_metrics(metrics.response_counts(tokens), metrics.token_counts(tokens))


@query("agg_hourly_deltas")
def hourly_deltas(spark, sf_dir):
    return metrics.hourly_deltas(accepted_events(spark, sf_dir), batch_id=7)


@query("agg_merge_metrics")
def _(spark, sf_dir):
    """Each broker partition taken as a batch of its own."""
    clean = accepted_events(spark, sf_dir)
    return metrics.merge_metrics(metrics.event_metrics(clean, "partition"))


@query("agg_quality")
def quality(spark, sf_dir):
    return classified.quality_metrics(classified_records(spark, sf_dir), batch_id=7)


@query("agg_batch_summary")
def _(spark, sf_dir):
    return classified.batch_summary(quality(spark, sf_dir))


@query("set_quality_union")
def _(spark, sf_dir):
    return classified.quality_union(classified_records(spark, sf_dir), batch_id=7)


@query("set_dead_union")
def _(spark, sf_dir):
    return _micros(classified.dead_letters(classified_records(spark, sf_dir)))



# --- audits ----------------------------------------------------------------------------


@query("agg_topic_verify")
def topic_verify(spark, sf_dir):
    return audit.verify_topic(broker_records(spark, sf_dir))


@query("agg_partition_counts")
def _(spark, sf_dir):
    return audit.partition_counts(broker_records(spark, sf_dir))


@query("agg_partition_offsets")
def _(spark, sf_dir):
    return audit.partition_offsets(broker_records(spark, sf_dir))


@query("join_reconcile")
def _(spark, sf_dir):
    """The cube behind damaged envelopes against the cube of all lines."""
    accepted = metrics.event_metrics(accepted_events(spark, sf_dir))
    return audit.reconcile(accepted, log_cube(spark, sf_dir))


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that arrived in trusted envelopes."""
    rows = classified.raw_events(classified_records(spark, sf_dir))
    return rows.select("source_file", "source_line_number")


def spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed lines, and again with every seventh in a source of its own."""
    number = F.col("source_line_number")
    own = F.struct("source_file", "source_line_number")
    spread = F.struct(
        F.concat("source_file", F.lit("-"), number % 7).alias("source_file"),
        F.floor((number + 6) / F.lit(7)).alias("source_line_number"),
    )
    return landed_lines(spark, sf_dir).select(F.inline(F.array(own, spread)))


@query("win_contiguous_prefix")
def contiguous_prefix(spark, sf_dir):
    """Every seventh line begins a gap-free source of its own."""
    return audit.confirmed_prefix(spread_lines(spark, sf_dir))


@query("win_line_gaps")
def _(spark, sf_dir):
    return audit.line_gaps(landed_lines(spark, sf_dir))


# --- profile ---------------------------------------------------------------------------


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_counts(log_lines(spark, sf_dir))


@query("agg_profile_totals")
def profile_totals(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    row = audit.one_row(
        profile.profile_totals(line_counts(spark, sf_dir), log_cube(spark, sf_dir)),
        profile.duplicate_totals(profile.line_copies(lines)),
    )
    joined = {
        name: F.array_join(F.col(name).cast("array<string>"), ",")
        for name in ("observed_hours", "airline_codes")
    }
    return row.withColumns(joined)


@query("agg_log_types")
def _(spark, sf_dir):
    return profile.log_type_counts(line_counts(spark, sf_dir))


@query("agg_failure_reasons")
def _(spark, sf_dir):
    return profile.failure_reason_counts(line_counts(spark, sf_dir))


@query("agg_fingerprints")
def fingerprints(spark, sf_dir):
    return profile.duplicate_totals(profile.line_copies(log_lines(spark, sf_dir)))


@query("sort_duplicates")
def _(spark, sf_dir):
    return profile.duplicate_fingerprints(profile.line_copies(log_lines(spark, sf_dir)))


@query("lim_invalid_records")
def _(spark, sf_dir):
    return profile.invalid_records(log_lines(spark, sf_dir))


# --- snapshots and publications --------------------------------------------------------


def log_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_checks.to_snapshot(log_cube(spark, sf_dir))


@query("snap_check_row")
def _(spark, sf_dir):
    """The cube with one kind of damage per hour of the day."""
    hour = F.col("stat_hour")
    responses, tokens = map(F.col, SNAPSHOT_COLUMNS[3:])
    damaged = log_snapshot(spark, sf_dir).withColumns(
        {
            "stat_date": F.when(hour == 1, F.substring("stat_date", 1, 7)).otherwise(
                F.col("stat_date")
            ),
            "airline_code": F.when(hour == 2, F.lower("airline_code")).otherwise(
                F.col("airline_code")
            ),
            SNAPSHOT_COLUMNS[3]: F.when(hour == 3, -responses).otherwise(responses),
            SNAPSHOT_COLUMNS[4]: F.when(hour == 4, responses - 1).otherwise(tokens),
            "stat_hour": F.when(hour == 5, 24).otherwise(hour),
        }
    )
    return snapshot_checks.checked_rows(damaged)


@query("snap_check_keys")
def _(spark, sf_dir):
    """Hours 12 and 13 folded together, so that keys repeat."""
    rows = log_snapshot(spark, sf_dir)
    hour = F.when(F.col("stat_hour") == 13, 12).otherwise(F.col("stat_hour"))
    return snapshot_checks.duplicate_keys(rows.withColumn("stat_hour", hour))


@query("agg_snapshot_totals")
def _(spark, sf_dir):
    return snapshot_checks.snapshot_totals(log_snapshot(spark, sf_dir))


def daily_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication log with one attempt per day of the log, every fifth one failed."""
    day = F.to_timestamp("event_date", "yyyyMMdd")
    failed = F.dayofmonth(day) % 5 == 0
    return (
        log_cube(spark, sf_dir)
        .groupBy("event_date")
        .agg(
            F.count(F.lit(1)).alias("source_row_count"),
            *[F.sum(name).alias(name) for name in MEASURES],
        )
        .select(
            F.concat(F.lit("day-"), "event_date").alias("publication_id"),
            F.concat(F.lit("root-"), F.dayofmonth(day) % 2).alias("source_hdfs_root"),
            F.lit("v1").alias("output_version"),
            "source_row_count",
            *MEASURES,
            F.sha2(F.substring("event_date", 1, 7), 256).alias("metrics_sha256"),
            F.when(failed, "failed").otherwise("published").alias("status"),
            F.when(failed, "refused").alias("failure_message"),
            day.alias("started_at"),
            F.timestamp_add("MINUTE", F.lit(5), day).alias("completed_at"),
        )
    )


def daily_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving rows, each day's under that day's publication."""
    return serving.serving_rows(
        log_cube(spark, sf_dir),
        F.concat(F.lit("day-"), "event_date"),
        F.lit(None).cast("timestamp"),
    )


def _plain_times(df: DataFrame) -> DataFrame:
    times = [name for name in ("started_at", "completed_at") if name in df.columns]
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in times})


@query("src_serving")
def _(spark, sf_dir):
    rows = served(spark, sf_dir).drop("updated_at", "publication_id")
    return rows.withColumn("stat_date", _iso("stat_date"))


@query("q_latest_publication")
def _(spark, sf_dir):
    return _plain_times(publications.latest_publication(daily_publications(spark, sf_dir)))


@query("q_recent_publications")
def _(spark, sf_dir):
    return _plain_times(publications.recent_publications(daily_publications(spark, sf_dir)))


@query("q_find_publication")
def _(spark, sf_dir):
    """The newest publication with the digest that the first day of the log has."""
    log = daily_publications(spark, sf_dir)
    digest = log.agg(F.min_by("metrics_sha256", "started_at")).first()[0]
    return _plain_times(publications.find_publication(log, "root-1", "v1", digest))


@query("join_exists_current")
def _(spark, sf_dir):
    """Publications of which rows are being served."""
    served_ids = publications.is_served(
        daily_serving(spark, sf_dir), daily_publications(spark, sf_dir)
    )
    return served_ids.select("publication_id", "status")


@query("join_scalar_current_hash")
def _(spark, sf_dir):
    return publications.served_digest(
        daily_serving(spark, sf_dir), daily_publications(spark, sf_dir)
    )


@query("agg_stage_verify")
def _(spark, sf_dir):
    """Totals of one publication's rows: the newest."""
    rows, log = daily_serving(spark, sf_dir), daily_publications(spark, sf_dir)
    newest = publications.latest_publication(log).select("publication_id")
    staged = rows.join(F.broadcast(newest), "publication_id", "left_semi")
    return publications.serving_totals(staged).drop("publication_count")


@query("agg_serving_verify")
def _(spark, sf_dir):
    return publications.serving_totals(daily_serving(spark, sf_dir))
