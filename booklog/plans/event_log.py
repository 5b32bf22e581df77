"""A booking log derived from the ``events`` table.

Every expression is row-local, so the log scales with the table and needs no shuffle. Only the
broker records deal the events out first, as each of them costs far more than reading its row.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.functions import evaluate_once, partition_key
from booklog.operators.envelope import build_envelopes, encode_envelopes

SOURCE_FILE = "events"
TOPIC = "gds.raw.v1"

# Airline codes picked by the last digit of a key.
AIRLINE_CODES = ("CZ", "MU", "CA", "HX", "CX", "KA", "HU", "KL", "MF", "3U")

# Events that one task makes records of: the least where cores would idle, and the most.
LEAST_EVENTS, MOST_EVENTS = 10_000, 1_000_000


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the table that the log derives from, read as they lie."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type"
    )


def dealt_events(events: DataFrame) -> DataFrame:
    """The same events in even parts, however the table's files are cut.

    A row group is read by one task, and a file of millions of events may have a single one.
    Three parts a core let a batch of a third of them keep every core busy; more would only add
    tasks. The count reads the footers only. Dealing by the id puts an event into the same part
    again when a task is repeated, and filters on the id still apply before the shuffle.
    """
    found = events.count()
    cores = events.sparkSession.sparkContext.defaultParallelism
    parts = max(min(3 * cores, -(-found // LEAST_EVENTS)), -(-found // MOST_EVENTS), 1)
    return events.repartition(parts, "event_id")


def _code(key: Column) -> Column:
    codes = F.array(*map(F.lit, AIRLINE_CODES))
    return F.element_at(codes, (key % len(AIRLINE_CODES)).cast("int") + 1)


def _raw_line() -> Column:
    user, kind, event = F.col("user_id"), F.col("event_type"), F.col("event_id")
    day, clock = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HH:mm:ss:SSS")
    success = F.concat(_code(user), F.lit(":success;"))
    payload = (
        F.when(
            kind == "purchase",
            F.concat(F.lit(",,1,"), F.repeat(success, (event % 3 + 1).cast("int"))),
        )
        .when(
            kind == "signup", F.concat(F.lit(",,1,"), success, _code(user + 3), F.lit(":success;"))
        )
        .when(kind == "error", F.concat(F.lit(",,1,"), _code(user), F.lit(":fail;")))
        .otherwise(F.concat(F.lit("payload,"), _code(user), F.lit(";,,")))
    )
    log_type = F.when(kind.isin("view", "click"), "ITAREQ").otherwise("ITARES")
    regular = F.concat(
        F.lit("TB.P"), user, F.lit(","), log_type, F.lit(","), day, F.lit(","),
        F.hour("ts"), F.lit(","), clock, F.lit(","), payload,
    )
    fixed_tail = F.lit(",19,19:00:00:000")
    slot = event % 101
    return (
        F.when(slot == 0, "")
        .when(slot == 1, "A,ITARES,20180830")
        .when(slot == 2, F.concat(F.lit(",ITARES,"), day, fixed_tail))
        .when(slot == 3, F.concat(F.lit("A,,"), day, fixed_tail))
        .when(slot == 4, "A,ITARES,20181340,19,19:00:00:000")
        .when(slot == 5, F.concat(F.lit("A,ITARES,"), day, F.lit(",24,19:00:00:000")))
        .when(slot == 6, F.concat(F.lit("A,OTHER,"), day, fixed_tail))
        .otherwise(regular)
    )


def event_lines(events: DataFrame) -> DataFrame:
    """``line_number, raw_line`` with one malformed line of each kind per 101 events."""
    lines = evaluate_once(events, "raw_line", _raw_line())
    return lines.select((F.col("event_id") + 1).alias("line_number"), "raw_line")


def event_envelopes(events: DataFrame) -> DataFrame:
    """Intact envelopes of the log with the broker position of each record."""
    lines = evaluate_once(events, "raw_line", _raw_line()).select(
        (F.col("event_id") + 1).alias("line_number"),
        "raw_line",
        (F.col("event_id") % 103).alias("slot"),
        F.lit(TOPIC).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.floor(F.col("event_id") / F.lit(3)).alias("offset"),
        # The table's times carry no zone; they are taken as UTC in any session.
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
        .cast("timestamp")
        .alias("timestamp"),
    )
    digest = F.sha2(F.lit(SOURCE_FILE), 256)
    return build_envelopes(lines, F.lit(SOURCE_FILE), digest, F.col("timestamp"))


def event_records(events: DataFrame) -> DataFrame:
    """Broker records of the log with each kind of broken envelope once per 103 events."""
    slot = F.col("slot")
    damaged = event_envelopes(events).withColumns(
        {
            "schema_version": F.when(slot == 2, 2).otherwise(F.col("schema_version")),
            "sent_id": F.col("event_id"),
            "event_id": F.when(slot == 3, "0" * 64).otherwise(F.col("event_id")),
        }
    )
    encoded = encode_envelopes(damaged)
    own_key = F.when(slot == 3, partition_key(_json_group(), F.col("sent_id"))).otherwise(
        F.col("key").cast("string")
    )
    key = F.when(slot == 4, "WRONG").otherwise(own_key)
    value = F.when(slot == 0, "not-json").when(slot == 1, "{}").otherwise(
        F.col("value").cast("string")
    )
    return encoded.select(
        key.cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def _json_group() -> Column:
    return F.get_json_object(F.col("value").cast("string"), "$.group_id")
