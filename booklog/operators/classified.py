"""Broker records classified once, then routed to their datasets.

``classify_broker_records`` carries everything the outputs need. Where several outputs
are wanted, persist it: each split below is then a filter over cached rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booklog.operators.envelope import classify_envelopes
from booklog.operators.records import PARSED_COLUMNS, classify_records, clean_columns
from booklog.schema import (
    CLEAN_EVENT,
    DEAD_LETTER,
    ENVELOPE_STAGE,
    QUALITY_METRIC,
    RAW_EVENT,
    RECORD_STAGE,
)

# Every reason that the two classifications give.
ENVELOPE_REASONS = (
    "invalid_json",
    "missing_required_fields",
    "unsupported_schema_version",
    "event_id_mismatch",
    "kafka_key_mismatch",
)
RECORD_REASONS = (
    "blank_line",
    "too_few_fields",
    "missing_group_id",
    "missing_log_type",
    "invalid_date",
    "invalid_hour",
    "unsupported_log_type",
)
FAILURES = [
    *((ENVELOPE_STAGE, reason) for reason in ENVELOPE_REASONS),
    *((RECORD_STAGE, reason) for reason in RECORD_REASONS),
]


def classify_broker_records(records: DataFrame) -> DataFrame:
    """Both classifications in one pass, with the stage and reason of the first failure.

    The message text is kept for records that failed as envelopes only; everywhere else it
    would repeat ``raw_line``.
    """
    broken = F.col("envelope_reason").isNotNull()
    judged = classify_envelopes(records)
    # Emptied before the fields are split, so that no message is copied along with them.
    judged = judged.withColumn("value_text", F.when(broken, F.col("value_text")))
    classified = classify_records(judged)
    stage = F.when(broken, ENVELOPE_STAGE).when(F.col("record_reason").isNotNull(), RECORD_STAGE)
    return classified.select(
        *RAW_EVENT.fieldNames(),
        *PARSED_COLUMNS,
        "value_text",
        stage.alias("failure_stage"),
        F.coalesce("envelope_reason", "record_reason").alias("failure_reason"),
    )


def raw_events(classified: DataFrame) -> DataFrame:
    """Every trusted envelope, whatever its record turned out to be."""
    trusted = ~F.col("failure_stage").eqNullSafe(F.lit(ENVELOPE_STAGE))
    return classified.filter(trusted).select(*RAW_EVENT.fieldNames())


def clean_events(classified: DataFrame) -> DataFrame:
    accepted = classified.filter("failure_reason IS NULL")
    return accepted.select(*clean_columns(RAW_EVENT.fieldNames())).select(*CLEAN_EVENT.fieldNames())


def dead_letters(classified: DataFrame) -> DataFrame:
    return classified.filter("failure_reason IS NOT NULL").select(*DEAD_LETTER.fieldNames())


def quality_metrics(classified: DataFrame, batch_id: int) -> DataFrame:
    """Batch totals and dead letters by reason, from one aggregation.

    The reasons are a closed vocabulary, so the second aggregation gathers at most a dozen
    counts.
    """
    counts = classified.groupBy("failure_stage", "failure_reason").agg(
        F.count(F.lit(1)).alias("records")
    )
    stage, records = F.col("failure_stage"), F.col("records")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, records)), F.lit(0))

    nothing = F.lit(None).cast("string")

    def metric(name: str, failure_stage: Column, failure_reason: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("metric_name"),
            failure_stage.alias("failure_stage"),
            failure_reason.alias("failure_reason"),
            value.alias("metric_value"),
        )

    trusted = ~stage.eqNullSafe(F.lit(ENVELOPE_STAGE))
    totals = (
        ("input_count", total(F.lit(True))),
        ("envelope_valid_count", total(trusted)),
        ("business_valid_count", total(stage.isNull())),
    )
    dead = F.collect_list(
        F.when(
            stage.isNotNull(),
            metric("dead_letter_count", stage, F.col("failure_reason"), records),
        )
    )
    rows = counts.agg(
        F.concat(
            F.array(*[metric(name, nothing, nothing, value) for name, value in totals]), dead
        ).alias("metrics")
    )
    tagged = F.lit(batch_id).cast("long").alias("batch_id")
    return rows.select(F.inline("metrics")).select(tagged, *QUALITY_METRIC.fieldNames()[1:])


def observed_counts() -> list[Column]:
    """Aggregates for ``observe``: all rows, the accepted ones, and those of every failure."""
    stage, reason = F.col("failure_stage"), F.col("failure_reason")
    failures = [
        F.count_if((stage == of) & (reason == why)).alias(f"{of}:{why}") for of, why in FAILURES
    ]
    return [
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(stage.isNull()).alias("business_valid_count"),
        *failures,
    ]


def observed_quality(counts: dict[str, int], batch_id: int) -> list[tuple]:
    """The rows of ``quality_metrics`` from what was observed while the batch was written."""
    dead = {(of, why): counts[f"{of}:{why}"] for of, why in FAILURES}
    if counts["business_valid_count"] + sum(dead.values()) != counts["input_count"]:
        raise ValueError("a record failed for a reason that is not in the vocabulary")
    broken = sum(number for (of, _), number in dead.items() if of == ENVELOPE_STAGE)
    totals = (
        ("input_count", counts["input_count"]),
        ("envelope_valid_count", counts["input_count"] - broken),
        ("business_valid_count", counts["business_valid_count"]),
    )
    rows = [(batch_id, name, None, None, number) for name, number in totals]
    failed = [(batch_id, "dead_letter_count", *key, number) for key, number in dead.items()]
    return rows + [row for row in failed if row[-1]]


def quality_union(classified: DataFrame, batch_id: int) -> DataFrame:
    """The rows of ``quality_metrics`` as two frames united: totals, and dead letters by reason.

    Each frame is an aggregation of its own, so persist ``classified`` first.
    """
    stage = F.col("failure_stage")
    totals = (
        ("input_count", F.count(F.lit(1))),
        ("envelope_valid_count", F.count_if(~stage.eqNullSafe(F.lit(ENVELOPE_STAGE)))),
        ("business_valid_count", F.count_if(stage.isNull())),
    )
    named = classified.agg(
        F.array(
            *[F.struct(F.lit(name).alias("metric_name"), value.alias("metric_value")) for name, value in totals]
        ).alias("totals")
    ).select(F.inline("totals"))
    reasons = dead_letters(classified).groupBy("failure_stage", "failure_reason")
    counted = reasons.agg(F.count(F.lit(1)).alias("metric_value"))
    united = named.unionByName(
        counted.withColumn("metric_name", F.lit("dead_letter_count")), allowMissingColumns=True
    )
    tagged = F.lit(batch_id).cast("long").alias("batch_id")
    return united.select(tagged, *QUALITY_METRIC.fieldNames()[1:])


def batch_summary(quality: DataFrame) -> DataFrame:
    """The four counts of each batch, read from its quality metrics."""
    value, name = F.col("metric_value"), F.col("metric_name")
    names = ("input_count", "envelope_valid_count", "business_valid_count", "dead_letter_count")
    return quality.groupBy("batch_id").agg(
        *[F.coalesce(F.sum(F.when(name == n, value)), F.lit(0)).alias(n) for n in names]
    )
