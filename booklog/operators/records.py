"""Parsing and first-match classification of raw log lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booklog.functions import evaluate_once, split_stripped
from booklog.schema import (
    LOG_TYPES,
    RECORD_STAGE,
    STATUS_INVALID,
    STATUS_UNSUPPORTED,
    STATUS_VALID,
)

LEADING_FIELDS = 5
PARSED_COLUMNS = ("field_group_id", "log_type", "event_date", "event_hour", "event_time")


def parse_hour(text: Column) -> Column:
    """Whole number or null; the range is judged by the classifier."""
    return text.try_cast("int")


def parse_date(text: Column) -> Column:
    """Calendar date of exactly eight digits from year 1 on, else null.

    Cast from its ISO form, which takes a fraction of the time that a pattern takes.
    """
    year, month, day = (F.substring(text, *place) for place in ((1, 4), (5, 2), (7, 2)))
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    return F.when(text.rlike(r"^(?!0000)[0-9]{8}\z"), iso.try_cast("date"))


def split_fields(lines: DataFrame) -> DataFrame:
    """Split on every comma, keeping empty fields; add the five leading fields and the count."""
    fields = evaluate_once(lines, "fields", split_stripped(F.col("raw_line"), -1))
    return fields.select(
        *lines.columns, *_leading_fields(), F.size("fields").alias("field_count")
    )


def _field(position: int) -> Column:
    return F.trim(F.try_element_at("fields", F.lit(position)))


def _leading_fields() -> list[Column]:
    names = ("field_group_id", "log_type", "event_date", "event_hour_text", "event_time")
    return [_field(position).alias(name) for position, name in enumerate(names, 1)]


def record_reason() -> Column:
    """First business rule that a split record breaks, null when it breaks none."""
    hour = F.col("event_hour")
    is_blank = (F.col("field_count") == 1) & (F.col("field_group_id") == "")
    return (
        F.when(is_blank, "blank_line")
        .when(F.col("field_count") < LEADING_FIELDS, "too_few_fields")
        .when(F.col("field_group_id") == "", "missing_group_id")
        .when(F.col("log_type") == "", "missing_log_type")
        .when(parse_date(F.col("event_date")).isNull(), "invalid_date")
        .when(hour.isNull() | ~hour.between(0, 23), "invalid_hour")
        .when(~F.col("log_type").isin(*LOG_TYPES), "unsupported_log_type")
    )


def classify_records(lines: DataFrame) -> DataFrame:
    """Add the parsed fields and ``record_reason`` to rows that carry ``raw_line``.

    Only the first five fields matter, so the payload is never split: the limit leaves it
    in one piece. ``field_count`` is exact up to that limit.
    """
    split = evaluate_once(
        lines, "fields", split_stripped(F.col("raw_line"), LEADING_FIELDS + 1)
    )
    fields = split.select(
        *lines.columns, *_leading_fields(), F.size("fields").alias("field_count")
    )
    parsed = fields.withColumn("event_hour", parse_hour(F.col("event_hour_text")))
    return parsed.select(
        *lines.columns, *PARSED_COLUMNS, "field_count", record_reason().alias("record_reason")
    )


def record_status(reason: Column) -> Column:
    return (
        F.when(reason.isNull(), STATUS_VALID)
        .when(reason == "unsupported_log_type", STATUS_UNSUPPORTED)
        .otherwise(STATUS_INVALID)
    )


def parsed_records(lines: DataFrame) -> DataFrame:
    """One parsed record per line: a rejected record keeps only what precedes its fault."""
    classified = classify_records(lines)
    reason = F.coalesce(F.col("record_reason"), F.lit(""))
    complete = reason.isin("", "unsupported_log_type")
    keeps_date = complete | (reason == "invalid_hour")
    keeps_both = keeps_date | (reason == "invalid_date")

    def kept(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name))

    others = [name for name in lines.columns if name != "group_id"]
    return classified.select(
        *others,
        kept(keeps_both | (reason == "missing_log_type"), "field_group_id").alias("group_id"),
        kept(keeps_both | (reason == "missing_group_id"), "log_type").alias("log_type"),
        kept(keeps_date, "event_date").alias("event_date"),
        kept(complete, "event_hour").alias("event_hour"),
        kept(complete, "event_time").alias("event_time"),
        record_status(F.col("record_reason")).alias("parse_status"),
        F.col("record_reason").alias("failure_reason"),
    )


def clean_columns(columns: list[str]) -> list[Column]:
    """The input columns, with the group taken from field one, then the parsed fields."""
    kept = [
        F.col("field_group_id").alias("group_id") if name == "group_id" else F.col(name)
        for name in columns
    ]
    return [*kept, *map(F.col, ("log_type", "event_date", "event_hour", "event_time"))]


def clean_records(lines: DataFrame) -> DataFrame:
    classified = classify_records(lines)
    return classified.filter("record_reason IS NULL").select(*clean_columns(lines.columns))


def dead_records(lines: DataFrame) -> DataFrame:
    classified = classify_records(lines)
    return classified.filter("record_reason IS NOT NULL").select(
        *lines.columns,
        F.lit(RECORD_STAGE).alias("failure_stage"),
        F.col("record_reason").alias("failure_reason"),
    )
