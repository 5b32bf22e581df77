"""Source quality profile: totals, vocabularies, rejects and duplicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booklog.functions import evaluate_once
from booklog.operators.audit import one_row
from booklog.operators.records import LEADING_FIELDS, classify_records, parsed_records
from booklog.schema import LOG_TYPES, RESPONSE_TYPE, STATUS_INVALID, SUCCESS_TOKEN

DEFAULT_INVALID_LIMIT = 1000
# What a row of ``profile_facts`` tells of.
LINES, SUCCESSES, COPIES = 0, 1, 2


def profile_facts(rows: DataFrame) -> DataFrame:
    """Everything that the profile counts, from one pass over ``split_rows``.

    Each line gives a row for its log type and reason (with its file split), one for its
    digest, and one per success; the three kinds are aggregated by the same shuffle, and
    copies are combined before it.
    """
    classified = classify_records(rows)
    has_type = (F.col("field_count") >= LEADING_FIELDS) & (F.col("log_type") != "")
    valid = F.col("record_reason").isNull()
    counts = valid & (F.col("log_type") == RESPONSE_TYPE) & F.contains("raw_line", F.lit(":success"))
    codes = F.when(counts, F.regexp_extract_all("raw_line", F.lit(SUCCESS_TOKEN), F.lit(1)))
    listed = evaluate_once(classified, "codes", F.coalesce(codes, F.array().cast("array<string>")))

    def fact(kind: int, **columns: Column) -> Column:
        names = {
            "a": "string", "b": "string", "hour": "int", "block": "long", "digest": "binary",
            "day": "int", "hours": "int", "opens": "long", "undecodable": "long", "first_id": "long",
        }
        values = [columns.get(name, F.lit(None)).cast(of).alias(name) for name, of in names.items()]
        return F.struct(F.lit(kind).alias("kind"), *values)

    hour_bit = F.when(valid, F.call_function("shiftleft", F.lit(1), F.col("event_hour")))
    line = fact(
        LINES,
        a=F.when(has_type, F.col("log_type")),
        b=F.concat_ws("\n", F.col("source_file"), F.col("record_reason")),
        block=F.col("block"),
        day=F.when(valid, F.col("event_date").try_cast("int")),
        hours=hour_bit,
        undecodable=(~F.is_valid_utf8("raw_line")).cast("long"),
        first_id=F.col("row_id"),
    )
    copy = fact(COPIES, digest=F.unhex(F.sha2("raw_line", 256)))
    place = F.sequence(F.lit(0), F.size("codes") - 1)
    successes = F.when(
        F.size("codes") > 0,
        F.transform(
            place,
            lambda k: fact(
                SUCCESSES,
                a=F.get("codes", k),
                b=F.col("event_date"),
                hour=F.col("event_hour"),
                opens=(F.array_position("codes", F.get("codes", k)) == k + 1).cast("long"),
            ),
        ),
    )
    facts = listed.select(F.inline(F.concat(F.array(line, copy), F.coalesce(successes, F.slice(F.array(line), 1, 0)))))
    return facts.groupBy("kind", "a", "b", "hour", "block", "digest").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.bit_or("hours").alias("hours"),
        F.sum("opens").alias("opens"),
        F.sum("undecodable").alias("undecodable"),
        F.min("first_id").alias("first_id"),
    )


def facts_of_lines(facts: DataFrame) -> DataFrame:
    """``profile_counts`` per file split."""
    parts = F.split("b", "\n")
    return facts.filter(F.col("kind") == LINES).select(
        F.col("a").alias("log_type"),
        F.get(parts, F.lit(1)).alias("failure_reason"),
        F.get(parts, F.lit(0)).alias("source_file"),
        "block", "records", "first_day", "last_day", "hours", "undecodable", "first_id",
    )


def facts_of_splits(facts: DataFrame) -> DataFrame:
    return facts_of_lines(facts).groupBy("source_file", "block").agg(
        F.min("first_id").alias("first_id"), F.sum("records").alias("lines")
    )


def facts_of_cube(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == SUCCESSES).select(
        F.col("b").alias("event_date"),
        F.col("hour").alias("event_hour"),
        F.col("a").alias("airline_code"),
        F.col("opens").alias("successful_response_records"),
        F.col("records").alias("success_token_count"),
    )


def facts_of_copies(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == COPIES).select("digest", F.col("records").alias("occurrences"))


def profile_counts(lines: DataFrame) -> DataFrame:
    """Line counts and observed dates and hours per log type and failure reason.

    One narrow pass feeds every count of the profile. Dates are numbers and hours are bits
    of a mask, so that the aggregation keeps its buffers in place and hashes. The log type
    is null where the line was rejected before it had one.
    """
    classified = classify_records(lines)
    has_type = (F.col("field_count") >= LEADING_FIELDS) & (F.col("log_type") != "")
    valid = F.col("record_reason").isNull()
    day = F.when(valid, F.col("event_date").try_cast("int"))
    hour_bit = F.when(valid, F.call_function("shiftleft", F.lit(1), F.col("event_hour")))
    return classified.groupBy(
        F.when(has_type, F.col("log_type")).alias("log_type"),
        F.col("record_reason").alias("failure_reason"),
    ).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.bit_or(hour_bit).alias("hours"),
        F.count_if(~F.is_valid_utf8("raw_line")).alias("undecodable"),
    )


def log_type_counts(counts: DataFrame) -> DataFrame:
    """Lines per log type, rejected ones included when they got far enough to have one."""
    return _regrouped(counts, "log_type")


def known_type_counts(counts: DataFrame) -> DataFrame:
    """One row with a map of the contract's log types and of all others together."""
    name = F.when(F.col("log_type").isin(*LOG_TYPES), F.col("log_type")).otherwise("other")
    by_type = log_type_counts(counts).groupBy(name.alias("name")).agg(F.sum("records").alias("records"))
    pairs = F.array_sort(F.collect_list(F.struct("name", "records")))
    return by_type.agg(F.map_from_entries(pairs).alias("log_type_counts"))


def failure_reason_counts(counts: DataFrame) -> DataFrame:
    return _regrouped(counts, "failure_reason")


def _regrouped(counts: DataFrame, name: str) -> DataFrame:
    present = counts.filter(F.col(name).isNotNull())
    return present.groupBy(name).agg(F.sum("records").alias("records"))


def profile_totals(counts: DataFrame, cube: DataFrame) -> DataFrame:
    """One row of totals from the line counts and the cube of the same lines.

    The gathered sets are bounded: 24 hours, 36 x 36 airline codes.
    """
    reason, records = F.col("failure_reason"), F.col("records")
    unsupported = reason == "unsupported_log_type"

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, records)), F.lit(0))

    def day(value: Column) -> Column:
        return F.lpad(value.cast("string"), 8, "0")

    observed = F.expr("filter(sequence(0, 23), h -> getbit(coalesce(hours, 0), h) = 1)")
    line_totals = counts.agg(
        total(F.lit(True)).alias("physical_line_count"),
        total(reason == "blank_line").alias("blank_line_count"),
        total(reason.isNull()).alias("valid_count"),
        total(reason.isNotNull() & ~unsupported).alias("invalid_count"),
        total(unsupported).alias("unsupported_count"),
        day(F.min("first_day")).alias("earliest_date"),
        day(F.max("last_day")).alias("latest_date"),
        F.bit_or("hours").alias("hours"),
    ).select("*", observed.alias("observed_hours"))
    cube_totals = cube.agg(
        F.sort_array(F.collect_set("airline_code")).alias("airline_codes"),
        F.coalesce(F.sum("success_token_count"), F.lit(0)).alias("total_success_tokens"),
        F.coalesce(F.sum("successful_response_records"), F.lit(0)).alias(
            "successful_response_records"
        ),
    )
    return one_row(line_totals.drop("hours"), cube_totals)


def line_copies(lines: DataFrame) -> DataFrame:
    """Occurrences per distinct line, keyed by the raw bytes of its SHA-256.

    Every line is shuffled once; 32 bytes of digest instead of the line or 64 hex digits
    keep that as small as an exact answer allows. Copies are combined before it.
    """
    return lines.groupBy(F.unhex(F.sha2("raw_line", 256)).alias("digest")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )


def duplicate_fingerprints(copies: DataFrame) -> DataFrame:
    """Lines that occur more than once, the most frequent first."""
    repeated = copies.filter("occurrences > 1")
    return repeated.select(F.lower(F.hex("digest")).alias("sha256"), "occurrences").orderBy(
        F.desc("occurrences"), F.asc("sha256")
    )


def duplicate_totals(copies: DataFrame) -> DataFrame:
    repeats = F.col("occurrences") > 1
    return copies.agg(
        F.coalesce(F.sum(F.when(repeats, F.col("occurrences") - 1)), F.lit(0)).alias(
            "duplicate_record_count"
        ),
        F.count_if(repeats).alias("duplicate_group_count"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The invalid lines with their reason; all other columns stay."""
    rejected = parsed_records(lines).filter(F.col("parse_status") == STATUS_INVALID)
    return rejected.select(*lines.columns, "failure_reason")


def first_rejected(rejected: DataFrame, limit: int) -> DataFrame:
    return rejected.select("line_number", "failure_reason", "raw_line").orderBy("line_number").limit(limit)


def invalid_records(lines: DataFrame, limit: int = DEFAULT_INVALID_LIMIT) -> DataFrame:
    """The first invalid lines in line order, as a report; counts never depend on it."""
    if limit < 0:
        raise ValueError("negative limit")
    return first_rejected(rejected_lines(lines), limit)
