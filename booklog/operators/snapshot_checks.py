"""Row, key, order and total checks of a snapshot of the hourly cube."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from booklog.operators.records import parse_date
from booklog.schema import AIRLINE_CODE, DIMENSIONS, MEASURES, SNAPSHOT_COLUMNS

KEY = list(SNAPSHOT_COLUMNS[:3])


def to_snapshot(cube: DataFrame) -> DataFrame:
    """Cube columns under their names in the snapshot file."""
    return cube.select(
        *[F.col(a).alias(b) for a, b in zip([*DIMENSIONS, *MEASURES], SNAPSHOT_COLUMNS)]
    )


def to_cube(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(
        *[F.col(b).alias(a) for a, b in zip([*DIMENSIONS, *MEASURES], SNAPSHOT_COLUMNS)]
    )


def row_violation() -> Column:
    """First rule that a typed snapshot row breaks, null when it breaks none."""
    hour = F.col("stat_hour")
    responses, tokens = F.col(SNAPSHOT_COLUMNS[3]), F.col(SNAPSHOT_COLUMNS[4])
    return (
        F.when(hour.isNull() | responses.isNull() | tokens.isNull(), "not_an_integer")
        .when(parse_date(F.col("stat_date")).isNull(), "invalid_stat_date")
        .when(~hour.between(0, 23), "hour_out_of_range")
        .when(~F.col("airline_code").rlike(AIRLINE_CODE), "invalid_airline_code")
        .when((responses < 0) | (tokens < 0), "negative_metric")
        .when(tokens < responses, "tokens_below_responses")
    )


def checked_rows(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("violation", row_violation())


def duplicate_keys(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def order_violations(numbered: DataFrame) -> DataFrame:
    """Rows of ``line_number`` + snapshot columns that do not sort after the line before.

    Each line meets its successor in an equi-join on the line number, so the check needs
    no global window.
    """
    key = F.struct(*KEY)
    current = numbered.select("line_number", key.alias("key"))
    previous = numbered.select((F.col("line_number") + 1).alias("line_number"), key.alias("before"))
    joined = current.join(previous, "line_number").filter("before >= key")
    return joined.select("line_number", "key.*", F.expr("before = key").alias("repeated"))


def snapshot_totals(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(SNAPSHOT_COLUMNS[3]), F.lit(0)).alias("successful_response_records"),
        F.coalesce(F.sum(SNAPSHOT_COLUMNS[4]), F.lit(0)).alias("success_token_count"),
    )


def canonical_line() -> Column:
    return F.concat_ws(",", *SNAPSHOT_COLUMNS)
