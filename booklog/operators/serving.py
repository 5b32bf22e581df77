"""The read-only analytical queries over the published hourly cube.

Results that the reader may find missing stay empty DataFrames; ``require_rows`` turns
that into an error where a caller wants one.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booklog.schema import MEASURES


class NotAvailableError(LookupError):
    """Nothing has been published, or the requested key has no rows."""


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise NotAvailableError(message)
    return df


def serving_rows(cube: DataFrame, publication_id: Column, updated_at: Column) -> DataFrame:
    """Cube rows as they are served: real dates, and the publication they belong to."""
    return cube.select(
        F.to_date("event_date", "yyyyMMdd").alias("stat_date"),
        F.col("event_hour").alias("stat_hour"),
        "airline_code",
        *MEASURES,
        publication_id.alias("publication_id"),
        updated_at.alias("updated_at"),
    )


def _totals() -> list[Column]:
    return [F.sum(name).alias(name) for name in MEASURES]


def _check_limit(limit: int, largest: int) -> None:
    if not 1 <= limit <= largest:
        raise ValueError(f"limit {limit} is outside 1..{largest}")


def overview(serving: DataFrame) -> DataFrame:
    """One row, or none when nothing is served."""
    totals = serving.agg(
        F.count(F.lit(1)).alias("metric_rows"),
        F.countDistinct("airline_code").alias("airline_count"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in MEASURES],
        F.min("stat_date").alias("start_date"),
        F.max("stat_date").alias("end_date"),
        F.min("publication_id").alias("publication_id"),
    )
    return totals.filter("metric_rows > 0 AND publication_id IS NOT NULL")


def in_dates(serving: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included; without one, from or to the end.

    Every question can be asked of the result. The bounds reach the Parquet scan, and
    published files hold ranges of days in order, so it opens only row groups of these days.
    """
    if first is not None and last is not None and first > last:
        raise ValueError(f"the range from {first} to {last} is inverted")
    if first is not None:
        serving = serving.filter(F.col("stat_date") >= first)
    if last is not None:
        serving = serving.filter(F.col("stat_date") <= last)
    return serving


def timeline(serving: DataFrame) -> DataFrame:
    return serving.groupBy("stat_date", "stat_hour").agg(*_totals()).orderBy("stat_date", "stat_hour")


def airline_count(serving: DataFrame) -> DataFrame:
    return serving.agg(F.countDistinct("airline_code").alias("total_airlines"))


def airline_totals(serving: DataFrame) -> DataFrame:
    return serving.groupBy("airline_code").agg(*_totals())


def airline_ranking(serving: DataFrame, limit: int = 20, by: str = MEASURES[0]) -> DataFrame:
    """The airlines with most responses, or most of the other measure."""
    _check_limit(limit, 100)
    if by not in MEASURES:
        raise ValueError(f"{by!r} is not one of {', '.join(MEASURES)}")
    return airline_totals(serving).orderBy(F.desc(by), F.asc("airline_code")).limit(limit)


def airline_shares(serving: DataFrame) -> DataFrame:
    """Each airline's part of both measures, from 0 to 1; null where a measure is 0 throughout.

    The window without a key sees one row per airline.
    """
    shares = [
        F.try_divide(name, F.sum(name).over(Window.partitionBy())).alias(name.rpartition("_")[0] + "_share")
        for name in MEASURES
    ]
    return airline_totals(serving).select("airline_code", *MEASURES, *shares)


def airline_timeline(serving: DataFrame, airline_code: str) -> DataFrame:
    return (
        serving.filter(F.col("airline_code") == airline_code.upper())
        .select("stat_date", "stat_hour", *MEASURES)
        .orderBy("stat_date", "stat_hour")
    )


def ranked_airlines(serving: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` airlines with their rank.

    The window has no partition key, but a top-k comes first, so it never sees more than
    ``limit`` rows.
    """
    _check_limit(limit, 20)
    # Served codes are never null, and they already make the order total. Saying so, and
    # naming the second measure, makes this input the same plan as the other side of a join
    # with the ranks: where it is computed rather than stored, it is then computed once.
    served = serving.filter(F.col("airline_code").isNotNull())
    order = [
        F.desc("successful_response_records"),
        F.asc("airline_code"),
        F.desc("success_token_count"),
    ]
    best = airline_totals(served).orderBy(*order).limit(limit)
    return best.select(
        "airline_code",
        F.row_number().over(Window.orderBy(*order)).alias("airline_rank"),
        *MEASURES,
    )


def heatmap(serving: DataFrame, limit: int = 10) -> DataFrame:
    """Hour totals of the best airlines, by rank and hour.

    The broadcast side holds at most ``limit`` (20) rows.
    """
    best = ranked_airlines(serving, limit).select("airline_code", "airline_rank")
    return (
        serving.join(F.broadcast(best), "airline_code")
        .groupBy("airline_rank", "airline_code", "stat_hour")
        .agg(*_totals())
        .orderBy("airline_rank", "stat_hour")
    )


def heatmap_axes(cells: DataFrame) -> DataFrame:
    """Axis values in display order: airlines by rank, hours ascending."""
    airline = F.struct(
        F.lit("airline").alias("axis"),
        F.col("airline_rank").cast("int").alias("position"),
        F.col("airline_code").alias("label"),
    )
    hour = F.struct(
        F.lit("hour").alias("axis"),
        F.col("stat_hour").cast("int").alias("position"),
        F.col("stat_hour").cast("string").alias("label"),
    )
    values = cells.select(F.inline(F.array(airline, hour)))
    return values.distinct().orderBy("axis", "position")
