import pathlib
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from booklog.operators import serving
from booklog.schema import HOURLY_METRIC, SERVING_METRIC
from booklog.sinks.publication import publish
from booklog.sinks.snapshot import export_snapshot
from booklog.sources import serving as reading
from booklog.sources.serving import ServingPaths

CUBE = [
    ("20180830", 9, "CA", 5, 6),
    ("20180830", 10, "CA", 1, 1),
    ("20180830", 9, "MU", 6, 6),
    ("20180831", 9, "3U", 2, 9),
]


@pytest.fixture(scope="module")
def rows(spark):
    cube = spark.createDataFrame(CUBE, HOURLY_METRIC)
    return serving.serving_rows(cube, F.lit("p1"), F.current_timestamp())


def values(df):
    return [tuple(row) for row in df.collect()]


def test_overview(rows):
    assert values(serving.overview(rows)) == [
        (4, 3, 14, 22, date(2018, 8, 30), date(2018, 8, 31), "p1")
    ]
    nothing = serving.overview(rows.limit(0))
    assert nothing.isEmpty()
    with pytest.raises(serving.NotAvailableError):
        serving.require_rows(nothing, "no snapshot")


def test_timeline_is_ordered_by_number_not_text(rows):
    assert values(serving.timeline(rows)) == [
        (date(2018, 8, 30), 9, 11, 12),
        (date(2018, 8, 30), 10, 1, 1),
        (date(2018, 8, 31), 9, 2, 9),
    ]


def test_ranking_breaks_ties_by_code(rows):
    assert values(serving.airline_ranking(rows, 2)) == [("CA", 6, 7), ("MU", 6, 6)]
    assert values(serving.airline_count(rows)) == [(3,)]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            serving.airline_ranking(rows, limit)


def test_airline_timeline_takes_any_case(rows):
    assert values(serving.airline_timeline(rows, "ca")) == [
        (date(2018, 8, 30), 9, 5, 6),
        (date(2018, 8, 30), 10, 1, 1),
    ]
    with pytest.raises(serving.NotAvailableError):
        serving.require_rows(serving.airline_timeline(rows, "ZZ"), "unknown airline")


def test_heatmap_and_axes(rows):
    cells = serving.heatmap(rows, 2)
    assert values(cells) == [(1, "CA", 9, 5, 6), (1, "CA", 10, 1, 1), (2, "MU", 9, 6, 6)]
    assert values(serving.heatmap_axes(cells)) == [
        ("airline", 1, "CA"),
        ("airline", 2, "MU"),
        ("hour", 9, "9"),
        ("hour", 10, "10"),
    ]
    with pytest.raises(ValueError):
        serving.heatmap(rows, 21)


def test_airline_filter_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/serving")
    stored = spark.read.parquet(f"{tmp_path}/serving")
    plan = serving.airline_timeline(stored, "CA")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(airline_code,CA)" in plan
    assert "publication_id" not in plan[plan.index("ReadSchema") :]


def days(*numbers):
    return [(date(2018, 8, n), 1, "CA", n, n + 1, "p", None) for n in numbers]


def test_ranges_of_dates(spark):
    rows = spark.createDataFrame(days(1, 2, 3, 4), SERVING_METRIC)

    def found(first=None, last=None):
        return sorted(row.stat_date.day for row in serving.in_dates(rows, first, last).collect())

    second, third = date(2018, 8, 2), date(2018, 8, 3)
    assert found() == [1, 2, 3, 4] and found(second) == [2, 3, 4] and found(None, third) == [1, 2, 3]
    assert found(second, third) == [2, 3] and found(third, third) == [3]
    assert found(date(2019, 1, 1)) == []
    with pytest.raises(ValueError, match="inverted"):
        serving.in_dates(rows, third, second)
    assert [row.successful_response_records for row in serving.timeline(serving.in_dates(rows, second, third)).collect()] == [2, 3]


def test_ranking_by_either_measure_and_shares(spark):
    day = date(2018, 8, 1)
    rows = [(day, 1, "CA", 3, 5, "p", None), (day, 2, "MU", 1, 15, "p", None)]
    df = spark.createDataFrame(rows, SERVING_METRIC)
    assert [row.airline_code for row in serving.airline_ranking(df).collect()] == ["CA", "MU"]
    by_tokens = serving.airline_ranking(df, by="success_token_count")
    assert [row.airline_code for row in by_tokens.collect()] == ["MU", "CA"]
    with pytest.raises(ValueError):
        serving.airline_ranking(df, by="airline_code")
    shares = {row.airline_code: (row[3], row[4]) for row in serving.airline_shares(df).collect()}
    assert shares == {"CA": (0.75, 0.25), "MU": (0.25, 0.75)}
    nothing = spark.createDataFrame([(day, 1, "CA", 0, 0, "p", None)], SERVING_METRIC)
    assert tuple(serving.airline_shares(nothing).first())[3:] == (None, None)


def test_one_day_reads_the_row_groups_of_one_file(spark, tmp_path, capsys):
    cube = [(f"201808{d:02d}", h, c, 1, 1) for d in range(1, 29) for h in range(24) for c in ("CA", "MU", "HX")]
    paths = ServingPaths(f"{tmp_path}/serving")
    snapshot = export_snapshot(spark, spark.createDataFrame(cube, HOURLY_METRIC), f"{tmp_path}/snapshot", "root", "v1")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        # Small tables would otherwise make a single file.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        published = publish(spark, snapshot, paths)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(pathlib.Path(paths.snapshot(published.publication_id)).glob("*.parquet"))
    day, holding = date(2018, 8, 9), 0
    for file in files:
        metadata = pq.ParquetFile(file).metadata
        for group in range(metadata.num_row_groups):
            bounds = metadata.row_group(group).column(0).statistics
            holding += bounds.min <= day <= bounds.max
    assert len(files) > 1 and holding == 1
    one = serving.in_dates(reading.serving_table(spark, paths), day, day)
    assert one.count() == 72
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(stat_date,2018-08-09)" in plan and "LessThanOrEqual(stat_date,2018-08-09)" in plan
