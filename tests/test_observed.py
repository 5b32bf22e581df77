import pytest

from booklog.config import Ingest, Store
from booklog.operators import classified as split
from booklog.schema import BROKER_RECORD
from booklog.sinks.batch import write_batch
from booklog.sources import batches, lines
from booklog.sources.broker import record_file_stream
from booklog.streaming.query import RowCount, start_query
from tests.test_storage import hundred, land


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(hundred(), BROKER_RECORD)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_observed_counts_equal_the_aggregate_and_the_union(spark, tmp_path, records):
    paths = Store(f"{tmp_path}/data")
    summary = write_batch(records, 4, paths)
    classified = split.classify_broker_records(records)
    expected = rows(split.quality_metrics(classified, 4))
    assert rows(split.quality_union(classified, 4)) == expected
    assert rows(batches.quality_metrics(spark, paths)) == expected
    assert (summary.input_count, summary.dead_letter_count) == (100, 25)


def test_an_empty_batch_is_observed_too(spark, tmp_path):
    paths = Store(f"{tmp_path}/data")
    assert write_batch(spark.createDataFrame([], BROKER_RECORD), 0, paths).input_count == 0
    assert batches.quality_metrics(spark, paths).count() == 3
    assert batches.commits(spark, paths).count() == 1
    empty = split.classify_broker_records(spark.createDataFrame([], BROKER_RECORD))
    assert rows(split.quality_union(empty, 0)) == rows(split.quality_metrics(empty, 0))


def test_a_reason_outside_the_vocabulary_is_an_error():
    counts = dict.fromkeys((f"{stage}:{reason}" for stage, reason in split.FAILURES), 0)
    with pytest.raises(ValueError, match="not in the vocabulary"):
        split.observed_quality({**counts, "input_count": 2, "business_valid_count": 1}, 0)


def test_counts_are_complete_beyond_the_history(spark, tmp_path):
    folder, settings = f"{tmp_path}/records", Ingest(Store(f"{tmp_path}/data"), f"{tmp_path}/ckpt")
    for part in range(4):
        land(spark, folder, hundred()[25 * part : 25 * part + 25])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    counted = RowCount()
    spark.streams.addListener(counted)
    try:
        query = start_query(record_file_stream(spark, folder, 1), settings)
        query.awaitTermination()
        assert counted.total() == 100
        assert len(query.recentProgress) < 4
    finally:
        spark.streams.removeListener(counted)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_a_query_that_runs_on_has_no_total():
    with pytest.raises(TimeoutError):
        RowCount().total(timeout=0.01)


def test_too_many_splits_are_refused(spark, tmp_path, monkeypatch):
    for number in range(3):
        (tmp_path / f"{number}.txt").write_text("a\nb\n")
    numbered = lines.log_lines(spark, str(tmp_path), number_across_files=True)
    assert sorted(row.line_number for row in numbered.collect()) == [1, 2, 3, 4, 5, 6]
    monkeypatch.setattr(lines, "SENT_SPLITS", 2)
    with pytest.raises(Exception, match="more than 2 file splits .*: 3; raise spark.sql.files.maxPartitionBytes"):
        lines.log_lines(spark, str(tmp_path)).collect()
