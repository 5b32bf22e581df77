import os
import re

import pytest

from booklog.config import Store
from booklog.schema import BROKER_RECORD
from booklog.sinks.batch import write_batch
from booklog.sinks.dated import clean_events_between, file_by_date
from booklog.sinks.seen_events import (
    distinct_responses,
    first_batches,
    fold_batches,
    folded_before,
    fresh_events,
    record_batch,
    seen_events,
)
from booklog.sources import storage
from tests.test_envelope import message


def records(spark, numbers, date="20180830"):
    rows = [f"G{i},ITARES,{date},19,t,CA:success;CA:success;MU:success;" for i in numbers]
    made = [(*message(row, int(row[1 : row.index(",")]) + 1), "t", 0, i, None) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, BROKER_RECORD)


def record(spark, paths, batch_id, numbers):
    write_batch(records(spark, numbers), batch_id, paths)
    record_batch(spark, paths, batch_id)


@pytest.fixture
def paths(tmp_path):
    return Store(f"{tmp_path}/data")


def first_counts(spark, paths):
    return {r.first_batch: r["count"] for r in first_batches(spark, paths).groupBy("first_batch").count().collect()}


def exchanges(df):
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    return len(re.findall(r"Exchange", plan))


def test_events_of_overlapping_batches_count_once(spark, paths):
    for batch_id, numbers in enumerate((range(10), range(5, 15), range(20), [])):
        record(spark, paths, batch_id, numbers)
    # Two airlines a record.
    assert first_counts(spark, paths) == {0: 20, 1: 10, 2: 10}
    assert [fresh_events(spark, paths, n).count() for n in range(4)] == [20, 10, 10, 0]
    assert {r.airline_code: r.successful_response_records for r in distinct_responses(spark, paths).collect()} == {
        "CA": 20,
        "MU": 20,
    }


def test_a_replay_gives_its_events_back_to_later_batches(spark, paths):
    for batch_id, numbers in ((0, range(10)), (1, range(5, 15)), (0, range(3))):
        record(spark, paths, batch_id, numbers)
    assert first_counts(spark, paths) == {0: 6, 1: 20}
    record(spark, paths, 0, [])
    assert first_counts(spark, paths) == {1: 20}


def test_history_is_never_shuffled(spark, paths):
    for batch_id in range(3):
        record(spark, paths, batch_id, range(10 * batch_id, 10 * batch_id + 15))
    assert exchanges(fresh_events(spark, paths, 2)) == 0
    assert exchanges(first_batches(spark, paths)) == 0
    # The sums at the end are all that moves.
    assert exchanges(distinct_responses(spark, paths)) == 1


def test_buckets_hold_where_the_session_shuffles_otherwise(spark, paths):
    record(spark, paths, 0, range(10))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(int(before) + 3))
    try:
        record(spark, paths, 1, range(5, 15))
        assert exchanges(fresh_events(spark, paths, 1)) == 0
        assert first_counts(spark, paths) == {0: 20, 1: 10}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_only_committed_batches_are_seen(spark, paths):
    record(spark, paths, 0, range(4))
    record(spark, paths, 1, range(2, 9))
    storage.delete(spark, f"{paths.commits}/batch_id=0")
    assert first_counts(spark, paths) == {1: 14}


def test_folding_keeps_the_first_batches_and_closes_them(spark, paths):
    for batch_id in range(4):
        record(spark, paths, batch_id, range(3 * batch_id, 3 * batch_id + 6))
    before = first_counts(spark, paths)
    fold_batches(spark, paths, before=2)
    fold_batches(spark, paths, before=3)
    fold_batches(spark, paths, before=1)
    assert folded_before(spark, paths) == 3 and first_counts(spark, paths) == before
    assert sorted(n for n in os.listdir(paths.seen_events) if n.startswith("run=")) == ["run=-3", "run=3"]
    assert fresh_events(spark, paths, 3).count() == before[3]
    assert seen_events(spark, paths).count() == sum(before.values()) + 6
    with pytest.raises(ValueError, match="folded"):
        record_batch(spark, paths, 2)
    record(spark, paths, 4, range(40, 44))
    assert first_counts(spark, paths) == before | {4: 8}


def test_a_fold_that_stopped_before_its_marker_is_done_again(spark, paths, monkeypatch):
    for batch_id in range(2):
        record(spark, paths, batch_id, range(batch_id, batch_id + 6))
    before = first_counts(spark, paths)
    claim = storage.claim

    def fail(spark, path, text):
        if "_folded" in path:
            raise OSError("gone")
        return claim(spark, path, text)

    monkeypatch.setattr(storage, "claim", fail)
    with pytest.raises(OSError, match="gone"):
        fold_batches(spark, paths, before=2)
    assert first_counts(spark, paths) == before
    monkeypatch.setattr(storage, "claim", claim)
    fold_batches(spark, paths, before=2)
    assert first_counts(spark, paths) == before and seen_events(spark, paths).count() == sum(before.values())


def file_dates(spark, paths, batch_id, dates):
    parts = [records(spark, numbers, date) for date, numbers in dates.items()]
    whole = records(spark, [])
    for part in parts:
        whole = whole.unionByName(part)
    write_batch(whole, batch_id, paths)
    return file_by_date(spark, paths, batch_id)


def by_date(df):
    return {(r.event_date, r.batch_id): r["count"] for r in df.groupBy("event_date", "batch_id").count().collect()}


def test_a_replay_that_drops_a_date_leaves_nothing(spark, paths):
    assert file_dates(spark, paths, 0, {"20180830": range(3), "20180831": range(4)}) == ["20180830", "20180831"]
    file_dates(spark, paths, 1, {"20180831": range(2)})
    assert by_date(clean_events_between(spark, paths)) == {
        ("20180830", 0): 3,
        ("20180831", 0): 4,
        ("20180831", 1): 2,
    }
    assert file_dates(spark, paths, 0, {"20180830": range(1)}) == ["20180830"]
    assert by_date(clean_events_between(spark, paths)) == {("20180830", 0): 1, ("20180831", 1): 2}
    assert file_dates(spark, paths, 0, {}) == []
    assert by_date(clean_events_between(spark, paths)) == {("20180831", 1): 2}


def test_a_range_of_dates_lists_its_folders_only(spark, paths):
    days = {f"201808{day}": range(day - 10) for day in range(11, 16)}
    file_dates(spark, paths, 0, days)
    one = clean_events_between(spark, paths, "20180813", "20180813")
    assert len(one.inputFiles()) >= 1 and all("event_date=20180813" in name for name in one.inputFiles())
    assert by_date(one) == {("20180813", 0): 3}
    assert by_date(clean_events_between(spark, paths, "20180814")) == {("20180814", 0): 4, ("20180815", 0): 5}
    assert clean_events_between(spark, paths, "20190101", "20190102").count() == 0
    with pytest.raises(ValueError, match="ends before"):
        clean_events_between(spark, paths, "20180815", "20180814")


def test_filed_events_of_uncommitted_batches_are_hidden(spark, paths):
    assert clean_events_between(spark, paths).count() == 0
    file_dates(spark, paths, 0, {"20180830": range(3)})
    storage.delete(spark, f"{paths.commits}/batch_id=0")
    assert clean_events_between(spark, paths).count() == 0
