"""The compacted ledger, runs of deltas, and versions that several writers want."""

import pathlib
import random
from collections import Counter

import pytest

from booklog.config import Store
from booklog.operators.metrics import merge_metrics
from booklog.schema import BATCH_COMMIT, BROKER_RECORD, HOURLY_DELTA
from booklog.sinks import batch as batch_sink
from booklog.sinks import cube as cube_sink
from booklog.sinks import publication as publication_sink
from booklog.sinks import runs
from booklog.sinks.batch import BatchSummary, commit_batch, replace_batch
from booklog.sinks.cube import publish_metrics
from booklog.sinks.publication import publish
from booklog.sinks.snapshot import export_snapshot
from booklog.sources import batches, ledger, storage
from booklog.sources import serving as reading
from booklog.sources.serving import ServingPaths


@pytest.fixture
def store(tmp_path):
    return Store(f"{tmp_path}/data")


def write(spark, store, number, *rows):
    """One batch of (airline, responses, tokens), as a replay would write it."""
    ledger.hide(spark, store, number)
    runs.drop_runs(spark, store, number)
    deltas = [(number, "20180830", 19, *row) for row in rows]
    replace_batch(spark.createDataFrame(deltas, HOURLY_DELTA).coalesce(1), store.hourly_airline_deltas, number)
    commit_batch(spark, BatchSummary(number, len(rows), 0, 0, 0), store)


def visible(spark, store):
    return ledger.read(spark, store).visible()


def cube(df):
    return {r.airline_code: (r.successful_response_records, r.success_token_count) for r in df.collect()}


def test_ranges_are_joined_and_cut():
    assert ledger.joined([(4, 4), (0, 1), (2, 3), (9, 9), (8, 8), (9, 12)]) == [(0, 4), (8, 12)]
    assert ledger.without([(0, 4), (8, 12)], [0, 3, 12, 20]) == [(1, 2), (4, 4), (8, 11)]
    drawn = random.Random(1)
    for _ in range(50):
        ids = set(drawn.sample(range(40), 20))
        gone = set(drawn.sample(range(40), 5))
        found = ledger.joined(ledger.without(ledger.joined([(x, x) for x in ids]), sorted(gone)))
        assert {x for low, high in found for x in range(low, high + 1)} == ids - gone


def test_a_long_ledger_is_a_snapshot_and_a_tail(spark, store):
    count = 100_000
    ones = [f"1L AS {f.name}" for f in BATCH_COMMIT.fields if f.name != "batch_id"]
    folder = storage.new_version(store.ledger)
    spark.range(count).selectExpr("id AS batch_id", *ones).coalesce(1).write.parquet(f"{folder}/rows")
    storage.write_text(spark, f"{folder}/ranges.json", f"[[0, {count - 1}]]")
    storage.switch(spark, store.ledger, folder)
    commit_batch(spark, BatchSummary(count, 5, 0, 0, 0), store)
    ledger.hide(spark, store, 77)
    found = ledger.read(spark, store)
    assert len(found.ranges) + len(found.tail) + len(found.hidden) == 3
    assert found.visible() == [(0, 76), (78, count)]
    listed = batches.commits(spark, store)
    assert listed.count() == count and listed.filter("batch_id = 77").isEmpty()
    assert len({pathlib.Path(x).parent for x in listed.inputFiles()}) == 2
    commit_batch(spark, BatchSummary(77, 9, 0, 0, 0), store)
    ledger.compact(spark, store)
    assert ledger.read(spark, store) == ledger.Ledger(storage.current(spark, store.ledger), [(0, count)], [], [])
    again = batches.commits(spark, store)
    assert again.count() == count + 1 and again.filter("batch_id = 77").first().input_count == 9


def test_a_half_done_compaction_harms_nothing(spark, store, monkeypatch):
    for number in (0, 1, 2):
        write(spark, store, number, ("CA", 1, number))
    ledger.settle(spark, store)
    assert ledger.read(spark, store).folder is None
    monkeypatch.setattr(ledger, "TAIL_BATCHES", 3)
    delete = storage.delete

    def fail(session, path):
        if "batch_id=1" in path:
            raise OSError("lost")
        delete(session, path)

    monkeypatch.setattr(storage, "delete", fail)
    with pytest.raises(OSError, match="lost"):
        ledger.settle(spark, store)
    monkeypatch.undo()
    expected = [(n, 1) for n in (0, 1, 2)]
    assert ledger.read(spark, store).tail == [1, 2]
    assert sorted((r.batch_id, r.input_count) for r in batches.commits(spark, store).collect()) == expected
    ledger.compact(spark, store)
    assert ledger.read(spark, store).tail == [] and visible(spark, store) == [(0, 2)]
    assert sorted((r.batch_id, r.input_count) for r in batches.commits(spark, store).collect()) == expected


def test_a_replay_hides_a_batch_of_the_snapshot(spark, store):
    for number in (0, 1, 2):
        write(spark, store, number, ("CA", 1, 10**number))
    ledger.compact(spark, store)
    ledger.hide(spark, store, 1)
    assert visible(spark, store) == [(0, 0), (2, 2)]
    assert cube(merge_metrics(batches.hourly_deltas(spark, store))) == {"CA": (2, 101)}
    write(spark, store, 1, ("MU", 5, 5))
    assert cube(merge_metrics(batches.hourly_deltas(spark, store))) == {"CA": (2, 101), "MU": (5, 5)}


def test_runs_cover_every_batch_once():
    drawn = random.Random(2)
    for _ in range(200):
        ids = [x for x in range(60) if drawn.random() < 0.9]
        spans = ledger.joined([(x, x) for x in ids])
        known = [set(), *({x for x in range(0, 60, 2**level) if drawn.random() < 0.8} for level in (1, 2, 3, 4))]
        found = Counter(x + k for level, firsts in enumerate(runs.cover(spans, known, 2)) for x in firsts for k in range(2**level))
        assert found == Counter(ids)


def test_merges_read_few_runs_and_equal_the_full_sum(spark, store):
    drawn = random.Random(3)

    def rows():
        return [(code, drawn.randrange(9), drawn.randrange(9)) for code in drawn.sample(["CA", "MU", "CZ"], drawn.randrange(1, 4))]

    def check():
        assert cube(runs.merged_runs(spark, store)) == cube(merge_metrics(batches.hourly_deltas(spark, store)))

    assert runs.merged_runs(spark, store).isEmpty()
    for number in range(9):
        # A batch without deltas is part of its runs too.
        write(spark, store, number, *(rows() if number != 5 else []))
    assert runs.close_runs(spark, store, fan=2) == 4 + 2 + 1
    check()
    read = runs.cover(visible(spark, store), runs.closed_runs(spark, store), 2)
    assert [len(x) for x in read] == [1, 0, 0, 1]
    write(spark, store, 9, *rows())
    assert runs.close_runs(spark, store) == 1
    # A replay drops one run a level; the next closing builds them again from the new rows.
    write(spark, store, 3, ("HX", 100, 100))
    assert [sorted(x) for x in runs.closed_runs(spark, store)] == [[], [0, 4, 6, 8], [4], []]
    check()
    assert runs.close_runs(spark, store) == 3
    check()
    assert publish_metrics(spark, store) == len(cube(batches.hourly_metrics(spark, store)))
    assert cube(batches.hourly_metrics(spark, store)) == cube(runs.merged_runs(spark, store))
    # A batch that is being written again counts in no run.
    ledger.hide(spark, store, 0)
    check()


def test_a_number_belongs_to_one_writer(spark, tmp_path):
    file = f"{tmp_path}/claims/1"
    assert [storage.claim(spark, file, x) for x in ("first", "second")] == [True, False]
    assert storage.read_text(spark, file) == "first" and storage.children(spark, f"{tmp_path}/claims") == ["1"]
    target = f"{tmp_path}/output"
    seen = storage.version_number(spark, target)
    storage.switch(spark, target, f"{target}/one", seen)
    with pytest.raises(storage.VersionConflict):
        storage.switch(spark, target, f"{target}/two", seen)
    assert storage.current(spark, target) == f"{target}/one"
    storage.switch(spark, target, f"{target}/three")
    assert storage.current(spark, target) == f"{target}/three" and storage.version_number(spark, target) == 1


def test_interleaved_merges_lose_nothing(spark, store, monkeypatch):
    write(spark, store, 0, ("CA", 1, 1))
    merged, inner = cube_sink.merged_runs, []

    def interrupted(session, paths):
        frame = merged(session, paths)
        if not inner:
            # While this merge is being written, a batch arrives and another writer merges it.
            inner.append(1)
            write(spark, store, 1, ("MU", 2, 2))
            inner.append(publish_metrics(spark, store))
        return frame

    monkeypatch.setattr(cube_sink, "merged_runs", interrupted)
    assert publish_metrics(spark, store) == 2 and inner == [1, 2]
    assert cube(batches.hourly_metrics(spark, store)) == {"CA": (1, 1), "MU": (2, 2)}
    assert storage.version_number(spark, store.hourly_airline_metrics) == 1


def test_of_interleaved_publications_one_fails(spark, store, tmp_path, monkeypatch):
    write(spark, store, 0, ("CA", 1, 1))
    serving, verify, inner = ServingPaths(f"{tmp_path}/serving"), publication_sink._verify, []
    cubes = merge_metrics(batches.hourly_deltas(spark, store))
    snapshot = export_snapshot(spark, cubes, f"{tmp_path}/snapshot", "root", "v1")

    def interrupted(*arguments):
        verify(*arguments)
        if not inner:
            inner.append(None)
            inner.append(publish(spark, snapshot, serving, force=True))

    monkeypatch.setattr(publication_sink, "_verify", interrupted)
    with pytest.raises(storage.VersionConflict):
        publish(spark, snapshot, serving, force=True)
    log = reading.publication_log(spark, serving).collect()
    assert sorted(r.status for r in log) == ["failed", "published"]
    assert {r.publication_id for r in reading.serving_table(spark, serving).collect()} == {inner[1].publication_id}


def test_batches_settle_their_ledger(spark, store, monkeypatch):
    settled = []
    monkeypatch.setattr(batch_sink.ledger, "settle", lambda *x: settled.append(x))
    batch_sink.write_batch(spark.createDataFrame([], BROKER_RECORD), 4, store)
    assert len(settled) == 1 and visible(spark, store) == [(4, 4)]
