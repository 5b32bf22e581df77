"""Tree digests, ordered parts, comparison by ranges, and the prefix that a stream keeps."""

import hashlib
import os
import pathlib
import random

import pytest

from booklog.operators.audit import confirmed_prefix, joined_runs, reconcile
from booklog.plans.reconcile import differing_ranges, reconcile_by_ranges
from booklog.schema import HOURLY_METRIC
from booklog.sinks import cube as cube_sink
from booklog.sinks.parts import LIST, PARTS, SUMMARY, export_parts, load_parts
from booklog.sinks.snapshot import export_snapshot
from booklog.config import Store
from booklog.sources import storage
from booklog.sources.lines import BLOCK_LINES, tree_identity
from booklog.sources.snapshot import SnapshotError
from booklog.streaming.prefix import add_lines, live_prefix, start_prefix, stored_runs

LANDED = "source_file string, source_line_number bigint"


# --- tree digests ----------------------------------------------------------------------


def plain_tree(content: bytes) -> str:
    """The root by the definition, line by line."""
    lines = content.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    level = []
    for start in range(0, len(lines), BLOCK_LINES):
        sums = [0] * 8
        block = lines[start : start + BLOCK_LINES]
        for number, line in enumerate(block, start + 1):
            digest = hashlib.sha256(str(number).encode() + b":" + line).hexdigest()
            for i in range(8):
                sums[i] += int(digest[8 * i : 8 * i + 8], 16)
        level.append(hashlib.sha256(",".join(map(str, [len(block), *sums])).encode()).hexdigest())
    for _ in range(3):
        level = [
            hashlib.sha256("".join(level[i : i + 1024]).encode()).hexdigest()
            for i in range(0, len(level), 1024)
        ]
    return hashlib.sha256(f"{len(content)},{len(lines)},{level[0]}".encode()).hexdigest()


def roots(spark, folder):
    return {
        pathlib.Path(row.source_file).name: (row.byte_size, row.line_count, row.tree_sha256)
        for row in tree_identity(spark, str(folder)).collect()
    }


def test_tree_digest_by_definition(spark, tmp_path):
    many = b"".join(b"line %d,\xc3\xa9\r\n" % i for i in range(3 * BLOCK_LINES + 5))
    contents = {
        "empty": b"",
        "blank": b"\n",
        "blanks": b"\n\n",
        "open_end": b"a\nb",
        "closed_end": b"a\nb\n",
        "swapped": b"b\na\n",
        "repeated": b"a\na\n",
        "bad_bytes": b"\xff\xfe\na\n",
        "full_block": b"x\n" * BLOCK_LINES,
        "many": many,
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = roots(spark, tmp_path)
    # Spark lists no empty files.
    del contents["empty"]
    assert {name: root for name, (_, _, root) in found.items()} == {
        name: plain_tree(content) for name, content in contents.items()
    }
    assert len({root for _, _, root in found.values()}) == len(contents)
    assert found["many"][:2] == (len(many), 3 * BLOCK_LINES + 5)


def test_tree_digest_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"".join(b"%d %s\n" % (i, b"x" * (i % 97)) for i in range(9_000)))
    seen, key = set(), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("1g", "100k", "33333", "7001"):
            spark.conf.set(key, size)
            seen.add(roots(spark, tmp_path)["log"])
    finally:
        spark.conf.set(key, before)
    assert len(seen) == 1


def test_parts_of_a_folder_are_one_source(spark, tmp_path):
    content = b"".join(b"%d\n" % i for i in range(1_000))
    (tmp_path / "whole").write_bytes(content)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0").write_bytes(content[:1_890])
    (tmp_path / "cut" / "part-1").write_bytes(content[1_890:])
    cut = tree_identity(spark, str(tmp_path / "cut"), number_across_files=True).first()
    assert (cut.byte_size, cut.line_count, cut.tree_sha256) == roots(spark, tmp_path / "whole")["whole"]


# --- ordered parts ---------------------------------------------------------------------


def cube_rows(days=6):
    drawn = random.Random(3)
    keys = [(f"201808{d + 10}", h, a) for d in range(days) for h in range(24) for a in ("CA", "HX", "MU")]
    drawn.shuffle(keys)
    return [(*key, n, n + drawn.randrange(3)) for key in keys for n in [drawn.randrange(50)]]


@pytest.fixture
def cube(spark):
    return spark.createDataFrame(cube_rows(), HOURLY_METRIC)


def parts_of(folder):
    return sorted(pathlib.Path(folder, PARTS).glob("part-*"))


def test_parts_are_the_single_file(spark, cube, tmp_path):
    export_snapshot(spark, cube, f"{tmp_path}/one", "root", "v1")
    single = pathlib.Path(storage.current(spark, f"{tmp_path}/one"), "metrics.csv").read_bytes()
    roots_seen = set()
    for part_rows in (1, 50, 10_000):
        folder = export_parts(spark, cube, f"{tmp_path}/by{part_rows}", part_rows)
        parts = parts_of(folder)
        assert b"".join(part.read_bytes() for part in parts) == single
        assert storage.current(spark, f"{tmp_path}/by{part_rows}") == folder
        assert (len(parts) > 5) == (part_rows < 10_000)
        if part_rows == 50:
            # Ranges are sampled, so parts are only about as large as asked for.
            assert max(part.read_bytes().count(b"\n") for part in parts) < 150
        summary = spark.read.json(f"{folder}/{SUMMARY}").first()
        assert summary.part_count == len(parts) and summary.byte_size == len(single)
        joined = "".join(hashlib.sha256(part.read_bytes()).hexdigest() for part in parts)
        if len(parts) < 1024:
            top = hashlib.sha256(joined.encode()).hexdigest()
            for _ in range(2):
                top = hashlib.sha256(top.encode()).hexdigest()
            assert summary.parts_sha256 == top
        roots_seen.add(summary.parts_sha256)
        assert {tuple(row) for row in load_parts(spark, folder).collect()} == set(cube_rows())
    assert len(roots_seen) == 3


@pytest.mark.parametrize("damage", ["byte", "lost", "added", "swapped", "list"])
def test_damaged_parts_are_refused(spark, cube, tmp_path, damage):
    folder = export_parts(spark, cube, f"{tmp_path}/parts", 100)
    parts = parts_of(folder)
    for name in (PARTS, LIST):
        for crc in pathlib.Path(folder, name).glob(".*.crc"):
            crc.unlink()
    first, second = parts[1].read_bytes(), parts[2].read_bytes()
    if damage == "byte":
        parts[1].write_bytes(first.replace(b"CA", b"CZ", 1))
    elif damage == "lost":
        parts[1].unlink()
    elif damage == "added":
        parts[1].with_name("part-99998-x.txt").write_bytes(b"20190101,1,CA,1,1\n")
    elif damage == "swapped":
        parts[1].write_bytes(second)
        parts[2].write_bytes(first)
    else:
        listed = next(pathlib.Path(folder, LIST).glob("part-*"))
        rest = listed.read_text().splitlines(keepends=True)[1:]
        listed.write_text("".join(rest))
        parts[0].unlink()
    with pytest.raises(SnapshotError):
        load_parts(spark, folder)


def test_failed_export_keeps_the_previous_parts(spark, cube, tmp_path):
    folder = export_parts(spark, cube, f"{tmp_path}/parts", 100)
    bad = spark.createDataFrame([("20180830", 24, "CA", 1, 1)], HOURLY_METRIC)
    for broken in (bad, cube.unionByName(cube), cube.limit(0)):
        with pytest.raises(SnapshotError):
            export_parts(spark, broken, f"{tmp_path}/parts", 100)
    assert storage.current(spark, f"{tmp_path}/parts") == folder
    assert load_parts(spark, folder).count() == cube.count()
    with pytest.raises(ValueError):
        export_parts(spark, cube, f"{tmp_path}/parts", 0)


# --- ranges ----------------------------------------------------------------------------


def saved(spark, folder, rows):
    spark.createDataFrame(rows, HOURLY_METRIC).write.parquet(str(folder))
    return spark.read.schema(HOURLY_METRIC).parquet(str(folder))


def test_ranges_find_what_a_full_comparison_finds(spark, tmp_path):
    rows = cube_rows()
    changed = [(*row[:3], row[3], row[4] + 1) if i in (4, 90) else row for i, row in enumerate(rows)]
    changed = [row for i, row in enumerate(changed) if i not in (7, 200)]
    changed += [("20180901", 3, "KA", 0, 0), ("20180810", 3, "ZH", 2, 2)]
    # Two measures that change places in one hour.
    twins = [i for i, row in enumerate(changed) if row[:2] == ("20180812", 5)][:2]
    a, b = (changed[i] for i in twins)
    changed[twins[0]], changed[twins[1]] = (*a[:3], *b[3:]), (*b[:3], *a[3:])
    left, right = saved(spark, tmp_path / "a", rows), saved(spark, tmp_path / "b", changed)
    for one, two in ((left, right), (right, left)):
        expected = {tuple(row) for row in reconcile(one, two).collect()}
        assert {tuple(row) for row in reconcile_by_ranges(spark, one, two).collect()} == expected
        assert len(expected) >= 6
    empty = saved(spark, tmp_path / "none", [])
    assert reconcile_by_ranges(spark, empty, empty).count() == 0
    assert reconcile_by_ranges(spark, left, empty).count() == len(rows)


def test_equal_cubes_shuffle_no_rows(spark, tmp_path):
    rows = cube_rows()
    left, right = saved(spark, tmp_path / "a", rows), saved(spark, tmp_path / "b", rows[::-1])
    assert differing_ranges(left, right, ["event_date"]).isEmpty()
    result = reconcile_by_ranges(spark, left, right)
    assert result.collect() == []
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [event_date" not in plan.split("Initial Plan")[0]


# --- live prefix -----------------------------------------------------------------------


def prefixes(df):
    return {row.source_file: (row.confirmed_line, row.distinct_lines) for row in df.collect()}


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_joined_runs_by_brute_force(spark, block):
    drawn = random.Random(block)
    spans = [("ab"[drawn.random() < 0.2], n, n + drawn.randrange(9)) for n in drawn.choices(range(1, 900), k=150)]
    spans += [("a", 1, 300), ("a", 300, 300), ("c", 5, 5), ("c", 5, 5), ("c", 6, 9)]
    held = {}
    for source, first, last in spans:
        held.setdefault(source, set()).update(range(first, last + 1))
    expected = {
        (s, n, next(m for m in range(n, 2_000) if m + 1 not in lines))
        for s, lines in held.items()
        for n in lines
        if n - 1 not in lines
    }
    runs = spark.createDataFrame(spans, "source_file string, first bigint, last bigint")
    found = [tuple(row) for row in joined_runs(runs, block).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_prefix_equals_the_batch_operator_after_any_split(spark, tmp_path):
    drawn = random.Random(5)
    lines = [("hot", n) for n in range(1, 400) if n != 250] + [("late", n) for n in range(2, 40)]
    lines += drawn.choices(lines, k=120)
    drawn.shuffle(lines)
    batches = [lines[:1], lines[1:300], [], lines[300:], [("late", 1), ("hot", 250), ("late", 1)]]
    folder, seen = f"{tmp_path}/runs", []
    for batch in batches:
        seen += batch
        add_lines(spark.createDataFrame(batch, LANDED), folder)
        whole = confirmed_prefix(spark.createDataFrame(seen, LANDED))
        assert prefixes(live_prefix(spark, folder)) == prefixes(whole)
    # A retried batch changes nothing, and what has no gap is one row.
    add_lines(spark.createDataFrame(batches[1], LANDED), folder)
    assert sorted(map(tuple, stored_runs(spark, folder).collect())) == [("hot", 1, 399), ("late", 1, 39)]


def test_rows_without_source_or_number_are_left_out(spark, tmp_path):
    rows = [(None, 1), ("a", None), ("a", 0), ("a", -3), ("a", 2), ("b", 1)]
    add_lines(spark.createDataFrame(rows, LANDED), f"{tmp_path}/runs")
    assert prefixes(live_prefix(spark, f"{tmp_path}/runs")) == {"a": (0, 1), "b": (1, 1)}
    assert live_prefix(spark, f"{tmp_path}/none").collect() == []


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    for wave in ([1, 2, 5], [3, 3, 9], [4]):
        rows = spark.createDataFrame([("s", n) for n in wave], LANDED)
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LANDED).parquet(f"{tmp_path}/in")
        start_prefix(stream, f"{tmp_path}/runs", f"{tmp_path}/checkpoint").awaitTermination()
    assert prefixes(live_prefix(spark, f"{tmp_path}/runs")) == {"s": (5, 6)}


def test_overtaken_writer_fails_and_loses_nothing(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/runs"
    add_lines(spark.createDataFrame([("s", 1)], LANDED), folder)
    real = storage.new_version

    def overtaken(target):
        monkeypatch.setattr(storage, "new_version", real)
        add_lines(spark.createDataFrame([("s", 2)], LANDED), folder)
        return real(target)

    monkeypatch.setattr(storage, "new_version", overtaken)
    with pytest.raises(storage.VersionConflict):
        add_lines(spark.createDataFrame([("s", 3)], LANDED), folder)
    assert prefixes(live_prefix(spark, folder)) == {"s": (2, 2)}
    add_lines(spark.createDataFrame([("s", 3)], LANDED), folder)
    assert prefixes(live_prefix(spark, folder)) == {"s": (3, 3)}
    assert len(os.listdir(folder)) <= storage.KEPT_VERSIONS + 1


def test_a_merge_that_is_always_overtaken_says_so(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise storage.VersionConflict("taken")

    monkeypatch.setattr(cube_sink.storage, "switch", refuse)
    monkeypatch.setattr(cube_sink, "close_runs", lambda *_: None)
    empty = spark.createDataFrame([], HOURLY_METRIC)
    monkeypatch.setattr(cube_sink, "merged_runs", lambda *_: empty)
    with pytest.raises(storage.VersionConflict, match="other writers"):
        cube_sink.publish_metrics(spark, Store(f"{tmp_path}/data"))
