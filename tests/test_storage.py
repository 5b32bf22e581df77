import gzip
import hashlib
import json
import os
import pathlib

import pytest

from booklog.config import Ingest, Store, Topic
from booklog.plans.cycle import inspect_outputs, output_counts, refresh
from booklog.schema import BROKER_RECORD, HOURLY_METRIC
from booklog.sinks import batch as batch_sink
from booklog.sinks.batch import commit_batch, write_batch
from booklog.operators.envelope import verify_strictly
from booklog.sinks.broker import file_records, send_options, write_to_topic
from booklog.sinks.cube import publish_metrics
from booklog.sinks.profile import write_profile
from booklog.sinks.publication import PublicationError, publish, validate_serving
from booklog.sinks.snapshot import export_snapshot
from booklog.sources import batches, lines, storage
from booklog.sources import serving as reading
from booklog.session import scratch_folder
from booklog.sources.broker import (
    record_file_stream,
    stream_options,
    topic_stream,
    whole_topic,
    whole_topic_options,
)
from booklog.sources.serving import ServingPaths
from booklog.sources.snapshot import Expectations, SnapshotError, load_snapshot
from booklog.streaming.query import await_rows, rows_seen, start_query
from tests.test_envelope import message


def hundred():
    """44 CA, 13 of CA CA MU, 18 requests, 14 bad hours, 11 that are not JSON."""
    rows = [f"CA{i},ITARES,20180830,19,19:00:00:000,CA:success;" for i in range(44)]
    rows += [f"B{i},ITARES,20180830,19,t,CA:success;CA:success;MU:success;" for i in range(13)]
    rows += [f"R{i},ITAREQ,20180830,19,t,payload" for i in range(18)]
    rows += [f"X{i},ITARES,20180830,24,t" for i in range(14)]
    messages = [message(line, number) for number, line in enumerate(rows, 1)]
    messages += [(b"k", b"not-json")] * 11
    return [(k, v, "t", i % 3, i // 3, None) for i, (k, v) in enumerate(messages)]


@pytest.fixture
def settings(tmp_path):
    return Ingest(Store(f"{tmp_path}/data"), f"{tmp_path}/ckpt")


def cube_of(spark, settings):
    return {
        row.airline_code: (row.successful_response_records, row.success_token_count)
        for row in batches.hourly_metrics(spark, settings.store).collect()
    }


def land(spark, folder, rows):
    spark.createDataFrame(rows, BROKER_RECORD).coalesce(1).write.mode("append").parquet(folder)


CUBE = {"CA": (57, 70), "MU": (13, 13)}


def test_two_waves_resume_on_one_checkpoint(spark, settings, tmp_path):
    rows, folder = hundred(), f"{tmp_path}/records"
    for wave, seen in ((rows[:40], 40), (rows[40:], 100)):
        land(spark, folder, wave)
        start_query(record_file_stream(spark, folder), settings).awaitTermination()
        publish_metrics(spark, settings.store)
        summary = inspect_outputs(spark, settings.store).first()
        assert summary.input_count == summary.unique_kafka_locations == seen
    assert (summary.envelope_valid_count, summary.business_valid_count) == (89, 75)
    assert summary.dead_letter_count == 25
    assert summary.raw_plus_envelope_dead_count == 100
    assert summary.clean_plus_business_dead_count == 89
    assert cube_of(spark, settings) == CUBE
    assert batches.commits(spark, settings.store).count() == 2
    assert output_counts(spark, settings.store).first().valid


def test_processing_time_trigger(spark, tmp_path):
    settings = Ingest(Store(f"{tmp_path}/data"), f"{tmp_path}/ckpt", every="1 second")
    land(spark, f"{tmp_path}/records", hundred())
    query = start_query(record_file_stream(spark, f"{tmp_path}/records"), settings)
    assert await_rows(query, 100, timeout=60) == 100
    assert not query.isActive
    publish_metrics(spark, settings.store)
    assert cube_of(spark, settings) == CUBE


def test_a_failing_batch_stops_the_query_and_frees_its_cache(spark, settings, tmp_path, monkeypatch):
    land(spark, f"{tmp_path}/records", hundred())
    write = batch_sink.replace_batch

    def fail(frame, dataset, batch_id):
        if dataset == settings.store.dead_letter:
            assert not spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
            raise ValueError("no space")
        write(frame, dataset, batch_id)

    monkeypatch.setattr(batch_sink, "replace_batch", fail)
    query = start_query(record_file_stream(spark, f"{tmp_path}/records"), settings)
    with pytest.raises(Exception, match="no space"):
        query.awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    # What was written before the failure is not visible; the retry gets the same batch.
    assert batches.raw_events(spark, settings.store).count() == 0
    monkeypatch.setattr(batch_sink, "replace_batch", write)
    start_query(record_file_stream(spark, f"{tmp_path}/records"), settings).awaitTermination()
    assert [r.batch_id for r in batches.commits(spark, settings.store).collect()] == [0]
    assert batches.raw_events(spark, settings.store).count() == 89


def test_a_backlog_becomes_several_batches(spark, settings, tmp_path):
    for part in range(4):
        land(spark, f"{tmp_path}/records", hundred()[25 * part : 25 * part + 25])
    start_query(record_file_stream(spark, f"{tmp_path}/records", 2), settings).awaitTermination()
    assert batches.commits(spark, settings.store).count() == 2


def test_only_committed_directories_are_read(spark, settings, tmp_path):
    records = spark.createDataFrame(hundred(), BROKER_RECORD)
    for number in (3, 4):
        write_batch(records, number, settings.store)
    storage.delete(spark, f"{settings.store.commits}/batch_id=4")
    harmed = settings.store.raw_events + "/batch_id=4"
    for name in os.listdir(harmed):
        if name.endswith(".parquet"):
            with open(f"{harmed}/{name}", "wb") as file:
                file.write(b"half")
    raw = batches.raw_events(spark, settings.store)
    assert raw.count() == 89
    opened = raw.selectExpr("input_file_name() AS file").distinct().collect()
    assert opened and not any("batch_id=4" in row.file for row in opened)


def test_a_batch_is_replaced_whole_and_invisible_until_committed(spark, settings):
    records = spark.createDataFrame(hundred(), BROKER_RECORD)
    first = write_batch(records, 7, settings.store)
    assert vars(first) == vars(write_batch(records, 7, settings.store))
    assert batches.raw_events(spark, settings.store).count() == 89
    empty = write_batch(records.limit(0), 7, settings.store)
    assert empty.input_count == 0
    assert batches.raw_events(spark, settings.store).count() == 0
    assert batches.hourly_deltas(spark, settings.store).count() == 0

    write_batch(records, 8, settings.store)
    storage.delete(spark, f"{settings.store.commits}/batch_id=8")
    assert batches.clean_events(spark, settings.store).count() == 0
    commit_batch(spark, first.__class__(8, 100, 89, 75, 25), settings.store)
    assert batches.clean_events(spark, settings.store).count() == 75
    assert dict(batches.clean_events(spark, settings.store).dtypes)["batch_id"] == "bigint"
    with pytest.raises(ValueError):
        write_batch(records, -1, settings.store)


def test_merge_twice_is_the_same(spark, settings):
    records = spark.createDataFrame(hundred(), BROKER_RECORD)
    write_batch(records.limit(60), 0, settings.store)
    write_batch(records.offset(60), 1, settings.store)
    assert publish_metrics(spark, settings.store) == publish_metrics(spark, settings.store) == 2
    assert cube_of(spark, settings) == CUBE


def test_a_merge_beside_a_reader_is_not_lost(spark, settings):
    records = spark.createDataFrame(hundred(), BROKER_RECORD)
    assert batches.hourly_metrics(spark, settings.store).isEmpty()
    write_batch(records.limit(40), 0, settings.store)
    publish_metrics(spark, settings.store)
    before = batches.hourly_metrics(spark, settings.store)
    write_batch(records.offset(40), 1, settings.store)
    target = settings.store.hourly_airline_metrics
    half = storage.new_version(target)
    spark.range(1).write.parquet(half)
    assert batches.hourly_metrics(spark, settings.store).inputFiles() == before.inputFiles()
    publish_metrics(spark, settings.store)
    assert cube_of(spark, settings) == CUBE
    # A reader that began with the old version still finishes with it.
    assert {r.airline_code: r.success_token_count for r in before.collect()} != {"CA": 70, "MU": 13}
    for _ in range(4):
        publish_metrics(spark, settings.store)
    assert len(storage.children(spark, f"{target}/{storage.MARKERS}")) == storage.KEPT_VERSIONS
    with pytest.raises(FileExistsError):
        storage.rename(spark, half, storage.current(spark, target))


UNSORTED = [
    ("20180830", 10, "MU", 1, 1),
    ("20180830", 2, "CA", 4, 7),
    ("20180829", 23, "3U", 2, 3),
]
CANONICAL = (
    b"stat_date,stat_hour,airline_code,successful_response_records,successful_booking_tokens\n"
    b"20180829,23,3U,2,3\n20180830,2,CA,4,7\n20180830,10,MU,1,1\n"
)


def exported(spark, folder, rows=UNSORTED):
    cube = spark.createDataFrame(rows, HOURLY_METRIC)
    return export_snapshot(spark, cube, folder, "root/", "v1")


def test_snapshot_bytes_and_manifest(spark, tmp_path):
    snapshot = exported(spark, f"{tmp_path}/snapshot")
    folder = pathlib.Path(storage.current(spark, f"{tmp_path}/snapshot"))
    digest = hashlib.sha256(CANONICAL).hexdigest()
    assert (folder / "metrics.csv").read_bytes() == CANONICAL
    manifest = {
        "metrics_sha256": digest,
        "output_version": "v1",
        "row_count": 3,
        "schema_version": 1,
        "source_hdfs_root": "root",
        "success_token_count": 11,
        "successful_response_records": 7,
    }
    expected = json.dumps(manifest, separators=(",", ":"), sort_keys=True) + "\n"
    # Key order follows the schema; content and layout are those of compact JSON.
    text = (folder / "manifest.json").read_text()
    assert json.loads(text) == manifest and len(text) == len(expected)
    assert snapshot.rows.count() == 3
    loaded = load_snapshot(spark, str(folder / "metrics.csv"), str(folder / "manifest.json"))
    assert loaded.metrics_sha256 == digest == snapshot.metrics_sha256
    # Another export does not change the rows of this one.
    exported(spark, f"{tmp_path}/snapshot", UNSORTED[:1])
    assert snapshot.rows.count() == 3
    with pytest.raises(SnapshotError, match="expectation says row_count"):
        load_snapshot(
            spark,
            str(folder / "metrics.csv"),
            str(folder / "manifest.json"),
            Expectations(row_count=4),
        )


HEAD, ROWS = CANONICAL.split(b"\n", 1)
BAD_FILES = [
    (b"", "no header line"),
    (HEAD + b"\n", "no rows"),
    (b"a,b\n" + ROWS, "wrong header"),
    (CANONICAL.replace(b"\n", b"\r\n"), "wrong header"),
    (CANONICAL.replace(b"MU,1,1\n", b"MU,1,1\r\n"), "not_canonical"),
    (CANONICAL[:-1], "line ends"),
    (CANONICAL.replace(b",1,1", b",1"), "wrong_column_count"),
    (CANONICAL.replace(b",2,CA", b",x,CA"), "not_an_integer"),
    (CANONICAL.replace(b",2,CA", b",02,CA"), "not_canonical"),
    (CANONICAL.replace(b",2,CA", b",24,CA"), "hour_out_of_range"),
    (CANONICAL.replace(b"20180829", b"20180230"), "invalid_stat_date"),
    (CANONICAL.replace(b"CA", b"ca"), "invalid_airline_code"),
    (CANONICAL.replace(b",1,1", b",-1,1"), "negative_metric"),
    (CANONICAL.replace(b",4,7", b",4,3"), "tokens_below_responses"),
    (CANONICAL.replace(b"20180830,10,MU", b"20180830,2,CA"), "repeated key"),
    (CANONICAL.replace(b"20180830,10", b"20180829,10"), "out of order"),
    (CANONICAL.replace(b",4,7", b",4,8"), "manifest says"),
]


def test_bad_snapshot_files_are_rejected_by_name(spark, tmp_path):
    exported(spark, f"{tmp_path}/snapshot")
    folder = pathlib.Path(storage.current(spark, f"{tmp_path}/snapshot"))
    for number, (content, reason) in enumerate(BAD_FILES):
        path = tmp_path / f"bad-{number}.csv"
        path.write_bytes(content)
        with pytest.raises(SnapshotError, match=reason):
            load_snapshot(spark, str(path), str(folder / "manifest.json"))


def test_bad_manifests_are_rejected(spark, tmp_path):
    exported(spark, f"{tmp_path}/snapshot")
    folder = pathlib.Path(storage.current(spark, f"{tmp_path}/snapshot"))
    good = json.loads((folder / "manifest.json").read_text())
    for number, (change, reason) in enumerate(
        [
            ({"schema_version": 2}, "schema_version"),
            ({"source_hdfs_root": " "}, "source_identity"),
            ({"row_count": -1}, "totals"),
            ({"metrics_sha256": "A" * 64}, "sha256"),
        ]
    ):
        path = tmp_path / f"manifest-{number}.json"
        path.write_text(json.dumps(good | change))
        with pytest.raises(SnapshotError, match=reason):
            load_snapshot(spark, str(folder / "metrics.csv"), str(path))


def test_a_failed_export_keeps_the_previous_snapshot(spark, tmp_path):
    exported(spark, f"{tmp_path}/snapshot")
    folder = pathlib.Path(storage.current(spark, f"{tmp_path}/snapshot"))
    with pytest.raises(SnapshotError, match="tokens_below_responses"):
        exported(spark, f"{tmp_path}/snapshot", [("20180830", 1, "CA", 2, 1)])
    assert (folder / "metrics.csv").read_bytes() == CANONICAL
    assert sorted(os.listdir(tmp_path / "snapshot")) == sorted([folder.name, storage.MARKERS])


def test_publication_states(spark, tmp_path):
    snapshot = exported(spark, f"{tmp_path}/snapshot")
    paths = ServingPaths(f"{tmp_path}/serving")
    assert reading.serving_table(spark, paths).isEmpty()
    with pytest.raises(LookupError):
        reading.current_publication(spark, paths)

    first = publish(spark, snapshot, paths)
    again = publish(spark, snapshot, paths)
    assert (first.status, again.status) == ("published", "unchanged")
    assert again.publication_id == first.publication_id
    forced = publish(spark, snapshot, paths, force=True)
    assert forced.status == "published" and forced.publication_id != first.publication_id
    assert validate_serving(spark, snapshot, paths) == (True, "the serving table holds this snapshot")
    served = reading.serving_table(spark, paths)
    assert {row.publication_id for row in served.collect()} == {forced.publication_id}
    assert reading.current_publication(spark, paths).first().publication_id == forced.publication_id

    # A snapshot whose declared totals are wrong is refused; the log says so.
    broken = type(snapshot)(**{**vars(snapshot), "row_count": 9})
    with pytest.raises(PublicationError, match="differ from"):
        publish(spark, broken, paths, force=True)
    log = reading.publication_log(spark, paths)
    recent = reading.recent_publications(log, 10).collect()
    assert [row.status for row in recent] == ["failed", "published", "published"]
    assert log.filter("status = 'failed'").first().failure_message.startswith("written totals")
    assert reading.serving_table(spark, paths).count() == 3
    assert not validate_serving(spark, broken, paths)[0]
    with pytest.raises(ValueError):
        reading.recent_publications(log, 0)

    other = exported(spark, f"{tmp_path}/other", UNSORTED[:2])
    publish(spark, other, paths)
    # The first content is known but no longer served, so it is published again.
    assert publish(spark, snapshot, paths).status == "published"


def test_refresh_cycle(spark, settings, tmp_path):
    serving = ServingPaths(f"{tmp_path}/serving")
    land(spark, f"{tmp_path}/records", hundred())

    def run():
        return refresh(
            spark,
            settings,
            serving,
            f"{tmp_path}/snapshot",
            record_file_stream(spark, f"{tmp_path}/records"),
        )

    assert (run().publication.status, run().publication.status) == ("published", "unchanged")
    totals = reading.serving_totals(reading.serving_table(spark, serving)).first()
    assert tuple(totals) == (2, 70, 83, 1)


MIXED = (
    "TB.P1780,ITARES,20180830,19,19:45:36:257,,,1,CA:success;CA:success;\n"
    "VA.P2241,ITARES,20180830,19,19:45:36:759,,,1,CA:success;\n"
    "VA.P2241,ITAREQ,20180830,19,19:45:36:647,payload,CA;,,\n"
    "MALFORMED\n"
    "VA.P2241,ITARES,20180830,19,19:45:36:759,,,1,CA:success;\n"
    "\n"
)


def test_profile_of_a_mixed_file(spark, tmp_path):
    source = tmp_path / "mixed.txt"
    source.write_text(MIXED)
    output = f"{tmp_path}/profile"
    row = write_profile(spark, str(source), output, invalid_limit=1).first().asDict()
    expected = {
        "source_name": "mixed.txt",
        "byte_size": len(MIXED),
        "sha256": hashlib.sha256(MIXED.encode()).hexdigest(),
        "physical_line_count": 6,
        "blank_line_count": 1,
        "valid_count": 4,
        "invalid_count": 2,
        "unsupported_count": 0,
        "earliest_date": "20180830",
        "latest_date": "20180830",
        "observed_hours": [19],
        "airline_codes": ["CA"],
        "total_success_tokens": 4,
        "successful_response_records": 3,
        "duplicate_record_count": 1,
        "duplicate_group_count": 1,
        "failure_reason_counts": {"blank_line": 1, "too_few_fields": 1},
        "log_type_counts": {"ITAREQ": 1, "ITARES": 3},
    }
    assert {name: row[name] for name in expected} == expected
    assert row["records_per_second"] > 0
    root, output = output, storage.current(spark, output)
    rejected = spark.read.csv(f"{output}/invalid_records.csv", header=True).collect()
    assert [tuple(r) for r in rejected] == [("4", "too_few_fields", "MALFORMED")]
    types = spark.read.json(f"{output}/log_type_counts.json").collect()
    assert {r.log_type: r.records for r in types} == {"ITARES": 3, "ITAREQ": 1}
    assert tuple(spark.read.json(f"{output}/duplicate_totals.json").first()) == (1, 1)
    metrics = spark.read.csv(f"{output}/hourly_airline_metrics.csv", header=True).collect()
    assert [tuple(r) for r in metrics] == [("20180830", "19", "CA", "3", "4")]
    with pytest.raises(FileExistsError):
        write_profile(spark, str(source), root)
    write_profile(spark, str(source), root, overwrite=True)
    with pytest.raises(ValueError):
        write_profile(spark, str(source), root, invalid_limit=-1)


def test_invalid_utf8_is_an_error(spark, tmp_path):
    source = tmp_path / "bad.txt"
    source.write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(lines.InvalidEncodingError):
        write_profile(spark, str(source), f"{tmp_path}/profile")
    with pytest.raises(lines.InvalidEncodingError):
        lines.require_utf8(spark, str(source))
    assert storage.current(spark, f"{tmp_path}/profile") is None


def test_rows_are_counted_once_per_batch():
    progress = [{"batchId": 0, "numInputRows": 40}] * 2 + [{"batchId": 1, "numInputRows": 60}]
    assert rows_seen(progress) == 100


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    texts = [f"{part}-{i}" * (1 + i % 5) for part in range(3) for i in range(5000)]
    for part in range(3):
        chunk = texts[part * 5000 : (part + 1) * 5000]
        (folder / f"part-{part}.txt").write_text("\n".join(chunk) + "\n")
    (folder / "part-9.txt").write_bytes(b"a\r\nb\rc\n\nlast")
    texts += ["a", "b", "c", "", "last"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = lines.log_lines(spark, str(folder), number_across_files=True)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 4
        rows = sorted((r.line_number, r.raw_line) for r in numbered.collect())
        assert rows == list(enumerate(texts, 1))
        per_file = lines.log_lines(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for row in per_file:
        by_file.setdefault(row.source_file.rsplit("/", 1)[1], []).append(
            (row.line_number, row.raw_line)
        )
    assert sorted(by_file["part-1.txt"]) == list(enumerate(texts[5000:10000], 1))


def test_numbering_never_shuffles_the_text(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a\nb\n")
    plan = lines.log_lines(spark, str(tmp_path / "log.txt"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "BroadcastHashJoin" in physical
    scans = [line for line in physical.splitlines() if "raw_line" in line]
    assert scans and not any("Exchange" in line or "Sort" in line for line in scans)


def test_file_identity(spark, tmp_path, monkeypatch):
    content = {f"f{i}.bin": os.urandom(3000 + i) for i in range(3)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    expected = {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    rows = lines.file_identity(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.byte_size, r.sha256) for r in rows} == expected
    assert tuple(lines.source_identity(spark, str(tmp_path)).first()) == (3, 9003, None)
    monkeypatch.setattr(lines, "WHOLE_FILE_BYTES", 3000)
    with pytest.raises(Exception, match="too large to hash"):
        lines.file_identity(spark, str(tmp_path)).collect()


def test_identity_split_by_split(spark, tmp_path, monkeypatch):
    """No task reads more than a split, and files beyond the bound of whole ones have digests."""
    mark = b"\xef\xbb\xbf"
    contents = (os.urandom(70_000), os.urandom(50_000) + b"\n\n", mark + os.urandom(30_000) + b"\r\n", b"x" * 9000, b"y")
    content = {f"f {i}.bin": data for i, data in enumerate((*contents, gzip.compress(os.urandom(2000))))}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed.gz").write_bytes(content.setdefault("packed.gz", gzip.compress(b"a line\n" * 50_000)))
    expected = {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    monkeypatch.setattr(lines, "STEP_FILE_BYTES", 100)
    monkeypatch.setattr(lines, "WHOLE_FILE_BYTES", 25_000)
    for size in ("7000", "40000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = lines.stepwise_identity(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(rows) == len(expected)
        found = {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.byte_size, r.sha256) for r in rows}
        assert found == expected


def test_kafka_options_and_missing_connector(spark):
    topic = Topic("broker:1", "log", from_start=False, batch_records=5, read_tasks=7)
    assert stream_options(topic) == {
        "kafka.bootstrap.servers": "broker:1",
        "subscribe": "log",
        "startingOffsets": "latest",
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": "5",
        "minPartitions": "7",
    }
    assert whole_topic_options(topic)["endingOffsets"] == "latest"
    for read in (topic_stream, whole_topic):
        with pytest.raises(Exception, match="kafka"):
            read(spark, topic)


def test_a_log_file_becomes_records_and_is_sent(spark, tmp_path):
    assert send_options("broker:1", "log")["kafka.acks"] == "all"
    assert send_options("broker:1", "log")["kafka.enable.idempotence"] == "true"
    (tmp_path / "day.log").write_text("A,ITARES,20180830,1,t,CA:success;\nB,ITAREQ,20180830,2,t\n")
    records = file_records(spark, f"{tmp_path}/day.log")
    verdicts = verify_strictly(records).collect()
    assert [row.violation for row in verdicts] == [None, None]
    values = [json.loads(bytes(row.value)) for row in records.collect()]
    digest = hashlib.sha256((tmp_path / "day.log").read_bytes()).hexdigest()
    assert {(v["source_file"], v["source_file_sha256"]) for v in values} == {("day.log", digest)}
    assert sorted(v["source_line_number"] for v in values) == [1, 2]
    with pytest.raises(Exception, match="kafka"):
        write_to_topic(records, "broker:1", "log")


@pytest.mark.parametrize(
    "make",
    [
        lambda: Store(" "),
        lambda: Store("d", "v0"),
        lambda: Store("d", "v1/x"),
        lambda: Ingest(Store("d"), ""),
        lambda: Ingest(Store("d"), "c", every=" "),
        lambda: Topic("", "t"),
        lambda: Topic("s", " "),
        lambda: Topic("s", "t", batch_records=0),
    ],
)
def test_bad_settings_are_rejected(make):
    with pytest.raises(ValueError):
        make()


def test_layout():
    assert Store("r/", "v2").raw_events == "r/v2/raw_events"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_folder(Session, "x")
