import hashlib
import json

from pyspark.sql import functions as F

from booklog.operators import audit, classified, envelope, metrics
from booklog.schema import BROKER_RECORD
from booklog.sinks.broker import broker_records

SOURCE = "b" * 64


def event_id(number, line, source=SOURCE):
    return hashlib.sha256(f"1\n{source}\n{number}\n{line}".encode()).hexdigest()


def message(line, number=1, **changes):
    """Key and value of one envelope, with overridden fields."""
    group = line.split(",", 1)[0].strip() or None
    fields = {
        "schema_version": 1,
        "event_id": event_id(number, line),
        "source_file": "log.txt",
        "source_file_sha256": SOURCE,
        "source_line_number": number,
        "group_id": group,
        "raw_line": line,
        "produced_at": "2026-08-11T00:00:00.000Z",
    }
    fields.update(changes)
    for name in [name for name, value in fields.items() if value is ...]:
        del fields[name]
    value = json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return (group or event_id(number, line)).encode(), value.encode()


def topic(spark, *messages):
    rows = [
        (key, value, "gds.raw.v1", i % 3, i // 3, None) for i, (key, value) in enumerate(messages)
    ]
    return spark.createDataFrame(rows, BROKER_RECORD)


GOOD = "VA.P中文,ITARES,20180830,19,19:00:00:000,CA:success;"
CASES = [
    (message(GOOD), None, None),
    (message("only one field", 2), None, None),
    ((message(",x", 3)), None, None),
    ((message(",x", 3, group_id="")), None, None),
    ((b"k", None), "invalid_json", "missing_value"),
    ((b"k", b"not-json"), "invalid_json", "invalid_json"),
    ((b"k", b"[1]"), "invalid_json", "not_an_object"),
    ((message(GOOD)[0], message(GOOD)[1] + b" junk"), "invalid_json", "invalid_json"),
    ((message(GOOD)[0], message(GOOD)[1] * 2), "invalid_json", "invalid_json"),
    ((message(GOOD)[0], message(GOOD)[1] + b"," + message(GOOD)[1]), "invalid_json", "invalid_json"),
    ((message(GOOD)[0], b" " + message(GOOD)[1] + b"\n"), None, None),
    ((message(GOOD)[0], b'{"group_id":"other",' + message(GOOD)[1][1:]), None, "invalid_json"),
    ((b"k", b""), "invalid_json", "invalid_json"),
    ((b"k", message(GOOD)[1][:-1]), "invalid_json", "invalid_json"),
    ((b"k", message(GOOD)[1].replace(b"\xe4\xb8\xad", b"\xff\xfe")), "invalid_json", "invalid_utf8"),
    ((b"k", b"{}"), "missing_required_fields", "missing_fields"),
    (message(GOOD, produced_at=...), "missing_required_fields", "missing_fields"),
    (message(GOOD, schema_version="1"), "missing_required_fields", "unsupported_schema_version"),
    (message(GOOD, schema_version=2), "unsupported_schema_version", "unsupported_schema_version"),
    (message(GOOD, event_id="0" * 64), "event_id_mismatch", "event_id_mismatch"),
    (message(GOOD, source_line_number=9), "event_id_mismatch", "event_id_mismatch"),
    ((b"WRONG", message(GOOD)[1]), "kafka_key_mismatch", "kafka_key_mismatch"),
    ((None, message(GOOD)[1]), "kafka_key_mismatch", "kafka_key_mismatch"),
    (message(GOOD, produced_at=5), None, "invalid_field_type"),
    (message("x,y", 4, group_id=...), "kafka_key_mismatch", "missing_fields"),
]


def test_first_broken_envelope_rule_wins(spark):
    records = topic(spark, *[case[0] for case in CASES])
    order = ["offset", "partition"]
    loose = envelope.classify_envelopes(records).orderBy(*order).collect()
    assert [row.envelope_reason for row in loose] == [case[1] for case in CASES]
    strict = envelope.verify_strictly(records).orderBy(*order).collect()
    assert [row.violation for row in strict] == [case[2] for case in CASES]
    assert all((row.verified_id is None) == (row.violation is not None) for row in strict)


def test_unicode_group_and_broker_metadata_survive(spark):
    row = envelope.valid_envelopes(topic(spark, message(GOOD))).first()
    assert (row.group_id, row.raw_line, row.topic, row.offset) == (
        "VA.P中文",
        GOOD,
        "gds.raw.v1",
        0,
    )


def test_encoded_messages_are_compact_sorted_json(spark):
    lines = spark.createDataFrame(
        [(1, 'A "q"\\,中文'), (2, "")], "line_number long, raw_line string"
    )
    for row in broker_records(lines, "log.txt", SOURCE).collect():
        fields = json.loads(bytes(row.value))
        again = json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert bytes(row.value).decode() == again
        assert fields["event_id"] == event_id(fields["source_line_number"], fields["raw_line"])
        key = fields["group_id"] or fields["event_id"]
        assert bytes(row.key).decode() == key
        assert fields["produced_at"][-5] == "." and fields["produced_at"].endswith("Z")


def test_production_time_is_utc_in_any_session_zone(spark):
    lines = spark.createDataFrame([(1, "a,b")], "line_number long, raw_line string")
    noon = F.timestamp_seconds(F.lit(1_700_000_000))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        built = envelope.build_envelopes(lines, F.lit("f"), F.lit(SOURCE), noon).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert built.produced_at == "2023-11-14T22:13:20.000Z"


def test_conservation_and_quality(spark):
    records = topic(
        spark,
        message(GOOD, 1),
        message("B,ITAREQ,20180830,1,t", 2),
        message("C,ITARES,20180830,1,t", 3),
        message("D,ITARES,20180830,24,t", 4),
        (b"k", b"not-json"),
    )
    rows = classified.classify_broker_records(records)
    raw, clean, dead = (
        split(rows)
        for split in (classified.raw_events, classified.clean_events, classified.dead_letters)
    )
    assert (raw.count(), clean.count(), dead.count()) == (4, 3, 2)
    quality = classified.quality_metrics(rows, 5)
    assert sorted(
        (row.metric_name, row.failure_stage or "", row.failure_reason or "", row.metric_value)
        for row in quality.collect()
    ) == [
        ("business_valid_count", "", "", 3),
        ("dead_letter_count", "envelope", "invalid_json", 1),
        ("dead_letter_count", "gds", "invalid_hour", 1),
        ("envelope_valid_count", "", "", 4),
        ("input_count", "", "", 5),
    ]
    texts = {row.failure_stage: row.value_text for row in dead.collect()}
    assert texts == {"envelope": "not-json", "gds": None}
    summary = audit.pipeline_summary(raw, clean, dead, quality).first().asDict()
    assert summary["input_count"] == summary["raw_plus_envelope_dead_count"] == 5
    assert summary["clean_plus_business_dead_count"] == 4
    assert summary["unique_kafka_locations"] == 5


def test_quality_of_an_empty_batch(spark):
    rows = classified.classify_broker_records(topic(spark).limit(0))
    values = {row.metric_name: row.metric_value for row in classified.quality_metrics(rows, 0).collect()}
    assert values == {"input_count": 0, "envelope_valid_count": 0, "business_valid_count": 0}


def test_topic_verification(spark):
    first, second = message(GOOD, 1), message("B,ITAREQ,20180830,1,t", 2)
    rows = [first, second, first, (b"WRONG", first[1])]
    records = spark.createDataFrame(
        [(k, v, "t", p, i, None) for i, ((k, v), p) in enumerate(zip(rows, (0, 2, 0, 1)))],
        BROKER_RECORD,
    )
    assert tuple(audit.verify_topic(records).first()) == (4, 3, 1, 1)
    counts = [tuple(row) for row in audit.partition_counts(records).collect()]
    assert counts == [(0, 2), (1, 1), (2, 1)]
    report = audit.topic_report(records, 4).first()
    assert report.partition_counts == {0: 2, 1: 1, 2: 1} and not report.sound
    once = topic(spark, first, second)
    assert audit.topic_report(once, 2).first().sound
    assert not audit.topic_report(once, 3).first().sound


def test_no_python_in_the_hot_path(spark):
    rows = classified.classify_broker_records(topic(spark, message(GOOD)))
    deltas = metrics.hourly_deltas(classified.clean_events(rows), 1)
    for df in (rows, deltas, classified.quality_metrics(rows, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        assert plan.count("from_json(StructField") <= 1


def test_a_record_is_parsed_once(spark):
    """The decode is mentioned once in the plan; a generator computes each mention anew."""
    rows = classified.classify_broker_records(topic(spark, message(GOOD)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(ArrayType(StructType(") == 1


def test_confirmed_prefix_and_gaps_against_brute_force(spark):
    bits = audit.BITMAP_BITS
    sources = {
        "gap": [1, 2, 3, 5, 6, 2],
        "late": [2, 3],
        "whole": list(range(1, 2 * bits + 10)),
        "full bucket": list(range(1, bits + 1)),
        "second bucket": [n for n in range(1, 2 * bits + 1) if n != bits + 8],
        "missing bucket": [*range(1, bits + 1), *range(2 * bits + 1, 2 * bits + 5)],
        "edge": [n for n in range(1, bits + 100) if n != bits],
    }
    rows = [(name, n) for name, numbers in sources.items() for n in numbers]
    lines = spark.createDataFrame(rows, "source_file string, source_line_number long")
    expected_prefix, expected_gaps = {}, set()
    for name, numbers in sources.items():
        present, prefix, previous = set(numbers), 0, 0
        while prefix + 1 in present:
            prefix += 1
        expected_prefix[name] = (prefix, len(present))
        for n in sorted(present):
            if n > previous + 1:
                expected_gaps.add((name, previous + 1, n - 1))
            previous = n
    found = {
        row.source_file: (row.confirmed_line, row.distinct_lines)
        for row in audit.confirmed_prefix(lines).collect()
    }
    assert found == expected_prefix
    assert {tuple(row) for row in audit.line_gaps(lines).collect()} == expected_gaps
    for df in (audit.confirmed_prefix(lines), audit.line_gaps(lines)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_reconcile_lists_only_differences(spark):
    schema = (
        "event_date string, event_hour int, airline_code string, "
        "successful_response_records long, success_token_count long"
    )
    left = spark.createDataFrame([("d", 1, "CA", 1, 2), ("d", 1, "MU", 1, 1)], schema)
    right = spark.createDataFrame([("d", 1, "CA", 1, 3), ("d", 2, "MU", 1, 1)], schema)
    rows = audit.reconcile(left, right).select("event_hour", "airline_code").collect()
    assert sorted(map(tuple, rows)) == [(1, "CA"), (1, "MU"), (2, "MU")]
    assert audit.reconcile(left, left.withColumn("event_hour", F.lit(1))).isEmpty()
