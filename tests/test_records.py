from booklog.operators import metrics, records
from pyspark.sql import functions as F


def frame(spark, *lines):
    rows = list(enumerate(lines, 1))
    return spark.createDataFrame(rows, "line_number long, raw_line string")


CASES = [
    ("G,ITARES,20180830,19,19:00:00:000,CA:success;", None),
    (" G , ITAREQ , 20180830 , +9 ,19:00:00:000", None),
    ("\tG　, ITARES ,20180830\x1f,7,19:00:00:000", None),
    ("", "blank_line"),
    (" \t　 ", "blank_line"),
    ("\t,x", "too_few_fields"),
    ("G,ITARES,20180830,19", "too_few_fields"),
    (" ,ITARES,20180830,19,19:00:00:000", "missing_group_id"),
    ("G, ,20180830,19,19:00:00:000", "missing_log_type"),
    ("G,ITARES,20181340,19,19:00:00:000", "invalid_date"),
    ("G,ITARES,20180230,19,19:00:00:000", "invalid_date"),
    ("G,ITARES,2018083,19,19:00:00:000", "invalid_date"),
    ("G,ITARES,00000830,19,19:00:00:000", "invalid_date"),
    ("G,ITARES,20180830,24,19:00:00:000", "invalid_hour"),
    ("G,ITARES,20180830,-1,19:00:00:000", "invalid_hour"),
    ("G,ITARES,20180830,9.5,19:00:00:000", "invalid_hour"),
    ("G,ITARES,20180830,x,19:00:00:000", "invalid_hour"),
    ("G,OTHER,20180830,19,19:00:00:000", "unsupported_log_type"),
    (",,,,", "missing_group_id"),
    ("组,ITARES,20180830,19,19:00:00:000", None),
]


def test_first_broken_rule_wins(spark):
    lines = frame(spark, *[line for line, _ in CASES])
    classified = records.classify_records(lines).orderBy("line_number").collect()
    assert [row.record_reason for row in classified] == [reason for _, reason in CASES]


def test_unicode_white_space_is_stripped_from_fields_only(spark):
    lines = frame(spark, "\tG　x　, ITARES ,20180830\x1f,7,t  ,　p　")
    row = records.clean_records(lines).first()
    assert (row.log_type, row.event_date, row.event_hour, row.event_time) == (
        "ITARES",
        "20180830",
        7,
        "t",
    )
    assert row.raw_line.endswith("　p　")
    assert records.classify_records(lines).first().field_group_id == "G　x"


def test_split_keeps_empty_fields(spark):
    row = records.split_fields(frame(spark, "a,,c,,e,,")).first()
    assert row.field_count == 7
    assert (row.field_group_id, row.log_type, row.event_date) == ("a", "", "c")


def test_status_and_partial_fields_of_rejected_records(spark):
    lines = frame(
        spark,
        ",ITARES,20180830,19,t",
        "G,,20180830,19,t",
        "G,ITARES,x,19,t",
        "G,ITARES,20180830,24,t",
        "G,OTHER,20180830,1,t",
        "G,ITAREQ,20180830,1,t",
        "short",
    )
    columns = ("group_id", "log_type", "event_date", "event_hour", "event_time", "parse_status")
    rows = records.parsed_records(lines).orderBy("line_number").select(*columns).collect()
    assert [tuple(row) for row in rows] == [
        (None, "ITARES", None, None, None, "invalid"),
        ("G", None, None, None, None, "invalid"),
        ("G", "ITARES", None, None, None, "invalid"),
        ("G", "ITARES", "20180830", None, None, "invalid"),
        ("G", "OTHER", "20180830", 1, "t", "unsupported"),
        ("G", "ITAREQ", "20180830", 1, "t", "valid"),
        (None, None, None, None, None, "invalid"),
    ]


def test_token_boundaries(spark):
    payloads = {
        "CA:success;CA:success;": ["CA", "CA"],
        "XCA:success;": [],
        "xCA:success;": ["CA"],
        "CA:successful;": [],
        "CA:success9": ["CA"],
        "CA:success": ["CA"],
        "CA:fail;MU:success;": ["MU"],
        "ca:success;": [],
        "3U:success;": ["3U"],
        ",CA:success MU:success": ["CA", "MU"],
    }
    lines = frame(spark, *[f"G,ITARES,20180830,1,t,{text}" for text in payloads])
    rows = metrics.token_rows(records.clean_records(lines))
    found = {number: [] for number in range(1, len(payloads) + 1)}
    for row in rows.orderBy("line_number", "place").collect():
        found[row.line_number].append(row.airline_code)
    assert list(found.values()) == list(payloads.values())


def cube(df):
    return {
        row.airline_code: (row.successful_response_records, row.success_token_count)
        for row in df.collect()
    }


def test_repeated_tokens_count_one_response(spark):
    lines = frame(
        spark,
        "A,ITARES,20180830,19,t,CA:success;CA:success;MU:success;",
        "B,ITARES,20180830,19,t,CA:success;",
        "C,ITAREQ,20180830,19,t,CA:success;",
    )
    clean = records.clean_records(lines)
    expected = {"CA": (2, 3), "MU": (1, 1)}
    assert cube(metrics.line_metrics(clean)) == expected
    by_line = clean.withColumn("event_id", F.sha2(F.col("line_number").cast("string"), 256))
    assert cube(metrics.event_metrics(by_line)) == expected


def test_a_repeated_event_counts_its_tokens_again_but_one_response(spark):
    line = "A,ITARES,20180830,19,t,CA:success;CA:success;"
    clean = records.clean_records(frame(spark, line, line))
    same_id = clean.withColumn("event_id", F.lit("ab" * 32))
    assert cube(metrics.event_metrics(same_id)) == {"CA": (1, 4)}
    tokens = metrics.token_rows(same_id)
    joined = metrics.join_metrics(metrics.response_counts(tokens), metrics.token_counts(tokens))
    assert cube(joined) == {"CA": (1, 4)}


def test_merge_recomputes_from_all_deltas(spark):
    deltas = spark.createDataFrame(
        [
            (0, "20180830", 19, "CA", 7, 11),
            (5, "20180830", 19, "CA", 1, 2),
            (5, "20180830", 19, "MU", 9, 9),
        ],
        "batch_id long, event_date string, event_hour int, airline_code string, "
        "successful_response_records long, success_token_count long",
    )
    assert cube(metrics.merge_metrics(deltas)) == {"CA": (8, 13), "MU": (9, 9)}
