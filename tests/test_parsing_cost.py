from datetime import date

from pyspark.sql import functions as F

from booklog.operators.classified import classify_broker_records
from booklog.operators.records import parse_date
from booklog.schema import BROKER_RECORD
from tests.test_storage import hundred


def test_a_record_costs_no_pattern_and_no_copy_of_the_parsed_array(spark):
    classified = classify_broker_records(spark.createDataFrame(hundred(), BROKER_RECORD))
    plan = classified._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(StructType(") == 1
    assert "gettimestamp(" not in plan and "parsed#" not in plan
    assert classified.filter("failure_reason IS NULL").count() == 75


def test_dates_are_those_of_the_pattern(spark):
    texts = ["20180830", "20200229", "20190229", "15000229", "00010101", "00000101", "99991231", "20181340", "20180431"]
    texts += ["20180830\n", " 20180830", "2018830", "201808300", "2018-8-3", "２０１８０８３０", "", None]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").select("text", parse_date(F.col("text")).alias("day"))
    valid = {row.text: row.day for row in rows.filter("day IS NOT NULL").collect()}
    assert valid == {
        "20180830": date(2018, 8, 30),
        "20200229": date(2020, 2, 29),
        "00010101": date(1, 1, 1),
        "99991231": date(9999, 12, 31),
    }
    plain = rows.filter(F.col("text").rlike("^(?!0000)[0-9]{8}$"))
    pattern = F.try_to_timestamp("text", F.lit("yyyyMMdd")).cast("date")
    assert plain.filter(~pattern.eqNullSafe(F.col("day"))).isEmpty()
