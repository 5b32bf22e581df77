"""Every registered query against its SQL oracle, and the known totals of the small log."""

import hashlib
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from booklog import registry
from tests.comparison import differences, oracle_connection

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(spark, connection, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, connection, entry.oracle_sql()[name]) is None


def test_table_files_are_hashed(spark):
    expected = set()
    for file in Path(SF_DIR).glob("*.parquet"):
        content = file.read_bytes()
        expected.add((file.name, len(content), hashlib.sha256(content).hexdigest()))
    rows = entry.queries()["src_table_identity"](spark, SF_DIR).collect()
    assert len(expected) > 1 and len(rows) == len(expected) and {tuple(row) for row in rows} == expected


@pytest.mark.skipif("0.001" not in SF_DIR, reason="totals of the smallest tables")
def test_known_totals(spark):
    totals = entry.queries()["agg_profile_totals"](spark, SF_DIR).first()
    assert (totals.physical_line_count, totals.valid_count) == (1000, 930)
    assert (totals.successful_response_records, totals.total_success_tokens) == (555, 730)
    assert (totals.duplicate_group_count, totals.duplicate_record_count) == (3, 27)
    best = entry.entry(spark).limit(3).collect()
    assert [tuple(row) for row in best] == [("CX", 75, 101), ("HX", 69, 92), ("MU", 67, 82)]
