from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from booklog.config import Store
from booklog.plans.event_log import LEAST_EVENTS, event_records, read_events
from booklog.registry.queries import broker_records
from booklog.schema import BROKER_RECORD
from booklog.sinks import batch
from booklog.sources import batches
from tests.test_storage import hundred


def events_file(folder, number):
    """One file with a single row group."""
    moments = [datetime(2024, 1, 1) + timedelta(seconds=i) for i in range(number)]
    kinds = [("view", "purchase", "signup", "error")[i % 4] for i in range(number)]
    columns = {"event_id": range(number), "ts": moments, "user_id": range(number), "event_type": kinds}
    schema = pa.schema({"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string()})
    pq.write_table(pa.table({k: list(v) for k, v in columns.items()}, schema), folder / "events.parquet")
    return str(folder)


def test_records_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    number = 8 * LEAST_EVENTS
    folder = events_file(tmp_path, number)
    records = broker_records(spark, folder)
    sizes = [row["count"] for row in records.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * number / 8
    plain = event_records(read_events(spark, folder))
    assert records.exceptAll(plain).isEmpty() and records.count() == number


def test_few_events_stay_together(spark, tmp_path):
    assert broker_records(spark, events_file(tmp_path, 100)).rdd.getNumPartitions() == 1
    assert broker_records(spark, events_file(tmp_path, 0)).count() == 0


def test_a_batch_is_cached_without_encoding(spark, tmp_path, monkeypatch):
    name, seen, write = "spark.sql.inMemoryColumnarStorage.compressed", [], batch.replace_batch

    def replace(frame, dataset, batch_id):
        seen.append(frame.sparkSession.conf.get(name))
        write(frame, dataset, batch_id)

    monkeypatch.setattr(batch, "replace_batch", replace)
    before, paths = spark.conf.get(name), Store(f"{tmp_path}/data")
    batch.write_batch(spark.createDataFrame(hundred(), BROKER_RECORD), 0, paths)
    assert seen[0] == "false" and set(seen[1:]) == {before} and spark.conf.get(name) == before
    assert (batches.clean_events(spark, paths).count(), batches.dead_letters(spark, paths).count()) == (75, 25)
