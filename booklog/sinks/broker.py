"""Log lines to broker records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.operators.envelope import build_envelopes, encode_envelopes
from booklog.sources.lines import file_identity, log_lines


def broker_records(lines: DataFrame, source_file: str, source_sha256: str) -> DataFrame:
    """``key, value`` of one source's numbered lines, produced now."""
    envelopes = build_envelopes(
        lines.select("line_number", "raw_line"),
        F.lit(source_file),
        F.lit(source_sha256),
        F.current_timestamp(),
    )
    return encode_envelopes(envelopes)


def send_options(servers: str, topic: str) -> dict[str, str]:
    """Every replica confirms, and a repeated send is stored once."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }


def write_to_topic(records: DataFrame, servers: str, topic: str) -> None:
    """Sends ``key, value`` rows; needs Spark's Kafka connector on the class path."""
    records.write.format("kafka").options(**send_options(servers, topic)).save()


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """The broker records of one log file: its lines, numbered, under its name and digest."""
    identity = file_identity(spark, path).first()
    name = identity.path.rpartition("/")[2]
    return broker_records(log_lines(spark, path), name, identity.sha256)
