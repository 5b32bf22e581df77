"""Schemas and closed vocabularies shared by every stage of the pipeline."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# Fixed values of the log and envelope contracts.
LOG_TYPES = ("ITARES", "ITAREQ")
RESPONSE_TYPE = "ITARES"
ENVELOPE_STAGE = "envelope"
RECORD_STAGE = "gds"
STATUS_VALID, STATUS_INVALID, STATUS_UNSUPPORTED = "valid", "invalid", "unsupported"
REQUIRED_ENVELOPE_FIELDS = (
    "schema_version",
    "event_id",
    "source_file",
    "source_file_sha256",
    "source_line_number",
    "raw_line",
    "produced_at",
)
SNAPSHOT_COLUMNS = (
    "stat_date",
    "stat_hour",
    "airline_code",
    "successful_response_records",
    "successful_booking_tokens",
)
SUCCESS_TOKEN = r"(?<![A-Z0-9])([A-Z0-9]{2}):success(?![A-Za-z])"
AIRLINE_CODE = "^[A-Z0-9]{1,8}$"
SHA256_HEX = "^[0-9a-f]{64}$"

DIMENSIONS = ["event_date", "event_hour", "airline_code"]
MEASURES = ["successful_response_records", "success_token_count"]


_TYPES = {
    "binary": T.BinaryType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs, usable before any session exists."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BROKER_RECORD = _struct(
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
)
ENVELOPE = _struct(
    "schema_version int, event_id string, source_file string, source_file_sha256 string, "
    "source_line_number bigint, group_id string, raw_line string, produced_at string"
)
BROKER_METADATA = _struct(
    "topic string, partition int, offset bigint, kafka_timestamp timestamp"
)
RAW_EVENT = T.StructType([*ENVELOPE.fields, *BROKER_METADATA.fields])
CLEAN_EVENT = T.StructType(
    [
        *RAW_EVENT.fields,
        *_struct("log_type string, event_date string, event_hour int, event_time string").fields,
    ]
)
DEAD_LETTER = T.StructType(
    [
        *RAW_EVENT.fields,
        *_struct("value_text string, failure_stage string, failure_reason string").fields,
    ]
)
QUALITY_METRIC = _struct(
    "batch_id bigint, metric_name string, failure_stage string, failure_reason string, "
    "metric_value bigint"
)
HOURLY_METRIC = _struct(
    "event_date string, event_hour int, airline_code string, "
    "successful_response_records bigint, success_token_count bigint"
)
HOURLY_DELTA = T.StructType([T.StructField("batch_id", T.LongType()), *HOURLY_METRIC.fields])
BATCH_COMMIT = _struct(
    "batch_id bigint, input_count bigint, envelope_valid_count bigint, "
    "business_valid_count bigint, dead_letter_count bigint"
)
SNAPSHOT_MANIFEST = _struct(
    "metrics_sha256 string, output_version string, row_count bigint, schema_version int, "
    "source_hdfs_root string, success_token_count bigint, successful_response_records bigint"
)
SERVING_METRIC = _struct(
    "stat_date date, stat_hour int, airline_code string, successful_response_records bigint, "
    "success_token_count bigint, publication_id string, updated_at timestamp"
)
PUBLICATION = _struct(
    "publication_id string, source_hdfs_root string, output_version string, "
    "source_row_count bigint, successful_response_records bigint, success_token_count bigint, "
    "metrics_sha256 string, status string, failure_message string, started_at timestamp, "
    "completed_at timestamp"
)
