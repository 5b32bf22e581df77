"""Versioned JSON envelopes around log lines: build, decode, verify, split."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from booklog.functions import evaluate_once, event_id, group_id_of, partition_key
from booklog.schema import (
    BROKER_METADATA,
    ENVELOPE,
    ENVELOPE_STAGE,
    RAW_EVENT,
    REQUIRED_ENVELOPE_FIELDS,
    SCHEMA_VERSION,
)

# Explicit options keep the optimizer from splitting one decode into one decode per field.
_DECODE = {"mode": "PERMISSIVE"}


def build_envelopes(
    lines: DataFrame, source_file: Column, source_sha256: Column, produced_at: Column
) -> DataFrame:
    """Envelope columns for rows of ``line_number, raw_line``; other columns stay."""
    others = [name for name in lines.columns if name not in ("line_number", "raw_line")]
    identity = event_id(source_sha256, F.col("line_number"), F.col("raw_line"))
    utc = F.to_utc_timestamp(produced_at, F.current_timezone())
    return lines.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        identity.alias("event_id"),
        source_file.alias("source_file"),
        source_sha256.alias("source_file_sha256"),
        F.col("line_number").alias("source_line_number"),
        group_id_of(F.col("raw_line")).alias("group_id"),
        "raw_line",
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("produced_at"),
        *others,
    )


def encode_envelopes(envelopes: DataFrame) -> DataFrame:
    """Broker ``key, value``: compact JSON in key order, a missing group kept as null."""
    payload = F.to_json(F.struct(*sorted(ENVELOPE.fieldNames())), {"ignoreNullFields": "false"})
    others = [name for name in envelopes.columns if name not in ENVELOPE.fieldNames()]
    return envelopes.select(
        partition_key(F.col("group_id"), F.col("event_id")).cast("binary").alias("key"),
        payload.cast("binary").alias("value"),
        *others,
    )


def decode_records(records: DataFrame) -> DataFrame:
    """Broker bytes to text and typed envelope fields, one JSON parse per record.

    The text is parsed as the only element of an array, so that anything after the closing
    brace makes the document invalid instead of being passed over. A lambda takes that array
    down to its element: mentioned twice outside of one, it would be parsed twice for every record,
    and as a column it would be copied along with it.
    """
    text = records.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("value_text"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
    )
    parsed = F.from_json(_as_array(F.col("value_text")), T.ArrayType(ENVELOPE), _DECODE)
    only = F.transform(F.array(parsed), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    decoded = text.select("*", F.explode(only).alias("envelope"))
    return decoded.select(
        "kafka_key", "value_text", "envelope.*", *BROKER_METADATA.fieldNames()
    )


def _as_array(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def envelope_reason() -> Column:
    """First envelope rule that a decoded record breaks, null when it breaks none.

    Whether the text is a JSON object at all only matters once a field is missing, so the
    second parse runs for those records alone. The key check can rely on the id, because
    the id check comes before it. Keys compare null-safely: no key is a wrong key.
    """
    missing = reduce(or_, [F.col(name).isNull() for name in REQUIRED_ENVELOPE_FIELDS])
    text = F.col("value_text")
    objects = F.from_json(_as_array(text), "array<map<string,string>>", _DECODE)
    as_object = F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))
    expected_id = event_id(
        F.col("source_file_sha256"), F.col("source_line_number"), F.col("raw_line")
    )
    expected_key = partition_key(F.col("group_id"), F.col("event_id"))
    return (
        F.when(text.isNull() | ~F.is_valid_utf8(text), "invalid_json")
        .when(missing & as_object.isNull(), "invalid_json")
        .when(missing, "missing_required_fields")
        .when(F.col("schema_version") != SCHEMA_VERSION, "unsupported_schema_version")
        .when(F.col("event_id") != expected_id, "event_id_mismatch")
        .when(~F.col("kafka_key").eqNullSafe(expected_key), "kafka_key_mismatch")
    )


def classify_envelopes(records: DataFrame) -> DataFrame:
    return decode_records(records).withColumn("envelope_reason", envelope_reason())


def valid_envelopes(records: DataFrame) -> DataFrame:
    classified = classify_envelopes(records)
    return classified.filter("envelope_reason IS NULL").select(*RAW_EVENT.fieldNames())


def dead_envelopes(records: DataFrame) -> DataFrame:
    classified = classify_envelopes(records)
    return classified.filter("envelope_reason IS NOT NULL").select(
        *RAW_EVENT.fieldNames(),
        "value_text",
        F.lit(ENVELOPE_STAGE).alias("failure_stage"),
        F.col("envelope_reason").alias("failure_reason"),
    )


def verify_strictly(records: DataFrame) -> DataFrame:
    """Independent verdict per broker record, judging JSON types instead of coercing them.

    Adds ``verified_id`` (null when the record is invalid) and ``violation`` (null when it
    is valid). Unlike the ingest path it wants all eight fields present, a group that may
    be null, and exact JSON types. Text after the document, and a document that repeats a
    key, are ``invalid_json``: which of two values is meant can't be told.
    """
    others = [name for name in records.columns if name not in ("key", "value")]
    text = records.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("value_text"),
        *others,
    )
    listed = evaluate_once(text, "listed", F.try_parse_json(_as_array(F.col("value_text"))))
    only = F.when(
        F.try_variant_get("listed", "$[1]", "variant").isNull(), F.try_variant_get("listed", "$[0]", "variant")
    )
    document = evaluate_once(listed, "document", only)
    names = ENVELOPE.fieldNames()
    fields = evaluate_once(
        document,
        "fields",
        F.struct(*[F.try_variant_get("document", f"$.{name}", "variant").alias(name) for name in names]),
    )
    typed = fields.select(
        *others,
        "kafka_key",
        "value_text",
        F.schema_of_variant("document").alias("document_type"),
        reduce(or_, [F.col(f"fields.{name}").isNull() for name in names]).alias("is_incomplete"),
        *[F.schema_of_variant(F.col(f"fields.{name}")).alias(f"{name}_type") for name in names],
        *[
            F.try_variant_get(F.col(f"fields.{field.name}"), "$", field.dataType.simpleString()).alias(field.name)
            for field in ENVELOPE.fields
        ],
        F.try_variant_get(F.col("fields.schema_version"), "$", "double").alias("version_number"),
    )
    judged = evaluate_once(typed, "violation", _violation())
    verified_id = F.when(F.col("violation").isNull(), F.col("event_id"))
    return judged.select(*others, verified_id.alias("verified_id"), "violation")


def _violation() -> Column:
    def wrong_type(name: str, *allowed: str) -> Column:
        return ~F.col(f"{name}_type").isin(*allowed)

    texts = ("event_id", "source_file", "source_file_sha256", "raw_line", "produced_at")
    wrong_types = reduce(
        or_,
        [wrong_type(name, "STRING") for name in texts]
        + [wrong_type("source_line_number", "BIGINT"), wrong_type("group_id", "STRING", "VOID")],
    )
    expected_id = event_id(
        F.col("source_file_sha256"), F.col("source_line_number"), F.col("raw_line")
    )
    expected_key = partition_key(F.col("group_id"), F.col("event_id"))
    not_one = F.col("schema_version_type").isin("STRING", "VOID") | ~F.col(
        "version_number"
    ).eqNullSafe(F.lit(float(SCHEMA_VERSION)))
    return (
        F.when(F.col("value_text").isNull(), "missing_value")
        .when(~F.is_valid_utf8("value_text"), "invalid_utf8")
        .when(F.col("document_type").isNull(), "invalid_json")
        .when(~F.startswith("document_type", F.lit("OBJECT")), "not_an_object")
        .when(F.col("is_incomplete"), "missing_fields")
        .when(not_one, "unsupported_schema_version")
        .when(wrong_types, "invalid_field_type")
        .when(F.col("event_id") != expected_id, "event_id_mismatch")
        .when(~F.col("kafka_key").eqNullSafe(expected_key), "kafka_key_mismatch")
    )
