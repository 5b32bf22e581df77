"""Identity rules of one physical source record."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from booklog.functions.text import strip
from booklog.schema import SCHEMA_VERSION


def event_id(source_sha256: Column, line_number: Column, raw_line: Column) -> Column:
    """SHA-256 over version, source digest, line number and text, joined by newlines."""
    canonical = F.concat_ws(
        "\n", F.lit(str(SCHEMA_VERSION)), source_sha256, line_number.cast("string"), raw_line
    )
    return F.sha2(canonical, 256)


def group_id_of(raw_line: Column) -> Column:
    """Text before the first comma, stripped; null when empty."""
    return F.nullif(strip(F.substring_index(raw_line, ",", 1)), F.lit(""))


def partition_key(group_id: Column, own_id: Column) -> Column:
    """Broker key: the group keeps its order, records without one use their own id."""
    return F.coalesce(F.nullif(group_id, F.lit("")), own_id)
