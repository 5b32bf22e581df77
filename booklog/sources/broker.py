"""Streams of broker records."""

from pyspark.sql import DataFrame, SparkSession

from booklog.config import BATCH_FILES, Topic
from booklog.schema import BROKER_RECORD


def stream_options(topic: Topic) -> dict[str, str]:
    found = {
        "kafka.bootstrap.servers": topic.servers,
        "subscribe": topic.name,
        "startingOffsets": "earliest" if topic.from_start else "latest",
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": str(topic.batch_records),
    }
    return found | ({"minPartitions": str(topic.read_tasks)} if topic.read_tasks else {})


def whole_topic_options(topic: Topic) -> dict[str, str]:
    """Everything that the topic holds now, for the audit."""
    return {
        "kafka.bootstrap.servers": topic.servers,
        "subscribe": topic.name,
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
    }


def topic_stream(spark: SparkSession, topic: Topic) -> DataFrame:
    """Broker records of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**stream_options(topic)).load()


def whole_topic(spark: SparkSession, topic: Topic) -> DataFrame:
    return spark.read.format("kafka").options(**whole_topic_options(topic)).load()


def record_file_stream(
    spark: SparkSession, path: str, files_per_batch: int = BATCH_FILES
) -> DataFrame:
    """Broker records landed as Parquet, read as a stream in batches of so many files."""
    reader = spark.readStream.schema(BROKER_RECORD).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
