"""JSON wire records: subscription and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.schemas import WIRE

CORRUPT = "_corrupt"


def subscribe(
    spark: SparkSession, topic: str, servers: str, max_offsets: int | None = None, **options: str
) -> DataFrame:
    """Stream of a whole Kafka topic; records that the broker lost are an error.

    ``max_offsets`` bounds a trigger's admission where a deployment wants that; other
    options, such as the starting offsets, can be given as well. Needs the Kafka
    connector package on the classpath.
    """
    settings = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        **({} if max_offsets is None else {"maxOffsetsPerTrigger": str(max_offsets)}),
        **options,
    }
    return spark.readStream.format("kafka").options(**settings).load()


def subscribe_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of JSON lines landed as files, one record per ``value``; ``max_files`` per trigger, if given."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def decode(raw: DataFrame, feed: str) -> DataFrame:
    """Typed columns from the JSON text in ``value``.

    A text that is not a record of the feed keeps its original in ``_corrupt`` with
    whatever fields could be read. Blank texts hold no record and are dropped before
    parsing, so that no text is parsed twice.
    """
    fields = WIRE[feed].fields + [T.StructField(CORRUPT, T.StringType(), True)]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    value = F.col("value").cast("string")
    texts = raw.select(value.alias("value")).filter(F.btrim("value", F.lit(" \t\r\n")) != "")
    return texts.select(F.from_json("value", T.StructType(fields), options).alias("data")).select("data.*")


def encode(records: DataFrame) -> DataFrame:
    """Records as JSON texts with ISO-8601 times to the microsecond, as ``decode`` reads."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return records.select(F.to_json(F.struct("*"), options).alias("value"))
