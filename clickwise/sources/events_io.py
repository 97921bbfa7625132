"""Event sources and sinks.

Zones are Hive-partitioned folders. Partition values are zero-padded strings
(``month=01``); ``clickwise.session`` turns partition type inference off so
they are read back as strings, and readers pass explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickwise.sources.schema_catalog import schema_summary, update_catalog, zone_lines
from clickwise.sources.zone_writer import TARGET_BYTES, start_zone_stream, write_balanced

TRANSPORT_SCHEMA = "kinesis struct<data string, partitionKey string, sequenceNumber string>"
PARTITION_COLS = ["year", "month", "day", "hour"]


def read_events(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """A1: transport records (JSON lines ``{"kinesis": {...}}``) -> data, partition_key, sequence_number."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(TRANSPORT_SCHEMA)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.json(path)
    return df.select(F.col("kinesis.data").alias("data"),
                     F.col("kinesis.partitionKey").alias("partition_key"),
                     F.col("kinesis.sequenceNumber").alias("sequence_number"))


def with_partitions(df: DataFrame, ts: F.Column, hour: bool = True) -> DataFrame:
    parts = {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")}
    if hour:
        parts["hour"] = F.date_format(ts, "HH")
    return df.withColumns(parts)


def write_raw(df: DataFrame, path: str, partition_by: str = "arrival", event_ts_col: str = "ts",
              checkpoint: str | None = None, trigger: dict | None = None, target_bytes: int = TARGET_BYTES):
    """A2: raw zone, gzip JSON lines partitioned year/month/day/hour, in files of about ``target_bytes``.

    ``partition_by="arrival"`` uses the write time (the delivery stream's
    namespace), ``"event"`` the event's own timestamp (X4). A streaming frame
    returns a started query with a 60 s trigger by default (G1); it goes by
    the event's time, so that a replay finds its folders again.
    """
    if df.isStreaming:
        return start_zone_stream(with_partitions(df, F.col(event_ts_col)), path, PARTITION_COLS, checkpoint, "json",
                                 target_bytes, trigger, compression="gzip")
    ts = F.current_timestamp() if partition_by == "arrival" else F.col(event_ts_col)
    write_balanced(with_partitions(df, ts), path, PARTITION_COLS, "json", target_bytes, compression="gzip")
    return None


def write_errors(df: DataFrame, path: str, result_col: str = "result") -> None:
    """A3: delivery errors partitioned by date and error type."""
    with_partitions(df, F.current_timestamp(), hour=False).write.mode("append") \
        .partitionBy("year", "month", "day", result_col).json(path)


def raw_schema(fields: str = "event_id string, user_id string, session_id string, event_type string, "
                              "product_id string, product_category string, product_name string, amount double, "
                              "currency string, quantity int, discount_pct double, timestamp string, "
                              "client struct<platform string, country_code string, ip_hash string>") -> str:
    return fields + ", year string, month string, day string, hour string"


def read_raw(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A4: raw-zone scan; filters on year/month/day/hour prune partitions."""
    return spark.read.schema(schema or raw_schema()).json(path)


def discover_schema(spark: SparkSession, path: str, catalog: DataFrame | None = None, crawl: int = 0) -> tuple[DataFrame, DataFrame]:
    """A5: (catalog, changes) of a zone crawled whole; ``errors`` and ``_temporary`` folders are left out."""
    return update_catalog(catalog, schema_summary(zone_lines(spark, path)), crawl)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Query result sink."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_dlq(df: DataFrame, path: str) -> None:
    """Dead letters, partitioned by the failure hour (``s3_key`` kept as a column)."""
    ts = F.to_timestamp(F.col("failed_at"))
    with_partitions(df, ts).write.mode("append").partitionBy(*PARTITION_COLS).json(path)


def write_processed(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES, checkpoint: str | None = None, trigger: dict | None = None):
    """Processed zone, parquet partitioned by the event's own date (``s3_partition``), batch or stream."""
    parts = {c: F.regexp_extract("s3_partition", rf"{c}=(\d+)", 1) for c in ("year", "month", "day")}
    out = df.withColumns(parts)
    if df.isStreaming:
        return start_zone_stream(out, path, [*parts], checkpoint, "parquet", target_bytes, trigger)
    write_balanced(out, path, [*parts], "parquet", target_bytes)
    return None


def distribute_by_user(df: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """Hash-partition by user (the producer's partition key)."""
    return df.repartition(n, key)
