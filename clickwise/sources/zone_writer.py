"""Byte-balanced writes into partitioned zones.

A size histogram per output partition gives each its number of files; rows
are dealt evenly over them by a row number, and each file is written by one
task. Small hours get one file, hot hours as many as their bytes need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20


def json_bytes(df: DataFrame) -> Column:
    """A row's size as JSON text."""
    return F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(1)


def balanced(df: DataFrame, partition_cols: list[str], target_bytes: int = TARGET_BYTES, row_bytes: Column | None = None) -> DataFrame:
    """``df`` with one task per output file, none (much) over ``target_bytes`` before compression.

    The histogram has one row per output partition. Rows of a partition meet
    only in the files they are dealt to, so a hot partition is spread over
    many tasks; the join to the histogram carries no row twice.
    """
    size = json_bytes(df) if row_bytes is None else row_bytes
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_p{i}") for i, c in enumerate(partition_cols)]
    names = [f"_p{i}" for i in range(len(partition_cols))]
    sized = df.withColumn("_size", size).select("*", *keys)
    sizes = sized.groupBy(*names).agg(F.ceil(F.greatest(F.sum("_size"), F.lit(1)) / F.lit(target_bytes)).cast("int").alias("_files"))
    # One row per output partition: the running number of files is a small ordered sum.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_files").over(
        Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    total = sizes.agg(F.sum("_files")).first()[0] or 1
    dealt = sized.withColumn("_row", F.monotonically_increasing_id()).join(starts, names)
    dealt = dealt.withColumn("_file", F.col("_start") + F.pmod(F.xxhash64("_row"), F.col("_files")).cast("int"))
    return dealt.repartitionById(int(total), "_file").select(*df.columns)


def write_balanced(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet", target_bytes: int = TARGET_BYTES,
                   mode: str = "append", **options) -> None:
    w = balanced(df, partition_cols, target_bytes).write.mode(mode).format(fmt).partitionBy(*partition_cols)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


def start_zone_stream(stream: DataFrame, path: str, partition_cols: list[str], checkpoint: str, fmt: str = "json",
                      target_bytes: int = TARGET_BYTES, trigger: dict | None = None, **options):
    """The same per micro-batch. The batch id is the last partition level and a replay overwrites
    just its own folders, so each row is written once. ``partition_cols`` must not depend on the clock."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(str(batch_id)))
        write_balanced(rows, path, [*partition_cols, "batch"], fmt, target_bytes, "overwrite", partitionOverwriteMode="dynamic", **options)
    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())
