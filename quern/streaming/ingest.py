"""Streams of files into tables, batch by batch, through the load operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.loads import merge, restored, swap_table


def latest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in a batch."""
    rest = [F.col(c).desc_nulls_last() for c in batch.columns if c not in keys and c != order]
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *rest)
    return batch.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def merge_stream(spark: SparkSession, path: str, schema: StructType, table: str, keys: list[str], order: str, checkpoint: str) -> None:
    """Merges all files at path that are new since the last call into the table."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = latest(batch, keys, order)
        there = restored(spark, table)
        swap_table(merge(spark.table(table), rows, keys, check=False) if there else rows, table)

    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and group, for streams and tables; rows later than late are left out of closed windows."""
    counted = events.withWatermark(time, late) if events.isStreaming else events
    out = counted.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), group, "n")
