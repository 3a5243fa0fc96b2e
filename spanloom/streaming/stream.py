"""The per-document operators over streams: they keep no state, so a stream takes them as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stripped, full lines of files that arrive in a folder."""
    return spark.readStream.format("text").load(folder).select(tx.stripped("value").alias("value")).where("value <> ''")


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def cleaned(rows: DataFrame, value: str = "value", min_length: int = 80) -> DataFrame:
    return rows.where(tx.long_enough(value, min_length)).withColumn(value, tx.cleanup(value))


def deduped(rows: DataFrame, time: str, value: str = "value", late: str = "1 hour") -> DataFrame:
    """The first of equal values, as far back as late; state older than that is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([value])


def windowed_counts(rows: DataFrame, time: str, by: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def each_batch(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Any batch operator over micro-batches, appended to Parquet; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
