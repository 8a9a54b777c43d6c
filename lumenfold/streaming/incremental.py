"""Incremental ingestion with Structured Streaming: micro-batches upserted by key, watermarks, windows over event time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.writes import dispose


def newer(df: DataFrame, column: str, last: str | None) -> DataFrame:
    """Rows above the stored mark; the filter reaches the source."""
    return df if last is None else df.where(F.col(column) > F.lit(last).cast(df.schema[column].dataType))


def mark_of(df: DataFrame, column: str) -> str | None:
    """The new mark: the largest value, as text."""
    return df.agg(F.max(column).cast("string")).first()[0]


def upsert_stream(stream: DataFrame, target: str, keys: Iterable[str], checkpoint: str, value: str = "value", disposition: str = "merge"):
    """Writes a stream of cells into versioned Parquet folders, one for each micro-batch, until the source is read.

    A batch that is run again after a failure writes the folder of its number again, from that of the one before, so a
    batch counts once. Folders before that one are deleted.
    """
    keys = list(keys)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(*keys, value).schema
        before = spark.read.schema(schema).parquet(f"{target}/v={number - 1}") if number else spark.createDataFrame([], schema)
        latest = batch.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "seq")).alias(value)) if {"ts", "seq"} <= set(batch.columns) else batch.select(*keys, value).dropDuplicates(keys)
        dispose(before, latest, keys, disposition, value).write.mode("overwrite").parquet(f"{target}/v={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, width: str, late: str, keys: Iterable[str], value: str, slide: str | None = None) -> DataFrame:
    """Count and sum by event-time window and keys, with late rows accepted up to a delay."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: Iterable[str], value: str) -> DataFrame:
    s = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(s.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def events_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
