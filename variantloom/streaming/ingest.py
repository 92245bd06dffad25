"""Streaming forms of resumption: jobs and candidates that arrive bit by bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).format(form).load(path)


def once(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark; records without a key or time are left out.

    Records are repeated days later: ``late`` must be longer than the longest such time, as what comes later
    still is dropped. :func:`into` needs no such bound.
    """
    timed = stream.where(F.col(key).isNotNull()).withColumn("_at", F.try_to_timestamp(F.col(at))).where("_at is not null")
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, at: str, window: str = "1 hour", late: str = "1 hour", *keys: str) -> DataFrame:
    """Records by tumbling window and keys, with late ones up to the watermark."""
    timed = stream.withColumn("_at", F.try_to_timestamp(F.col(at))).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def into(stream: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str = "candidate_id") -> StreamingQuery:
    """Run ``step`` on each batch and append the rows whose key the folder does not hold yet, so that a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark, made = batch.sparkSession, step(batch)
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            seen = spark.read.schema(made.schema).parquet(folder).select(key)  # of all columns only the key is read
            made = made.join(seen.join(made.select(key).distinct(), key, "left_semi"), key, "left_anti")
        made.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
