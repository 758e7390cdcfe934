"""Incremental ingestion with restart safety, as Structured Streaming over an append-only log of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def admit_once(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each key once, whatever is delivered again: rows of a batch are reduced to one for each key and
    held against what earlier batches left. A batch that is run again after a failure overwrites its own folder only."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(folder)
        files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if files.exists(there) and len(files.listStatus(there)):
            earlier = spark.read.parquet(folder).where(F.col("batch") != number).select(key)
            fresh = fresh.join(earlier, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str, files_per_batch: int = 100) -> StreamingQuery:
    """Reads all files of Parquet that are there now, a bounded number at a time, admits each key once, and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(admit_once(target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Counts by a column, kept up with the stream; for output mode complete or update."""
    return stream.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, column: str, width: str = "1 hour", late: str = "9 days") -> DataFrame:
    """Counts by tumbling window and column; rows may be late by `late`, then their window is final. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), column).agg(F.count(F.lit(1)).alias("n"))


STATES = ("running", "finished", "interrupted")


def illegal_transitions(log: DataFrame) -> DataFrame:
    """(id, state, seq) of a state log that may not follow what came before: a second running, or an end without running."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("id").orderBy("seq"))
    good = F.when(F.col("state") == "running", before.isNull()).otherwise(before == "running")
    return log.withColumn("good", F.coalesce(good, F.lit(False))).where("NOT good").select("id", "state", "seq")


def recover(log: DataFrame) -> DataFrame:
    """(id, state): samples left running by a broken run; they end as interrupted and are never sent again."""
    latest = log.groupBy("id").agg(F.max_by("state", "seq").alias("state"))
    return latest.where("state = 'running'").withColumn("state", F.lit("interrupted"))


def pending(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Cases that no entry of the log is about."""
    return cases.join(log.select("id"), "id", "left_anti")
