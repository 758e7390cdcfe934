"""Queries that run as streams to the end of what is there, with their state in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import shared_folder
from tessera.sources.tables import table
from tessera.streaming import ingest


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_admitted(spark: SparkSession, folder: str) -> DataFrame:
    """Message keys that file ingestion admits, each once, however often it was delivered."""
    place = _place(spark)  # the source is given as a pattern, which may match a file as well as a folder
    schema = table(spark, folder, "messages").select("message_key", "id", "role").schema
    ingest.ingest(spark, f"{folder}/messages.parque[t]", schema, f"{place}/out", f"{place}/state", "message_key").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("message_key")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type, counted by a stream with a watermark."""
    place = _place(spark)  # the source is given as a pattern, which may match a file as well as a folder
    # Event times have no zone; they are read as UTC, the session's.
    stream = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(stream, "ts", "event_type")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/out")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.unix_seconds("window.start").alias("hour"), "event_type", "n")


QUERIES = {"stream_admitted": stream_admitted, "stream_windows": stream_windows}
SQL = {
    "stream_admitted": "SELECT DISTINCT message_key FROM messages WHERE message_key IS NOT NULL",
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
