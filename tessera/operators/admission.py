"""Gates a recorded sample passes before it is exported: provenance, artefacts, paths; and what a repair is told."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.curate import is_training_chat, reject_reason

PNG_MAGIC = "89504E470D0A1A0A"
FEEDBACK_CHARS = 6000


def checksum_ok(content: Column, digest: Column) -> Column:
    """The bytes have the recorded SHA-256 digest."""
    return F.sha2(content, 256) == F.lower(digest)


def is_png(content: Column) -> Column:
    """The bytes begin like a PNG file."""
    return F.hex(F.substring(content, 1, 8)) == PNG_MAGIC


def is_contained(path: Column) -> Column:
    """A path is relative and stays below the folder it is relative to."""
    parts = F.split(path, "[/\\\\]+")
    return path.isNotNull() & (path != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")


def artefacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content): the files below root that fit a pattern, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.lit(root.removeprefix("file:").rstrip("/") + "/")
    return files.select(F.regexp_replace(F.col("path"), F.concat(F.lit("^.*\\Q"), below, F.lit("\\E")), F.lit("")).alias("path"), "content")


def provenance(wanted: Mapping[str, Column]) -> list[tuple[str, Column]]:
    """Rules that columns equal what is wanted of them; two nulls are equal."""
    return [(name, F.col(name).eqNullSafe(value)) for name, value in wanted.items()]


def admitted(samples: DataFrame, files: DataFrame, wanted: Mapping[str, Column]) -> DataFrame:
    """samples(..., messages, world_path, world_sha256) with reason, the first gate a row fails, null if it passes all:
    provenance, roles, path, artefact, checksum. Rows are kept with their reason, none is dropped."""
    joined = samples.join(files.select(F.col("path").alias("world_path"), "content"), "world_path", "left")
    rules = [*provenance(wanted), ("roles", is_training_chat()), ("path", is_contained(F.col("world_path"))), ("artefact", F.col("content").isNotNull()), ("checksum", checksum_ok(F.col("content"), F.col("world_sha256")))]
    return joined.withColumn("reason", reject_reason(rules)).drop("content")


def feedback(hints: Column, issues: Column, boxes: Column) -> Column:
    """What a repair is told: hints, issues as `code: message`, and the footprints (id, x, y, r, b); cut at a fixed length."""
    listed = F.transform(issues, lambda i: F.concat(i["code"], F.lit(": "), i["message"]))
    places = F.transform(boxes, lambda b: F.concat(b["id"], F.lit(" ["), F.concat_ws(",", b["x"], b["y"], b["r"], b["b"]), F.lit("]")))
    lines = F.concat(F.coalesce(hints, F.array()), F.coalesce(listed, F.array()), F.when(F.size(F.coalesce(places, F.array())) > 0, F.concat(F.array(F.lit("Footprints as left, top, right, bottom; the last two are outside:")), places)).otherwise(F.array().cast("array<string>")))
    return F.left(F.array_join(lines, "\n"), F.lit(FEEDBACK_CHARS))
