"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import stats
from tessera.sources.tables import table


def scalar_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the events."""
    return table(spark, folder, "events").select("event_id", scalars.seed_of(F.concat(F.lit("42:"), "event_id")).alias("seed"), (scalars.seed_of(F.concat(F.lit("42:"), "event_id"), 12) % 3).alias("third"))


def scalar_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """Halves of the order lines' numbers, rounded to even, by result."""
    half = scalars.half_even((F.col("l_linenumber") + F.col("l_partkey") % 9) / 2.0).cast("long")
    return table(spark, folder, "lineitem").groupBy(half.alias("rounded")).agg(F.count(F.lit(1)).alias("lines"))


def scalar_finite(spark: SparkSession, folder: str) -> DataFrame:
    """Latencies that are usable numbers, by provider."""
    good = scalars.finite(F.col("latency_seconds")) & (F.col("latency_seconds") > 0)
    return table(spark, folder, "predictions").groupBy("provider").agg(F.count(F.lit(1)).alias("predictions"), F.count_if(good).alias("timed"), F.sum(F.when(good, F.round(F.col("latency_seconds") * 1000).cast("long"))).alias("millis"))


def scalar_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the prompts: the theme in capitals, whether the id is of the theme, the prompt shortened, when it was recorded."""
    rows = table(spark, folder, "prompt_specs").where("id IS NOT NULL").select("id", "theme", "prompt", "recorded_at").distinct()
    return rows.select("id", F.upper("theme").alias("label"), F.coalesce(F.startswith("id", "theme"), F.lit(False)).alias("of_theme"), scalars.shortened(F.col("prompt"), 40).alias("short"), scalars.utc_text(F.col("recorded_at").cast("timestamp")).alias("recorded"))


def map_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors of the prompts with the theme put over them: their number and the theme that holds."""
    rows = table(spark, folder, "prompt_specs").where("id IS NOT NULL").select("id", "theme", "descriptors", "recorded_at").dropDuplicates(["id"])
    made = scalars.merged_maps(F.col("descriptors"), F.when(F.col("theme").isNotNull(), F.create_map(F.lit("theme"), F.col("theme"))))
    return rows.select("id", F.size(made).alias("members"), made["theme"].alias("theme"))


def stat_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Mean loss by epoch of a training log (here: the values of the events in five epochs)."""
    log = table(spark, folder, "events").select((F.col("event_id") % 5).alias("epoch"), F.col("value").alias("loss"))
    return stats.epoch_means(log, "epoch", "loss")


def stat_smoke(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the loss fell enough from the first epoch to the last."""
    return stats.smoke_test(stat_epochs(spark, folder), 0.1)


QUERIES = {"scalar_labels": scalar_labels, "map_merged": map_merged, "stat_epochs": stat_epochs, "stat_smoke": stat_smoke, "scalar_seeds": scalar_seeds, "scalar_rounding": scalar_rounding, "scalar_finite": scalar_finite}
_EPOCHS = "SELECT event_id % 5 AS epoch, count(*) AS steps, round(avg(value), 6) AS mean_loss FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1"
SQL = {
    "scalar_labels": "SELECT DISTINCT id, upper(theme) AS label, coalesce(starts_with(id, theme), false) AS of_theme, CASE WHEN length(prompt) > 40 THEN substr(prompt, 1, 39) || '…' ELSE prompt END AS short, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded FROM prompt_specs WHERE id IS NOT NULL",
    "map_merged": "SELECT id, CAST(cardinality(coalesce(any_value(descriptors), MAP {})) + CASE WHEN any_value(theme) IS NOT NULL AND NOT coalesce(list_contains(map_keys(any_value(descriptors)), 'theme'), false) THEN 1 ELSE 0 END AS INTEGER) AS members, coalesce(any_value(theme), any_value(descriptors)['theme']) AS theme FROM prompt_specs WHERE id IS NOT NULL GROUP BY 1",
    "stat_epochs": _EPOCHS,
    "stat_smoke": f"WITH m AS ({_EPOCHS}), e AS (SELECT arg_min(mean_loss, epoch) AS first, arg_max(mean_loss, epoch) AS last FROM m) SELECT first, last, round((first - last) / first, 6) AS reduction, coalesce(round((first - last) / first, 6) >= 0.1, false) AS passed FROM e",
    "scalar_seeds": "SELECT event_id, CAST('0x' || substr(sha256('42:' || event_id), 1, 8) AS BIGINT) AS seed, CAST('0x' || substr(sha256('42:' || event_id), 1, 12) AS BIGINT) % 3 AS third FROM events",
    "scalar_rounding": "SELECT CAST(round_even((l_linenumber + l_partkey % 9) / 2.0::DOUBLE, 0) AS BIGINT) AS rounded, count(*) AS lines FROM lineitem GROUP BY 1",
    "scalar_finite": "SELECT provider, count(*) AS predictions, count(*) FILTER (isfinite(latency_seconds) AND latency_seconds > 0) AS timed, CAST(sum(CAST(round(latency_seconds * 1000) AS BIGINT)) FILTER (isfinite(latency_seconds) AND latency_seconds > 0) AS BIGINT) AS millis FROM predictions GROUP BY 1",
}
