"""Distributions and rates: each in one pass, with map-side aggregation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(rows: DataFrame, column: str, domain: Iterable[str], name: str) -> DataFrame:
    """Counts of a column over a fixed domain; values that don't occur have 0, values outside of it are left out."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return F.broadcast(values).join(counted, column, "left").select(column, F.coalesce(name, F.lit(0)).alias(name))


def compare_variants(rows: DataFrame, variant: str, names: tuple[str, ...], metrics: dict[str, Column]) -> DataFrame:
    """(metric, one column for each variant): the rates of boolean metrics side by side."""
    rated = rows.groupBy(variant).agg(*[F.avg(c.cast("int")).alias(m) for m, c in metrics.items()])
    long = rated.select(variant, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    return long.groupBy("metric").pivot(variant, list(names)).agg(F.round(F.max("v"), 6))


def epoch_means(log: DataFrame, epoch: str, loss: str) -> DataFrame:
    """(epoch, steps, mean_loss) of a training log; steps without a finite loss aren't counted."""
    good = F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double"))
    return log.where(good).groupBy(F.col(epoch).alias("epoch")).agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg(loss), 6).alias("mean_loss"))


def smoke_test(means: DataFrame, least_reduction: float) -> DataFrame:
    """(first, last, reduction, passed): by how much the loss fell from the first epoch to the last, relative to the first."""
    ends = means.agg(F.min_by("mean_loss", "epoch").alias("first"), F.max_by("mean_loss", "epoch").alias("last"))
    reduction = F.round(F.try_divide(F.col("first") - F.col("last"), "first"), 6)
    return ends.select("first", "last", reduction.alias("reduction"), F.coalesce(reduction >= least_reduction, F.lit(False)).alias("passed"))
