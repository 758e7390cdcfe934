"""Stop rules of an ingestion run, over its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_streaks(log: DataFrame, actor: str, order: list[str], bad: Column) -> DataFrame:
    """log with streak: how many rows in a row, up to this one, are bad; any other row resets it."""
    seq = Window.partitionBy(actor).orderBy(*order)
    resets = F.sum(F.when(bad, 0).otherwise(1)).over(seq)
    counted = log.withColumn("_resets", resets)
    streak = F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy(actor, "_resets").orderBy(*order))
    return counted.withColumn("streak", streak).drop("_resets")


def breakers(log: DataFrame, actor: str, order: list[str], bad: Column, most: int = 3) -> DataFrame:
    """(actor, first): the place of the row that first makes `most` bad ones in a row."""
    return with_streaks(log, actor, order, bad).where(F.col("streak") == most).groupBy(actor).agg(F.min(order[0]).alias("first"))


def within_budget(log: DataFrame, actor: str, order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows that were begun while the sum of all earlier ones was below the budget: the last may overshoot it."""
    spent = F.sum(cost).over(Window.partitionBy(actor).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_spent", F.coalesce(spent, F.lit(0))).where(F.col("_spent") < budget).drop("_spent")


def until_stop(log: DataFrame, actor: str, order: list[str], stop: Column) -> DataFrame:
    """Rows up to the first one that stops the run at once, that one included."""
    stopped = F.sum(F.when(stop, 1).otherwise(0)).over(Window.partitionBy(actor).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_stopped", F.coalesce(stopped, F.lit(0))).where("_stopped = 0").drop("_stopped")


def latest(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value): the value of each key's last row, even if it is null."""
    return log.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("s")).select(key, F.col(f"s.{value}").alias(value))
