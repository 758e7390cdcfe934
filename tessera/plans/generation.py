"""Queries of the generators; they read no table, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.decode import decoded, world_maps, world_objects, world_relations
from tessera.operators import generate, validate

ROWS, SEED = 90, 42


def gen_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """An inventory of a thousand prompts by theme."""
    return generate.inventory(spark, 1000, SEED).groupBy("theme", "biome").agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("prompt").alias("distinct_prompts"))


def gen_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Placement tasks by relation and difficulty, with the number whose witness decodes and has no issue."""
    made = decoded(generate.tasks(spark, ROWS, SEED), "witness")
    issues = validate.issues(world_objects(made, "id"), world_relations(made, "id"), world_maps(made, "id")).select(F.col("world").alias("id")).distinct()
    judged = made.select("id", "relation", "difficulty", "schema_ok").join(issues.withColumn("bad", F.lit(True)), "id", "left")
    return judged.groupBy("relation", "difficulty").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("schema_ok") & F.col("bad").isNull()).alias("feasible"))


QUERIES = {"gen_inventory": gen_inventory, "gen_tasks": gen_tasks}
