"""Micro-averaged scores of relations: repeated edges, unknown or ambiguous ends and missing requirements cost slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.expect import missing_edges
from tessera.operators.geometry import Box, edge_valid
from tessera.operators.validate import canonical_ends, resolved


def checks(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(world, pos, relation_type, reason): each relation with the first reason why it doesn't pass, null if it does. An edge
    that came earlier is repeated even if the earlier one failed; an id that several objects carry is ambiguous."""
    counts = objects.groupBy("world", "id").agg(F.count(F.lit(1)).alias("n"))
    edges = resolved(relations, objects)
    for end in ("source", "target"):
        edges = edges.join(counts.select("world", F.col("id").alias(end), F.col("n").alias(f"n_{end}")), ["world", end], "left")
    unique = (F.coalesce("n_source", F.lit(0)) == 1) & (F.coalesce("n_target", F.lit(0)) == 1)
    kind = F.col("relation_type")
    failed = F.when(kind == "near", "not_near").when(kind == "inside", "not_inside").otherwise("not_connected")
    reason = (
        F.when(F.col("repeated"), "duplicate_relation")
        .when(F.col("source") == F.col("target"), "self_relation")
        .when(~unique, "missing_or_ambiguous_reference")
        .when(~edge_valid(kind, Box(F.col("s")), Box(F.col("t"))), failed)
    )
    return edges.select("world", "pos", "relation_type", reason.alias("reason"))


def slots(objects: DataFrame, relations: DataFrame, needed: DataFrame, minimums: DataFrame) -> DataFrame:
    """(world, kind, passed, slots) of minimums(world, kind, minimum). Slots are the largest of: relations given plus needed
    ones that are missing, the minimum, and the needed ones."""
    given = checks(objects, relations).groupBy("world", F.col("relation_type").alias("kind")).agg(F.count(F.lit(1)).alias("predicted"), F.count_if(F.col("reason").isNull()).alias("passed"))
    absent = missing_edges(relations, needed).groupBy("world", F.col("relation_type").alias("kind")).agg(F.count(F.lit(1)).alias("absent"))
    distinct = canonical_ends(needed).select("world", F.col("relation_type").alias("kind"), "key_a", "key_b").distinct()
    required = distinct.groupBy("world", "kind").agg(F.count(F.lit(1)).alias("required"))
    joined = minimums
    for part in (given, absent, required):
        joined = joined.join(part, ["world", "kind"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("world", "kind", n("passed").alias("passed"), F.greatest(n("predicted") + n("absent"), "minimum", n("required")).alias("slots"))


def micro(scored: DataFrame) -> DataFrame:
    """(kind, passed, slots, accuracy); accuracy is null where there is no slot."""
    summed = scored.groupBy("kind").agg(F.sum("passed").alias("passed"), F.sum("slots").alias("slots"))
    return summed.withColumn("accuracy", F.round(F.try_divide("passed", "slots"), 6))
