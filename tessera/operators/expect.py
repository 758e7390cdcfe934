"""Checks of worlds against what was wanted of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.domain import NEAR_TILES
from tessera.operators.geometry import Box, distance, shares_edge, touches_border
from tessera.operators.validate import canonical_ends


def object_count(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(world, kind, expected, actual) of wanted(world, kind, expected) that differ; a type that isn't there counts as 0."""
    actual = objects.groupBy("world", "kind").agg(F.count(F.lit(1)).alias("actual"))
    joined = wanted.join(actual, ["world", "kind"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where("actual <> expected").select("world", "kind", "expected", "actual")


def relation_count(relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """(world, kind, minimum, actual) of wanted(world, kind, minimum) with too few relations, valid or not."""
    actual = relations.groupBy("world", F.col("relation_type").alias("kind")).agg(F.count(F.lit(1)).alias("actual"))
    joined = wanted.join(actual, ["world", "kind"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where("actual < minimum").select("world", "kind", "minimum", "actual")


def map_mismatch(maps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Worlds whose map differs from wanted(world, width, height, biome) in any member; two nulls are equal."""
    members = ("width", "height", "biome")
    joined = maps.join(wanted.select("world", *[F.col(c).alias(f"wanted_{c}") for c in members]), "world")
    same = F.struct(*members).eqNullSafe(F.struct(*[F.col(f"wanted_{c}").alias(c) for c in members]))
    return joined.where(~same).select("world", *members, *[f"wanted_{c}" for c in members])


def required_objects(objects: DataFrame, needed: DataFrame) -> DataFrame:
    """(world, id, absent, wrong_type, wrong_size) of needed(world, id, kind, w, h) whose object, the last one of the id, is not
    there or differs."""
    last = objects.groupBy("world", "id").agg(F.max_by(F.struct(F.col("kind").alias("k"), F.col("w").alias("ow"), F.col("h").alias("oh")), "pos").alias("o"))
    joined = needed.join(last, ["world", "id"], "left")
    there = F.col("o").isNotNull()
    differs = lambda c: F.coalesce(there & ~c, F.lit(False)).cast("long")
    same_size = F.col("o.ow").eqNullSafe(F.col("w")) & F.col("o.oh").eqNullSafe(F.col("h"))
    wrong = joined.select("world", "id", (~there).cast("long").alias("absent"), differs(F.col("o.k").eqNullSafe(F.col("kind"))).alias("wrong_type"), differs(same_size).alias("wrong_size"))
    return wrong.where("absent + wrong_type + wrong_size > 0")


def inventory_differs(objects: DataFrame, needed: DataFrame) -> DataFrame:
    """(world, missing, surplus): worlds of needed(world, id) whose set of ids is another one, with the numbers of ids on
    one side only. Worlds for which nothing is needed are free."""
    wanted = needed.select("world", "id").distinct().withColumn("wanted", F.lit(True))
    there = objects.select("world", "id").distinct().join(needed.select("world").distinct(), "world", "left_semi").withColumn("there", F.lit(True))
    sides = wanted.join(there, ["world", "id"], "full")
    counted = sides.groupBy("world").agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("surplus"))
    return counted.where("missing + surplus > 0")


def task_errors(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(world, constraint, errors): what the named parts, each with a column `world`, find wrong."""
    made = [part.groupBy("world").agg(F.count(F.lit(1)).alias("errors")).select("world", F.lit(name).alias("constraint"), "errors") for name, part in parts]
    return reduce(DataFrame.unionByName, made)


def task_outcomes(worlds: DataFrame, annotated: DataFrame, errors: DataFrame) -> DataFrame:
    """(world, task_pass) of worlds(world, expectations_pass): whether all expectations are met and no task constraint is
    broken; null for worlds that aren't annotated, which no rate counts."""
    broken = errors.select("world").distinct().withColumn("broken", F.lit(True))
    marked = annotated.select("world").distinct().withColumn("marked", F.lit(True))
    joined = worlds.join(marked, "world", "left").join(broken, "world", "left")
    return joined.select("world", F.when(F.col("marked"), F.coalesce("expectations_pass", F.lit(False)) & F.col("broken").isNull()).alias("task_pass"))


def mismatch_map(counts: DataFrame) -> DataFrame:
    """(world, mismatches): the counts(world, kind, expected, actual) of a world that differ, as a map from the type to both
    numbers, types in order."""
    each = F.array_sort(F.collect_list(F.struct("kind", F.struct("expected", "actual").alias("n"))))
    return counts.groupBy("world").agg(F.map_from_entries(each).alias("mismatches"))


def missing_edges(relations: DataFrame, needed: DataFrame) -> DataFrame:
    """(world, relation_type, key_a, key_b) of needed edges that no relation gives, in whatever direction it is written."""
    keys = ["world", "relation_type", "key_a", "key_b"]
    return canonical_ends(needed).select(*keys).distinct().join(canonical_ends(relations).select(*keys), keys, "left_anti")


def off_border(objects: DataFrame, maps: DataFrame) -> DataFrame:
    """Objects that don't touch the border of their map."""
    return objects.join(maps, "world").where(~touches_border(Box(), F.col("width"), F.col("height")))


def repair_hints(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolved `near` and `connected_to` relations between known ends that don't hold and whose type has no minimum in
    wanted(world, relation_type): those that may simply be left out."""
    s, t = Box(F.col("s")), Box(F.col("t"))
    broken = ((F.col("relation_type") == "near") & (distance(s, t) > NEAR_TILES)) | ((F.col("relation_type") == "connected_to") & ~shares_edge(s, t))
    return edges.where(F.col("s").isNotNull() & F.col("t").isNotNull() & broken).join(wanted, ["world", "relation_type"], "left_anti")
