"""The spatial validator: ten issue codes over (objects, relations, maps), one row for each issue.

Objects and relations are partitioned by world throughout, so the windows, the two endpoint joins and the pair join use
one exchange of each input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.domain import CATEGORIES, CODE_CATEGORIES, NEAR_TILES
from tessera.operators.geometry import Box, contains, distance, in_bounds, overlaps, same_bounds, shares_edge


def canonical_ends(relations: DataFrame) -> DataFrame:
    """With key_a and key_b: the ends in order, but for `inside`, where the direction counts."""
    directed = F.col("relation_type") == "inside"
    return relations.withColumns({"key_a": F.when(directed, F.col("source")).otherwise(F.least("source", "target")), "key_b": F.when(directed, F.col("target")).otherwise(F.greatest("source", "target"))})


def last_by_id(objects: DataFrame) -> DataFrame:
    """One object for each id of a world: the last one."""
    return objects.groupBy("world", "id").agg(F.max_by(F.struct("x", "y", "r", "b"), "pos").alias("box"))


def resolved(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations with repeated (the same edge came earlier), and the footprints of their ends as structs s and t, null for
    unknown ids."""
    ends = last_by_id(objects)
    again = F.row_number().over(Window.partitionBy("world", "relation_type", "key_a", "key_b").orderBy("pos")) > 1
    edges = canonical_ends(relations).withColumn("repeated", again)
    edges = edges.join(ends.select("world", F.col("id").alias("source"), F.col("box").alias("s")), ["world", "source"], "left")
    return edges.join(ends.select("world", F.col("id").alias("target"), F.col("box").alias("t")), ["world", "target"], "left")


def relation_issues(edges: DataFrame) -> DataFrame:
    """(world, pos, code) of resolved relations: a repeated one is reported and checked further; one to itself or to an
    unknown id is not."""
    s, t = Box(F.col("s")), Box(F.col("t"))
    kind = F.col("relation_type")
    geometry = (
        F.when((kind == "near") & (distance(s, t) > NEAR_TILES), "not_near")
        .when((kind == "inside") & ~(contains(t, s) & ~same_bounds(t, s)), "not_inside")
        .when((kind == "connected_to") & ~shares_edge(s, t), "not_connected")
    )
    known = F.col("s").isNotNull() & F.col("t").isNotNull()
    checked = F.when(F.col("source") == F.col("target"), "self_relation").when(~known, "missing_reference").otherwise(geometry)
    codes = F.array_compact(F.array(F.when(F.col("repeated"), "duplicate_relation"), checked))
    return edges.select("world", "pos", F.explode(codes).alias("code"))


def valid_containments(edges: DataFrame) -> DataFrame:
    """(world, low, high): unordered ids of `inside` relations that the geometry bears out."""
    s, t = Box(F.col("s")), Box(F.col("t"))
    good = edges.where((F.col("relation_type") == "inside") & (F.col("source") != F.col("target")) & contains(t, s) & ~same_bounds(t, s))
    return good.select("world", F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")).distinct()


def object_issues(objects: DataFrame, maps: DataFrame) -> DataFrame:
    """(world, pos, code): repeated ids and footprints beyond the map."""
    again = F.row_number().over(Window.partitionBy("world", "id").orderBy("pos")) > 1
    placed = objects.withColumn("again", again).join(maps, "world")
    outside = ~in_bounds(Box(), F.col("width"), F.col("height"))
    codes = F.array_compact(F.array(F.when(F.col("again"), "duplicate_id"), F.when(outside, "out_of_bounds")))
    return placed.select("world", "pos", F.explode(codes).alias("code"))


def pair_issues(objects: DataFrame, containments: DataFrame) -> DataFrame:
    """(world, pos, other, code): pairs of objects that share tiles, on one layer (overlap) or as entity and structure
    without a bridge (blocked_entity), unless one holds the other."""
    side = lambda p: objects.select("world", *[F.col(c).alias(f"{p}{c}") for c in ("pos", "id", "kind", "x", "y", "r", "b", "layer")])
    pairs = side("a_").join(side("b_"), "world").where((F.col("a_pos") < F.col("b_pos")) & overlaps(Box("a_"), Box("b_")))
    layers = F.array_sort(F.array("a_layer", "b_layer"))
    blocked = (layers == F.array(F.lit(1), F.lit(2))) & (F.col("a_kind") != "bridge") & (F.col("b_kind") != "bridge")
    code = F.when(F.col("a_layer") == F.col("b_layer"), "overlap").when(blocked, "blocked_entity")
    found = pairs.withColumns({"code": code, "low": F.least("a_id", "b_id"), "high": F.greatest("a_id", "b_id")}).where(F.col("code").isNotNull())
    return found.join(containments, ["world", "low", "high"], "left_anti").select("world", F.col("a_pos").alias("pos"), F.col("b_pos").alias("other"), "code")


def issues(objects: DataFrame, relations: DataFrame, maps: DataFrame) -> DataFrame:
    """(world, pos, code): every issue of every world; a world without a row is valid. Worlds without a map have no issue of
    bounds; an empty table of objects or relations gives none of its kind."""
    edges = resolved(relations, objects)
    pairs = pair_issues(objects, valid_containments(edges)).select("world", "pos", "code")
    return object_issues(objects, maps).unionByName(relation_issues(edges)).unionByName(pairs)


def category(code: Column) -> Column:
    """The category a code is reported under."""
    known = F.create_map(*[F.lit(x) for pair in CODE_CATEGORIES.items() for x in pair])
    return F.coalesce(known[code], F.lit("other"))


def zero_filled(counted: DataFrame) -> DataFrame:
    """(category, issues, worlds) of all categories, zero where there are none."""
    domain = counted.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return F.broadcast(domain).join(counted, "category", "left").select("category", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("worlds", F.lit(0)).alias("worlds"))


def by_category(found: DataFrame) -> DataFrame:
    """(category, issues, worlds): occurrences and worlds concerned of all categories."""
    return zero_filled(found.groupBy(category(F.col("code")).alias("category")).agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("world").alias("worlds")))


def world_flags(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(world, valid, boundary_correct, overlap_free): verdicts on each world that has objects."""
    codes = found.groupBy("world").agg(F.collect_set("code").alias("codes"))
    worlds = objects.select("world").distinct().join(codes, "world", "left")
    has = lambda *names: F.coalesce(F.arrays_overlap("codes", F.array(*[F.lit(n) for n in names])), F.lit(False))
    return worlds.select("world", F.col("codes").isNull().alias("valid"), (~has("out_of_bounds", "duplicate_id")).alias("boundary_correct"), (~has("overlap", "blocked_entity", "duplicate_id")).alias("overlap_free"))
