"""Worlds derived from the order tables, by integer arithmetic: a map for each order, an object for each order line,
relations between lines that follow one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.domain import BIOMES, OBJECT_TYPES, RELATION_TYPES
from tessera.operators.geometry import layer
from tessera.sources.tables import table


def _choose(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def maps(spark: SparkSession, folder: str) -> DataFrame:
    """(world, width, height, biome)."""
    odd = F.col("o_custkey") % 2
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("world"), (24 + 8 * odd).cast("int").alias("width"), (20 + 4 * odd).cast("int").alias("height"), _choose(BIOMES, F.col("o_custkey") % 5).alias("biome"))


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """(world, pos, id, kind, x, y, w, h, r, b, layer); ids repeat within a world where line numbers do."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    made = lines.select(
        F.col("l_orderkey").alias("world"),
        F.row_number().over(order).alias("pos"),
        F.concat(F.lit("o_"), "l_linenumber").alias("id"),
        _choose(OBJECT_TYPES, F.col("l_partkey") % 18).alias("kind"),
        (F.col("l_partkey") % 32).cast("int").alias("x"),
        (F.col("l_suppkey") % 24).cast("int").alias("y"),
        (1 + F.col("l_quantity").cast("int") % 4).alias("w"),
        (1 + F.col("l_partkey") % 3).cast("int").alias("h"),
    )
    return made.withColumns({"r": F.col("x") + F.col("w"), "b": F.col("y") + F.col("h"), "layer": layer(F.col("kind"))})


def relations(things: DataFrame) -> DataFrame:
    """(world, pos, relation_type, source, target): an edge from each object to the next one; in every fifth world all edges
    again in the other direction, in every seventh one edge to an unknown object."""
    following = Window.partitionBy("world").orderBy("pos")
    kind = _choose(RELATION_TYPES, F.col("pos") % 3)
    edges = things.select("world", "pos", kind.alias("relation_type"), F.col("id").alias("source"), F.lead("id").over(following).alias("next"))
    variants = F.array(
        F.when(F.col("next").isNotNull(), F.struct(F.col("pos").alias("pos"), F.col("relation_type").alias("relation_type"), F.col("source").alias("source"), F.col("next").alias("target"))),
        F.when(F.col("next").isNotNull() & (F.col("world") % 5 == 0), F.struct((F.col("pos") + 100).alias("pos"), F.col("relation_type").alias("relation_type"), F.col("next").alias("source"), F.col("source").alias("target"))),
        F.when((F.col("pos") == 1) & (F.col("world") % 7 == 0), F.struct((F.col("pos") + 200).alias("pos"), F.lit("near").alias("relation_type"), F.col("source").alias("source"), F.lit("o_99").alias("target"))),
    )
    return edges.select("world", F.explode(F.array_compact(variants)).alias("e")).select("world", "e.*")


def worlds(spark: SparkSession, folder: str) -> DataFrame:
    """(world, width, height, objects, relations): the same worlds, one row each. The order lines are shuffled once."""
    lines = table(spark, folder, "lineitem")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    packed = lines.groupBy(F.col("l_orderkey").alias("world")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("lines"))

    def thing(line: Column, i: Column) -> Column:
        kind = _choose(OBJECT_TYPES, line["l_partkey"] % 18)
        x, y = (line["l_partkey"] % 32).cast("int"), (line["l_suppkey"] % 24).cast("int")
        w, h = 1 + line["l_quantity"].cast("int") % 4, (1 + line["l_partkey"] % 3).cast("int")
        return F.struct(
            (i + 1).alias("pos"), F.concat(F.lit("o_"), line["l_linenumber"]).alias("id"), kind.alias("kind"), x.alias("x"), y.alias("y"),
            (x + w).alias("r"), (y + h).alias("b"), layer(kind).alias("layer"),
        )

    made = packed.select("world", F.transform("lines", thing).alias("objects"))
    edge = lambda pos, kind, a, b: F.struct(pos.alias("pos"), kind.alias("relation_type"), a.alias("source"), b.alias("target"))
    following = F.transform(
        F.slice("objects", F.lit(1), F.size("objects") - 1), lambda o, i: edge(o["pos"], _choose(RELATION_TYPES, o["pos"] % 3), o["id"], F.get("objects", i + 1)["id"])
    )
    made = made.withColumn("_chain", following)
    back = F.transform("_chain", lambda e: edge(e["pos"] + 100, e["relation_type"], e["target"], e["source"]))
    first = F.get("objects", F.lit(0))
    unknown = F.array(edge(first["pos"] + 200, F.lit("near"), first["id"], F.lit("o_99")))
    none = F.filter("_chain", lambda e: F.lit(False))
    edges = F.concat("_chain", F.when(F.col("world") % 5 == 0, back).otherwise(none), F.when(F.col("world") % 7 == 0, unknown).otherwise(none))
    return made.select("world", "objects", edges.alias("relations")).join(maps(spark, folder), "world", "left")


#: The same views in SQL, for a WITH clause.
SQL = """
maps AS (SELECT o_orderkey AS world, CAST(24 + 8 * (o_custkey % 2) AS INTEGER) AS width, CAST(20 + 4 * (o_custkey % 2) AS INTEGER) AS height,
  ['forest','snow','desert','city','arcane'][CAST(o_custkey % 5 AS INTEGER) + 1] AS biome FROM orders),
base AS (SELECT l_orderkey AS world, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS INTEGER) AS pos,
  'o_' || l_linenumber AS id,
  ['house','tree','river','road','bridge','monster','castle','ruin','rock','dune','tower','wall','library','portal','npc','crystal','courtyard','vehicle'][CAST(l_partkey % 18 AS INTEGER) + 1] AS kind,
  CAST(l_partkey % 32 AS INTEGER) AS x, CAST(l_suppkey % 24 AS INTEGER) AS y, CAST(1 + CAST(l_quantity AS INTEGER) % 4 AS INTEGER) AS w, CAST(1 + l_partkey % 3 AS INTEGER) AS h FROM lineitem),
objects AS (SELECT *, x + w AS r, y + h AS b, CASE WHEN kind IN ('river','road','dune','courtyard') THEN 0 WHEN kind IN ('monster','npc','vehicle') THEN 2 ELSE 1 END AS layer FROM base),
chain AS (SELECT world, pos, ['near','inside','connected_to'][pos % 3 + 1] AS relation_type, id AS source, lead(id) OVER (PARTITION BY world ORDER BY pos) AS target FROM objects),
relations AS (SELECT * FROM chain WHERE target IS NOT NULL
  UNION ALL SELECT world, pos + 100, relation_type, target, source FROM chain WHERE target IS NOT NULL AND world % 5 = 0
  UNION ALL SELECT world, pos + 200, 'near', source, 'o_99' FROM chain WHERE pos = 1 AND world % 7 = 0)
"""
