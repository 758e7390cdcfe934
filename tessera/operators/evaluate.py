"""The layered verdict on answers: JSON, schema, geometry, expectations. A layer that isn't reached stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.decode import decoded
from tessera.operators import local
from tessera.operators.geometry import layer


def as_rows(answers: DataFrame) -> DataFrame:
    """Decoded answers with width, height, objects and relations as the row-local validator wants them."""

    def thing(o: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"), o["id"].alias("id"), o["object_type"].alias("kind"), o["x"].alias("x"), o["y"].alias("y"),
            (o["x"] + o["w"]).alias("r"), (o["y"] + o["h"]).alias("b"), layer(o["object_type"]).alias("layer"),
        )

    edge = lambda e, i: F.struct(i.alias("pos"), e["relation_type"].alias("relation_type"), e["source"].alias("source"), e["target"].alias("target"))
    return answers.withColumns({"width": F.col("world.map.width"), "height": F.col("world.map.height"), "objects": F.transform("world.objects", thing), "relations": F.transform("world.relations", edge)})


def unmet(expectations: Column) -> Column:
    """Codes of expectations(object_counts, map_spec, minimum_relations) that the row's world doesn't meet; parts that are
    null ask for nothing."""
    counts, least, board = expectations["object_counts"], expectations["minimum_relations"], expectations["map_spec"]
    wrong = F.exists(F.map_entries(counts), lambda e: F.size(F.filter("objects", lambda o: o["kind"] == e["key"])) != e["value"])
    few = F.exists(F.map_entries(least), lambda e: F.size(F.filter("relations", lambda r: r["relation_type"] == e["key"])) < e["value"])
    other = board.isNotNull() & ~(board["width"].eqNullSafe(F.col("world.map.width")) & board["height"].eqNullSafe(F.col("world.map.height")) & board["biome"].eqNullSafe(F.col("world.map.biome")))
    return F.array_compact(F.array(F.when(wrong, "object_count"), F.when(other, "map_mismatch"), F.when(few, "relation_count")))


def verdicts(answers: DataFrame, raw: str, expectations: str) -> DataFrame:
    """answers with status (invalid_schema, invalid_spatial, invalid_expectations or valid), json_ok, schema_valid,
    spatial_valid, counts_valid, expectations_valid and codes. The expectations column may be null; then its verdicts are."""
    keep = answers.columns
    made = local.with_issues(as_rows(decoded(answers, raw)).withColumn("schema_valid", F.col("schema_ok")))
    spatial = F.when(F.col("schema_valid"), F.size("issues") == 0)
    given = F.col("schema_valid") & F.col(expectations).isNotNull()
    made = made.withColumn("_unmet", F.when(given, unmet(F.col(expectations))))
    status = (
        F.when(~F.col("schema_valid"), "invalid_schema")
        .when(~spatial, "invalid_spatial")
        .when(F.size(F.coalesce("_unmet", F.array())) > 0, "invalid_expectations")
        .otherwise("valid")
    )
    codes = F.concat(F.coalesce("schema_issues.code", F.array()), F.when(F.col("schema_valid"), F.col("issues.code")).otherwise(F.array().cast("array<string>")), F.when(F.coalesce(spatial, F.lit(False)), F.coalesce("_unmet", F.array())).otherwise(F.array().cast("array<string>")))
    return made.select(
        *keep, status.alias("status"), "json_ok", "schema_valid", spatial.alias("spatial_valid"),
        F.when(given, ~F.array_contains("_unmet", "object_count")).alias("counts_valid"),
        F.when(given & spatial, F.size("_unmet") == 0).alias("expectations_valid"), codes.alias("codes"),
    )


def rates(judged: DataFrame, by: str) -> DataFrame:
    """Five strict rates by a column, over all samples; what was not reached counts as failed."""
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 6).alias(c.replace("_valid", "").replace("_ok", "") + "_rate")
    return judged.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), *[rate(c) for c in ("json_ok", "schema_valid", "spatial_valid", "counts_valid", "expectations_valid")])
