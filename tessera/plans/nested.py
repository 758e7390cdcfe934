"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import nested
from tessera.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Children of every run record's world and expectations."""
    return nested.world_children(table(spark, folder, "run_records"))


def p5_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema graph of the run records."""
    return nested.schema_graph(table(spark, folder, "run_records"), "record")


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all flat tables of the run records, with their links; fields as sorted JSON text."""
    from pyspark.sql import functions as F

    records = table(spark, folder, "run_records")
    flat = nested.flatten(records, "run_id", "record", nested.layout(nested.schema_graph(records, "record")))
    return flat.withColumn("fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))), {"ignoreNullFields": "false"}))


def p5_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of objects, with typed columns for all their leaves and the key of their parent."""
    return nested.flat_tables(table(spark, folder, "run_records"), "run_id", "record", always=nested.WORLD_TABLES)["objects"]


QUERIES = {"p5_objects": p5_objects, "p5_found": p5_found, "p5_schema": p5_schema, "p5_rows": p5_rows}
SQL: dict[str, str] = {}
