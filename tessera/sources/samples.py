"""Small sound worlds for demonstrations and tests, one for each theme of geometry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _thing(name: str, kind: str, x: int, y: int, w: int = 1, h: int = 1) -> dict:
    return {"object_type": kind, "id": name, "position": [x, y], "attributes": {"size": [w, h]}}


def _edge(kind: str, source: str, target: str) -> dict:
    return {"relation_type": kind, "source": source, "target": target}


WORLDS = (
    {"scene": "ford", "objects": [_thing("brook", "river", 0, 6, 20, 2), _thing("planks", "bridge", 9, 6, 2, 2), _thing("hut", "house", 9, 9, 2, 2)], "relations": [_edge("inside", "planks", "brook"), _edge("near", "hut", "planks")]},
    {"scene": "yard", "map": {"biome": "city"}, "objects": [_thing("court", "courtyard", 4, 4, 8, 8), _thing("keep", "tower", 6, 6, 2, 2), _thing("guard", "npc", 9, 9)], "relations": [_edge("inside", "keep", "court"), _edge("inside", "guard", "court")]},
    {"scene": "row", "objects": [_thing("first", "wall", 2, 2, 3, 1), _thing("second", "wall", 5, 2, 3, 1), _thing("third", "wall", 8, 2, 3, 1)], "relations": [_edge("connected_to", "first", "second"), _edge("connected_to", "second", "third")]},
    {"scene": "waste", "map": {"width": 16, "height": 16, "biome": "desert"}, "objects": [_thing("hill", "dune", 0, 0, 6, 6), _thing("stone", "rock", 2, 2, 2, 2), _thing("beast", "monster", 10, 10)], "relations": [_edge("inside", "stone", "hill")]},
    {"scene": "hall", "map": {"biome": "arcane"}, "objects": [_thing("books", "library", 3, 3, 4, 3), _thing("gate", "portal", 8, 3, 1, 3), _thing("shard", "crystal", 7, 7)], "relations": [_edge("near", "books", "gate"), _edge("near", "shard", "gate")]},
)


def sample_worlds(spark: SparkSession) -> DataFrame:
    """(scene, raw): the worlds as documents."""
    return spark.createDataFrame([(w["scene"], json.dumps(w)) for w in WORLDS], "scene string, raw string")
