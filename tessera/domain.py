"""Fixed values of the document type: a tile map with objects, and relations between them."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
OBJECT_TYPES = ("house", "tree", "river", "road", "bridge", "monster", "castle", "ruin", "rock", "dune", "tower", "wall", "library", "portal", "npc", "crystal", "courtyard", "vehicle")
GROUND_TYPES = ("river", "road", "dune", "courtyard")
ENTITY_TYPES = ("monster", "npc", "vehicle")
BIOMES = ("forest", "snow", "desert", "city", "arcane")
RELATION_TYPES = ("near", "inside", "connected_to")
THEME_BIOMES = {"forest": "forest", "city": "city", "desert": "desert", "ice": "snow", "dungeon": "arcane", "fantasy": "arcane", "cyberpunk": "city"}
#: Issue codes and the category each is reported under; others are `other`.
CODE_CATEGORIES = {"overlap": "overlap", "blocked_entity": "overlap", "out_of_bounds": "out_of_bounds", "not_near": "near_violation", "not_inside": "inside_violation", "not_connected": "connected_to_violation", "missing_reference": "invalid_reference"}
CATEGORIES = ("overlap", "out_of_bounds", "near_violation", "inside_violation", "connected_to_violation", "invalid_reference", "other")
NEAR_TILES = 3
IDENTIFIER = r"\A[a-z][a-z0-9_]{0,47}\z"
LIMITS = {"objects": 256, "relations": 512, "tags": 12, "tag": 40, "style": 80, "coordinate": 127, "extent": 128, "least_side": 8, "prompt": 8000}
SCHEMA_VERSION = "1.0"
DEFAULT_MAP = {"width": 32, "height": 24, "biome": "forest"}

OBJECT = T.StructType(
    [
        T.StructField("object_type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("style", T.StringType()),
        T.StructField("material", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
RELATION = T.StructType([T.StructField(c, T.StringType()) for c in ("relation_type", "source", "target")])
MAP = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("biome", T.StringType())])
WORLD = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("map", MAP),
        T.StructField("objects", T.ArrayType(OBJECT)),
        T.StructField("relations", T.ArrayType(RELATION)),
    ]
)
ISSUE = T.StructType([T.StructField(c, T.StringType()) for c in ("code", "path", "message")])
