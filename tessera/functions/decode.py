"""Strict decoding of world documents: JSON with nothing around it, no unknown member, exact types, all limits."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import domain

Issue = tuple[str, str, str]
_IDENTIFIER = re.compile(domain.IDENTIFIER.replace(r"\z", r"\Z"))


class _Reader:
    """Reads one value after another and gathers what is wrong with them."""

    def __init__(self) -> None:
        self.issues: list[Issue] = []

    def wrong(self, code: str, path: str, message: str) -> None:
        self.issues.append((code, path, message))

    def members(self, value: object, path: str, required: tuple[str, ...], optional: tuple[str, ...]) -> dict | None:
        if not isinstance(value, dict):
            self.wrong("model_type", path, "an object is wanted")
            return None
        for name in required:
            if name not in value:
                self.wrong("missing", f"{path}.{name}", "the member is missing")
        for name in value:
            if name not in required and name not in optional:
                self.wrong("extra_forbidden", f"{path}.{name}", "no such member is known")
        return value

    def integer(self, value: object, path: str, low: int, high: int) -> int | None:
        if isinstance(value, bool) or not isinstance(value, int):
            self.wrong("int_type", path, "a whole number is wanted")
        elif value < low:
            self.wrong("greater_than_equal", path, f"at least {low} is wanted")
        elif value > high:
            self.wrong("less_than_equal", path, f"at most {high} is wanted")
        else:
            return value
        return None

    def text(self, value: object, path: str, most: int | None = None, null: bool = False) -> str | None:
        if value is None and null:
            return None
        if not isinstance(value, str):
            self.wrong("string_type", path, "a string is wanted")
        elif most is not None and len(value) > most:
            self.wrong("string_too_long", path, f"at most {most} characters are wanted")
        else:
            return value
        return None

    def one_of(self, value: object, path: str, names: tuple[str, ...]) -> str | None:
        if isinstance(value, str) and value in names:
            return value
        self.wrong("literal_error", path, "the value is none of the known ones")
        return None

    def name(self, value: object, path: str) -> str | None:
        found = self.text(value, path)
        if found is not None and not _IDENTIFIER.match(found):
            self.wrong("string_pattern_mismatch", path, "a lower-case name is wanted")
        return found

    def sequence(self, value: object, path: str, least: int, most: int) -> list:
        if not isinstance(value, list):
            self.wrong("list_type", path, "a list is wanted")
            return []
        if len(value) < least:
            self.wrong("too_short", path, f"at least {least} elements are wanted")
        elif len(value) > most:
            self.wrong("too_long", path, f"at most {most} elements are wanted")
        return value

    def pair(self, value: object, path: str, low: int, high: int) -> tuple[int | None, int | None]:
        found = self.sequence(value, path, 2, 2)
        numbers = [self.integer(v, f"{path}.{i}", low, high) for i, v in enumerate(found)]
        return (numbers[0], numbers[1]) if len(numbers) == 2 else (None, None)


def _object(reader: _Reader, value: object, path: str) -> dict:
    limits = domain.LIMITS
    found = reader.members(value, path, ("object_type", "id", "position"), ("attributes",)) or {}
    about = reader.members(found.get("attributes", {}), f"{path}.attributes", (), ("size", "style", "material", "tags")) or {}
    x, y = reader.pair(found["position"], f"{path}.position", 0, limits["coordinate"]) if "position" in found else (None, None)
    w, h = reader.pair(about.get("size", [1, 1]), f"{path}.attributes.size", 1, limits["extent"])
    tags = reader.sequence(about.get("tags", []), f"{path}.attributes.tags", 0, limits["tags"])
    return {
        "object_type": reader.one_of(found["object_type"], f"{path}.object_type", domain.OBJECT_TYPES) if "object_type" in found else None,
        "id": reader.name(found["id"], f"{path}.id") if "id" in found else None,
        "x": x, "y": y, "w": w, "h": h,
        "style": reader.text(about.get("style"), f"{path}.attributes.style", limits["style"], True),
        "material": reader.text(about.get("material"), f"{path}.attributes.material", limits["style"], True),
        "tags": [reader.text(t, f"{path}.attributes.tags.{i}", limits["tag"]) for i, t in enumerate(tags)],
    }


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _overflows(value: object) -> bool:
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, float) and not math.isfinite(value):
            return True
        todo += value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return False


def number_error(raw: str | None) -> str | None:
    """Why the value of a JSON text can't be kept although it is JSON: one of its numbers is beyond the range of doubles. Such
    a text keeps its literal and has no value; null for all others."""
    try:
        value = json.loads(raw, parse_constant=_no_constant) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return "a number is beyond the range of doubles" if _overflows(value) else None


def decode(raw: str | None) -> tuple[bool, list[Issue], dict | None]:
    """(is JSON, what is wrong, the world with defaults filled in; null if anything is wrong). A member that comes twice has
    its last value; NaN and the infinities are no JSON; numbers beyond the range of doubles are none of the schema."""
    if raw is None:
        return False, [("json_invalid", "", "there is no text")], None
    try:
        value = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError) as reason:
        return False, [("json_invalid", "", str(reason)[:200])], None
    reader = _Reader()
    found = reader.members(value, "$", ("scene", "objects"), ("schema_version", "map", "relations"))
    if found is None:
        return True, reader.issues, None
    board = reader.members(found.get("map", {}), "$.map", (), tuple(domain.DEFAULT_MAP)) or {}
    side = lambda c: reader.integer(board.get(c, domain.DEFAULT_MAP[c]), f"$.map.{c}", domain.LIMITS["least_side"], domain.LIMITS["extent"])
    world = {
        "schema_version": reader.one_of(found.get("schema_version", domain.SCHEMA_VERSION), "$.schema_version", (domain.SCHEMA_VERSION,)),
        "scene": reader.name(found["scene"], "$.scene") if "scene" in found else None,
        "map": {"width": side("width"), "height": side("height"), "biome": reader.one_of(board.get("biome", domain.DEFAULT_MAP["biome"]), "$.map.biome", domain.BIOMES)},
        "objects": [_object(reader, o, f"$.objects.{i}") for i, o in enumerate(reader.sequence(found.get("objects", [None]), "$.objects", 1, domain.LIMITS["objects"]))] if "objects" in found else [],
        "relations": [],
    }
    for i, value in enumerate(reader.sequence(found.get("relations", []), "$.relations", 0, domain.LIMITS["relations"])):
        path = f"$.relations.{i}"
        edge = reader.members(value, path, ("relation_type", "source", "target"), ()) or {}
        kind = reader.one_of(edge["relation_type"], f"{path}.relation_type", domain.RELATION_TYPES) if "relation_type" in edge else None
        world["relations"].append({"relation_type": kind} | {c: reader.name(edge[c], f"{path}.{c}") if c in edge else None for c in ("source", "target")})
    return True, reader.issues, None if reader.issues else world


DECODED = T.StructType([T.StructField("json_ok", T.BooleanType()), T.StructField("schema_issues", T.ArrayType(domain.ISSUE)), T.StructField("world", domain.WORLD)])


@F.pandas_udf(DECODED)
def strict_decode(raws: pd.Series) -> pd.DataFrame:
    """struct(json_ok, schema_issues, world) of raw documents, decoded in Arrow batches."""
    rows = []
    for raw in raws:
        ok, found, world = decode(raw)
        rows.append((ok, [dict(zip(("code", "path", "message"), i)) for i in found], world))
    return pd.DataFrame(rows, columns=["json_ok", "schema_issues", "world"])


@F.pandas_udf(T.StringType())
def number_errors(raws: pd.Series) -> pd.Series:
    """number_error() of raw documents."""
    return raws.map(number_error)


def decoded(rows: DataFrame, column: str) -> DataFrame:
    """The rows with json_ok, schema_ok, schema_issues and world."""
    made = rows.withColumn("_d", strict_decode(F.col(column)))
    return made.select(*rows.columns, F.col("_d.json_ok").alias("json_ok"), F.col("_d.world").isNotNull().alias("schema_ok"), F.col("_d.schema_issues").alias("schema_issues"), F.col("_d.world").alias("world"))


def world_objects(worlds: DataFrame, key: str) -> DataFrame:
    """(world, pos, id, kind, x, y, w, h, r, b, layer) of decoded worlds, as the spatial operators want them."""
    from tessera.operators.geometry import layer

    each = worlds.where("world IS NOT NULL").select(F.col(key).alias("k"), F.posexplode("world.objects").alias("pos", "o"))
    made = each.select(F.col("k").alias("world"), "pos", F.col("o.id").alias("id"), F.col("o.object_type").alias("kind"), *[F.col(f"o.{c}").alias(c) for c in "xywh"])
    return made.withColumns({"r": F.col("x") + F.col("w"), "b": F.col("y") + F.col("h"), "layer": layer(F.col("kind"))})


def world_relations(worlds: DataFrame, key: str) -> DataFrame:
    """(world, pos, relation_type, source, target) of decoded worlds."""
    each = worlds.where("world IS NOT NULL").select(F.col(key).alias("k"), F.posexplode("world.relations").alias("pos", "o"))
    return each.select(F.col("k").alias("world"), "pos", "o.relation_type", "o.source", "o.target")


def world_maps(worlds: DataFrame, key: str) -> DataFrame:
    """(world, width, height, biome) of decoded worlds."""
    return worlds.where("world IS NOT NULL").select(F.col(key).alias("world"), "world.map.*")


def canonical(world: Column) -> Column:
    """A world as text with all members in fixed order, nulls included."""
    return F.to_json(world, {"ignoreNullFields": "false"})


def fingerprint(world: Column) -> Column:
    """The digest of a world's content, whatever its scene is called."""
    return F.sha2(canonical(world.dropFields("scene")), 256)


def document(world: Column) -> Column:
    """A world as the text of a document, in the form that is decoded: positions and sizes as pairs, defaults written out."""
    thing = lambda o: F.struct(
        o["object_type"].alias("object_type"), o["id"].alias("id"), F.array(o["x"], o["y"]).alias("position"),
        F.struct(F.array(o["w"], o["h"]).alias("size"), o["style"].alias("style"), o["material"].alias("material"), o["tags"].alias("tags")).alias("attributes"),
    )
    made = F.struct(world["schema_version"].alias("schema_version"), world["scene"].alias("scene"), world["map"].alias("map"), F.transform(world["objects"], thing).alias("objects"), world["relations"].alias("relations"))
    return F.when(world.isNotNull(), F.to_json(made, {"ignoreNullFields": "false"}))


def same_content(a: Column, b: Column) -> Column:
    """Two decoded worlds are equal in everything, defaults filled in; two nulls are."""
    return canonical(a).eqNullSafe(canonical(b))


def schema() -> dict:
    """The schema of a document for other programs: every member with its type and limits."""
    limits = domain.LIMITS
    whole = lambda low, high: {"type": "integer", "minimum": low, "maximum": high}
    pair = lambda low, high: {"type": "array", "items": whole(low, high), "minItems": 2, "maxItems": 2}
    name = {"type": "string", "pattern": domain.IDENTIFIER.replace(r"\A", "^").replace(r"\z", "$")}
    of = lambda members, required=(): {"type": "object", "properties": members, "required": list(required), "additionalProperties": False}
    text = {"type": ["string", "null"], "maxLength": limits["style"]}
    about = of({"size": pair(1, limits["extent"]), "style": text, "material": text, "tags": {"type": "array", "items": {"type": "string", "maxLength": limits["tag"]}, "maxItems": limits["tags"]}})
    thing = of({"object_type": {"enum": list(domain.OBJECT_TYPES)}, "id": name, "position": pair(0, limits["coordinate"]), "attributes": about}, ("object_type", "id", "position"))
    edge = of({"relation_type": {"enum": list(domain.RELATION_TYPES)}, "source": name, "target": name}, ("relation_type", "source", "target"))
    side = whole(limits["least_side"], limits["extent"])
    board = of({"width": side, "height": side, "biome": {"enum": list(domain.BIOMES)}})
    return of({"schema_version": {"const": domain.SCHEMA_VERSION}, "scene": name, "map": board, "objects": {"type": "array", "items": thing, "minItems": 1, "maxItems": limits["objects"]}, "relations": {"type": "array", "items": edge, "maxItems": limits["relations"]}}, ("scene", "objects"))
