"""Strict decoding."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from tessera.functions.decode import decode, decoded, fingerprint, number_error, same_content, schema, world_objects

WORLD = {"scene": "mill_pond", "objects": [{"object_type": "house", "id": "h_1", "position": [3, 4]}]}


def changed(**members):
    return json.dumps(WORLD | members)


def piece(**members):
    return json.dumps(WORLD | {"objects": [WORLD["objects"][0] | members]})


@pytest.mark.parametrize(
    ("raw", "codes"),
    [
        (json.dumps(WORLD), []),
        (None, ["json_invalid"]),
        ("", ["json_invalid"]),
        ("{bad", ["json_invalid"]),
        (json.dumps(WORLD) + " x", ["json_invalid"]),
        ("```json\n" + json.dumps(WORLD) + "\n```", ["json_invalid"]),
        ("[]", ["model_type"]),
        (changed(extra=1), ["extra_forbidden"]),
        (changed(schema_version="2.0"), ["literal_error"]),
        (changed(scene="Mill"), ["string_pattern_mismatch"]),
        (changed(scene="mill\n"), ["string_pattern_mismatch"]),
        (changed(objects=[]), ["too_short"]),
        (changed(map={"width": 7}), ["greater_than_equal"]),
        (changed(map={"width": True}), ["int_type"]),
        (piece(position=["2", 1]), ["int_type"]),
        (piece(position=[2.0, 1]), ["int_type"]),
        (piece(position=[-1, 128]), ["greater_than_equal", "less_than_equal"]),
        (piece(position=[1]), ["too_short"]),
        (piece(object_type="ship"), ["literal_error"]),
        (piece(attributes={"size": [0, 1]}), ["greater_than_equal"]),
        (piece(attributes={"tags": ["x" * 41]}), ["string_too_long"]),
        (changed(relations=[{"relation_type": "near", "source": "h_1"}]), ["missing"]),
        ('{"scene": "a", "scene": "mill", "objects": [{"object_type": "tree", "id": "t", "position": [1, 1]}]}', []),
        (piece(position=[1, 1]).replace("[1, 1]", "[1e999, 1]"), ["int_type"]),
        (piece(position=[1, 1]).replace("[1, 1]", "[NaN, 1]"), ["json_invalid"]),
        ('{"x": NaN}', ["json_invalid"]),
        ('{"x": -Infinity}', ["json_invalid"]),
    ],
)
def test_decode(raw, codes):
    ok, found, world = decode(raw)
    assert [c for c, _, _ in found] == codes
    assert (world is None) == bool(codes)
    assert ok == ("json_invalid" not in codes)


def test_defaults():
    world = decode(json.dumps(WORLD))[2]
    assert world["map"] == {"width": 32, "height": 24, "biome": "forest"} and world["objects"][0]["w"] == 1 and world["relations"] == []


def test_frame(spark):
    rows = spark.createDataFrame([(1, json.dumps(WORLD)), (2, changed(scene="other_name")), (3, None), (4, "{")], "k long, raw string")
    made = decoded(rows, "raw")
    assert [r.schema_ok for r in made.orderBy("k").collect()] == [True, True, False, False]
    prints = [r[0] for r in made.where("schema_ok").select(fingerprint(made.world)).collect()]
    assert prints[0] == prints[1]
    assert world_objects(made, "k").count() == 2


def test_numbers_out_of_range():
    assert number_error('{"a": [1, {"b": 1e999}]}') == "a number is beyond the range of doubles"
    assert [number_error(t) for t in ('{"a": 1e308}', "{bad", '{"a": NaN}', None)] == [None] * 4


def test_schema_names_every_member():
    made = schema()
    assert set(made["properties"]) == {"schema_version", "scene", "map", "objects", "relations"} and made["required"] == ["scene", "objects"]
    assert json.loads(json.dumps(made)) == made


def test_content_is_the_same(spark):
    rows = spark.createDataFrame([(json.dumps(WORLD), changed(map={"width": 32})), (json.dumps(WORLD), changed(map={"width": 40}))], "a string, b string")
    both = decoded(decoded(rows, "a").select("b", F.col("world").alias("w")), "b")
    assert [r.s for r in both.select(same_content(F.col("w"), F.col("world")).alias("s")).collect()] == [True, False]
