"""Small worlds, one for each issue, and the semantics of scores."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import expect, geometry, local, score, validate

OBJECTS = "world long, pos int, id string, kind string, x int, y int, w int, h int"
RELATIONS = "world long, pos int, relation_type string, source string, target string"


def boxes(spark, rows):
    made = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], OBJECTS)
    return made.withColumns({"r": F.col("x") + F.col("w"), "b": F.col("y") + F.col("h"), "layer": geometry.layer(F.col("kind"))})


def edges(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], RELATIONS)


def board(spark):
    return spark.createDataFrame([(1, 32, 24, "forest")], "world long, width int, height int, biome string")


def codes(spark, things, links):
    made = boxes(spark, things), edges(spark, links), board(spark)
    found = sorted((r.pos, r.code) for r in validate.issues(*made).collect())
    assert found == sorted((r.pos, r.code) for r in local.issues(local.packed(*made)).collect())
    return sorted(code for _, code in found)


HOUSE, TREE = ("a", "house", 2, 2, 4, 4), ("t", "tree", 12, 12, 1, 1)


@pytest.mark.parametrize(
    ("things", "links", "wanted"),
    [
        ([HOUSE, TREE], [], []),
        ([HOUSE, ("a", "tree", 12, 12, 1, 1)], [], ["duplicate_id"]),
        ([HOUSE, ("t", "tree", 31, 12, 2, 1)], [], ["out_of_bounds"]),
        ([HOUSE, ("t", "tree", 7, 2, 1, 1)], [("near", "a", "t"), ("near", "t", "a")], ["duplicate_relation"]),
        ([HOUSE, TREE], [("near", "a", "a")], ["self_relation"]),
        ([HOUSE, TREE], [("near", "a", "z")], ["missing_reference"]),
        ([HOUSE, ("t", "tree", 8, 2, 1, 1)], [("near", "a", "t")], []),
        ([HOUSE, ("t", "tree", 9, 2, 1, 1)], [("near", "a", "t")], ["not_near"]),
        ([HOUSE, TREE], [("inside", "t", "a")], ["not_inside"]),
        ([HOUSE, ("t", "tree", 6, 6, 1, 1)], [("connected_to", "a", "t")], ["not_connected"]),
        ([HOUSE, ("t", "tree", 6, 5, 1, 1)], [("connected_to", "a", "t")], []),
        ([HOUSE, ("t", "tree", 3, 3, 1, 1)], [], ["overlap"]),
        ([HOUSE, ("t", "tree", 3, 3, 1, 1)], [("inside", "t", "a")], []),
        ([HOUSE, ("t", "tree", 3, 3, 1, 1)], [("inside", "a", "t")], ["not_inside", "overlap"]),
        ([HOUSE, ("n", "npc", 3, 3, 1, 1)], [], ["blocked_entity"]),
        ([("a", "bridge", 2, 2, 4, 4), ("n", "npc", 3, 3, 1, 1)], [], []),
        ([("a", "road", 2, 2, 4, 4), ("n", "npc", 3, 3, 1, 1), ("h", "house", 3, 4, 1, 1)], [], []),
        ([HOUSE, ("b", "wall", 2, 2, 4, 4)], [("inside", "a", "b")], ["not_inside", "overlap"]),
    ],
)
def test_issue(spark, things, links, wanted):
    assert codes(spark, things, links) == wanted


def test_against_brute_force(spark):
    """Random worlds, pair by pair."""
    rng = random.Random(5)
    kinds = ("house", "npc", "road", "bridge", "tree")
    things = [(f"o{i}", rng.choice(kinds), rng.randrange(28), rng.randrange(20), rng.randrange(1, 5), rng.randrange(1, 5)) for i in range(40)]
    layer = {"road": 0, "npc": 2}
    wanted = []
    for a, b in itertools.combinations(things, 2):
        if a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]:
            la, lb = layer.get(a[1], 1), layer.get(b[1], 1)
            if la == lb:
                wanted.append("overlap")
            elif {la, lb} == {1, 2} and "bridge" not in (a[1], b[1]):
                wanted.append("blocked_entity")
    assert codes(spark, things, []) == sorted(wanted)


def test_scores(spark):
    """A repeated edge, one to an ambiguous id and a missing one all cost a slot."""
    things = boxes(spark, [HOUSE, ("t", "tree", 7, 2, 1, 1), ("d", "rock", 20, 20, 1, 1), ("d", "rock", 22, 20, 1, 1)])
    links = edges(spark, [("near", "a", "t"), ("near", "t", "a"), ("near", "a", "d")])
    needed = edges(spark, [("near", "a", "q")])
    minimums = spark.createDataFrame([(1, "near", 1), (1, "inside", 0)], "world long, kind string, minimum int")
    got = {r.kind: (r.passed, r.slots) for r in score.slots(things, links, needed, minimums).collect()}
    assert got == {"near": (1, 4), "inside": (0, 0)}
    rates = {r.kind: r.accuracy for r in score.micro(score.slots(things, links, needed, minimums)).collect()}
    assert rates == {"near": 0.25, "inside": None}


def test_empty_tables(spark):
    nothing = boxes(spark, [])
    assert validate.issues(nothing, edges(spark, []), board(spark)).count() == 0
    assert validate.by_category(validate.issues(nothing, edges(spark, []), board(spark))).count() == 7
    wanted = spark.createDataFrame([(1, "house", 1)], "world long, kind string, expected int")
    assert expect.object_count(nothing, wanted).collect()[0].actual == 0
