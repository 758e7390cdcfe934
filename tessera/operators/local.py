"""The spatial validator row by row: a world with its objects and relations as arrays is checked in one projection, without
a join or a shuffle. Same issues as `validate.issues`, which works on exploded tables; a world has 256 objects at most, so
pairs within a row are bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.domain import NEAR_TILES
from tessera.operators.geometry import Box, contains, distance, edge_valid, overlaps, same_bounds, shares_edge

#: Parts the two names of a key; no identifier has it.
BETWEEN = "\x1f"


def _issue(place: Column, code: Column | str) -> Column:
    return F.struct(place.alias("pos"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(BETWEEN), F.greatest(a, b))


def _resolved(edge: Column, objects: Column) -> Column:
    """An edge with its canonical key and the last object of each end, null for an unknown one."""
    last = lambda name: F.try_element_at(F.filter(objects, lambda o: o["id"] == name), F.lit(-1))
    directed = F.concat(edge["source"], F.lit(BETWEEN), edge["target"])
    key = F.concat(edge["relation_type"], F.lit(BETWEEN), F.when(edge["relation_type"] == "inside", directed).otherwise(_key(edge["source"], edge["target"])))
    return F.struct(edge["pos"].alias("pos"), edge["relation_type"].alias("kind"), edge["source"].alias("source"), edge["target"].alias("target"), key.alias("key"), last(edge["source"]).alias("s"), last(edge["target"]).alias("t"))


OBJECT_CODES = frozenset(("duplicate_id", "out_of_bounds"))
EDGE_CODES = frozenset(("duplicate_relation", "self_relation", "missing_reference", "not_near", "not_inside", "not_connected"))
PAIR_CODES = frozenset(("overlap", "blocked_entity"))


def with_issues(worlds: DataFrame, codes: frozenset[str] = OBJECT_CODES | EDGE_CODES | PAIR_CODES) -> DataFrame:
    """worlds(world, width, height, objects, relations) with issues, an array of (pos, code). An object has pos, id, kind, x,
    y, r, b, layer; a relation pos, relation_type, source, target. A missing array counts as empty, a missing size as no
    bound. Only the rules of the wanted codes are computed."""
    objects, edges = F.col("objects"), F.col("_edges")
    rows = worlds.withColumn("objects", F.coalesce("objects", F.array().cast(worlds.schema["objects"].dataType)))
    rows = rows.withColumn("_edges", F.transform(F.coalesce("relations", F.array().cast(worlds.schema["relations"].dataType)), lambda e: _resolved(e, F.col("objects"))))
    # Held: a valid `inside` between two objects, in whichever direction.
    inside = lambda e: contains(Box(e["t"]), Box(e["s"])) & ~same_bounds(Box(e["t"]), Box(e["s"]))
    held = F.filter(edges, lambda e: (e["kind"] == "inside") & (e["source"] != e["target"]) & inside(e))
    rows = rows.withColumn("_held", F.transform(held, lambda e: _key(e["source"], e["target"])))

    def of_object(o: Column, i: Column) -> Column:
        again = F.exists(F.slice(objects, F.lit(1), i), lambda p: p["id"] == o["id"])
        outside = (o["r"] > F.col("width")) | (o["b"] > F.col("height"))
        rules = [F.when(broken, _issue(o["pos"], code)) for code, broken in (("duplicate_id", again), ("out_of_bounds", outside)) if code in codes]
        return F.array_compact(F.array(*rules))

    def of_edge(e: Column, i: Column) -> Column:
        repeated = F.exists(F.slice(edges, F.lit(1), i), lambda p: p["key"] == e["key"])
        s, t = Box(e["s"]), Box(e["t"])
        broken = (
            F.when(e["source"] == e["target"], "self_relation")
            .when(e["s"].isNull() | e["t"].isNull(), "missing_reference")
            .when((e["kind"] == "near") & (distance(s, t) > NEAR_TILES), "not_near")
            .when((e["kind"] == "inside") & ~inside(e), "not_inside")
            .when((e["kind"] == "connected_to") & ~shares_edge(s, t), "not_connected")
        )
        rules = [F.when(repeated, _issue(e["pos"], "duplicate_relation"))] if "duplicate_relation" in codes else []
        if codes & EDGE_CODES - {"duplicate_relation"}:
            rules.append(F.when(broken.isin(*sorted(codes)), _issue(e["pos"], broken)))
        return F.array_compact(F.array(*rules))

    def of_pair(a: Column, b: Column) -> Column:
        # Layers 1 and 2 together; ground, 0, blocks nothing.
        blocked = (a["layer"] + b["layer"] == 3) & (a["layer"] != 0) & (b["layer"] != 0) & (a["kind"] != "bridge") & (b["kind"] != "bridge")
        code = F.when(a["layer"] == b["layer"], "overlap").when(blocked, "blocked_entity")
        free = ~F.array_contains("_held", _key(a["id"], b["id"]))
        return F.when(overlaps(Box(a), Box(b)) & code.isin(*sorted(codes)) & free, _issue(a["pos"], code))

    def pairs_of(a: Column, i: Column) -> Column:
        return F.array_compact(F.transform(F.slice(objects, i + 2, F.size(objects)), lambda b: of_pair(a, b)))

    parts = [(OBJECT_CODES, objects, of_object), (EDGE_CODES, edges, of_edge), (PAIR_CODES, objects, pairs_of)]
    found = F.concat(*[F.flatten(F.transform(column, rule)) for own, column, rule in parts if codes & own])
    return rows.withColumn("issues", found).drop("_edges", "_held")


def issues(worlds: DataFrame, *codes: str) -> DataFrame:
    """(world, pos, code): every issue of every world, or those of the given codes."""
    made = with_issues(worlds, frozenset(codes)) if codes else with_issues(worlds)
    return made.select("world", F.inline("issues"))


def histogram(worlds: DataFrame, name: str, by: Callable[[Column], Column] = lambda code: code) -> DataFrame:
    """(name, issues, worlds): issues and worlds concerned by code, or by what `by` makes of a code. Each world's issues are
    counted in its row, so that no distinct count is left for the shuffle."""
    keys = with_issues(worlds).select(F.transform("issues", lambda i: by(i["code"])).alias("k"))
    each = keys.select(F.explode(F.transform(F.array_distinct("k"), lambda k: F.struct(k.alias(name), F.size(F.filter("k", lambda x: x == k)).alias("n"))))).select("col.*")
    return each.groupBy(name).agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("worlds"))


def world_flags(worlds: DataFrame) -> DataFrame:
    """(world, valid, boundary_correct, overlap_free): verdicts on each world."""
    codes = with_issues(worlds).select("world", F.col("issues.code").alias("codes"))
    has = lambda *names: F.arrays_overlap("codes", F.array(*[F.lit(n) for n in names]))
    return codes.select("world", (F.size("codes") == 0).alias("valid"), (~has("out_of_bounds", "duplicate_id")).alias("boundary_correct"), (~has("overlap", "blocked_entity", "duplicate_id")).alias("overlap_free"))


def packed(objects: DataFrame, relations: DataFrame, maps: DataFrame) -> DataFrame:
    """Exploded tables as one row for each world that has objects or relations."""
    things = objects.groupBy("world").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "kind", "x", "y", "r", "b", "layer"))).alias("objects"))
    edges = relations.groupBy("world").agg(F.array_sort(F.collect_list(F.struct("pos", "relation_type", "source", "target"))).alias("relations"))
    return things.join(edges, "world", "full").join(maps, "world", "left")


def checks(worlds: DataFrame) -> DataFrame:
    """worlds with checks, an array of (pos, kind, key, reason): each relation with the first reason why it doesn't pass, null
    if it does. The same rules as `score.checks`."""
    objects, edges = F.col("objects"), F.col("_edges")
    rows = worlds.withColumn("_edges", F.transform("relations", lambda e: _resolved(e, objects)))
    single = lambda name: F.size(F.filter(objects, lambda o: o["id"] == name)) == 1

    def check(e: Column, i: Column) -> Column:
        s, t = Box(e["s"]), Box(e["t"])
        kind = e["kind"]
        failed = F.when(kind == "near", "not_near").when(kind == "inside", "not_inside").otherwise("not_connected")
        reason = (
            F.when(F.exists(F.slice(edges, F.lit(1), i), lambda p: p["key"] == e["key"]), "duplicate_relation")
            .when(e["source"] == e["target"], "self_relation")
            .when(~(single(e["source"]) & single(e["target"])), "missing_or_ambiguous_reference")
            .when(~edge_valid(kind, s, t), failed)
        )
        return F.struct(e["pos"].alias("pos"), kind.alias("kind"), e["key"].alias("key"), reason.alias("reason"))

    return rows.withColumn("checks", F.transform(edges, check)).drop("_edges")


def slots(worlds: DataFrame) -> DataFrame:
    """(world, kind, passed, slots) of worlds that also have required, an array of (relation_type, source, target), and
    minimums, a map from type to number. The same rules as `score.slots`; types come from the minimums."""
    bare = lambda e: F.struct(F.lit(0).alias("pos"), e["relation_type"].alias("relation_type"), e["source"].alias("source"), e["target"].alias("target"))
    rows = checks(worlds).withColumn("_wanted", F.array_distinct(F.transform("required", lambda e: _resolved(bare(e), F.array().cast(worlds.schema["objects"].dataType))["key"])))
    rows = rows.withColumn("_absent", F.array_except("_wanted", F.transform("checks", lambda c: c["key"])))

    def of_kind(kind: Column, minimum: Column) -> Column:
        mine = F.filter("checks", lambda c: c["kind"] == kind)
        keys = lambda column: F.size(F.filter(column, lambda k: F.startswith(k, F.concat(kind, F.lit(BETWEEN)))))
        places = F.greatest(F.size(mine) + keys("_absent"), minimum.cast("int"), keys("_wanted"))
        return F.struct(kind.alias("kind"), F.size(F.filter(mine, lambda c: c["reason"].isNull())).cast("long").alias("passed"), places.cast("long").alias("slots"))

    return rows.select("world", F.inline(F.transform(F.map_entries("minimums"), lambda e: of_kind(e["key"], e["value"]))))
