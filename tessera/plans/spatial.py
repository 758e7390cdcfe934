"""Queries over the worlds derived from the order tables: geometry, issues, expectations, relation scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.domain import NEAR_TILES, OBJECT_TYPES, RELATION_TYPES
from tessera.operators import curate, expect, local, score, stats, validate, views
from tessera.operators.geometry import Box, contains, distance, edge_valid, in_bounds, overlaps, same_bounds, shares_edge, touches_border

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = "WITH " + views.SQL
#: Neighbours in a world's order, and their geometry.
PAIRS_SQL = """, pairs AS (SELECT a.world, a.pos, a.x AS ax, a.y AS ay, a.r AS ar, a.b AS ab, o.x AS bx, o.y AS "by", o.r AS br, o.b AS bb
  FROM objects a JOIN objects o ON a.world = o.world AND o.pos = a.pos + 1),
geo AS (SELECT *, greatest(ax - br + 1, bx - ar + 1, ay - bb + 1, "by" - ab + 1, 0) AS tiles, ax < br AND bx < ar AND ay < bb AND "by" < ab AS overlapping,
  bx <= ax AND "by" <= ay AND ar <= br AND ab <= bb AS within, ax = bx AND ay = "by" AND ar = br AND ab = bb AS same,
  ((ar = bx OR br = ax) AND greatest(ay, "by") < least(ab, bb)) OR ((ab = "by" OR bb = ay) AND greatest(ax, bx) < least(ar, br)) AS edge FROM pairs)
"""
#: All issues, as rows (world, pos, code).
ISSUES_SQL = """, ends AS (SELECT world, id, arg_max(x, pos) AS x, arg_max(y, pos) AS y, arg_max(r, pos) AS r, arg_max(b, pos) AS b FROM objects GROUP BY 1, 2),
keyed AS (SELECT *, CASE WHEN relation_type = 'inside' THEN source ELSE least(source, target) END AS key_a, CASE WHEN relation_type = 'inside' THEN target ELSE greatest(source, target) END AS key_b FROM relations),
edges AS (SELECT k.*, row_number() OVER (PARTITION BY k.world, relation_type, key_a, key_b ORDER BY pos) > 1 AS repeated, s.id IS NOT NULL AND t.id IS NOT NULL AS known,
  greatest(s.x - t.r + 1, t.x - s.r + 1, s.y - t.b + 1, t.y - s.b + 1, 0) AS tiles,
  t.x <= s.x AND t.y <= s.y AND s.r <= t.r AND s.b <= t.b AND NOT (s.x = t.x AND s.y = t.y AND s.r = t.r AND s.b = t.b) AS held,
  ((s.r = t.x OR t.r = s.x) AND greatest(s.y, t.y) < least(s.b, t.b)) OR ((s.b = t.y OR t.b = s.y) AND greatest(s.x, t.x) < least(s.r, t.r)) AS edge
  FROM keyed k LEFT JOIN ends s ON k.world = s.world AND k.source = s.id LEFT JOIN ends t ON k.world = t.world AND k.target = t.id),
held AS (SELECT DISTINCT world, least(source, target) AS low, greatest(source, target) AS high FROM edges WHERE relation_type = 'inside' AND source <> target AND known AND held),
clashes AS (SELECT a.world, a.pos, CASE WHEN a.layer = o.layer THEN 'overlap' WHEN a.layer + o.layer = 3 AND a.layer > 0 AND o.layer > 0 AND a.kind <> 'bridge' AND o.kind <> 'bridge' THEN 'blocked_entity' END AS code,
  least(a.id, o.id) AS low, greatest(a.id, o.id) AS high FROM objects a JOIN objects o ON a.world = o.world AND a.pos < o.pos AND a.x < o.r AND o.x < a.r AND a.y < o.b AND o.y < a.b),
issues AS (
  SELECT world, pos, 'duplicate_id' AS code FROM (SELECT world, pos, row_number() OVER (PARTITION BY world, id ORDER BY pos) AS n FROM objects) WHERE n > 1
  UNION ALL SELECT o.world, o.pos, 'out_of_bounds' FROM objects o JOIN maps m ON o.world = m.world WHERE o.r > m.width OR o.b > m.height
  UNION ALL SELECT world, pos, 'duplicate_relation' FROM edges WHERE repeated
  UNION ALL SELECT world, pos, 'self_relation' FROM edges WHERE source = target
  UNION ALL SELECT world, pos, 'missing_reference' FROM edges WHERE source <> target AND NOT known
  UNION ALL SELECT world, pos, 'not_near' FROM edges WHERE source <> target AND known AND relation_type = 'near' AND tiles > 3
  UNION ALL SELECT world, pos, 'not_inside' FROM edges WHERE source <> target AND known AND relation_type = 'inside' AND NOT held
  UNION ALL SELECT world, pos, 'not_connected' FROM edges WHERE source <> target AND known AND relation_type = 'connected_to' AND NOT edge
  UNION ALL SELECT c.world, c.pos, c.code FROM clashes c WHERE c.code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.world = c.world AND h.low = c.low AND h.high = c.high))
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    return local.issues(views.worlds(spark, folder))


@query("geo_bounds", WITH + "SELECT o.world, o.pos, o.id, o.kind, o.x, o.y, o.r, o.b, o.layer, (o.r <= m.width AND o.b <= m.height) AS in_bounds, (o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height) AS at_border FROM objects o JOIN maps m ON o.world = m.world")
def geo_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Footprints, layers, and whether they end in bounds or touch the border."""
    placed = views.objects(spark, folder).join(views.maps(spark, folder), "world")
    size = F.col("width"), F.col("height")
    return placed.select("world", "pos", "id", "kind", "x", "y", "r", "b", "layer", in_bounds(Box(), *size).alias("in_bounds"), touches_border(Box(), *size).alias("at_border"))


@query("geo_neighbours", WITH + PAIRS_SQL + "SELECT world, pos, tiles, overlapping, within, same, edge FROM geo")
def geo_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Distance, overlap, containment and shared edges of objects that follow one another."""
    nxt = lambda c: F.lead(c).over(Window.partitionBy("world").orderBy("pos")).alias(f"n_{c}")
    pairs = views.objects(spark, folder).select("world", "pos", "x", "y", "r", "b", *[nxt(c) for c in "xyrb"]).where("n_x IS NOT NULL")
    a, b = Box(), Box("n_")
    return pairs.select("world", "pos", distance(a, b).alias("tiles"), overlaps(a, b).alias("overlapping"), contains(b, a).alias("within"), same_bounds(a, b).alias("same"), shares_edge(a, b).alias("edge"))


@query("geo_edge_valid", WITH + ISSUES_SQL + "SELECT world, pos, relation_type, CASE relation_type WHEN 'near' THEN tiles <= 3 WHEN 'inside' THEN held ELSE edge END AS valid FROM edges WHERE known AND source <> target")
def geo_edge_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the geometry bears out each relation between two known objects."""
    things = views.objects(spark, folder)
    edges = validate.resolved(views.relations(things), things).where("s IS NOT NULL AND t IS NOT NULL AND source <> target")
    return edges.select("world", "pos", "relation_type", edge_valid(F.col("relation_type"), Box(F.col("s")), Box(F.col("t"))).alias("valid"))


def _code_query(code: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return local.issues(views.worlds(spark, folder), code).groupBy("world").agg(F.count(F.lit(1)).alias("issues"))

    run.__doc__ = f"Worlds with the issue {code} and how often."
    query(f"val_{code}", WITH + ISSUES_SQL + f"SELECT world, count(*) AS issues FROM issues WHERE code = '{code}' GROUP BY 1")(run)


for _code in ("duplicate_id", "out_of_bounds", "duplicate_relation", "self_relation", "missing_reference", "not_near", "not_inside", "not_connected", "overlap", "blocked_entity"):
    _code_query(_code)


@query("val_code_histogram", WITH + ISSUES_SQL + "SELECT code, count(*) AS issues, count(DISTINCT world) AS worlds FROM issues GROUP BY 1")
def val_code_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Issues and worlds by code."""
    return local.histogram(views.worlds(spark, folder), "code")


@query(
    "val_category_histogram",
    WITH + ISSUES_SQL + """, cats AS (SELECT unnest(['overlap','out_of_bounds','near_violation','inside_violation','connected_to_violation','invalid_reference','other']) AS category),
tagged AS (SELECT world, CASE code WHEN 'overlap' THEN 'overlap' WHEN 'blocked_entity' THEN 'overlap' WHEN 'out_of_bounds' THEN 'out_of_bounds' WHEN 'not_near' THEN 'near_violation' WHEN 'not_inside' THEN 'inside_violation' WHEN 'not_connected' THEN 'connected_to_violation' WHEN 'missing_reference' THEN 'invalid_reference' ELSE 'other' END AS category FROM issues)
SELECT c.category, count(t.world) AS issues, count(DISTINCT t.world) AS worlds FROM cats c LEFT JOIN tagged t ON c.category = t.category GROUP BY 1""",
)
def val_category_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Issues and worlds by category, zero-filled."""
    return validate.zero_filled(local.histogram(views.worlds(spark, folder), "category", validate.category))


FLAGS_SQL = """, flags AS (SELECT o.world, count(i.code) = 0 AS valid, count(*) FILTER (i.code IN ('out_of_bounds','duplicate_id')) = 0 AS boundary_correct,
  count(*) FILTER (i.code IN ('overlap','blocked_entity','duplicate_id')) = 0 AS overlap_free FROM (SELECT DISTINCT world FROM objects) o LEFT JOIN issues i ON o.world = i.world GROUP BY 1)
"""


@query("val_joined_histogram", WITH + ISSUES_SQL + "SELECT code, count(*) AS issues, count(DISTINCT world) AS worlds FROM issues GROUP BY 1")
def val_joined_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Issues and worlds by code, by joins over exploded tables instead of row by row."""
    things = views.objects(spark, folder)
    found = validate.issues(things, views.relations(things), views.maps(spark, folder))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("world").alias("worlds"))


@query("val_world_flags", WITH + ISSUES_SQL + FLAGS_SQL + "SELECT * FROM flags")
def val_world_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Validity, boundary and overlap verdicts by world."""
    return local.world_flags(views.worlds(spark, folder))


@query("val_rates", WITH + ISSUES_SQL + FLAGS_SQL + "SELECT count(*) AS worlds, round(avg(CAST(valid AS INTEGER)), 6) AS valid_rate, round(avg(CAST(boundary_correct AS INTEGER)), 6) AS boundary_accuracy, round(avg(CAST(overlap_free AS INTEGER)), 6) AS overlap_free_rate FROM flags")
def val_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the verdicts over all worlds."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return val_world_flags(spark, folder).agg(F.count(F.lit(1)).alias("worlds"), rate("valid").alias("valid_rate"), rate("boundary_correct").alias("boundary_accuracy"), rate("overlap_free").alias("overlap_free_rate"))


@query("val_repair_hints", WITH + ISSUES_SQL + "SELECT world, pos, relation_type, source, target FROM edges WHERE known AND ((relation_type = 'near' AND tiles > 3) OR (relation_type = 'connected_to' AND NOT edge)) AND world % 3 <> 0")
def val_repair_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Optional relations that should go: geometry doesn't bear them out and no minimum of their type is wanted (here: in
    two worlds of three)."""
    things = views.objects(spark, folder)
    wanted = views.maps(spark, folder).where("world % 3 = 0").select("world", F.explode(F.array(*[F.lit(r) for r in RELATION_TYPES])).alias("relation_type"))
    return expect.repair_hints(validate.resolved(views.relations(things), things), wanted).select("world", "pos", "relation_type", "source", "target")


# Expectations: a world wants as many objects of its first object's type as its order has lines, a map, and two relations.
WANTED_SQL = """, wanted AS (SELECT world, kind, CAST(1 + world % 3 AS BIGINT) AS expected FROM objects WHERE pos = 1),
wanted_relations AS (SELECT world, unnest(['near','inside','connected_to']) AS kind, CAST(1 + world % 2 AS BIGINT) AS minimum FROM maps),
wanted_map AS (SELECT world, CAST(24 + 8 * (world % 2) AS INTEGER) AS width, 20 AS height, CASE WHEN world % 2 = 0 THEN 'forest' ELSE biome END AS biome FROM maps)
"""


def _wanted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    first = views.objects(spark, folder).where("pos = 1").select("world", "kind", (1 + F.col("world") % 3).alias("expected"))
    worlds = views.maps(spark, folder).select("world")
    edges = worlds.select("world", F.explode(F.array(*[F.lit(r) for r in RELATION_TYPES])).alias("kind"), (1 + F.col("world") % 2).alias("minimum"))
    biome = F.when(F.col("world") % 2 == 0, "forest").otherwise(F.col("biome"))
    return first, edges, views.maps(spark, folder).select("world", (24 + 8 * (F.col("world") % 2)).cast("int").alias("width"), F.lit(20).alias("height"), biome.alias("biome"))


@query("exp_object_count", WITH + WANTED_SQL + "SELECT w.world, w.kind, w.expected, count(o.id) AS actual FROM wanted w LEFT JOIN objects o ON w.world = o.world AND w.kind = o.kind GROUP BY 1, 2, 3 HAVING count(o.id) <> w.expected")
def exp_object_count(spark: SparkSession, folder: str) -> DataFrame:
    """Expected counts that aren't met, with both numbers; types without expectation are free."""
    return expect.object_count(views.objects(spark, folder), _wanted(spark, folder)[0])


@query("exp_relation_count", WITH + WANTED_SQL + "SELECT w.world, w.kind, w.minimum, count(r.pos) AS actual FROM wanted_relations w LEFT JOIN relations r ON w.world = r.world AND w.kind = r.relation_type GROUP BY 1, 2, 3 HAVING count(r.pos) < w.minimum")
def exp_relation_count(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum numbers of relations that aren't met."""
    return expect.relation_count(views.relations(views.objects(spark, folder)), _wanted(spark, folder)[1])


@query("exp_map_mismatch", WITH + WANTED_SQL + "SELECT m.world, m.width, m.height, m.biome, w.width AS wanted_width, w.height AS wanted_height, w.biome AS wanted_biome FROM maps m JOIN wanted_map w ON m.world = w.world WHERE m.width <> w.width OR m.height <> w.height OR m.biome <> w.biome")
def exp_map_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds whose map is not the wanted one."""
    return expect.map_mismatch(views.maps(spark, folder), _wanted(spark, folder)[2])


# Tasks: in two worlds of three, the first two objects are required, in every fifth world one more that no world has.
TASK_SQL = """, needed AS (SELECT world, id, ['house','tree','river'][CAST(world % 3 AS INTEGER) + 1] AS kind, w, h FROM objects WHERE pos <= 2 AND world % 3 > 0
  UNION ALL SELECT world, 'o_98', 'house', 1, 1 FROM maps WHERE world % 3 > 0 AND world % 5 = 0),
ends AS (SELECT world, id, arg_max(kind, pos) AS kind, arg_max(w, pos) AS w, arg_max(h, pos) AS h FROM objects GROUP BY 1, 2),
required_wrong AS (SELECT n.world, n.id, count(*) FILTER (e.id IS NULL) AS absent, count(*) FILTER (e.kind <> n.kind) AS wrong_type, count(*) FILTER (e.w <> n.w OR e.h <> n.h) AS wrong_size
  FROM needed n LEFT JOIN ends e ON n.world = e.world AND n.id = e.id GROUP BY 1, 2 HAVING count(*) FILTER (e.id IS NULL OR e.kind <> n.kind OR e.w <> n.w OR e.h <> n.h) > 0),
id_sides AS (SELECT coalesce(n.world, o.world) AS world, n.id AS wanted, o.id AS there FROM (SELECT DISTINCT world, id FROM needed) n
  FULL JOIN (SELECT DISTINCT world, id FROM objects WHERE world IN (SELECT world FROM needed)) o ON n.world = o.world AND n.id = o.id),
id_sets AS (SELECT world, count(*) FILTER (there IS NULL) AS missing, count(*) FILTER (wanted IS NULL) AS surplus FROM id_sides GROUP BY 1 HAVING count(*) FILTER (there IS NULL OR wanted IS NULL) > 0),
off AS (SELECT o.world, o.id FROM objects o JOIN maps m ON o.world = m.world WHERE o.pos = 1 AND o.world IN (SELECT world FROM needed) AND NOT (o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height)),
task_errors AS (SELECT world, 'inventory' AS "constraint", count(*) AS errors FROM id_sets GROUP BY 1 UNION ALL SELECT world, 'required_object', count(*) FROM required_wrong GROUP BY 1 UNION ALL SELECT world, 'boundary', count(*) FROM off GROUP BY 1),
unmet AS (SELECT w.world FROM wanted w LEFT JOIN objects o ON w.world = o.world AND w.kind = o.kind GROUP BY w.world, w.kind, w.expected HAVING count(o.id) <> w.expected),
outcomes AS (SELECT m.world, CASE WHEN m.world IN (SELECT world FROM needed) THEN m.world NOT IN (SELECT world FROM unmet) AND m.world NOT IN (SELECT world FROM task_errors) END AS task_pass FROM maps m)
"""


def _needed(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in OBJECT_TYPES[:3]]), (F.col("world") % 3 + 1).cast("int"))
    first = views.objects(spark, folder).where("pos <= 2 AND world % 3 > 0").select("world", "id", kind.alias("kind"), "w", "h")
    ghost = views.maps(spark, folder).where("world % 3 > 0 AND world % 5 = 0").select("world", F.lit("o_98").alias("id"), F.lit("house").alias("kind"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return first.unionByName(ghost)


def _task_errors(spark: SparkSession, folder: str) -> DataFrame:
    things, needed = views.objects(spark, folder), _needed(spark, folder)
    off = expect.off_border(things.where("pos = 1").join(needed.select("world").distinct(), "world", "left_semi"), views.maps(spark, folder))
    return expect.task_errors(("inventory", expect.inventory_differs(things, needed)), ("required_object", expect.required_objects(things, needed).select("world", "id").distinct()), ("boundary", off))


def _task_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    unmet = exp_object_count(spark, folder).select("world").distinct().withColumn("unmet", F.lit(True))
    worlds = views.maps(spark, folder).select("world").join(unmet, "world", "left").select("world", F.col("unmet").isNull().alias("expectations_pass"))
    return expect.task_outcomes(worlds, _needed(spark, folder), _task_errors(spark, folder))


@query("exp_required_objects", WITH + WANTED_SQL + TASK_SQL + "SELECT * FROM required_wrong")
def exp_required_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Required objects that are absent, or there with another type or size."""
    wrong = expect.required_objects(views.objects(spark, folder), _needed(spark, folder))
    return wrong.groupBy("world", "id").agg(*[F.sum(c).alias(c) for c in ("absent", "wrong_type", "wrong_size")])


@query("exp_inventory", WITH + WANTED_SQL + TASK_SQL + "SELECT * FROM id_sets")
def exp_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds whose ids are not the required ones, with the numbers missing and beyond."""
    return expect.inventory_differs(views.objects(spark, folder), _needed(spark, folder))


@query("exp_task_errors", WITH + WANTED_SQL + TASK_SQL + 'SELECT "constraint", count(*) AS worlds, CAST(sum(errors) AS BIGINT) AS errors FROM task_errors GROUP BY 1')
def exp_task_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Task constraints that are broken: worlds and errors of each."""
    return _task_errors(spark, folder).groupBy("constraint").agg(F.count(F.lit(1)).alias("worlds"), F.sum("errors").alias("errors"))


@query("exp_task_pass", WITH + WANTED_SQL + TASK_SQL + "SELECT world, CASE WHEN task_pass THEN 'passed' WHEN NOT task_pass THEN 'failed' ELSE 'not applicable' END AS outcome FROM outcomes")
def exp_task_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each world passes its task; not applicable where it has none."""
    passed = F.col("task_pass")
    return _task_outcomes(spark, folder).select("world", F.when(passed, "passed").when(~passed, "failed").otherwise("not applicable").alias("outcome"))


@query("exp_task_rate", WITH + WANTED_SQL + TASK_SQL + "SELECT count(*) AS worlds, count(task_pass) AS annotated, count(*) FILTER (task_pass) AS passed, round(avg(CAST(task_pass AS INTEGER)), 6) AS task_pass_rate FROM outcomes")
def exp_task_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of passed tasks, over annotated worlds only."""
    return _task_outcomes(spark, folder).agg(F.count(F.lit(1)).alias("worlds"), F.count("task_pass").alias("annotated"), F.count_if("task_pass").alias("passed"), F.round(F.avg(F.col("task_pass").cast("int")), 6).alias("task_pass_rate"))


@query("exp_scenario_mismatches", WITH + WANTED_SQL + ", each AS (SELECT w.world, w.kind, w.expected, count(o.id) AS actual FROM wanted w LEFT JOIN objects o ON w.world = o.world AND w.kind = o.kind GROUP BY 1, 2, 3 HAVING count(o.id) <> w.expected) SELECT world, '{' || string_agg('\"' || kind || '\":{\"expected\":' || expected || ',\"actual\":' || actual || '}', ',' ORDER BY kind) || '}' AS mismatches FROM each GROUP BY 1")
def exp_scenario_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Of each world that misses its counts, the types with the expected and the actual number, as JSON."""
    made = expect.mismatch_map(exp_object_count(spark, folder))
    return made.select("world", F.to_json("mismatches").alias("mismatches"))


@query("stat_failure_reasons", WITH + ISSUES_SQL + "SELECT code AS reason, count(DISTINCT world) AS samples FROM issues GROUP BY 1 UNION ALL SELECT 'interrupted', count(DISTINCT world) FROM objects WHERE world NOT IN (SELECT world FROM issues) AND world % 11 = 0 HAVING count(*) > 0")
def stat_failure_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by each distinct reason they failed for; a failed one without a code (here: every eleventh) was interrupted."""
    from tessera.sources import runs

    codes = local.with_issues(views.worlds(spark, folder)).select("world", F.col("issues.code").alias("codes"))
    status = F.when((F.size("codes") == 0) & (F.col("world") % 11 > 0), "success").when(F.size("codes") > 0, "invalid_spatial")
    reasons = codes.select(F.explode(runs.failure_reasons(status, F.col("codes"))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("samples"))


KNOWN_SQL = WITH + ", content AS (SELECT world, sha256(string_agg(kind || ':' || w || 'x' || h, ',' ORDER BY pos)) AS fingerprint FROM objects GROUP BY 1) SELECT world, fingerprint FROM content WHERE world % 4 > 0 AND fingerprint NOT IN (SELECT fingerprint FROM content WHERE world % 4 = 0)"


@query("known_excluded", KNOWN_SQL)
def known_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds whose content (here: types and sizes in their order) is none of the known ones (here: every fourth)."""
    text = F.array_join(F.transform("objects", lambda o: F.concat(o["kind"], F.lit(":"), o["r"] - o["x"], F.lit("x"), o["b"] - o["y"])), ",")
    content = views.worlds(spark, folder).where("objects IS NOT NULL").select("world", F.sha2(text, 256).alias("fingerprint"))
    return curate.admitted(content.where("world % 4 > 0"), content.where("world % 4 = 0"), "fingerprint").select("world", "fingerprint")


@query("exp_missing_edges", WITH + ISSUES_SQL + ", needed AS (SELECT DISTINCT world, relation_type, CASE WHEN relation_type = 'inside' THEN target ELSE least(source, target) END AS key_a, CASE WHEN relation_type = 'inside' THEN source ELSE greatest(source, target) END AS key_b FROM chain WHERE target IS NOT NULL) SELECT n.* FROM needed n WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.world = n.world AND k.relation_type = n.relation_type AND k.key_a = n.key_a AND k.key_b = n.key_b)")
def exp_missing_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Required edges (here: those between neighbours, the other way round) that no relation gives."""
    edges = views.relations(views.objects(spark, folder))
    needed = edges.where("pos < 100").select("world", "relation_type", F.col("target").alias("source"), F.col("source").alias("target"))
    return expect.missing_edges(edges, needed)


@query("exp_boundary_object", WITH + "SELECT o.world, o.id FROM objects o JOIN maps m ON o.world = m.world WHERE o.pos = 1 AND NOT (o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height)")
def exp_boundary_object(spark: SparkSession, folder: str) -> DataFrame:
    """Named objects (here: the first of each world) that should touch the border and don't."""
    return expect.off_border(views.objects(spark, folder).where("pos = 1"), views.maps(spark, folder)).select("world", "id")


SCORES_SQL = """, id_counts AS (SELECT world, id, count(*) AS n FROM objects GROUP BY 1, 2),
judged AS (SELECT e.*, source <> target AND NOT repeated AND s.n = 1 AND t.n = 1 AND CASE relation_type WHEN 'near' THEN tiles <= 3 WHEN 'inside' THEN held ELSE edge END AS good
  FROM edges e LEFT JOIN id_counts s ON e.world = s.world AND e.source = s.id LEFT JOIN id_counts t ON e.world = t.world AND e.target = t.id),
needed AS (SELECT DISTINCT c.world, relation_type AS kind, CASE WHEN relation_type = 'inside' THEN target ELSE least(source, target) END AS key_a, CASE WHEN relation_type = 'inside' THEN source ELSE greatest(source, target) END AS key_b FROM chain c WHERE target IS NOT NULL),
absent AS (SELECT world, kind, count(*) AS n FROM needed d WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.world = d.world AND k.relation_type = d.kind AND k.key_a = d.key_a AND k.key_b = d.key_b) GROUP BY 1, 2),
given AS (SELECT world, relation_type AS kind, count(*) AS predicted, count(*) FILTER (good) AS passed FROM judged GROUP BY 1, 2),
required AS (SELECT world, kind, count(*) AS n FROM needed GROUP BY 1, 2),
slots AS (SELECT w.world, w.kind, coalesce(g.passed, 0) AS passed, greatest(coalesce(g.predicted, 0) + coalesce(a.n, 0), w.minimum, coalesce(r.n, 0)) AS slots
  FROM wanted_relations w LEFT JOIN given g ON w.world = g.world AND w.kind = g.kind LEFT JOIN absent a ON w.world = a.world AND w.kind = a.kind LEFT JOIN required r ON w.world = r.world AND w.kind = r.kind)
"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    made = views.worlds(spark, folder)
    chain = F.filter("relations", lambda e: e["pos"] < 100)
    needed = F.transform(chain, lambda e: F.struct(e["relation_type"].alias("relation_type"), e["target"].alias("source"), e["source"].alias("target")))
    minimums = F.create_map(*[x for r in RELATION_TYPES for x in (F.lit(r), 1 + F.col("world") % 2)])
    # Worlds are those that have a map; without order lines they have no objects.
    worlds = views.maps(spark, folder).select("world").join(made, "world", "left")
    none = lambda c: F.coalesce(c, F.array().cast(made.schema[c].dataType))
    return local.slots(worlds.withColumns({"objects": none("objects"), "relations": none("relations")}).withColumns({"required": needed, "minimums": minimums}))


@query("score_slots", WITH + ISSUES_SQL + WANTED_SQL + SCORES_SQL + "SELECT * FROM slots")
def score_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Passed relations and slots by world and type."""
    return _scores(spark, folder)


@query("score_micro", WITH + ISSUES_SQL + WANTED_SQL + SCORES_SQL + "SELECT kind, sum(passed)::BIGINT AS passed, sum(slots)::BIGINT AS slots, round(sum(passed) / nullif(sum(slots), 0), 6) AS accuracy FROM slots GROUP BY 1")
def score_micro(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-averaged accuracy by type; null where there is no slot."""
    return score.micro(_scores(spark, folder))


@query("score_joined_micro", WITH + ISSUES_SQL + WANTED_SQL + SCORES_SQL + "SELECT kind, sum(passed)::BIGINT AS passed, sum(slots)::BIGINT AS slots, round(sum(passed) / nullif(sum(slots), 0), 6) AS accuracy FROM slots GROUP BY 1")
def score_joined_micro(spark: SparkSession, folder: str) -> DataFrame:
    """The same by joins over exploded tables."""
    things = views.objects(spark, folder)
    edges = views.relations(things)
    needed = edges.where("pos < 100").select("world", "relation_type", F.col("target").alias("source"), F.col("source").alias("target"))
    return score.micro(score.slots(things, edges, needed, _wanted(spark, folder)[1]))


@query("score_reasons", WITH + ISSUES_SQL + SCORES_SQL.replace("wanted_relations w", "(SELECT world, 'near' AS kind, 0 AS minimum FROM maps) w") + "SELECT relation_type, CASE WHEN repeated THEN 'duplicate_relation' WHEN source = target THEN 'self_relation' WHEN good IS NULL OR (SELECT count(*) FROM id_counts s WHERE s.world = j.world AND s.id IN (j.source, j.target) AND s.n = 1) < 2 THEN 'missing_or_ambiguous_reference' WHEN relation_type = 'near' THEN 'not_near' WHEN relation_type = 'inside' THEN 'not_inside' ELSE 'not_connected' END AS reason, count(*) AS edges FROM judged j WHERE good IS NOT TRUE GROUP BY 1, 2")
def score_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why relations don't pass, by type."""
    reasons = local.checks(views.worlds(spark, folder)).select(F.inline("checks")).where("reason IS NOT NULL")
    return reasons.groupBy(F.col("kind").alias("relation_type"), "reason").agg(F.count(F.lit(1)).alias("edges"))


@query("stat_object_distribution", WITH + ISSUES_SQL + FLAGS_SQL + ", kinds AS (SELECT unnest(['house','tree','river','road','bridge','monster','castle','ruin','rock','dune','tower','wall','library','portal','npc','crystal','courtyard','vehicle']) AS kind) SELECT k.kind, count(o.world) AS objects FROM kinds k LEFT JOIN (SELECT o.* FROM objects o JOIN flags f ON o.world = f.world WHERE f.valid) o ON k.kind = o.kind GROUP BY 1")
def stat_object_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Objects by type over valid worlds, all types, zero-filled."""
    valid = val_world_flags(spark, folder).where("valid").select("world")
    return stats.zero_filled(views.objects(spark, folder).join(valid, "world", "left_semi"), "kind", OBJECT_TYPES, "objects")


@query("stat_relation_distribution", WITH + "SELECT relation_type, count(*) AS relations, count(DISTINCT world) AS worlds FROM relations GROUP BY 1")
def stat_relation_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Relations by type, and worlds that have the type."""
    return views.relations(views.objects(spark, folder)).groupBy("relation_type").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("world").alias("worlds"))


@query("stat_footprints", WITH + "SELECT w || 'x' || h AS footprint, count(*) AS objects FROM objects GROUP BY 1")
def stat_footprints(spark: SparkSession, folder: str) -> DataFrame:
    """Objects by footprint."""
    return views.objects(spark, folder).groupBy(F.concat_ws("x", "w", "h").alias("footprint")).agg(F.count(F.lit(1)).alias("objects"))


@query("stat_maps", WITH + "SELECT width || 'x' || height AS size, biome, count(*) AS worlds FROM maps GROUP BY 1, 2")
def stat_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds by map size and biome."""
    return views.maps(spark, folder).groupBy(F.concat_ws("x", "width", "height").alias("size"), "biome").agg(F.count(F.lit(1)).alias("worlds"))


@query("stat_averages", WITH + "SELECT count(*) AS worlds, sum(n)::BIGINT AS objects, round(sum(n) / count(*), 6) AS objects_per_world, count(*) FILTER (border) AS at_border FROM (SELECT o.world, count(*) AS n, bool_or(o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height) AS border FROM objects o JOIN maps m ON o.world = m.world GROUP BY 1)")
def stat_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds, objects, objects a world, and worlds with an object at the border."""
    placed = views.objects(spark, folder).join(views.maps(spark, folder), "world")
    each = placed.groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.bool_or(touches_border(Box(), F.col("width"), F.col("height"))).alias("border"))
    return each.agg(F.count(F.lit(1)).alias("worlds"), F.sum("n").alias("objects"), F.round(F.try_divide(F.sum("n"), F.count(F.lit(1))), 6).alias("objects_per_world"), F.count_if("border").alias("at_border"))


@query("stat_object_counts", WITH + "SELECT world, kind, count(*) AS n FROM objects GROUP BY 1, 2")
def stat_object_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Objects by world and type."""
    return views.objects(spark, folder).groupBy("world", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("stat_relation_counts", WITH + "SELECT world, relation_type, count(*) AS n FROM relations GROUP BY 1, 2")
def stat_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Relations by world and type."""
    return views.relations(views.objects(spark, folder)).groupBy("world", "relation_type").agg(F.count(F.lit(1)).alias("n"))


@query("sort_painter", WITH + "SELECT world, id, pos, CAST(row_number() OVER (PARTITION BY world ORDER BY layer, w * h DESC, pos) AS INTEGER) AS place FROM objects")
def sort_painter(spark: SparkSession, folder: str) -> DataFrame:
    """The order of drawing: by layer, larger first, then as listed."""
    order = Window.partitionBy("world").orderBy("layer", F.desc(F.col("w") * F.col("h")), "pos")
    return views.objects(spark, folder).select("world", "id", "pos", F.row_number().over(order).alias("place"))


@query("win_type_numbers", WITH + "SELECT world, pos, kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY world, kind ORDER BY pos) AS VARCHAR), 3, '0') AS name FROM objects")
def win_type_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Names numbered within each type of a world."""
    number = F.row_number().over(Window.partitionBy("world", "kind").orderBy("pos"))
    return views.objects(spark, folder).select("world", "pos", F.concat_ws("_", "kind", F.lpad(number.cast("string"), 3, "0")).alias("name"))


@query("json_fingerprints", WITH + ", texts AS (SELECT world, sha256(string_agg(concat_ws('|', id, kind, x, y, w, h), ';' ORDER BY pos)) AS fingerprint FROM objects GROUP BY 1) SELECT fingerprint, count(*) AS worlds FROM texts GROUP BY 1")
def json_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Worlds by the digest of their content, names aside."""
    text = F.concat_ws("|", "id", "kind", "x", "y", "w", "h")
    each = views.objects(spark, folder).groupBy("world").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("o"))
    return each.select(F.sha2(F.array_join("o.t", ";"), 256).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("worlds"))


@query("variant_comparison", WITH + PAIRS_SQL + """, shifted AS (SELECT world, pos, x + pos % 2 AS x, y, r + pos % 2 AS r, b FROM objects),
rates AS (SELECT 'plain' AS variant, 'in_bounds' AS metric, avg(CAST(o.r <= m.width AND o.b <= m.height AS INTEGER)) AS v FROM objects o JOIN maps m ON o.world = m.world UNION ALL SELECT 'shifted', 'in_bounds', avg(CAST(o.r <= m.width AND o.b <= m.height AS INTEGER)) FROM shifted o JOIN maps m ON o.world = m.world
 UNION ALL SELECT 'plain', 'at_border', avg(CAST(o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height AS INTEGER)) FROM objects o JOIN maps m ON o.world = m.world UNION ALL SELECT 'shifted', 'at_border', avg(CAST(o.x = 0 OR o.y = 0 OR o.r = m.width OR o.b = m.height AS INTEGER)) FROM shifted o JOIN maps m ON o.world = m.world)
SELECT metric, round(max(v) FILTER (variant = 'plain'), 6) AS plain, round(max(v) FILTER (variant = 'shifted'), 6) AS shifted FROM rates GROUP BY 1""")
def variant_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of two variants side by side; the second has every other object one tile to the right."""
    placed = views.objects(spark, folder).join(views.maps(spark, folder), "world")
    moved = placed.withColumns({"x": F.col("x") + F.col("pos") % 2, "r": F.col("r") + F.col("pos") % 2})
    both = placed.withColumn("variant", F.lit("plain")).unionByName(moved.withColumn("variant", F.lit("shifted")))
    size = F.col("width"), F.col("height")
    return stats.compare_variants(both, "variant", ("plain", "shifted"), {"in_bounds": in_bounds(Box(), *size), "at_border": touches_border(Box(), *size)})


assert NEAR_TILES == 3  # the SQL above has the number in it
