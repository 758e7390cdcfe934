"""Generators: a balanced prompt inventory, placement tasks with a witness, and a bounded generate-validate-repair loop.

Every row has a seed of its own, derived from the run's seed and its number, so rows can be made anywhere, in any order,
and a longer inventory begins with the shorter one."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.domain import NEAR_TILES, RELATION_TYPES, THEME_BIOMES
from tessera.runtime import Stored, cut, store

MOST_PROMPTS = 100_000
SOLID = ("house", "tower", "wall", "library", "rock", "tree", "castle", "ruin")
#: Own wording of the inventory.
MOODS = ("quiet", "busy", "windswept", "sunken", "festive", "half-built", "overgrown", "orderly")
PLACES = ("mill", "harbour", "market", "quarry", "orchard", "observatory", "crossing", "workshop", "garden", "camp", "archive", "bathhouse")
FEATURES = ("a dry fountain", "a row of lamps", "an old well", "a fallen column", "two hedges", "a signal mast", "a covered walk", "a stack of barrels", "a broken cart", "a stone circle")


def _pick(names: tuple[str, ...], seed: int, part: str) -> Column:
    """One of the names by the digest of seed, part and row."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(part), "id"), 256), 1, 12), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(n) for n in names]), (h % len(names) + 1).cast("int"))


def _number(seed: int, part: str, below: int) -> Column:
    """A number below a limit by the digest of seed, part and row."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(part), "id"), 256), 1, 12), 16, 10).cast("long")
    return (h % below).cast("int")


def inventory(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """(id, theme, biome, prompt, expectations, descriptors): themes in turn, so that their numbers differ by one at most. The
    row's number is part of the prompt's name, so prompts are unique without a look at the others. The expectations are
    those the prompt states: a map, counts of two types and a minimum of one relation."""
    if isinstance(rows, bool) or not isinstance(rows, int) or not 1 <= rows <= MOST_PROMPTS:
        raise ValueError(f"between 1 and {MOST_PROMPTS} prompts can be made")
    themes = tuple(THEME_BIOMES)
    biomes = F.create_map(*[F.lit(x) for pair in THEME_BIOMES.items() for x in pair])
    made = spark.range(rows).withColumn("theme", F.element_at(F.array(*[F.lit(t) for t in themes]), (F.col("id") % len(themes) + 1).cast("int")))
    mood, first, second = _pick(MOODS, seed, "mood"), _pick(FEATURES, seed, "first"), _pick(FEATURES, seed, "second")
    width, height = _number(seed, "width", 3) * 8 + 24, _number(seed, "height", 3) * 4 + 20
    kind, other, relation = _pick(SOLID, seed, "kind"), _pick(("road", "river", "courtyard"), seed, "ground"), _pick(RELATION_TYPES, seed, "relation")
    n, m = _number(seed, "n", 4) + 1, _number(seed, "m", 2) + 1
    prompt = F.format_string(
        "Lay out %s no. %d, a %s place in the %s theme, with %s beside %s, on %d by %d tiles: %d of the type %s, %d of the type %s, and at least one relation %s.",
        _pick(PLACES, seed, "place"), F.col("id"), mood, F.col("theme"), first, second, width, height, n, kind, m, other, relation,
    )
    wants = F.struct(
        F.create_map(kind, n, other, m).alias("object_counts"), F.struct(width.alias("width"), height.alias("height"), biomes[F.col("theme")].alias("biome")).alias("map"),
        F.create_map(relation, F.lit(1)).alias("minimum_relations"),
    )
    name = F.concat_ws("_", "theme", F.lpad(F.col("id").cast("string"), 9, "0"), F.substring(F.sha2(prompt, 256), 1, 10))
    about = F.create_map(F.lit("mood"), mood, F.lit("first"), first, F.lit("second"), second)
    return made.select(name.alias("id"), "theme", biomes[F.col("theme")].alias("biome"), prompt.alias("prompt"), wants.alias("expectations"), about.alias("descriptors"))


@dataclass(frozen=True)
class Task:
    """What a task wants: objects with sizes, edges between them, one object at the border."""

    width: int
    height: int
    objects: tuple[tuple[str, str, int, int], ...]
    relations: tuple[tuple[str, str, str], ...]
    at_border: str

    def prompt(self) -> str:
        """The task in words."""
        things = ", ".join(f"{n} ({k}, {w} by {h})" for n, k, w, h in self.objects)
        edges = "; ".join(f"{s} {k} {t}" for k, s, t in self.relations)
        return f"On {self.width} by {self.height} tiles place {things}. Relations: {edges}. {self.at_border} touches the border."


#: Objects and edges by difficulty: one edge of the focus relation; two, the other of the next relation; a chain of three.
DIFFICULTIES = {"easy": (3, 1), "medium": (5, 2), "hard": (9, 3)}


def row_seed(*parts: object) -> int:
    """An integer from the digest of the parts."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def make_task(seed: int, relation: str, difficulty: str) -> Task:
    """A task of a focus relation and a difficulty, the same for the same seed. A hard one has a chain, in which the target of
    an edge is the source of the next; a medium one has two separate edges."""
    rng = random.Random(seed)
    n, edges = DIFFICULTIES[difficulty]
    objects = [(f"{kind}_{i:03d}", kind, rng.randint(1, 3), rng.randint(1, 3)) for i, kind in enumerate(rng.choice(SOLID) for _ in range(n))]
    focus = RELATION_TYPES.index(relation)
    kinds = [RELATION_TYPES[(focus + i) % len(RELATION_TYPES)] for i in range(edges)]
    ends = [(i, i + 1) for i in range(edges)] if difficulty == "hard" else [(2 * i, 2 * i + 1) for i in range(edges)]
    for kind, (i, j) in zip(kinds, ends):
        if kind == "inside":  # the second is large enough to hold the first
            objects[j] = (*objects[j][:2], objects[i][2] + 1, objects[i][3] + 1)
    wanted = tuple((kind, objects[i][0], objects[j][0]) for kind, (i, j) in zip(kinds, ends))
    return Task(rng.choice((24, 32, 40)), rng.choice((20, 24)), tuple(objects), wanted, objects[-1][0])


def _holds(kind: str, s: tuple[int, int, int, int], t: tuple[int, int, int, int]) -> bool:
    (ax, ay, ar, ab), (bx, by, br, bb) = s, t
    if kind == "near":
        return max(ax - br + 1, bx - ar + 1, ay - bb + 1, by - ab + 1, 0) <= NEAR_TILES
    if kind == "inside":
        return bx <= ax and by <= ay and ar <= br and ab <= bb and s != t
    return (ar == bx or br == ax) and max(ay, by) < min(ab, bb) or (ab == by or bb == ay) and max(ax, bx) < min(ar, br)


def place(task: Task, seed: int, visits: int = 20_000) -> dict[str, tuple[int, int]] | None:
    """Positions for all of a task's objects that meet it, by search with backtracking; None if so many visits don't find
    any. The related objects go first, as they are the hardest."""
    rng = random.Random(seed)
    bound = [name for _, s, t in task.relations for name in ((t, s) if _ == "inside" else (s, t))]
    order = sorted(task.objects, key=lambda o: (bound.index(o[0]) if o[0] in bound else len(bound), o[0] != task.at_border, -o[2] * o[3]))
    edges = {frozenset(e[1:]): e for e in task.relations}
    placed: dict[str, tuple[int, int, int, int]] = {}
    left = visits

    def fits(name: str, box: tuple[int, int, int, int]) -> bool:
        for other, b in placed.items():
            edge = edges.get(frozenset((name, other)))
            if edge:
                s, t = (box, b) if name == edge[1] else (b, box)
                if not _holds(edge[0], s, t):
                    return False
                if edge[0] == "inside":
                    continue
            if box[0] < b[2] and b[0] < box[2] and box[1] < b[3] and b[1] < box[3]:
                return False
        return name != task.at_border or box[0] == 0 or box[1] == 0 or box[2] == task.width or box[3] == task.height

    def search(i: int) -> bool:
        nonlocal left
        if i == len(order):
            return True
        name, _, w, h = order[i]
        spots = [(x, y) for x in range(task.width - w + 1) for y in range(task.height - h + 1)]
        rng.shuffle(spots)
        for x, y in spots:
            left -= 1
            if left < 0:
                return False
            box = (x, y, x + w, y + h)
            if fits(name, box):
                placed[name] = box
                if search(i + 1):
                    return True
                del placed[name]
        return False

    return {n: b[:2] for n, b in placed.items()} if search(0) else None


TASK_ROWS = "id string, relation string, difficulty string, objects int, relations int, at_border string, prompt string, required array<struct<id:string,kind:string,w:int,h:int>>, edges array<struct<relation_type:string,source:string,target:string>>, witness string"


def _tasks(seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, relation, difficulty in frame[["id", "relation", "difficulty"]].itertuples(index=False):
                own = row_seed("task", seed, i, relation, difficulty)
                task = make_task(own, relation, difficulty)
                spots = place(task, own)
                edges = [dict(zip(("relation_type", "source", "target"), e)) for e in task.relations]
                world = None
                if spots:
                    things = [{"object_type": k, "id": n, "position": list(spots[n]), "attributes": {"size": [w, h]}} for n, k, w, h in task.objects]
                    world = json.dumps({"scene": f"task_{i}", "map": {"width": task.width, "height": task.height}, "objects": things, "relations": edges})
                required = [dict(zip(("id", "kind", "w", "h"), o)) for o in task.objects]
                out.append((f"task_{i:06d}", relation, difficulty, len(task.objects), len(edges), task.at_border, task.prompt(), required, edges, world))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TASK_ROWS.replace("struct<id:string,kind:string,w:int,h:int>", "").replace("struct<relation_type:string,source:string,target:string>", "").split(", ")])

    return run


def tasks(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """TASK_ROWS: tasks over all relations and difficulties in turn, each with a world that meets it; the witness is null if the
    search found none."""
    levels = F.array(*[F.lit(d) for d in DIFFICULTIES])
    kinds = F.array(*[F.lit(r) for r in RELATION_TYPES])
    grid = spark.range(rows).select("id", F.get(kinds, (F.col("id") % 3).cast("int")).alias("relation"), F.get(levels, (F.floor(F.col("id") / 3) % 3).cast("int")).alias("difficulty"))
    return grid.mapInPandas(_tasks(seed), TASK_ROWS)


#: Parts of a hundred tasks of a benchmark by difficulty.
BENCHMARK_PARTS = {"easy": 30, "medium": 40, "hard": 30}


def benchmark(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """TASK_ROWS of a benchmark: of a hundred tasks 30 are easy, 40 medium and 30 hard, relations in turn within each. All have a
    witness, which shows that they can be met; it is not for export: see sinks.freeze_benchmark()."""
    if isinstance(rows, bool) or rows < 1 or rows % 10:
        raise ValueError("a benchmark has a multiple of ten tasks")
    place_ = F.col("id") % 10
    level = F.when(place_ < 3, "easy").when(place_ < 7, "medium").otherwise("hard")
    grid = spark.range(rows).select("id", F.get(F.array(*[F.lit(r) for r in RELATION_TYPES]), (F.col("id") % 3).cast("int")).alias("relation"), level.alias("difficulty"))
    made = cut(grid.mapInPandas(_tasks(seed), TASK_ROWS))
    if made.where("witness IS NULL").limit(1).count():
        raise ValueError("a task has no witness; choose another seed")
    return made


def curriculum(candidates: DataFrame, protected: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of candidates(seq, grp, fingerprint, valid): valid ones of no protected group(grp), of no known
    world (fingerprint), and with neither key of an accepted one before; the rejected ones have a reason."""
    marked = candidates.join(protected.select("grp").distinct().withColumn("_held", F.lit(True)), "grp", "left").join(known.select("fingerprint").distinct().withColumn("_known", F.lit(True)), "fingerprint", "left")
    reason = F.when(~F.coalesce("valid", F.lit(False)), "invalid").when(F.col("_held"), "protected_prompt").when(F.col("_known"), "known_world")
    marked = cut(marked.withColumn("reason", reason).drop("_held", "_known"))
    accepted = greedy_distinct(marked.where("reason IS NULL").drop("reason"), "seq", ("grp", "fingerprint"))
    again = marked.where("reason IS NULL").join(accepted.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("duplicate"))
    return accepted, marked.where("reason IS NOT NULL").unionByName(again)


def greedy_distinct(rows: DataFrame, order: str, keys: tuple[str, str]) -> DataFrame:
    """Rows accepted one by one in an order without ties, each unless one of its two keys was accepted before; null keys
    equal one another.

    Order decides, but not all of it: in each round the rows that come first for both of their keys are accepted, and those
    that share a key with an accepted one are rejected, until none is open. Each round settles the first open row of all at
    least, and whatever doesn't hang on it. No task sees more than one key's rows, reduced on the way."""
    a, b = keys
    open_ = store(rows.select(F.col(order).alias("o"), F.xxhash64(F.lit(1), a).alias("a"), F.xxhash64(F.lit(2), b).alias("b")), "open")
    taken: list[Stored] = []
    while open_.rows:
        firsts = [open_.df.groupBy(k).agg(F.min("o").alias(f"first_{k}")) for k in ("a", "b")]
        ranked = open_.df.join(firsts[0], "a").join(firsts[1], "b")
        taken.append(store(ranked.where("o = first_a AND o = first_b").select("o", "a", "b"), "taken"))
        new = taken[-1].df
        left = store(open_.df.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select("o", "a", "b"), "open")
        open_.drop()
        open_ = left
    if not taken:
        return rows
    accepted = reduce(DataFrame.unionByName, [t.df for t in taken]).select(F.col("o").alias(order))
    return rows.join(accepted, order, "left_semi")


def repair_rounds(cases: DataFrame, backend: Callable[[list[str], list[str | None]], list[str]], validate: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """(id, attempt, raw, passed): up to `attempts` rounds over cases(id, prompt). Each round asks the backend for all cases
    that haven't passed, with the feedback of the round before; validate(id, raw) gives (id, passed, feedback)."""
    if isinstance(attempts, bool) or not 1 <= attempts <= 5:
        raise ValueError("between 1 and 5 attempts are allowed")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["raw"] = backend(frame["prompt"].tolist(), [f if isinstance(f, str) else None for f in frame["feedback"]])
            yield frame[["id", "prompt", "raw"]]

    open_, done = cases.select("id", "prompt").withColumn("feedback", F.lit(None).cast("string")), None
    for number in range(1, attempts + 1):
        answered = cut(open_.mapInPandas(ask, "id string, prompt string, raw string"))
        judged = cut(answered.join(validate(answered.select("id", "raw")), "id"))
        rows = judged.select("id", F.lit(number).alias("attempt"), "raw", "passed")
        done = rows if done is None else done.unionByName(rows)
        open_ = judged.where(~F.coalesce("passed", F.lit(False))).select("id", "prompt", F.substring("feedback", 1, 6000).alias("feedback"))
    assert done is not None
    return done


