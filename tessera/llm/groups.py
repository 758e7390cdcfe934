"""Problem 1: splits that keep related records together.

Rows of a membership table are edges between an id and a digest. Minimum-edge contraction (Borůvka) turns them
into a spanning forest that is kept as a table; each tree is one set of related records. Roots are stratified by
size band and dealt systematically to the splits, so a set is never torn and the shares stay near the wish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Stored, join_unique, store

SPLITS = ("train", "val", "test")
SHARES = (0.8, 0.1, 0.1)
#: Edges that one task contracts by itself; more are contracted by all tasks, round by round, until so few are left.
ONE_TASK = 500_000
#: Sets of at least this share of all ids are dealt one by one, so there are few of them.
LARGE = 1e-3
#: Roots of one bucket of the distributed ranking; the running totals over buckets are the only thing one task sees.
BUCKET_ROOTS = 100_000


def split_name(column: Column) -> Column:
    """train, val or test in whatever case and spacing; `validation` is val; anything else is null."""
    plain = F.lower(F.regexp_replace(column, r"[^\p{L}]", ""))
    plain = F.when(plain == "validation", "val").otherwise(plain)
    return F.when(plain.isin(*SPLITS), plain)


def digest_name(column: Column) -> Column:
    """The 64 hex digits of a digest without prefix, case or spacing; other text is trimmed and lowered; blank is null."""
    low = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    digits = F.regexp_extract(low, "([0-9a-f]{64})", 1)
    return F.when(digits != "", digits).when(low != "", low)


@dataclass
class Forest:
    """labels(v, root): every vertex that has an edge. edges(a, b): the chosen spanning edges, one less in each tree than
    it has vertices. Both are tables in the shared folder."""

    labels: DataFrame
    edges: DataFrame


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each vertex, chosen edges) of edges between vertices 0, 1, … in order of weight, by minimum-edge contraction."""
    root = np.arange(max(a.max(initial=-1), b.max(initial=-1)) + 1)
    chosen = np.zeros(len(a), bool)
    left = np.arange(len(a))
    while len(left):
        x, y = root[a[left]], root[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        least = np.full(len(root), len(a))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        picked = np.flatnonzero(least < len(a))
        edge = least[picked]
        chosen[edge] = True
        # Each picks its least edge; of two that picked the same one the smaller is the root.
        p, q = root[a[edge]], root[b[edge]]
        other = np.where(p == picked, q, p)
        up = np.arange(len(root))
        up[picked] = other
        mutual = picked[(up[other] == picked) & (picked < other)]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return root, np.flatnonzero(chosen)


def _contract_rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """contract() of all edges of one task: a row (v, root) for each vertex, and (null, null, e) for each chosen edge."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": [], "e": []}), *frames], ignore_index=True).sort_values("e")
    code, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True).map(bytes))
    root, chosen = contract(code[: len(edges)], code[len(edges) :])
    names = np.asarray(names, object)
    # The least vertex of a tree gives it its name.
    least = pd.Series(names).groupby(root).min()
    yield pd.DataFrame({"v": names, "root": least.loc[root].to_numpy(object), "e": None}, dtype=object)
    yield pd.DataFrame({"v": None, "root": None, "e": edges["e"].to_numpy(object)[chosen]}, dtype=object)


def spanning_forest(edges: DataFrame) -> Forest:
    """Spanning forest of edges(a, b), both binary. Self loops and nulls carry nothing; repeated edges count once. An empty
    input gives an empty forest.

    Edges are ordered by 128 bits of a hash of theirs. Every round at least halves the number of trees that still have
    an edge; tables that a round has replaced are deleted."""
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    first = store(edges.select("a", "b", F.unhex(F.md5(F.concat("a", "b"))).alias("e")).distinct(), "edges")
    current, left = first, first.rows
    chosen: list[Stored] = []
    labels: Stored | None = None
    while left > ONE_TASK:
        e = current.df
        both = e.select(F.col("a").alias("v"), "e", F.col("b").alias("p")).unionByName(e.select(F.col("b").alias("v"), "e", F.col("a").alias("p")))
        picks = store(both.groupBy("v").agg(F.min(F.struct("e", "p")).alias("m")).select("v", F.col("m.e").alias("e"), F.col("m.p").alias("p")), "picks")
        # Two vertices that picked the same edge point at each other; the smaller one becomes the root.
        back = picks.df.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        joined = join_unique(picks.df.select("v", "p"), back, "p", picks.rows)
        tree = store(joined.select("v", F.when((F.col("pp") == F.col("v")) & (F.col("v") < F.col("p")), F.col("v")).otherwise(F.col("p")).alias("p")), "tree")
        while True:
            up = tree.df.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            step = store(join_unique(tree.df.select("v", "p"), up, "p", tree.rows).select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "tree")
            tree.drop()
            tree = step
            if not tree.df.where("moved").limit(1).count():
                break
        chosen.append(picks)
        labels = _relabelled(labels, tree.df.select("v", F.col("p").alias("root")))
        for end in ("a", "b"):
            e = join_unique(e, tree.df.select(F.col("v").alias(end), F.col("p").alias(f"n{end}")), end, left)
        e = e.where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "e")
        after = store(e.groupBy("a", "b").agg(F.min("e").alias("e")), "edges")
        tree.drop()
        if current is not first:
            current.drop()
        current, left = after, after.rows
    rest = store(current.df.coalesce(1).mapInPandas(_contract_rest, "v binary, root binary, e binary"), "rest")
    labels = _relabelled(labels, rest.df.where("v IS NOT NULL").select("v", "root"))
    picked = rest.df.where("e IS NOT NULL").select("e")
    for part in chosen:
        picked = picked.unionByName(part.df.select("e"))
    if chosen:
        forest = store(first.df.join(picked.distinct(), "e", "left_semi").select("a", "b"), "forest")
    else:
        forest = store(first.df.join(picked, "e", "left_semi").select("a", "b"), "forest")
    for part in (first, rest, *chosen, *([] if current is first else [current])):
        part.drop()
    return Forest(labels.df, forest.df)


def _relabelled(labels: Stored | None, tree: DataFrame) -> Stored:
    """Labels after a contraction, tree(v, root) being the new roots of old ones."""
    if labels is None:
        return store(tree, "labels")
    over = tree.select(F.col("v").alias("root"), F.col("root").alias("next"))
    made = store(join_unique(labels.df, over, "root", labels.rows, "left").select("v", F.coalesce("next", "root").alias("root")), "labels")
    labels.drop()
    return made


def _vertex(kind: str, name: Column) -> Column:
    """A vertex of the graph: 128 bits of the kind and the name. Shuffles carry 16 bytes, however long names are."""
    return F.unhex(F.md5(F.concat(F.lit(kind), name)))


def related_ids(members: DataFrame) -> DataFrame:
    """(id, root, splits): each id of members(id, prompt_group, split) once, the root of its set and the splits of its
    own rows as bits (1 train, 2 val, 4 test). Rows joined by an id or a digest, or a chain of them, share a root;
    an id without digest is its own root; a null id takes no part."""
    bits = F.when(F.col("s") == "train", 1).when(F.col("s") == "val", 2).when(F.col("s") == "test", 4).otherwise(0)
    rows = members.where(F.col("id").isNotNull()).select("id", digest_name(F.col("prompt_group")).alias("d"), split_name(F.col("split")).alias("s"))
    forest = spanning_forest(membership_edges(rows))
    own = rows.groupBy("id").agg(F.bit_or(bits).alias("splits")).withColumn("v", _vertex("i", F.col("id").cast("string")))
    return own.join(forest.labels, "v", "left").select("id", F.coalesce("root", "v").alias("root"), "splits")


def membership_edges(rows: DataFrame) -> DataFrame:
    """(a, b): the vertices of an id and a digest for each of rows(id, d) that has both."""
    return rows.where("id IS NOT NULL AND d IS NOT NULL").select(_vertex("i", F.col("id").cast("string")).alias("a"), _vertex("d", F.col("d")).alias("b"))


def forest_of(members: DataFrame) -> DataFrame:
    """(id, digest): the spanning forest of a membership table as pairs of its names; what holds related ids together.
    Each set of n ids and digests has n - 1 of them."""
    rows = members.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), digest_name(F.col("prompt_group")).alias("d")).where("d IS NOT NULL").distinct()
    named = rows.withColumn("a", _vertex("i", F.col("id"))).withColumn("b", _vertex("d", F.col("d")))
    return named.join(spanning_forest(named.select("a", "b")).edges, ["a", "b"], "left_semi").select("id", F.col("d").alias("digest"))


def torn_ids(members: DataFrame) -> DataFrame:
    """(id): every id whose set of related rows holds more than one of train, val and test."""
    ids = store(related_ids(members), "ids")
    torn = ids.df.groupBy("root").agg(F.bit_or("splits").alias("all")).where(F.bit_count("all") > 1).select("root")
    return join_unique(ids.df, torn, "root", ids.rows).select("id")


def _deal_large(sizes: list[tuple[bytes, int]], total: int, shares: tuple[float, ...]) -> tuple[dict[bytes, int], list[float]]:
    """The split of each large set, the largest first to where most is lacking; and the shares that are left for the rest."""
    room = [total * s for s in shares]
    given = {}
    for root, n in sorted(sizes, key=lambda r: (-r[1], r[0])):
        best = max(range(len(room)), key=room.__getitem__)
        given[root] = best
        room[best] -= n
    room = [max(0.0, r) for r in room]
    return given, [r / sum(room) for r in room] if sum(room) else [float(s) for s in shares]


def deal(ids: DataFrame, shares: tuple[float, ...] = SHARES, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """(id, split): one split for each id of (id, root), with the given shares of all ids.

    Sets of at least LARGE of all ids, a thousand at most, are dealt one by one, the largest first, to the split that lacks
    most. All other roots are ordered by size band (powers of two) and within a band by a hash, and dealt by their place in
    the band: the place times the golden ratio, less its whole part, falls into the share of a split, which keeps
    every stretch of places near the shares. Ranking is done by buckets: one task sees only totals."""
    ids = store(ids.select("id", "root"), "ids")
    sizes = store(ids.df.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = ids.rows
    least = max(2, total * LARGE)
    large, left = _deal_large([(bytes(r.root), r.n) for r in sizes.df.where(F.col("n") >= least).collect()], total, shares)
    buckets = max(1, sizes.rows // BUCKET_ROOTS)
    small = sizes.df.where(F.col("n") < least)
    banded = small.withColumn("band", -F.floor(F.log2("n")).cast("int")).withColumn("h", F.xxhash64("root")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    before = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("roots"))
    before = before.withColumn("before", F.sum("roots").over(Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("roots")).drop("roots")
    place = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "root")) - 1 + F.col("before")
    at = F.pmod(place * F.lit((5**0.5 - 1) / 2), F.lit(1.0))
    split = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(at < sum(left[: i + 1]), names[i]).otherwise(split)
    dealt = banded.join(before, ["band", "bucket"]).select("root", split.alias("split"))
    if large:
        given = ids.df.sparkSession.createDataFrame([(r, names[i]) for r, i in large.items()], "root binary, split string")
        dealt = dealt.unionByName(given)
    return join_unique(ids.df, dealt, "root", total).select("id", "split")
