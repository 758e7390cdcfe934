"""Problem 6: splitting oversized items at natural boundaries.

A text over its limit is cut by dynamic programming over boundary positions: the cuts chosen have the least sum of cut
penalties and of deviations from an even size, no piece is over the limit, and each piece begins exactly the wanted
overlap before the end of the one before it. One token stands for four characters, rounded up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_CHARS = 4
#: Kinds of boundary, best first, with the cost of a cut there. A cut inside a word costs PLAIN_CUT.
BOUNDARIES = (
    (re.compile(r"(?:\r?\n[^\S\n]*){2,}"), 0.0),
    (re.compile(r"\r?\n"), 0.3),
    (re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+|[。！？]"), 0.5),
    (re.compile(r"\},\s*|\],\s*"), 0.8),
    (re.compile(r"[,;:]\s+|[，；、]"), 2.0),
    (re.compile(r"\s+"), 4.0),
)
PLAIN_CUT = 16.0
#: Boundaries that cost as much are offered only where no cheaper one lies within a sixteenth of the step on both sides.
DEAR = 2.0
#: Weight of a piece's squared deviation from the even size, as a share of the limit.
IMBALANCE = 1.0
#: Positions inside unbroken runs are offered at this many for each step, the limit less the overlap.
PLAIN_PER_STEP = 16


def tokens(length: int) -> int:
    """Tokens of so many characters."""
    return -(-length // TOKEN_CHARS)


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end (0 < position < length), ascending, and the cost of each. `step` is how far a piece
    can go beyond its overlap. Where no boundary lies within a sixteenth of it, plain positions fill the gap, so that every
    limit can be met."""
    n = len(text)
    cost = np.full(n + 1, np.inf)
    for pattern, price in reversed(BOUNDARIES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        cost[ends] = price
    cost[0] = cost[n] = np.inf
    known = np.flatnonzero(np.isfinite(cost))
    stride = max(1, step // PLAIN_PER_STEP)
    edges = np.concatenate(([0], known, [n]))
    gaps = np.flatnonzero(np.diff(edges) > stride)
    plain = [np.arange(edges[g] + stride, edges[g + 1], stride) for g in gaps]
    if plain:
        cost[np.concatenate(plain)] = PLAIN_CUT
    places = np.flatnonzero(np.isfinite(cost))
    costs = cost[places]
    # A dear boundary with a much cheaper one close by on either side never makes a better cut.
    if 2 * stride > step:
        return places, costs
    good = np.concatenate(([-n - step], places[costs < DEAR], [2 * n + step]))
    right = np.searchsorted(good, places)
    keep = (costs < DEAR) | (good[right] - places > stride) | (places - good[right - 1] > stride)
    return places[keep], costs[keep]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in characters, for a limit and an overlap in characters.
    The overlap is made smaller than the limit if it isn't, and a text within the limit is one piece."""
    n = len(text)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)]
    places, costs = boundaries(text, limit - overlap)
    ends = np.concatenate((places, [n]))
    prices = np.concatenate((costs, [0.0]))
    count = -(-(n - overlap) // (limit - overlap))
    even = (n - overlap) / count + overlap
    best = np.full(len(ends), np.inf)
    origin = np.full(len(ends), -1, np.int64)
    # A piece that ends at ends[j] begins at 0 or at ends[i] - overlap for an i before it, and moves on from it.
    first = np.searchsorted(ends, ends + overlap - limit, side="left")
    for j, end in enumerate(ends):
        if end <= limit:
            best[j] = IMBALANCE * ((end - even) / limit) ** 2 + prices[j]
        low = first[j]
        if low < j:
            sizes = end - ends[low:j] + overlap
            totals = best[low:j] + IMBALANCE * ((sizes - even) / limit) ** 2
            totals[ends[low:j] <= overlap] = np.inf
            k = int(np.argmin(totals))
            if totals[k] + prices[j] < best[j]:
                best[j], origin[j] = totals[k] + prices[j], low + k
    out, j = [], len(ends) - 1
    while j >= 0:
        i = origin[j]
        out.append((int(ends[i]) - overlap if i >= 0 else 0, int(ends[j])))
        j = i
    return out[::-1]


SCHEMA = "piece int, pieces int, start long, stop long, tokens int, content string"


def _cut(key: str) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text, limit, overlap in zip(frame[key], frame["_text"], frame["_limit"], frame["_overlap"]):
                spans = cut_points(text, int(limit) * TOKEN_CHARS, int(overlap) * TOKEN_CHARS)
                out += [(name, k, len(spans), a, b, tokens(b - a), text[a:b]) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=[key, *(c.split()[0] for c in SCHEMA.split(", "))])

    return run


def oversized(messages: DataFrame, settings: DataFrame, key: str = "message_key", text: str = "content") -> DataFrame:
    """(key, _text, _limit, _overlap): each message once whose text has more tokens than its profile allows. A null
    profile means the default one; null texts, unknown profiles and profiles without a limit have no piece."""
    allowed = settings.groupBy("profile").agg(F.max("max_seq_length").alias("_limit"), F.max(F.coalesce("overlap_tokens", F.lit(0))).alias("_overlap"), F.max(F.coalesce("is_default", F.lit(False))).alias("_default"))
    # The default profile stands a second time under the name of null; a join on a null-safe key needs no second pass.
    unnamed = allowed.where("_default").orderBy("profile").limit(1).withColumn("profile", F.lit(None).cast("string"))
    named = allowed.where("profile IS NOT NULL").unionByName(unnamed).drop("_default").withColumnRenamed("profile", "_profile")
    rows = messages.select(F.col(key), F.col(text).alias("_text"), F.col("profile").alias("_named"))
    rows = rows.where(F.col(key).isNotNull() & F.col("_text").isNotNull())
    big = rows.join(named, F.col("_named").eqNullSafe(F.col("_profile"))).where(F.ceil(F.char_length("_text") / TOKEN_CHARS) > F.col("_limit"))
    return big.select(key, "_text", "_limit", "_overlap").dropDuplicates([key])


def split_items(messages: DataFrame, settings: DataFrame, key: str = "message_key", text: str = "content") -> DataFrame:
    """(key, piece, pieces, start, stop, tokens, content): the pieces of every oversized message in order. Consecutive
    pieces share exactly the profile's overlap; the first begins at 0, the last stops at the end, and no piece is over
    the limit. Messages within the limit have no row; a message delivered twice is cut once."""
    big = oversized(messages, settings, key, text)
    kind = messages.schema[key].dataType.simpleString()
    return big.mapInPandas(_cut(key), f"{key} {kind}, {SCHEMA}")
