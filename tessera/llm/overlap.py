"""Problem 7: same or near-same records across splits.

Evaluation texts (those listed in val or test) are indexed in shards by a compressed full-text index; each shard is
built once and written to the shared folder. The training texts are streamed past all shards, where they lie, by
backward search. Equal texts are one class from the start, so copies are neither indexed nor searched twice.

A training text is cut into pieces, each a match of the index. Two texts that differ in at most n words have one of any
n + 1 pieces in common, as a change spoils one piece at most: so the n + 1 pieces with the fewest places are taken, and
all places of each are candidates, however many there are. Pieces that stand nowhere have none. Of a candidate the words
that are changed, added or dropped are counted, segments in any order; where that is too many, the spans that both share in
any order are merged and what they leave is counted, as a lost sentence end may hide that a sentence has moved. The pair is
near if at most a given share of its words is left.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.dedup import keyed
from tessera.llm.fmindex import FMIndex, pieces
from tessera.llm.groups import split_name
from tessera.llm.tiling import tiles
from tessera.runtime import cut, drop_folder, join_unique, new_folder, read_folder

#: Largest share of changed, added or dropped words: near copies have up to one in eight, other pairs one in five.
MOST_CHANGED = 0.16
#: Words of a span that may stand anywhere.
LEAST_SPAN = 4
#: Symbols of a shard's texts, about; its index is built in one task. Characters of a block of training texts.
SHARD_SYMBOLS = 4_000_000
BLOCK_CHARS = 16_000_000
#: Places at which a piece ends at first; doubled for the texts that give too few pieces.
FIRST_PLACES = 128
SKETCH = 256
#: Places that are unfolded at once; more take more steps.
HELD = 1_000_000
#: Ids of one class that are held in one row while pairs are written out.
TOGETHER = 1_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edits(a: list, b: list) -> int:
    """Least number of words changed, added or dropped from a to b, by bit vectors over a."""
    if not a or not b:
        return len(a) or len(b)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    look = at.get
    for w in b:
        same = look(w, 0)
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus, vertical = plus << 1 | 1, minus << 1, same | down
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return score


def changed(x: list[list], y: list[list]) -> int:
    """Words to change, add or drop between two texts given as segments: those of the texts as they stand, or those of
    segments brought together in any order, whichever is less. Equal segments are one another's, then those with the
    most words in common."""
    whole = edits([w for s in x for w in s], [w for s in y for w in s])
    if not whole or len(x) == 1 == len(y):
        return whole
    free = Counter(map(tuple, y))
    rest = []
    for s in map(tuple, x):
        if free[s]:
            free[s] -= 1
        else:
            rest.append(s)
    others = [list(s) for s in free.elements()]
    bags = list(map(Counter, others))
    total = 0
    for s in rest:
        mine = Counter(s)
        common = [sum((mine & bag).values()) for bag in bags]
        best = max(range(len(bags)), key=common.__getitem__, default=-1)
        if best < 0 or not common[best]:
            total += len(s)
            continue
        total += edits(list(s), others.pop(best))
        bags.pop(best)
    return min(whole, total + sum(map(len, others)))


def moved(x: list[list], y: list[list]) -> int:
    """Words outside of the spans that two texts share, whatever the order of the spans: sentences may have moved although a
    sentence end was lost on one side. Spans are tiles of at least LEAST_SPAN words; shorter ones count as changed."""
    a, b = ([w for s in text for w in s] for text in (x, y))
    return max(len(a), len(b)) - sum(n for _, _, n in tiles(a, b, LEAST_SPAN))


def changed_words(a: str, b: str) -> int:
    """changed() of two texts with a segment on each line."""
    return changed([s.split() for s in a.split("\n")], [s.split() for s in b.split("\n")])


def most_changed(size: np.ndarray, share: float) -> np.ndarray:
    """Words that may differ when the larger text has so many."""
    return np.floor(share * size + 1e-9).astype(np.int64)


def _sketches(symbols: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Bags of symbols as parity bits: one changed word flips at most two."""
    bit = (symbols.astype(np.uint64) * _ODD) >> np.uint64(56)
    table = np.zeros((count, SKETCH // 64), np.uint64)
    np.bitwise_xor.at(table, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return table


@dataclass
class Shard:
    """The evaluation texts of one shard: their keys, words by number, segments (lengths, 0 behind each text), index."""

    keys: list[str]
    words: list[str]
    parts: np.ndarray
    index: FMIndex

    @classmethod
    def build(cls, keys: pd.Series, texts: pd.Series) -> Shard:
        known: dict[str, int] = {}
        flat: list[int] = []
        parts: list[int] = []
        offsets = [0]
        for text in texts:
            for line in text.split("\n"):
                found = line.split()
                flat.extend(known.setdefault(w, len(known) + 1) for w in found)
                parts.append(len(found))
            parts.append(0)
            offsets.append(len(flat))
        return cls(list(keys), list(known), np.array(parts, np.int64), FMIndex(np.array(flat, np.int64), np.array(offsets, np.int64)))

    def row(self) -> dict:
        """As one row of a table."""
        return {"keys": "\n".join(self.keys), "words": "\n".join(self.words), "parts": self.parts.astype("<u4").tobytes(), "index": self.index.to_bytes()}

    @classmethod
    def of_row(cls, row: dict) -> Shard:
        return cls(row["keys"].split("\n"), row["words"].split("\n"), np.frombuffer(row["parts"], "<u4").astype(np.int64), FMIndex.from_bytes(row["index"]))

    def __post_init__(self) -> None:
        index, count = self.index, len(self.keys)
        self.known = {w: i + 1 for i, w in enumerate(self.words)}
        self.ends = np.append(index.starts[1:], index.n - 1) - 1
        self.sizes = self.ends - index.starts
        owner = np.searchsorted(index.starts, np.arange(index.n), side="right") - 1
        own = index.sequence > 0
        self.sketches = _sketches(index.sequence[own], owner[own], count)
        self.breaks = np.append(-1, np.flatnonzero(self.parts == 0))

    def segments(self, number: int) -> list[list[int]]:
        """The symbols of a text by segments."""
        at, out = int(self.index.starts[number]), []
        for n in self.parts[self.breaks[number] + 1 : self.breaks[number + 1]].tolist():
            out.append(self.index.sequence[at : at + n].tolist())
            at += n
        return out


@dataclass
class Block:
    """Training texts: distinct segments as word lists, and the segments of each text."""

    lines: list[list[str]]
    texts: list[list[int]]

    @classmethod
    def of(cls, texts: pd.Series) -> Block:
        known: dict[str, int] = {}
        numbers = [[known.setdefault(s, len(known)) for s in text.split("\n")] for text in texts]
        return cls([s.split() for s in known], numbers)


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, … count[i] times for each i."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def candidates(shard: Shard, block: Block, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, low, high): for each training text the rows of the index of so many of its pieces that each near text has
    one of them in common with it."""
    index = shard.index
    look = shard.known.get
    symbols = [[look(w, -1) for w in s] for s in block.lines]
    flat, line_offsets = np.array([w for s in symbols for w in s], np.int64), np.cumsum([0] + [len(s) for s in symbols])
    text = np.repeat(np.arange(len(block.texts)), [len(x) for x in block.texts])
    line = np.array([n for x in block.texts for n in x], np.int64)
    sizes = np.bincount(text, weights=np.diff(line_offsets)[line], minlength=len(block.texts)).astype(np.int64)
    needed = most_changed(sizes / (1 - share), share) + 1
    places = FIRST_PLACES
    while len(text):
        used, mine = np.unique(line, return_inverse=True)
        lengths = line_offsets[used + 1] - line_offsets[used]
        at, low, high = pieces(index, flat[_spread(line_offsets[used], lengths)], np.concatenate(([0], np.cumsum(lengths))), places)
        order = np.argsort(at, kind="stable")
        low, high = low[order], high[order]
        counts = np.bincount(at, minlength=len(used))
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        rows = _spread(begin[mine], counts[mine])
        owner, width = np.repeat(text, counts[mine]), (high - low)[rows]
        order = np.lexsort((width, owner))
        owner, width, rows = owner[order], width[order], rows[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        few = np.bincount(owner[width <= places], minlength=len(sizes)) >= needed
        if places >= index.n:
            few[:] = True
        take = few[owner] & (rank < needed[owner]) & (width > 0)
        yield owner[take], low[rows[take]], high[rows[take]]
        stay = ~few[text]
        text, line = text[stay], line[stay]
        places *= 2


def search(shard: Shard, block: Block, share: float) -> Iterator[tuple[int, int, int]]:
    """(training text, evaluation text, changed words) of all near pairs."""
    owner = np.repeat(np.arange(len(block.lines)), [len(s) for s in block.lines])
    symbols = np.array([shard.known.get(w) or (hash(w) & 0x7FFFFFFF) for s in block.lines for w in s], np.int64)
    by_line = _sketches(symbols, owner, len(block.lines))
    sketches, sizes = np.zeros((len(block.texts), SKETCH // 64), np.uint64), np.zeros(len(block.texts), np.int64)
    for i, numbers in enumerate(block.texts):
        sketches[i] = np.bitwise_xor.reduce(by_line[numbers], axis=0)
        sizes[i] = sum(len(block.lines[n]) for n in numbers)
    look = shard.known.get
    bound = 2 * most_changed(sizes / (1 - share), share)
    for t, low, high in candidates(shard, block, share):
        part = np.cumsum(high - low) // HELD
        ends = np.flatnonzero(np.diff(part, append=-1)) + 1
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
            count = (high - low)[a:b]
            x, y = np.repeat(t[a:b], count), shard.index.text_of(_spread(low[a:b], count)).astype(np.int64)
            # What the training text allows at most is tried first, it is one number for all its candidates.
            near = np.bitwise_count(sketches[x, 0] ^ shard.sketches[y, 0]) <= bound[x]
            x, y = x[near], y[near]
            most = most_changed(np.maximum(sizes[x], shard.sizes[y]), share)
            near = np.abs(sizes[x] - shard.sizes[y]) <= most
            x, y, most = x[near], y[near], most[near]
            flips = np.zeros(len(x), np.int64)
            for k in range(SKETCH // 64):
                flips += np.bitwise_count(sketches[x, k] ^ shard.sketches[y, k])
                near = flips <= 2 * most
                x, y, most, flips = x[near], y[near], most[near], flips[near]
            pairs, first = np.unique(x * len(shard.keys) + y, return_index=True)
            last, mine = -1, []
            for i, j, n in zip((pairs // len(shard.keys)).tolist(), (pairs % len(shard.keys)).tolist(), most[first].tolist()):
                if i != last:
                    last, mine = i, [[look(w, -1) for w in block.lines[s]] for s in block.texts[i]]
                theirs = shard.segments(j)
                differing = changed(mine, theirs)
                if differing > n:
                    differing = moved(mine, theirs)
                if differing <= n:
                    yield i, j, differing


@lru_cache(maxsize=2)
def _load(folder: str, shard: int) -> Shard:
    return Shard.of_row(read_folder(f"{folder}/shard={shard}")[0])


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"shard": int(frame["shard"].iloc[0])} | Shard.build(frame["k"], frame["segs"]).row()])


LINKS = "key_t string, key_e string, changed int"


def _stream(folder: str, shards: list[int], share: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def flush(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = pd.concat([f["k"] for f in frames]).to_numpy()
        block = Block.of(pd.concat([f["segs"] for f in frames]))
        for number in shards:
            shard = _load(folder, number)
            # A pair may come once for each part of its candidates.
            found = {(i, j): n for i, j, n in search(shard, block, share)}
            yield pd.DataFrame([(keys[i], shard.keys[j], n) for (i, j), n in found.items()], columns=["key_t", "key_e", "changed"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        chars = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            chars += int(frame["segs"].str.len().sum())
            if chars >= BLOCK_CHARS:
                yield from flush(held)
                held, chars = [], 0
        if held:
            yield from flush(held)

    return run


def near_texts(held: DataFrame, train: DataFrame, share: float = MOST_CHANGED) -> DataFrame:
    """(key_t, key_e, changed): all near pairs of the distinct texts of two frames of (k, segs), without the equal ones."""
    spark = held.sparkSession
    size = F.size(F.split("segs", r"\s+"))
    symbols = held.agg(F.sum(size)).first()[0] or 0
    if not symbols:
        return spark.createDataFrame([], LINKS)
    shards = math.ceil(symbols / SHARD_SYMBOLS)
    folder = new_folder(spark, "index")
    placed = held.select("k", "segs", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"))
    built = placed.groupBy("shard").applyInPandas(_build, "shard int, keys string, words string, parts binary, index binary")
    built.write.partitionBy("shard").parquet(folder)
    numbers = sorted(r[0] for r in placed.select("shard").distinct().collect())
    links = cut(train.select("k", "segs").mapInPandas(_stream(folder, numbers, share), LINKS).where("key_t <> key_e"))
    drop_folder(spark, folder)
    return links


def classes_of(prompts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): texts(id, k, train, held) are the listed ids with the class of their text; classes(k, segs,
    trains, helds) the distinct texts with the numbers of ids in train and in val or test."""
    listed = members.where("id IS NOT NULL").groupBy("id").agg(
        F.max(split_name(F.col("split")) == "train").alias("train"), F.max(split_name(F.col("split")).isin("val", "test")).alias("held")
    ).where("train OR held").select("id", F.coalesce("train", F.lit(False)).alias("train"), F.coalesce("held", F.lit(False)).alias("held"))
    texts = keyed(prompts, "id", "prompt").groupBy("id", "key", "proof").agg(F.min("segs").alias("segs"))
    texts = cut(texts.select("id", F.concat("key", F.hex("proof")).alias("k"), "segs").join(listed, "id"))
    classes = texts.groupBy("k").agg(F.min("segs").alias("segs"), F.count_if("train").alias("trains"), F.count_if("held").alias("helds"))
    # Search is dear for its bytes: it is spread over all cores however small the table is.
    return texts.drop("segs"), cut(classes.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, "k"))


def linked_classes(classes: DataFrame, share: float = MOST_CHANGED) -> DataFrame:
    """(key_t, key_e, changed): links between the classes of training and of held-out texts; equal texts are one class
    and linked to themselves."""
    near = near_texts(classes.where("helds > 0"), classes.where("trains > 0"), share)
    same = classes.where("helds > 0 AND trains > 0").select(F.col("k").alias("key_t"), F.col("k").alias("key_e"), F.lit(0).alias("changed"))
    return near.unionByName(same)


def _together(texts: DataFrame, classes: DataFrame, flag: str, name: str) -> DataFrame:
    """(k, part, ids): the ids of each class that have the flag, in rows of about TOGETHER."""
    counts = classes.select("k", _parts(F.col(f"{flag}s")).alias("parts"))
    placed = join_unique(texts.where(flag).select("id", "k"), counts, "k", texts.count())
    placed = placed.select("id", "k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return placed.groupBy("k", "part").agg(F.collect_set("id").alias(name))


def _parts(count: Column) -> Column:
    return F.ceil(count / TOGETHER).cast("int")


def cross_split(prompts: DataFrame, members: DataFrame, share: float = MOST_CHANGED) -> DataFrame:
    """(id_a, id_b, same, id_train, id_eval): each pair of different ids of which one is listed in train and the other in
    val or test and whose texts are the same (same = true) or near. id_a is the smaller id as a string. An id listed
    in several splits counts in each. Ids without text, listing or known split, and null ids, have no pairs.

    Pairs are written out last: a link of two classes is parted into blocks of ids, so no task holds a whole class."""
    texts, classes = classes_of(prompts, members)
    links = linked_classes(classes, share)
    for key, flag in (("key_t", "train"), ("key_e", "held")):
        links = links.join(classes.select(F.col("k").alias(key), _parts(F.col(f"{flag}s")).alias("n")), key)
        links = links.withColumn(f"part_{flag}", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    for key, flag in (("key_t", "train"), ("key_e", "held")):
        side = _together(texts, classes, flag, f"ids_{flag}").withColumnRenamed("k", key).withColumnRenamed("part", f"part_{flag}")
        links = links.join(side, [key, f"part_{flag}"])
    pairs = links.select((F.col("key_t") == F.col("key_e")).alias("same"), F.explode("ids_train").alias("id_train"), "ids_held")
    pairs = pairs.select("same", "id_train", F.explode("ids_held").alias("id_eval")).where("id_train <> id_eval")
    return pairs.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b"), "same", "id_train", "id_eval")


def links_of_ids(prompts: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, same, near): one row for each held-out id and text with its class and the number of training ids that
    have the same text and a near one. Nothing is written out by pairs."""
    texts, classes = classes_of(prompts, members)
    trains = classes.select(F.col("k").alias("key_t"), F.col("trains").alias("n"))
    counted = linked_classes(classes).where("key_t <> key_e").join(trains, "key_t").groupBy(F.col("key_e").alias("k")).agg(F.sum("n").alias("near"))
    about = classes.select("k", "trains").join(counted, "k", "left")
    found = join_unique(texts.where("held"), about, "k", texts.count())
    return found.select("id", F.col("k").alias("class"), (F.col("trains") - F.col("train").cast("int")).alias("same"), F.coalesce("near", F.lit(0)).alias("near"))


def report(prompts: DataFrame, members: DataFrame) -> DataFrame:
    """(split, source, same, pairs, ids): overlaps of val and test with train by split and source of the held-out id.
    An id listed in both val and test counts in each; a null source is its own group. Counted by class, without pairs."""
    linked = links_of_ids(prompts, members)
    listed = members.select("id", split_name(F.col("split")).alias("split")).where("split IN ('val', 'test')").distinct()
    source = prompts.groupBy("id").agg(F.min("source").alias("source"))
    kinds = F.array(F.struct(F.lit(True).alias("same"), F.col("same").alias("n")), F.struct(F.lit(False).alias("same"), F.col("near").alias("n")))
    each = linked.select("id", F.inline(kinds)).where("n > 0").join(listed, "id").join(source, "id", "left")
    return each.groupBy("split", "source", "same").agg(F.sum("n").alias("pairs"), F.count_distinct("id").alias("ids"))
