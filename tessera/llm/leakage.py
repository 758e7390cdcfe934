"""Problem 9: evaluation texts leaking into training text.

The evaluation items are made ready once, in blocks of bounded size that are written to the shared folder; the corpus is
read once and streamed past all blocks where it lies, so neither items nor documents pass the driver or a shuffle. Shared
seeds of running words are looked up for a batch of documents at once; pairs whose seeds lie close together are compared by
greedy string tiling. Tiles that follow one another in both texts, with no more than a share of changed words between
them, form a passage; the long tiles of an item, wherever they stand, form its coverage. An item leaks if one passage
is long enough, or if most of it is covered by long tiles, as when its parts were reordered.

House sentences (found in more than a few items) are taken out of the items and the documents before, so they neither
count nor interrupt a passage.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.canon import SENTENCE_END, plain, words
from tessera.llm.tiling import tiles
from tessera.runtime import cut, drop_folder, new_folder, read_folder

#: A passage has at least so many running words of the item.
LEAST_WORDS = 18
#: Share of a passage's words that may be changed, added or dropped: about one in ten. Sentences made from one template
#: differ in one word in nine and more.
MOST_CHANGED = 0.09
#: Words of a seed, seeds that make a candidate and the words of the document they must lie in, least words of a tile.
#: A passage of LEAST_WORDS has 16 seeds; each of the changed words it may have takes three at most.
SEED, LEAST_SEEDS, SEED_WINDOW, LEAST_TILE = 3, 6, 24, 2
#: An item also leaks if tiles of at least so many words cover this share of its words, and LEAST_WORDS, in any order.
COVERING_TILE, LEAST_COVERAGE = 8, 0.8
#: A sentence in more items than this is a house sentence.
HOUSE_ITEMS = 3
#: Most characters of evaluation text or of house sentences in one block, about; more make more blocks.
BLOCK_CHARS = 4_000_000
#: Documents that are compared at once.
BATCH = 2_000

_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9a-fA-F]{2})|\\+[nrtbfv]|\\+(?=[\"'/\\])|=\r?\n")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    return chr(int(code, 16)) if code else " "


def text_words(text: str | None) -> list[str]:
    """Words of a text, whatever its escaping, markup and quoting."""
    if not text:
        return []
    if "\\" in text or "%" in text or "=" in text:
        text = _ESCAPES.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    return words(plain(text))


def sentences_of(text: str | None) -> set[str]:
    """The sentences of a text as words parted by a space."""
    return {" ".join(w) for s in SENTENCE_END.split(text) if (w := text_words(s))} if text else set()


def by_first_word(house: Iterable[str]) -> dict[str, list[list[str]]]:
    """House sentences by their first word, the longest first."""
    out: dict[str, list[list[str]]] = {}
    for sentence in sorted((s.split() for s in house), key=len, reverse=True):
        out.setdefault(sentence[0], []).append(sentence)
    return out


@dataclass
class Items:
    """Evaluation items ready for comparison: their own words, and sorted seeds with the items that have them."""

    ids: list
    words: list[list[str]]
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        known = self.known
        numbers = [[known.setdefault(w, len(known) + 1) for w in own] for own in self.words]
        seeds = [np.unique(seed_codes(np.array(x, np.int64))) for x in numbers]
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.items = flat[order], item[order]


def seed_codes(numbers: np.ndarray) -> np.ndarray:
    """One code for each run of SEED words; numbers are below 2^21. Runs with an unknown word (0) have code 0."""
    if len(numbers) < SEED:
        return np.zeros(0, np.int64)
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), a << 42 | b << 21 | c, 0)


def without(found: list[str], house: dict[str, list[list[str]]]) -> list[str]:
    """A word list without the house sentences in it."""
    out, i, n = [], 0, len(found)
    while i < n:
        for sentence in house.get(found[i], ()):
            if found[i : i + len(sentence)] == sentence:
                i += len(sentence)
                break
        else:
            out.append(found[i])
            i += 1
    return out


def compare(item: list[str], document: list[str]) -> tuple[int, float]:
    """(words, coverage): the words that the longest passage of an item in a document has in common with it, with few
    changed, added or dropped between them; and the share of the item's words in long tiles, in any order."""
    marked = tiles(item, document, LEAST_TILE)
    covered = sum(n for _, _, n in marked if n >= COVERING_TILE)
    return longest_passage(marked), covered / len(item)


def longest_passage(marked: list[tuple[int, int, int]]) -> int:
    """The most matched words of a chain of tiles that go forward in both texts; gaps count as changed words."""
    best = 0
    # The best chain that ends with each tile.
    chains: list[list[tuple[int, int, int]]] = []  # (start in item, matched words, changed words)
    for k, (i, j, n) in enumerate(marked):
        mine = [(i, n, 0)]
        for (pi, pj, pn), before in zip(marked[:k], chains):
            gap_item, gap_document = i - pi - pn, j - pj - pn
            if gap_item < 0 or gap_document < 0 or max(gap_item, gap_document) > MOST_GAP:
                continue
            mine += [(start, matched + n, changed + max(gap_item, gap_document)) for start, matched, changed in before]
        # Of chains with the same start only the one with the fewest changes matters.
        least: dict[int, tuple[int, int, int]] = {}
        for chain in mine:
            if chain[0] not in least or chain[2] < least[chain[0]][2]:
                least[chain[0]] = chain
        chains.append(list(least.values()))
        for start, matched, changed in chains[-1]:
            if matched > best and changed <= MOST_CHANGED * (i + n - start):
                best = matched
    return best


#: Most words between two tiles of a passage.
MOST_GAP = 4


def candidates(documents: list[list[str]], items: Items) -> list[tuple[int, int]]:
    """(document, item) of the pairs that have LEAST_SEEDS shared seeds within SEED_WINDOW words of the document."""
    look = items.known.get
    numbers = np.array([n for d in documents for n in (*[look(w, 0) for w in d], 0)], np.int64)
    owner = np.repeat(np.arange(len(documents)), [len(d) + 1 for d in documents])
    codes = seed_codes(numbers)
    at = np.flatnonzero(codes)
    codes = codes[at]
    low, high = np.searchsorted(items.seeds, codes), np.searchsorted(items.seeds, codes, side="right")
    count = high - low
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    place, item = np.repeat(at, count), items.items[rows]
    order = np.lexsort((place, item))
    place, item = place[order], item[order]
    reach = LEAST_SEEDS - 1
    near = (item[reach:] == item[:-reach]) & (place[reach:] - place[:-reach] <= SEED_WINDOW) & (owner[place[reach:]] == owner[place[:-reach]])
    pairs = np.unique(owner[place[:-reach][near]] * (len(items.ids) + 1) + item[:-reach][near])
    return list(zip((pairs // (len(items.ids) + 1)).tolist(), (pairs % (len(items.ids) + 1)).tolist()))


def leaked_items(documents: list[list[str]], items: Items) -> Iterator[tuple[int, object, int, float]]:
    """(document, item, words of its longest passage, coverage) of the items that leak into documents given as words."""
    for d, i in candidates(documents, items):
        own = items.words[i]
        length, coverage = compare(own, documents[d])
        if length >= LEAST_WORDS or coverage >= LEAST_COVERAGE and coverage * len(own) >= LEAST_WORDS:
            yield d, items.ids[i], length, coverage


@lru_cache(maxsize=2)
def _house(folder: str, block: int) -> dict[str, list[list[str]]]:
    return by_first_word(r["s"] for r in read_folder(f"{folder}/block={block}"))


@lru_cache(maxsize=2)
def _items(folder: str, block: int) -> Items:
    rows = read_folder(f"{folder}/block={block}")
    return Items([r["i"] for r in rows], [r["own"].split() for r in rows])


def _own_words(texts: Iterable[str | None], house: str, blocks: list[int]) -> list[list[str]]:
    """The words of texts without house sentences."""
    found = [text_words(t) for t in texts]
    for block in blocks:
        known = _house(house, block)
        found = [without(w, known) for w in found]
    return found


def _write_blocks(rows: DataFrame, text: str, name: str) -> tuple[str, list[int]]:
    """Writes rows to the shared folder in blocks of about BLOCK_CHARS by a hash of the text; its address and the blocks."""
    blocks = max(1, math.ceil((rows.agg(F.sum(F.char_length(text))).first()[0] or 0) / BLOCK_CHARS))
    folder = new_folder(rows.sparkSession, name)
    placed = cut(rows.withColumn("block", F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")).repartition(blocks, "block"))
    placed.write.partitionBy("block").parquet(folder)
    return folder, sorted(r[0] for r in placed.select("block").distinct().collect())


def house_sentences(items: DataFrame) -> DataFrame:
    """(s): the sentences, as words, that stand in more than HOUSE_ITEMS items of (i, t)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"s": [s for t in frame["t"] for s in sentences_of(t)]}, dtype=object)

    each = items.select("t").mapInPandas(run, "s string")
    return each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOUSE_ITEMS).select("s")


def leaks(documents: DataFrame, evaluation: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, words, coverage): each document with each item it leaks, the words of the longest passage and the
    share of the item in long tiles. Null and empty texts leak nothing, an empty table gives no row, items without enough
    words of their own can't leak.

    House sentences and items are counted and made ready by tasks and written in blocks of about BLOCK_CHARS characters
    (one longer item is in a block of its own size); tasks hold one block at a time."""
    spark = documents.sparkSession
    rows = cut(evaluation.select(F.col(item).alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates(["i"]))
    house, house_blocks = _write_blocks(house_sentences(rows), "s", "house")
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((documents, key), (evaluation, item))}

    def ready(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = _own_words(frame["t"], house, house_blocks)
            kept = [k for k, w in enumerate(own) if len(w) >= LEAST_WORDS]
            yield pd.DataFrame({"i": frame["i"].to_numpy(object)[kept], "own": np.array([" ".join(own[k]) for k in kept], object)})

    folder, blocks = _write_blocks(rows.mapInPandas(ready, f"i {kind[item]}, own string"), "own", "items")

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for begin in range(0, len(frame), BATCH):
                names = frame[key].iloc[begin : begin + BATCH].tolist()
                found = _own_words(frame[text].iloc[begin : begin + BATCH], house, house_blocks)
                for block in blocks:
                    out += [(names[d], *rest) for d, *rest in leaked_items(found, _items(folder, block))]
            yield pd.DataFrame(out, columns=[key, "item_id", "words", "coverage"])

    texts = documents.select(key, text).where(F.col(text).isNotNull())
    leaked = cut(texts.mapInPandas(match, f"{key} {kind[key]}, item_id {kind[item]}, words int, coverage double"))
    drop_folder(spark, house)
    drop_folder(spark, folder)
    return leaked.withColumnRenamed("item_id", item)


def passages(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): the leaks by a passage of at least LEAST_WORDS running words."""
    return leaks(documents, evaluation).where(F.col("words") >= LEAST_WORDS).select("doc_id", "item_id", "words")


def leaked_report(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(item_id, suite, documents): the leaked test items with the number of documents that carry a passage of them."""
    suites = evaluation.groupBy("item_id").agg(F.min("suite").alias("suite"))
    counted = leaks(documents, evaluation).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
    return counted.join(suites, "item_id").select("item_id", "suite", "documents")
