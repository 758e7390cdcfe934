"""Problem 10: subject areas of documents.

Texts are turned once into numbers of their words by sentences. A complement naive Bayes model of sentences is trained from
labelled documents: a feature speaks for a subject as far as it is missing from all that is not of the subject. It is
refined by expectation-maximization with soft assignments: the subject of a sentence is hidden, in a labelled document
one of its labels or none, in an unlabelled one any or none, and each document has shares of subjects of its own. Rounds go
on until the assignments settle. Whether a sentence treats a subject or only mentions it, compares with it or quotes it,
is told by the words around the telling ones; that posterior is calibrated for each subject on labelled sentences that
it was not learned from. A sentence counts for every subject whose posterior passes; a document has the subjects that
enough of its sentences treat.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.canon import plain, words
from tessera.runtime import cut

#: Sentences that must treat a subject.
LEAST_SENTENCES = 3
#: The model is fitted on at most so many labelled documents, those of the smallest hashes; everything else covers all.
LABELLED_DOCUMENTS = 6_000
#: Most rounds over the labelled sample and over the corpus. They end before, when the share of the assignments that
#: changes, and in the corpus the share of sentences that the classes win or lose, falls below SETTLED.
LABELLED_ROUNDS, CORPUS_ROUNDS, SETTLED = 20, 2, 0.02
#: Share of documents in which a feature that no labelled document has must teach something to be kept: it bounds the
#: model, as a document has few words. What labelled documents and descriptions have is kept, however rare.
LEAST_DOCUMENT_SHARE, LEAST_DOCUMENTS = 2e-4, 3
#: Weight of an unlabelled document against a labelled one.
UNLABELLED_WEIGHT = 0.5
SMOOTHING = 0.5
#: Least weight of a feature for a subject; below it is what all texts of a language share.
LEAST_WEIGHT = 0.4
#: Score from which a sentence is of a subject at all.
LEAST_SCORE = 2.0
#: Features with this weight for some subject are telling; the others around them are context.
TELLING = 1.5
#: What the general rate of a context word weighs against its rate with one subject, in sentences; and what the general
#: calibration weighs against that of one subject.
POOLED_WEIGHT = 30.0
#: Least score of a further subject of a sentence; more where labels show chance hits of that subject.
LEAST_FURTHER = 4.0
#: Documents that are scored at once.
CHUNK = 1_000

_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]*_]*\s+|[\r\n]+")
_END = "\x00"
_TOKEN = re.compile(r"[^\W_]+|\x00")
_PARTED = {i: " " for i in range(1, 128) if not chr(i).isalnum()}
_NUMBERS: dict[str, int] = {}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _number(word: str) -> int:
    """A number of 32 bits for a word, the same everywhere; 0 is the end of a sentence, 1 a number in the text."""
    if len(_NUMBERS) > 1_000_000:
        _NUMBERS.clear()
    made = 0 if word == _END else 1 if word.isdigit() else max(2, zlib.crc32(word.encode("utf-8", "replace")))
    _NUMBERS[word] = made
    return made


def sentence_numbers(text: str | None) -> bytes:
    """The words of a text as numbers of four bytes, a zero behind each sentence or line; numbers in the text are left out."""
    if not text:
        return b""
    text = _SENTENCE.sub(f" {_END} ", plain(text))
    found = text.translate(_PARTED).split() if text.isascii() else _TOKEN.findall(text)
    found.append(_END)
    out = list(map(_NUMBERS.get, found))
    if None in out:
        out = [_number(w) if n is None else n for w, n in zip(found, out)]
    numbers = np.array(out, "<u4")
    numbers = numbers[numbers != 1]
    # Of ends that follow one another one is kept; a text without words has none.
    ends = numbers == 0
    return numbers[~ends | np.append(False, ~ends[:-1])].tobytes()


@dataclass
class Texts:
    """Features of a batch of texts, by sentence: single words and pairs of neighbours."""

    keys: np.ndarray
    sentence: np.ndarray
    document: np.ndarray  # of each sentence
    count: int

    @classmethod
    def of(cls, numbers: Iterable[bytes]) -> Texts:
        rows = list(numbers)
        flat = np.frombuffer(b"".join(rows), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])
        end = flat == 0
        number = np.cumsum(end) - end
        flat, at = flat[~end], number[~end]
        near = at[1:] == at[:-1]
        single, pair = flat * _A, (flat[:-1] * _A + flat[1:] * _B)[near]
        keys = np.concatenate((single ^ (single >> _C), (pair ^ (pair >> _C)) * _B))
        sentence = np.concatenate((at, at[1:][near]))
        order = np.argsort(sentence, kind="stable")
        return cls(keys[order], sentence[order], owner[end], len(rows))

    def sums(self, rows: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Sums of rows by sentence; `sentence` grows."""
        out = np.zeros((len(self.document), rows.shape[1]), rows.dtype)
        if len(rows):
            first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
            out[sentence[first]] = np.add.reduceat(rows, first, axis=0)
        return out


def words_of(text: str) -> np.ndarray:
    """The keys of the single words of a text."""
    flat = np.frombuffer(sentence_numbers(text), "<u4").astype(np.uint64)
    flat = flat[flat > 0] * _A
    return flat ^ (flat >> _C)


@dataclass
class Counts:
    """Documents, in parts where assignments are soft, in which each feature stands in a sentence of each class; the last
    class is `none`."""

    keys: np.ndarray
    table: np.ndarray

    @classmethod
    def sum(cls, parts: list[Counts], classes: int) -> Counts:
        if not parts:
            return cls(np.zeros(0, np.uint64), np.zeros((0, classes)))
        keys, at = np.unique(np.concatenate([p.keys for p in parts]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        table = np.concatenate([p.table for p in parts])[order]
        first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        return cls(keys, np.add.reduceat(table, first, axis=0) if len(keys) else table)

    @classmethod
    def of(cls, texts: Texts, assigned: np.ndarray) -> Counts:
        """The counts of a batch: a feature has in a document the greatest part any of its sentences gives it."""
        # Sentences come in order of the documents, and so do those of one feature.
        order = np.argsort(texts.keys, kind="stable")
        keys, sentence = texts.keys[order], texts.sentence[order]
        if not len(keys):
            return cls(keys, np.zeros((0, assigned.shape[1])))
        document = texts.document[sentence]
        fresh = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(fresh | np.append(True, document[1:] != document[:-1]))
        # Most features stand in one sentence of a document: only the others need a comparison.
        table = assigned.astype(np.float32)[sentence[first]]
        several = np.diff(np.append(first, len(sentence))) > 1
        at = np.flatnonzero(several)
        if len(at):
            size = np.diff(np.append(first, len(sentence)))[at]
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            rows = np.repeat(first[at] - begin, size) + np.arange(size.sum())
            table[at] = np.maximum.reduceat(assigned.astype(np.float32)[sentence[rows]], begin, axis=0)
        begin = np.flatnonzero(fresh[first])
        return cls(keys[first][begin], np.add.reduceat(table, begin, axis=0))


@dataclass
class Model:
    """keys: features, sorted. weights[f, c]: complement weight for each subject, and for none. told[f, c]: how far a
    context feature speaks for a sentence that is of subject c treating it. slope, level: calibration of their sum, for
    each subject. further: the score a subject needs where another one explains the sentence better."""

    subjects: list[str]
    fallback: str | None = None
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    told: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))
    level: np.ndarray = field(default_factory=lambda: np.zeros(0))
    further: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _tells: tuple | None = None

    def __post_init__(self) -> None:
        k = len(self.subjects)
        if not len(self.keys):
            self.weights, self.told = np.zeros((0, k + 1), np.float32), np.zeros((0, k), np.float32)
        if not len(self.slope):
            self.slope, self.level, self.further = np.ones(k), np.ones(k), np.full(k, LEAST_FURTHER)

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(row of the model, sentence) of the features it knows."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, texts.keys), len(self.keys) - 1)
        known = self.keys[at] == texts.keys
        return at[known], texts.sentence[known]

    def fit_weights(self, counts: Counts) -> None:
        """Complement weights: how much rarer a feature is outside of a class than anywhere."""
        n = counts.table
        every = n.sum(axis=1, keepdims=True)
        outside, total = every - n, n.sum()
        size = SMOOTHING * max(1, len(n))
        weights = np.log(every + SMOOTHING) - np.log(outside + SMOOTHING) + np.log((total - n.sum(axis=0) + size) / (total + size))
        weights[weights < LEAST_WEIGHT] = 0.0
        tells = weights.max(axis=1, initial=0.0) > 0
        self.keys, self.weights = counts.keys[tells], weights[tells].astype(np.float32)
        self.told = np.zeros((len(self.keys), len(self.subjects)), np.float32)

    def treats(self, texts: Texts, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The calibrated posterior that a sentence treats each subject, provided that it is of it."""
        tells = self.tells[found[0]]
        x = texts.sums(self.told[found[0][tells]], found[1][tells])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.level, -30, 30).astype(np.float32)))

    @property
    def tells(self) -> np.ndarray:
        """The features that are context."""
        if self._tells is None or self._tells[0] is not self.told:
            self._tells = (self.told, self.told.any(axis=1))
        return self._tells[1]

    def assign(self, texts: Texts, allowed: np.ndarray | None = None) -> np.ndarray:
        """Soft classes of the sentences; allowed[d, c] says which subjects a document may have. The shares of a document are
        found along with them. What is of a subject and doesn't treat it is of none."""
        k = len(self.subjects)
        found = self.find(texts)
        scores = texts.sums(self.weights[found[0]], found[1])
        like = np.exp(scores - scores.max(axis=1, keepdims=True, initial=0.0))
        treats = self.treats(texts, found)
        lost = like[:, :k] * (1 - treats)
        like[:, :k] *= treats
        like[:, k] += lost.sum(axis=1)
        if allowed is not None:
            like[:, :k] *= allowed[texts.document]
        part = like / np.maximum(like.sum(axis=1, keepdims=True), 1e-300)
        if not len(part):
            return part
        fresh = np.append(True, texts.document[1:] != texts.document[:-1])
        first, own = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        for _ in range(2):
            seen = np.add.reduceat(part, first, axis=0)
            shares = (seen + 0.1) / (seen.sum(axis=1, keepdims=True) + 0.1 * (k + 1))
            part = like * shares[own]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        return part

    def evidence(self, texts: Texts, found: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sentences, subject, score) of the best subjects of all sentences, then of the second ones and so on. A further
        one has the features that no better one explains: a word of several subjects speaks for the best of them."""
        rows, sentence = found
        subjects = self.weights[:, :-1]
        while len(rows):
            scores = texts.sums(subjects[rows], sentence)
            best = scores.argmax(axis=1)
            passes = np.flatnonzero(scores[np.arange(len(scores)), best] >= LEAST_SCORE)
            if not len(passes):
                return
            yield passes, best[passes], scores[passes, best[passes]]
            keep = np.zeros(len(scores), bool)
            keep[passes] = True
            stay = keep[sentence] & (subjects[rows, best[sentence]] <= 0)
            rows, sentence = rows[stay], sentence[stay]

    def counts(self, texts: Texts) -> np.ndarray:
        """Sentences of each document that treat each subject: all whose own posterior passes."""
        found = self.find(texts)
        treats = self.treats(texts, found)
        out = np.zeros((texts.count, len(self.subjects)), np.int64)
        for turn, (sentences, subject, score) in enumerate(self.evidence(texts, found)):
            passes = treats[sentences, subject] > 0.5
            if turn:
                passes &= score >= self.further[subject]
            np.add.at(out, (texts.document[sentences[passes]], subject[passes]), 1)
        return out

    def classify(self, numbers: list[bytes]) -> list[list[str]]:
        """The subjects of texts given as sentence_numbers(); none for a text without words."""
        enough = self.counts(Texts.of(numbers)) >= LEAST_SENTENCES
        names = np.array(self.subjects, object)
        other = [self.fallback] if self.fallback else []
        return [(names[row].tolist() or other) if blob else [] for row, blob in zip(enough, numbers)]


def _logistic(x: np.ndarray, y: np.ndarray, start: tuple[float, float], weight: float) -> tuple[float, float]:
    """Slope and level of the posterior that y is true at x, drawn towards `start` with a weight in observations."""
    beta, prior = np.array(start, float), np.array(start, float)
    design = np.column_stack((x, np.ones(len(x))))
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (y - p) - weight * 0.1 * (beta - prior)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * max(1e-3, weight * 0.1), gradient)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-4:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


@dataclass
class Labelled:
    """Labelled documents made ready: the features and labels[d, c]."""

    texts: Texts
    labels: np.ndarray

    def subset(self, keep: np.ndarray) -> Labelled:
        """The same without the sentences of other documents."""
        own = keep[self.texts.document]
        number = np.cumsum(own) - 1
        kept = own[self.texts.sentence]
        texts = Texts(self.texts.keys[kept], number[self.texts.sentence[kept]], self.texts.document[own], self.texts.count)
        return Labelled(texts, self.labels)


def _context(model: Model, labelled: Labelled) -> tuple[np.ndarray, np.ndarray]:
    """(keys, told) of the context features: in sentences of a subject, whether the document has its label. Each subject
    has odds of its own; where it has few sentences they are drawn towards those of all subjects."""
    texts, k = labelled.texts, len(model.subjects)
    found = model.find(texts)
    strong = model.keys[model.weights[:, :k].max(axis=1, initial=0.0) >= TELLING]
    first = next(model.evidence(texts, found), None)
    if first is None:
        return np.zeros(0, np.uint64), np.zeros((0, k))
    subject = np.full(len(texts.document), -1)
    subject[first[0]] = first[1]
    treated = labelled.labels[texts.document, np.maximum(subject, 0)] & (subject >= 0)
    n = np.zeros((2, k))
    np.add.at(n, (treated[first[0]].astype(int), first[1]), 1)
    of = (subject[texts.sentence] >= 0) & ~np.isin(texts.keys, strong)
    keys, at = np.unique(texts.keys[of], return_inverse=True)
    yes, every = np.zeros((len(keys), k)), np.zeros((len(keys), k))
    which = texts.sentence[of]
    np.add.at(every, (at, subject[which]), 1)
    np.add.at(yes, (at, subject[which]), treated[which])
    odds = lambda p: np.log(p / (1 - p))
    rate = (n[1].sum() + 1) / (n.sum() + 2)
    level = odds((n[1] + POOLED_WEIGHT * rate) / (n.sum(axis=0) + POOLED_WEIGHT))
    p = (yes.sum(axis=1) + 2 * rate) / (every.sum(axis=1) + 2)
    # The general odds of the word, moved to the subject's own rate, are what its sentences are held against.
    expected = 1 / (1 + np.exp(-(level + (odds(p) - odds(rate))[:, None])))
    told = odds((yes + POOLED_WEIGHT * expected) / (every + POOLED_WEIGHT)) - level
    told[abs(told) <= 0.5] = 0.0
    tells = (told != 0).any(axis=1) & (every.sum(axis=1) > 1)
    return keys[tells], told[tells]


def _with_context(model: Model, keys: np.ndarray, told: np.ndarray) -> None:
    """Puts context into the model, beside its weights."""
    every = np.union1d(model.keys, keys)
    weights = np.zeros((len(every), len(model.subjects) + 1), np.float32)
    weights[np.searchsorted(every, model.keys)] = model.weights
    table = np.zeros((len(every), len(model.subjects)), np.float32)
    table[np.searchsorted(every, keys)] = told
    model.keys, model.weights, model.told = every, weights, table


def calibrate(model: Model, labelled: Labelled) -> np.ndarray:
    """Fits the context and the posteriors of the subjects. Slopes and levels are fitted on documents that the context
    was not learned from, half by half. Returns (posterior, truth) of those sentences, to measure the calibration."""
    k = len(model.subjects)
    bare, weights = model.keys, model.weights
    half = np.arange(labelled.texts.count) % 2 == 0
    seen: list[np.ndarray] = []
    others: list[np.ndarray] = []
    for learn, hold in ((half, ~half), (~half, half)):
        model.keys, model.weights, model.told = bare, weights, np.zeros((len(bare), k), np.float32)
        _with_context(model, *_context(model, labelled.subset(learn)))
        texts = labelled.subset(hold).texts
        found = model.find(texts)
        x = texts.sums(model.told[found[0]], found[1])
        for turn, (sentences, subject, score) in enumerate(model.evidence(texts, found)):
            rows = np.column_stack((subject, x[sentences, subject], labelled.labels[texts.document[sentences], subject], score))
            (others if turn else seen).append(rows)
    model.keys, model.weights, model.told = bare, weights, np.zeros((len(bare), k), np.float32)
    model.slope, model.level, model.further = np.ones(k), np.ones(k), np.full(k, LEAST_FURTHER)
    if not seen:
        return np.zeros((0, 2))
    table = np.concatenate(seen)
    base = _logistic(table[:, 1], table[:, 2], (0.5, 0.0), 1.0)
    for c in range(k):
        own = table[table[:, 0] == c]
        model.slope[c], model.level[c] = _logistic(own[:, 1], own[:, 2], base, POOLED_WEIGHT) if len(own) else base
    _with_context(model, *_context(model, labelled))
    posterior = lambda t: 1 / (1 + np.exp(-(model.slope[t[:, 0].astype(int)] * t[:, 1] + model.level[t[:, 0].astype(int)])))
    if others:
        # A further subject needs the least score from which no more sentences lack the label than have it below.
        rest = np.concatenate(others)
        rest = rest[(rest[:, 3] >= LEAST_FURTHER) & (posterior(rest) > 0.5)]
        for c in range(k):
            own = rest[rest[:, 0] == c]
            chance, true = np.sort(own[own[:, 2] == 0, 3]), np.sort(own[own[:, 2] == 1, 3])
            worse = np.arange(len(chance), 0, -1) > np.searchsorted(true, chance, side="right")
            if worse.any():
                model.further[c] = np.nextafter(chance[worse][-1], np.inf)
    return np.column_stack((posterior(table), table[:, 2]))


def _described(names: list[str], descriptions: dict[str, str], classes: int) -> Counts:
    parts = []
    for c, name in enumerate(names):
        keys = np.unique(words_of(f"{name} {descriptions[name]}"))
        table = np.zeros((len(keys), classes))
        table[:, c] = 2.0
        parts.append(Counts(keys, table))
    return Counts.sum(parts, classes)


def fallback_of(descriptions: dict[str, str]) -> str | None:
    """The subject that is given only where no other is: the one whose description says so, or else none."""
    return next((s for s in sorted(descriptions) if re.search(r"\bnone of the other\b|\bno other\b", descriptions[s], re.I)), None)


def fit(rows: Iterable[tuple[str | None, Iterable[str]]], descriptions: dict[str, str], fallback: str | None = None) -> tuple[Model, Labelled, Counts]:
    """The model, the documents made ready and their counts, from labelled texts and the subjects' descriptions."""
    rows = list(rows)
    fallback = fallback or fallback_of(descriptions)
    names = sorted(s for s in descriptions if s != fallback)
    model = Model(names, fallback)
    k = len(names)
    labels = np.array([[s in set(own) for s in names] for _, own in rows], bool).reshape(len(rows), k)
    labelled = Labelled(Texts.of(sentence_numbers(t) for t, _ in rows), labels)
    described = _described(names, descriptions, k + 1)
    # At first all sentences of a document are of its labels alike, of none if it has none.
    even = np.column_stack((labels, ~labels.any(axis=1))).astype(float)
    assigned = (even / even.sum(axis=1, keepdims=True))[labelled.texts.document]
    model.level += 30.0  # as long as nothing is known of contexts every sentence treats what it is of
    for _ in range(LABELLED_ROUNDS):
        counts = Counts.of(labelled.texts, assigned)
        model.fit_weights(Counts.sum([described, counts], k + 1))
        before, assigned = assigned, model.assign(labelled.texts, labels)
        if not len(assigned) or abs(assigned - before).sum(axis=1).mean() < SETTLED:
            break
    counts = Counts.sum([described, Counts.of(labelled.texts, assigned)], k + 1)
    model.fit_weights(counts)
    calibrate(model, labelled)
    return model, labelled, counts


def refine(model: Model, labelled: Labelled, counts: Counts, corpus: Counts) -> None:
    """The model anew from the labelled counts and those of the corpus."""
    k = len(model.subjects)
    model.fit_weights(Counts.sum([counts, Counts(corpus.keys, corpus.table * UNLABELLED_WEIGHT)], k + 1))
    calibrate(model, labelled)


#: Rows of counts a task holds before it adds them up, and before it hands them on.
GATHERED = 3_000_000


def _gather(shared: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of the corpus by feature under the model; under key 0 the sentences of each class."""

    def frame(parts: list[Counts], mass: np.ndarray) -> pd.DataFrame:
        counts = Counts.sum(parts, len(mass))
        table = np.vstack((counts.table, mass))
        return pd.DataFrame({"f": np.append(counts.keys.view(np.int64), 0)} | {f"c{c}": table[:, c].astype(np.float32) for c in range(len(mass))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value  # type: ignore[attr-defined]
        parts: list[Counts] = []
        mass = np.zeros(len(model.subjects) + 1)
        for each in frames:
            for i in range(0, len(each), CHUNK):
                texts = Texts.of(each["numbers"].iloc[i : i + CHUNK])
                if len(texts.document):
                    assigned = model.assign(texts)
                    mass += assigned.sum(axis=0)
                    parts.append(Counts.of(texts, assigned))
                if sum(len(p.keys) for p in parts) > GATHERED:
                    parts = [Counts.sum(parts, len(mass))]
                    if len(parts[0].keys) > GATHERED // 2:
                        yield frame(parts, mass)
                        parts, mass = [], np.zeros(len(mass))
        yield frame(parts, mass)

    return run


def numbered(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, numbers) of the documents with text, read and parted into sentences once; kept in the shared folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for each in frames:
            yield pd.DataFrame({"key": each["key"].to_numpy(object), "numbers": [sentence_numbers(t) for t in each["text"]]}, dtype=object)

    kind = documents.schema[key].dataType.simpleString()
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    return cut(texts.mapInPandas(run, f"key {kind}, numbers binary"))


def train(documents: DataFrame, numbers: DataFrame, labels: DataFrame, descriptions: DataFrame, key: str = "doc_id", text: str = "text", most: int = LABELLED_DOCUMENTS) -> Model:
    """The model of labelled documents, at most `most`, refined over all documents."""
    spark = documents.sparkSession
    about = {r[0]: r[1] or "" for r in descriptions.select("subject", "description").collect() if r[0]}
    wanted = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).groupBy(key).agg(F.collect_set("subject").alias("subjects"))
    chosen = wanted.orderBy(F.xxhash64(key), key).limit(most)
    rows = [(r[0], r[1]) for r in documents.select(key, text).where(F.col(text).isNotNull()).join(chosen, key).select(text, "subjects").collect()]
    model, labelled, counts = fit(rows, about)
    k = len(model.subjects)
    total = numbers.count()
    known = spark.createDataFrame(pd.DataFrame({"f": counts.keys.view(np.int64), "known": True}), "f long, known boolean")
    least = max(LEAST_DOCUMENTS, LEAST_DOCUMENT_SHARE * total)
    classes = [f"c{c}" for c in range(k + 1)]
    before = np.zeros(k + 1)
    for _ in range(CORPUS_ROUNDS if k else 0):
        shared = spark.sparkContext.broadcast(model)
        gathered = numbers.select("numbers").mapInPandas(_gather(shared), ", ".join(["f long", *(f"{c} float" for c in classes)]))
        summed = gathered.groupBy("f").agg(*[F.sum(c).alias(c) for c in classes])
        every = sum((F.col(c) for c in classes[1:]), F.col("c0"))
        # What no class has more than a third of tells nothing.
        tells = (every >= least) & (3 * F.greatest(*classes) >= every)
        kept = summed.join(known, "f", "left").where(tells | F.col("known") | (F.col("f") == 0)).select("f", *classes).toPandas()
        mass = kept.loc[kept["f"] == 0, classes].to_numpy(float).sum(axis=0)
        if abs(mass - before).sum() < SETTLED * mass.sum():
            break
        before, kept = mass, kept[kept["f"] != 0].sort_values("f")
        model = Model(model.subjects, model.fallback)
        refine(model, labelled, counts, Counts(kept["f"].to_numpy(np.int64).view(np.uint64), kept[classes].to_numpy(float)))
    return model


def subjects_of(documents: DataFrame, labels: DataFrame, descriptions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject): every subject that at least LEAST_SENTENCES sentences of a document treat; the fallback subject, the
    one described by the lack of any other, only where there is no other. Null and wordless texts have none. Without
    labels the descriptions alone teach."""
    numbers = numbered(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, numbers, labels, descriptions, key, text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for each in frames:
            out = []
            for i in range(0, len(each), CHUNK):
                part = each.iloc[i : i + CHUNK]
                out += [(name, s) for name, own in zip(part["key"], shared.value.classify(list(part["numbers"]))) for s in own]
            yield pd.DataFrame(out, columns=[key, "subject"])

    kind = documents.schema[key].dataType.simpleString()
    return numbers.mapInPandas(run, f"{key} {kind}, subject string")


def composition(documents: DataFrame, labels: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(subject, documents, share): the make-up of the corpus; share is of all documents that have a subject."""
    found = cut(subjects_of(documents, labels, descriptions))
    total = found.agg(F.count_distinct("doc_id")).first()[0]
    counted = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counted.withColumn("share", F.round(F.col("documents") / F.lit(max(1, total)), 6))
