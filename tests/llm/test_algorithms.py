"""The algorithms without Spark, against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import canon, leakage, overlap, pieces, subjects, tokens
from tessera.llm.fmindex import FMIndex, pieces as index_pieces


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The  Mill,\tby the　pond", "the mill by THE pond!", True),
        ("the mill", "mill the", False),
        ("Ｆｕｌｌ １２ ​width", "full 12 width", True),
        ("site: Tarn; map: 3 by 4; mood: dark", '{"mood": "DARK", "site": "tarn", "map": "3 by 4"}', True),
        ("site: Tarn\nmood: dark\nmap: 3 by 4", "map = 3 by 4 | site = Tarn | mood = dark", True),
        ("site: Tarn; map: 3 by 4; mood: dark", "site: dark; map: 3 by 4; mood: Tarn", False),
        ("name: Ann; color: red", "color: red; name: Ann", True),
        ("name: Ann; color: red", "color = red | name = Ann", True),
        ("name: Ann\ncolor: red", '{"color": "red", "name": "Ann"}', True),
        ("name: Ann; color: red", "name: red; color: Ann", False),
        ("name: Ann", '{"name": "Ann"}', True),
        ("name: Ann", "Name - Ann!", True),
        ("The mill; the pond", "The pond; the mill", False),
        ("We need Tarn: one mill. Weather: rain.", "Weather: rain. We need Tarn: one mill.", False),
        ("Straße", "STRASSE", True),
        ("été", "été", True),
    ],
)
def test_canonical(a, b, same):
    assert (canon.canonical(a) == canon.canonical(b)) == same


def test_canonical_blank():
    assert [canon.canonical(t) for t in (None, "", " \n", "​", "?!")] == [None] * 5


def test_index_finds_all_places():
    rng = random.Random(1)
    texts = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    flat = np.array([w for t in texts for w in t])
    offsets = np.cumsum([0] + [len(t) for t in texts])
    made = FMIndex(flat, offsets)
    for index in (made, FMIndex.from_bytes(made.to_bytes())):
        assert [w for w in index.sequence.tolist() if w] == flat.tolist()
        for _ in range(100):
            word = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 6))]
            low, high = np.array([0]), np.array([index.n])
            for c in reversed(word):
                low, high = index.step(np.array([c]), low, high)
            got = sorted(index.text_of(np.arange(low[0], high[0])))
            assert got == sorted(t for t, x in enumerate(texts) for i in range(len(x)) if x[i : i + len(word)] == word)


def test_pieces_cover_queries():
    index = FMIndex(np.array([1, 2, 3, 4, 1, 2]), np.array([0, 4, 6]))
    at, low, high = index_pieces(index, np.array([1, 2, 3, -1, 4, 4]), np.array([0, 4, 6]), 1)
    assert sorted(zip(at.tolist(), (high - low).tolist())) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 1)]
    at, low, high = index_pieces(index, np.array([1, 2, 3, -1, 4, 4]), np.array([0, 4, 6]), 0)
    assert sorted(zip(at.tolist(), (high - low).tolist())) == [(0, 0), (0, 1), (1, 0)]


def test_edits_against_brute_force():
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
        assert overlap.edits(a, b) == table[-1, -1]


def near_pairs(evaluation, training, share=overlap.MOST_CHANGED):
    """What search() finds between two frames of (k, segs), through a stored index."""
    shard = overlap.Shard.of_row(overlap.Shard.build(evaluation["k"], evaluation["segs"]).row())
    keys = training["k"].tolist()
    return {(keys[i], shard.keys[j]) for i, j, _ in overlap.search(shard, overlap.Block.of(training["segs"]), share)}


def all_near_pairs(evaluation, training):
    allowed = lambda a, b: int(np.floor(overlap.MOST_CHANGED * max(len(a.split()), len(b.split())) + 1e-9))
    return {(t.k, e.k) for t in training.itertuples() for e in evaluation.itertuples() if overlap.changed_words(t.segs, e.segs) <= allowed(t.segs, e.segs)}


def all_moved_pairs(evaluation, training):
    parts = lambda text: [s.split() for s in text.split("\n")]
    size = lambda text: len(text.split())
    return {(t.k, e.k) for t in training.itertuples() for e in evaluation.itertuples() if overlap.moved(parts(t.segs), parts(e.segs)) <= int(overlap.MOST_CHANGED * max(size(t.segs), size(e.segs)) + 1e-9)}


def test_near_pairs_against_brute_force():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    base = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(5)) for _ in range(60)]

    def edited(text):
        lines = text.split("\n")
        rng.shuffle(lines)
        found = [w for line in lines for w in [*line.split(), "\n"]]
        for _ in range(rng.randrange(12)):
            found[rng.randrange(len(found))] = rng.choice([*vocabulary, "", "new"])
        return "\n".join(" ".join(x.split()) for x in " ".join(found).split("\n") if x.strip())

    evaluation = pd.DataFrame({"k": [f"e{i}" for i in range(60)], "segs": base})
    training = pd.DataFrame({"k": [f"t{i}" for i in range(120)], "segs": [edited(base[i % 60]) for i in range(120)]})
    want = all_near_pairs(evaluation, training)
    got = near_pairs(evaluation, training)
    assert want <= got <= want | all_moved_pairs(evaluation, training) and len(want) > 40


@pytest.mark.parametrize("family", [20, 50, 100, 300])
def test_near_pairs_of_large_families(family):
    """One training text and many near variants of it, among as many other texts: every one is found."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]

    def variant(words):
        made = list(words)
        for i in rng.sample(range(40), 2):
            made[i] = f"n{rng.randrange(10**9)}"
        return "\n".join(" ".join(made[i : i + 10]) for i in range(0, 40, 10))

    texts = [variant(base) for _ in range(family)] + [variant([f"x{rng.randrange(50)}" for _ in range(40)]) for _ in range(family)]
    evaluation = pd.DataFrame({"k": [f"e{i}" for i in range(len(texts))], "segs": texts})
    training = pd.DataFrame({"k": [f"t{i}" for i in range(20)], "segs": [variant(base) for _ in range(20)]})
    assert near_pairs(evaluation, training) == {(t, f"e{i}") for t in training["k"] for i in range(family)}


def test_no_near_pair_is_missed(monkeypatch):
    """Repeated words, texts of one word and lengths at the very limit, against all pairs; with few places held too."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 26))) for _ in range(300)]
    texts += ["\n".join(" ".join(t.split()[i : i + 6]) for i in range(0, len(t.split()), 6)) for t in (" ".join([w if rng.random() > 0.1 else rng.choice(["a", "b a", "new"]) for w in s.split()]) for s in texts[:300])]
    rng.shuffle(texts)
    evaluation = pd.DataFrame({"k": [f"e{i}" for i in range(300)], "segs": texts[:300]})
    training = pd.DataFrame({"k": [f"t{i}" for i in range(300)], "segs": texts[300:]})
    want = all_near_pairs(evaluation, training)
    assert len(want) > 100
    further = all_moved_pairs(evaluation, training)
    for held, places in ((overlap.HELD, 128), (7, 1), (50, 4)):
        monkeypatch.setattr(overlap, "HELD", held)
        monkeypatch.setattr(overlap, "FIRST_PLACES", places)
        got = near_pairs(evaluation, training)
        assert want <= got <= want | further


def test_moved_sentence_with_a_lost_end():
    """Sentences in another order, and one end lost on either side: near all the same."""
    parts = ["one river runs past the old mill at noon", "two goats stand near the wall of the yard", "the gate is open and the road leads north", "nine lamps burn above the market until dawn"]
    a, b = "\n".join(parts), "\n".join([parts[3], parts[1], parts[0], parts[2]])
    lost = "\n".join([f"{parts[0]} {parts[1]}", parts[2], parts[3]])
    evaluation = pd.DataFrame({"k": ["a", "b", "lost"], "segs": [a, b, lost]})
    training = pd.DataFrame({"k": ["x", "y", "z"], "segs": [lost, b, a]})
    assert near_pairs(evaluation, training) == {(t, e) for t in "xyz" for e in ("a", "b", "lost")}


def test_lost_and_moved_sentence_ends():
    """A sentence end lost on either side, and segments in another order."""
    a = "one river runs past the old mill\ntwo goats stand near the wall\nthe gate is open"
    assert overlap.changed_words(a, a.replace("\n", " ")) == overlap.changed_words(a.replace("\n", " "), a) == 0
    assert overlap.changed_words(a, "\n".join(reversed(a.split("\n")))) == 0
    assert overlap.changed_words(a, a.replace("two", "three")) == 1 and overlap.changed_words(a, "") == 17


def test_cut_points_hold_their_limits():
    rng = random.Random(4)
    for _ in range(60):
        parts = [rng.choice(["word", "longerword", "x" * rng.randrange(1, 90), "é🏰", "。"]) + rng.choice([" ", ". ", "\n", "\n\n", ", ", ""]) for _ in range(rng.randrange(1, 150))]
        text, limit = "".join(parts), rng.randrange(8, 200)
        over = rng.randrange(0, limit)
        spans = pieces.cut_points(text, limit, over)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in spans)
        assert all(b == d - (d - b) and c == b - over for (a, b), (c, d) in zip(spans, spans[1:]))
        assert "".join(text[a:b] if i == 0 else text[a + over : b] for i, (a, b) in enumerate(spans)) == text


def test_cuts_prefer_sentences():
    text = "One two three four. " * 30
    ends = [b for _, b in pieces.cut_points(text, 100, 20)[:-1]]
    assert all(text[b - 2 : b] == ". " for b in ends)


def least_cost(text, limit, over):
    """The same cost by plain recursion over all positions."""
    places, costs = pieces.boundaries(text, limit - over)
    price = dict(zip(places.tolist(), costs.tolist())) | {len(text): 0.0}
    count = -(-(len(text) - over) // (limit - over))
    even = (len(text) - over) / count + over
    best = {}
    for end in sorted(price):
        options = [0.0 + ((end - even) / limit) ** 2] if end <= limit else []
        options += [best[e] + ((end - e + over - even) / limit) ** 2 for e in best if over < e < end and end - e + over <= limit]
        if options:
            best[end] = min(options) + price[end]
    return best[len(text)]


def test_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(20):
        text = "".join(rng.choice(["ab ", "cde. ", "fghij, ", "k\n", "lm\n\n"]) for _ in range(60))
        spans = pieces.cut_points(text, 60, 10)
        places, costs = pieces.boundaries(text, 50)
        price = dict(zip(places.tolist(), costs.tolist())) | {len(text): 0.0}
        count = -(-(len(text) - 10) // 50)
        even = (len(text) - 10) / count + 10
        assert abs(sum(((b - a - even) / 60) ** 2 + price[b] for a, b in spans) - least_cost(text, 60, 10)) < 1e-9


def test_leaving_out_dear_boundaries_costs_nothing(monkeypatch):
    """The cuts chosen among the offered boundaries, held against the best ones among all boundaries."""
    rng = random.Random(10)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "longer ", "end. ", "part, ", "line\n", "block\n\n", "x" * rng.randrange(1, 12)]) for _ in range(150))
        limit, over = rng.randrange(60, 160), rng.randrange(0, 30)
        spans = pieces.cut_points(text, limit, over)
        with monkeypatch.context() as patch:
            patch.setattr(pieces, "DEAR", float("inf"))
            places, costs = pieces.boundaries(text, limit - over)
            price = dict(zip(places.tolist(), costs.tolist())) | {len(text): 0.0}
            even = (len(text) - over) / -(-(len(text) - over) // (limit - over)) + over
            cost = sum(((b - a - even) / limit) ** 2 + price[b] for a, b in spans)
            assert cost <= least_cost(text, limit, over) + 1e-9


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_encoding_round_trip(text):
    encoder = tokens.encoder(tokens.vocabulary_path())
    clean = text.encode("utf-8", "replace").decode("utf-8")
    assert encoder.decode(encoder.encode(clean)) == clean


def test_encoding_against_library():
    import base64

    import tiktoken

    path = tokens.vocabulary_path()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=tokens.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    encoder = tokens.encoder(path)
    for _ in range(300):
        text = "".join(rng.choice("aab bßé🏰\n\t日漢xyz123.,'s ") for _ in range(rng.randrange(300)))
        assert encoder.encode(text) == other.encode_ordinary(text)
    assert encoder.encode(None) == encoder.encode("") == []


HOUSE = "Keep every tile inside the board."
ITEM = "The ferryman of Tarn hides nine letters under the paving while the old mill turns slowly in green rain before the gates are opened. " + HOUSE + " Nobody asks why the bell is cracked."


def prepared():
    texts = [ITEM, *(f"{HOUSE} Item number {w} stands alone here." for w in ("one", "two", "three", "four"))]
    counts = Counter(s for t in texts for s in leakage.sentences_of(t))
    house = leakage.by_first_word(s for s, n in counts.items() if n > leakage.HOUSE_ITEMS)
    own = [leakage.without(leakage.text_words(t), house) for t in texts]
    kept = [i for i, w in enumerate(own) if len(w) >= leakage.LEAST_WORDS]
    return leakage.Items(kept, [own[i] for i in kept]), house


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (ITEM, True),
        ("Before. " + ITEM.replace(" ", "\n> ").replace(HOUSE, "").upper() + " After.", True),
        ('{"content": "' + ITEM.replace(" ", "\\n") + '"}', True),
        (ITEM.replace("nine", "seven").replace("slowly ", ""), True),
        (" ".join(ITEM.split()[:19]), True),
        (" ".join(ITEM.split()[:15]), False),
        (" ".join(w if i % 5 else "other" for i, w in enumerate(ITEM.split())), False),
        (HOUSE * 5, False),
        ("", False),
        (" ".join(ITEM.split()[:10]) + " then something else was told about it " + " ".join(ITEM.split()[12:22]), False),
        (ITEM.replace("hides", f"hides. {HOUSE}"), True),
    ],
)
def test_leaks(text, leaks):
    items, house = prepared()
    assert bool(list(leakage.leaked_items([leakage.without(leakage.text_words(text), house)], items))) == leaks


def test_reordered_parts_are_coverage():
    """An item of sixty words cut into four parts of fifteen that stand in another order."""
    words = [f"word{i}" for i in range(60)]
    items = leakage.Items([7], [words])
    parts = [words[i : i + 15] for i in range(0, 60, 15)]
    document = [w for k in (2, 0, 3, 1) for w in (*parts[k], f"between{k}")]
    assert list(leakage.leaked_items([["a"] * 50, document, []], items)) == [(1, 7, 15, 1.0)]
    assert list(leakage.leaked_items([[w for k in (2, 0) for w in parts[k]]], items)) == []


def test_candidates_against_brute_force():
    rng = random.Random(4)
    texts = lambda n: [[rng.choice("abcdefgh") for _ in range(rng.randrange(60))] for _ in range(n)]
    own, documents = texts(30), texts(40)
    items = leakage.Items(list(range(30)), own)
    want = set()
    for d, doc in enumerate(documents):
        for i, item in enumerate(own):
            seeds = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
            hits = [k for k in range(len(doc) - 2) if tuple(doc[k : k + 3]) in seeds]
            if any(b - a <= leakage.SEED_WINDOW for a, b in zip(hits, hits[leakage.LEAST_SEEDS - 1 :])):
                want.add((d, i))
    assert set(leakage.candidates(documents, items)) == want and 0 < len(want) < 1200


def classify(model, text):
    return model.classify([subjects.sentence_numbers(text)])[0]


def test_subjects_on_held_out_labels():
    folder = FOLDER.replace("0.001", "0.1")
    labels = defaultdict(set)
    for k, s in duckdb.sql(f"SELECT * FROM '{folder}/doc_labels.parquet'").fetchall():
        labels[k].add(s)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' WHERE doc_id IN (SELECT doc_id FROM '{folder}/doc_labels.parquet')").fetchall())
    about = dict(duckdb.sql(f"SELECT * FROM '{folder}/subjects.parquet'").fetchall())
    keys = sorted(texts)
    train, test = keys[::2], keys[1::2]
    model, _, _ = subjects.fit([(texts[k], labels[k]) for k in train], about)
    assert model.fallback == "mapcraft"
    found = {k: set(classify(model, texts[k])) for k in test}
    assert np.mean([found[k] == labels[k] for k in test]) > 0.9
    assert model.classify([subjects.sentence_numbers(t) for t in (None, "", " \n", "4 5.")]) == [[]] * 4


def test_posteriors_are_calibrated():
    """On labelled sentences that a context was not learned from, the mean posterior of each fifth is near the share that is true."""
    folder = FOLDER.replace("0.001", "0.1")
    rows = duckdb.sql(f"SELECT any_value(text), list(subject) FROM '{folder}/doc_labels.parquet' JOIN '{folder}/documents.parquet' USING (doc_id) GROUP BY doc_id ORDER BY doc_id").fetchall()
    about = dict(duckdb.sql(f"SELECT * FROM '{folder}/subjects.parquet'").fetchall())
    model, labelled, counts = subjects.fit(rows, about)
    model.fit_weights(counts)
    posterior, truth = subjects.calibrate(model, labelled).T
    assert len(truth) > 500
    order = np.argsort(posterior)
    assert max(abs(posterior[part].mean() - truth[part].mean()) for part in np.array_split(order, 5)) < 0.1


def test_complement_weights_against_brute_force():
    rng = np.random.RandomState(3)
    keys, table = np.arange(1, 21, dtype=np.uint64), rng.randint(0, 9, (20, 4)).astype(float) + 0.5
    model = subjects.Model(["a", "b", "c"])
    model.fit_weights(subjects.Counts(keys, table))
    a = subjects.SMOOTHING
    for f, row in zip(keys.tolist(), table):
        for c in range(4):
            inside = (row.sum() + a) / (table.sum() + 20 * a)
            outside = (row.sum() - row[c] + a) / (table.sum() - table[:, c].sum() + 20 * a)
            weight = np.log(inside / outside)
            at = np.flatnonzero(model.keys == f)
            got = model.weights[at[0], c] if len(at) else 0.0
            assert abs(got - (weight if weight >= subjects.LEAST_WEIGHT else 0.0)) < 1e-5


def test_features_are_counted_once_in_a_document():
    texts = subjects.Texts.of(map(subjects.sentence_numbers, ["Mill mill. Mill pond!", None, "pond"]))
    assigned = np.array([[0.25, 0.75], [1.0, 0.0], [0.5, 0.5]])
    counts = subjects.Counts.of(texts, assigned)
    got = {w: counts.table[counts.keys == subjects.words_of(w)[0]].tolist() for w in ("mill", "pond")}
    assert got == {"mill": [[1.0, 0.75]], "pond": [[1.5, 0.5]]} and len(counts.keys) == 4


def two_subjects():
    law = ["The tribunal gave its verdict before the statute was read.", "The plaintiff asked the tribunal for a verdict.", "A statute bound the plaintiff and the tribunal."]
    music = ["The choir sang a melody with one violin.", "A violin played the melody for the choir.", "The choir knew the melody and the rhythm."]
    court = ["The court of the tribunal heard the plaintiff.", "The choir sang in the court to a violin."]
    rows = [(" ".join([*side, also]), {name}) for name, side, also in (("law", law, court[0]), ("music", music, court[1])) for _ in range(30)]
    return subjects.fit(rows, {"law": "tribunal, verdict", "music": "melody, choir", "other": "Only tiles, with none of the other subjects"})[0]


def test_a_sentence_may_treat_two_subjects():
    model = two_subjects()
    assert classify(model, "The tribunal gave its verdict and the choir sang a melody. " * 3) == ["law", "music"]
    assert classify(model, "The tribunal gave its verdict and the choir sang a melody. " * 2) == ["other"]
    assert classify(model, "The court of the tribunal heard the plaintiff. " * 3) == ["law"]


def test_each_subject_has_its_own_calibration():
    """A word that marks a passing mention of one subject says nothing against the other."""
    seen = [("tribunal", "again", {0}, 100), ("tribunal", "today", {0}, 40), ("melody", "again", set(), 60), ("melody", "today", {1}, 60)]
    rows = [(f"{a} {b}", labels) for a, b, labels, n in seen for _ in range(n)]
    random.Random(1).shuffle(rows)
    model = subjects.Model(["law", "music"])
    model.keys = np.sort(np.concatenate([subjects.words_of(w) for w in ("tribunal", "melody")]))
    model.weights = np.array([[5.0, 0, 0] if key == subjects.words_of("tribunal")[0] else [0, 5.0, 0] for key in model.keys], np.float32)
    model.told = np.zeros((2, 2), np.float32)
    labels = np.array([[c in own for c in range(2)] for _, own in rows])
    subjects.calibrate(model, subjects.Labelled(subjects.Texts.of(subjects.sentence_numbers(t) for t, _ in rows), labels))
    count = lambda text: model.counts(subjects.Texts.of([subjects.sentence_numbers(text)]))[0].tolist()
    assert count("Tribunal again. " * 3) == [3, 0] and count("Melody today.") == [0, 1] and count("Melody again.") == [0, 0]
