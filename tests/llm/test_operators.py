"""The operators on small tables: nulls anywhere, empty and long texts, ties, repeated rows, empty tables, other columns."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import oracle
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from tessera.llm import dedup, defects, groups, leakage, overlap, pieces, queries, subjects, tokens, truncation


def frame(spark, rows, schema):
    """With columns beside that have the names operators use inside."""
    made = spark.createDataFrame(rows, schema)
    for name in ("key", "k", "segs", "root", "h", "s", "f", "_text", "_salt", "pieces", "kind", "words", "v"):
        if name not in made.columns:
            made = made.withColumn(name, F.lit("clash"))
    return made


MEMBERS = "id string, prompt_group string, split string"
D = {n: n * 64 for n in "abcdef"}


def torn(spark, rows):
    return sorted(r.id for r in groups.torn_ids(frame(spark, rows, MEMBERS)).collect())


def test_torn_ids(spark):
    rows = [
        ("1", D["a"], "train"), ("2", f" SHA256:{D['a'].upper()}\n", "val"), ("3", D["b"], "train"), ("3", D["c"], "train"), ("4", D["c"], None), ("5", D["b"], " Test"),
        ("6", None, "train"), ("7", None, "test"), ("8", D["d"], "train"), ("9", D["d"], "TRAIN "), ("10", D["e"], "train"), ("10", D["e"], "train"), ("11", None, "val"), ("11", D["f"], "Validation"), (None, D["d"], "test"), ("12", "", "val"), ("13", "", "train"),
    ]
    assert torn(spark, rows) == ["1", "2", "3", "4", "5"]
    assert torn(spark, []) == []
    assert torn(spark, [("1", None, None)]) == []


def test_long_chain_and_hub(spark):
    """A chain of 60 ids that is torn at its ends, and a digest that many ids share."""
    chain = [(f"c{i:02d}", f"{j:064x}", "train" if i < 59 else "test") for i in range(60) for j in (i, i + 1)]
    hub = [(f"h{i}", D["a"], "val") for i in range(300)]
    assert torn(spark, chain + hub) == sorted({r[0] for r in chain})
    ids = groups.related_ids(frame(spark, chain + hub, MEMBERS))
    split = groups.deal(ids).join(ids, "id")
    assert split.groupBy("root").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split.count() == 360
    forest = groups.forest_of(frame(spark, chain + hub, MEMBERS))
    assert forest.count() == 60 + 61 - 1 + 300 and forest.where("digest LIKE '0%'").count() == 120


@pytest.mark.parametrize("one_task", [0, 15, 10**6])
def test_forest_against_union_find(spark, monkeypatch, one_task):
    """Contracted by all tasks, by all and then one, by one alone: the same sets, and edges that span them."""
    monkeypatch.setattr(groups, "ONE_TASK", one_task)
    rng = random.Random(5)
    pairs = [(f"a{rng.randrange(60)}", f"b{rng.randrange(60)}") for _ in range(55)] + [(f"a{i}", "hub") for i in range(60, 90)] + [(None, "b1"), ("a1", "a1")]
    forest = groups.spanning_forest(spark.createDataFrame(pairs, "a string, b string").selectExpr("CAST(a AS binary) a", "CAST(b AS binary) b"))
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def sets(edges):
        parent.clear()
        joined = sum(find(a) != find(b) and not parent.update({find(a): find(b)}) for a, b in edges)
        out = defaultdict(set)
        for x in list(parent):
            out[find(x)].add(x)
        return sorted(map(sorted, out.values())), joined

    want, spanning = sets([(a, b) for a, b in pairs if a and b and a != b])
    got = defaultdict(set)
    for r in forest.labels.collect():
        got[bytes(r.root)].add(bytes(r.v).decode())
    assert sorted(map(sorted, got.values())) == want
    chosen = [(bytes(r.a).decode(), bytes(r.b).decode()) for r in forest.edges.collect()]
    assert sets(chosen) == (want, len(chosen)) and len(chosen) == spanning


def shares_of(spark, rows, shares):
    dealt = groups.deal(spark.createDataFrame(rows, "id string, root string").selectExpr("id", "CAST(root AS binary) root"), shares)
    return {r.split: r.n / len(rows) for r in dealt.groupBy("split").agg(F.count("*").alias("n")).collect()}


def test_deal_is_near_the_shares(spark):
    small = [(str(i), str(i // 3)) for i in range(6000)]
    for shares in ((0.8, 0.1, 0.1), (0.5, 0.25, 0.25), (0.34, 0.33, 0.33)):
        got = shares_of(spark, small, shares)
        assert all(abs(got[n] - s) < 0.01 for n, s in zip(groups.SPLITS, shares))
    large = small + [(f"x{i}", f"big{i // 600}") for i in range(3000)]
    got = shares_of(spark, large, (0.5, 0.25, 0.25))
    assert all(abs(got[n] - s) < 0.02 for n, s in zip(groups.SPLITS, (0.5, 0.25, 0.25)))
    assert shares_of(spark, [(f"x{i}", "all") for i in range(50)], (0.2, 0.2, 0.6)) == {"test": 1.0}


PROMPTS = "id string, prompt string, source string"


def test_duplicates(spark):
    rows = [("b", "The mill, by the pond", "x"), ("a", "THE MILL by the\tpond!", None), ("a", "THE MILL by the\tpond!", None), ("c", "mill the by the pond", "x"), ("d", None, "x"), ("e", " ", "x"), (None, "the mill by the pond", "x"), ("f", "long " * 50_000, "x"), ("g", "LONG " * 50_000, "x")]
    made = frame(spark, rows, PROMPTS)
    assert sorted(map(tuple, dedup.copies(made).collect())) == [("a", "b"), ("f", "g")]
    assert sorted(map(tuple, dedup.distinct_texts(made).collect())) == [("a", 2), ("c", 1), ("f", 2)]
    assert dedup.collisions(made).count() == 0
    empty = frame(spark, [], PROMPTS)
    assert dedup.copies(empty).count() == dedup.distinct_texts(empty).count() == 0


def test_cross_split_in_small_parts(spark, monkeypatch):
    """Many shards and blocks, classes parted into blocks of few ids: the same pairs."""
    monkeypatch.setattr(overlap, "SHARD_SYMBOLS", 150)
    monkeypatch.setattr(overlap, "BLOCK_CHARS", 50)
    monkeypatch.setattr(overlap, "TOGETHER", 3)
    base = [f"place {i} lies by the river and has {i * 7 % 11} towers of stone with {i * 3} windows each" for i in range(11)]
    prompts = [(f"{i:03d}", base[i % 11] + (" today" if i % 5 == 0 else ""), "s") for i in range(120)]
    members = [(f"{i:03d}", "x", "train" if i % 2 else "test") for i in range(120)]
    got = {(r.id_a, r.id_b) for r in overlap.cross_split(frame(spark, prompts, PROMPTS), frame(spark, members, MEMBERS)).collect()}
    words = [p[1] for p in prompts]
    want = {(prompts[i][0], prompts[j][0]) for i in range(120) for j in range(i) if i % 2 != j % 2 and overlap.changed_words(words[i], words[j]) <= int(overlap.MOST_CHANGED * max(len(words[i].split()), len(words[j].split())))}
    want = {(min(p), max(p)) for p in want}
    assert (len(got - want), len(want - got), len(got) > 250) == (0, 0, True)


def test_cross_split(spark):
    text = "One river runs past the mill. Two goats stand near the wall at noon. The gate is open and the road leads to the old library of Tarn."
    near = "Two goats stand near the wall today. One river runs past the mill. The gate is open and the road leads to the old library of Tarn."
    far = "Three towers rise over the harbour. " + text[:60]
    prompts = frame(spark, [("a", text, "s"), ("b", text.upper(), "s"), ("c", near, None), ("d", far, "s"), ("e", None, "s"), ("f", text, "s"), ("g", text, "s"), ("a", text, "s"), (None, text, "s")], PROMPTS)
    members = frame(spark, [("a", None, "train"), ("b", "x", " VAL"), ("c", "x", "test"), ("d", "x", "test"), ("e", "x", "test"), ("f", "x", None), ("g", "x", "train"), ("g", "x", "test"), ("zz", "x", "test"), (None, None, "test"), ("b", "x", "val")], MEMBERS)
    got = {(r.id_a, r.id_b) for r in overlap.cross_split(prompts, members).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "g"), ("b", "g"), ("c", "g")}
    report = {(r.split, r.source, r.same): (r.pairs, r.ids) for r in overlap.report(prompts, members).collect()}
    assert report == {("val", "s", True): (2, 1), ("test", "s", True): (1, 1), ("test", None, False): (2, 1)}
    assert {(r.id, r.same, r.near) for r in overlap.links_of_ids(prompts, members).collect()} == {("b", 2, 0), ("c", 0, 2), ("g", 1, 0), ("d", 0, 0)}
    assert overlap.cross_split(prompts.limit(0), members).count() == overlap.cross_split(prompts, members.limit(0)).count() == 0


PREDICTIONS = "prediction_key long, id string, source string, model string, raw_response string, error string"
MESSAGES = "message_key long, id string, turn int, role string, content string, profile string"
SUITE = "id string, prompt string"
ASKED = "Build the mill of Tarn on 24 by 20 tiles. Put three trees near the pond, and let the road end at the gate."


def tables(spark, rows):
    messages = [(1, "m", 0, "system", "Be brief.", None), (2, "m", 1, "user", ASKED, None), (2, "m", 1, "user", ASKED, None), (3, "n", 1, "user", None, None), (4, None, 1, "user", "?", None), (5, "m", 1, None, None, None)]
    return frame(spark, rows, PREDICTIONS), frame(spark, messages, MESSAGES), frame(spark, [("suite", ASKED), (None, None)], SUITE)


ANSWERS = [
    (1, "m", "s", "x", None, None), (2, "m", "s", "x", "I can't do that.", None), (3, "m", "s", "x", "The mill is ne", None), (4, "m", None, None, ASKED.upper(), None), (5, "suite", "s", "x", "Das Haus steht bei der Mühle und der Weg ist frei.", None),
    (6, "gone", "s", "x", ASKED, None), (7, None, "s", "x", "Das Haus steht bei der Mühle und der Weg ist frei.", None), (8, "m", "s", "x", "The mill stands at 3, the trees near the pond.", None), (9, "n", "s", "x", "[]", None), (2, "m", "s", "x", "I can't do that.", None), (None, "m", "s", "x", "", None),
    (10, "m", "s", "x", "The trees stand there. " * 20_000, None), (11, "m", "s", "x", '{"objects": [{"id": "a"}', "read timed out"), (12, "m", "s", "x", None, "provider declined the scene request"),
]


def test_defects(spark):
    got = sorted(map(tuple, defects.broken_pairs(*tables(spark, ANSWERS)).collect()))
    assert got == [(1, "empty"), (2, "refusal"), (3, "truncated"), (4, "copied"), (5, "other_language"), (9, "empty"), (11, "truncated"), (12, "refusal")]
    assert defects.broken_pairs(*tables(spark, [])).count() == 0


def test_truncation(spark):
    providers = spark.createDataFrame([("p", "x", 3), ("p", None, 1)], "provider string, model string, max_tokens int")
    predictions, messages, suite = tables(spark, ANSWERS)
    got = {r.prediction_key: r.cause for r in truncation.cut_answers(predictions, providers, messages, suite).collect()}
    assert got == {3: "model", 11: "model"}
    shares = {r.source: (r.answers, r.truncated) for r in truncation.by_source(predictions, providers, messages, suite).collect()}
    assert shares["s"] == (9, 2) and shares[None] == (1, 0)
    limited = spark.createDataFrame([("w", "é" * 10)] * 9 + [("w", "short")], "source string, raw_response string")
    assert {(r.measure, r.limit) for r in truncation.hidden_limits(limited).collect()} >= {("characters", 10), ("utf8_bytes", 20)}
    empty = tables(spark, [])[0]
    assert truncation.cut_answers(empty, providers, messages, suite).count() == truncation.hidden_limits(empty).count() == 0


def test_limit_decides(spark):
    """A repetition of a question without end mark that misses its last field: whole, unless it lies at its source's limit."""
    fields = [f"{n}: {n[::-1]} {i} of the old town, with three trees by the long wall" for i, n in enumerate(("site", "mood", "material", "weather"))]
    asked = "\n".join([*fields, "map: small"])
    answer = "\n".join(fields)
    at, over = [("s", answer)] * 4, ("t", answer + " " * 3)
    rows = [(i, "q", source, None, text, None) for i, (source, text) in enumerate([*at, over, *[("t", "Whole sentences of this source are longer than the limit of the other one, by far, and they do end. " * 4)] * 5])]
    rows += [(100 + i, None, "s", None, f"Answer {i} is short.", None) for i in range(5)]
    predictions = frame(spark, rows, PREDICTIONS)
    messages = frame(spark, [(1, "q", 1, "user", asked, None)], MESSAGES)
    providers = spark.createDataFrame([], "provider string, model string, max_tokens int")
    suite = frame(spark, [], SUITE)
    got = truncation.cut_answers(predictions, providers, messages, suite)
    assert sorted((r.prediction_key, r.cause) for r in got.collect()) == [(i, "source") for i in range(4)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all(m in plan for m in truncation.MEASURES) and "Generate" in plan and "max_tokens" in plan
    whole = frame(spark, [(i, "q", "s", None, asked, None) for i in range(4)], PREDICTIONS)
    assert truncation.cut_answers(whole, providers, messages, suite).count() == 0


SETTINGS = "profile string, max_seq_length int, overlap_tokens int, is_default boolean"


def test_pieces(spark):
    settings = spark.createDataFrame([("tiny", 10, 2, False), ("std", 20, 4, True), ("none", None, None, None), (None, 1, 1, None)], SETTINGS)
    texts = [(1, "a", 0, "user", "x" * 40, "tiny"), (2, "a", 0, "user", "x" * 41, "tiny"), (3, "a", 0, "user", "x" * 80, None), (4, "a", 0, "user", "word " * 17, None), (5, "a", 0, "user", None, "tiny"), (6, "a", 0, "user", "", "tiny"), (7, "a", 0, "user", "x" * 99, "gone"), (8, "a", 0, "user", "x" * 99, "none"), (2, "a", 0, "user", "x" * 41, "tiny"), (None, "a", 0, "user", "x" * 99, "tiny"), (9, "a", 0, "user", "word. " * 30_000, "tiny")]
    made = pieces.split_items(frame(spark, texts, MESSAGES), settings)
    rows = made.where("message_key < 9").orderBy("message_key", "piece").collect()
    assert {r.message_key for r in rows} == {2, 4}
    assert all(r.tokens <= {2: 10, 4: 20}[r.message_key] for r in rows)
    assert [r.start for r in rows if r.message_key == 2 and r.piece == 1] == [r.stop - 8 for r in rows if r.message_key == 2 and r.piece == 0]
    assert made.where("message_key = 9 AND tokens > 10").count() == 0
    assert pieces.split_items(frame(spark, [], MESSAGES), settings).count() == 0


DOCUMENTS = "doc_id long, text string, source string"


def test_encoding(spark):
    rows = [(1, "Hello  world", None), (2, "", "s"), (3, None, "s"), (1, "Hello  world", None), (None, "x", "s"), (4, "long word " * 50_000, "s")]
    got = tokens.encode_table(frame(spark, rows, DOCUMENTS)).collect()
    encoder = tokens.encoder(tokens.vocabulary_path())
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), encoder.encode(t)) for k, t, _ in rows)
    assert tokens.encode_table(frame(spark, [], DOCUMENTS)).count() == 0


ITEMS = "item_id long, text string, suite string"
PASSAGE = "The ferryman of Tarn hides nine letters under the paving while the old mill turns slowly in green rain before the gates are opened by the guard"


def test_leaks(spark, monkeypatch):
    items = frame(spark, [(1, PASSAGE, "a"), (2, "short text", "a"), (3, None, "a"), (None, PASSAGE, "a"), (1, PASSAGE, "a"), (4, PASSAGE + " again", None)], ITEMS)
    documents = frame(spark, [(1, "x " + PASSAGE.upper(), "s"), (2, None, "s"), (3, "", "s"), (4, PASSAGE[:60], "s"), (5, "filler " * 20_000 + PASSAGE, None)], DOCUMENTS)
    want = {(1, 1), (1, 4), (5, 1), (5, 4)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(documents, items).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(documents, items).collect()} == want
    assert leakage.leaks(documents, items.limit(0)).count() == leakage.leaks(documents.limit(0), items).count() == 0
    assert {(r.item_id, r.documents) for r in leakage.leaked_report(documents, items).collect()} == {(1, 2), (4, 2)}


def test_subjects_of_odd_tables(spark):
    about = spark.createDataFrame([("law", "tribunal, verdict"), ("music", "melody"), ("mapcraft", "tiles, with none of the other subjects"), (None, None)], "subject string, description string")
    law, music = "The tribunal gave its verdict here. ", "They sang a melody in the hall. "
    rows = [(i, (law if i % 2 else music) * 4, None) for i in range(40)] + [(100, None, None), (101, "", None), (102, " \n", None), (103, law + music, None), (104, law * 20_000, None), (None, law, None)]
    documents = frame(spark, rows, DOCUMENTS)
    labels = spark.createDataFrame([(i, "law" if i % 2 else "music") for i in range(30)] + [(999, "law"), (None, "law"), (3, None)], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(documents, labels, about).collect()}
    assert {(39, "law"), (38, "music"), (103, "mapcraft"), (104, "law")} <= got and not {100, 101, 102} & {k for k, _ in got}
    assert subjects.subjects_of(documents.limit(0), labels, about).count() == 0
    subjects.subjects_of(documents, labels.limit(0), about).count()


def test_rare_subject_keeps_its_words(spark, monkeypatch):
    """The words of a subject stand in fewer documents than the share asks for, but labels speak for them."""
    monkeypatch.setattr(subjects, "LEAST_DOCUMENT_SHARE", 0.3)
    about = spark.createDataFrame([("law", "courts"), ("music", "songs"), ("mapcraft", "tiles, with none of the other subjects")], "subject string, description string")
    law, music = "The tribunal gave its verdict here. ", "They sang a melody in the hall. "
    documents = frame(spark, [(i, (law if i < 20 else music) * 4, None) for i in range(200)], DOCUMENTS)
    labels = spark.createDataFrame([(i, "law" if i < 20 else "music") for i in range(10, 60)], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(documents, labels, about).collect()}
    assert got == {(i, "law" if i < 20 else "music") for i in range(200)}


@pytest.fixture(scope="module")
def connection():
    return oracle.views(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, connection: duckdb.DuckDBPyConnection, name):
    assert oracle.differences(queries.QUERIES[name](spark, FOLDER).toPandas(), connection.sql(queries.SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys() - {"p3_collisions"}))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
