"""Splits, first-wins, windows, audits, nested records, sources, sinks, ingestion."""

from __future__ import annotations

import json
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.decode import decoded
from tessera.functions.text import fold, folding_table, normal, ordering
from tessera.operators import audit, batch, curate, evaluate, generate, local, nested, windows
from tessera.runtime import join_unique
from tessera.sources import documents, runs, samples, sinks
from tessera.streaming import ingest


@pytest.mark.parametrize(("n", "sizes"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (2, 0, 0)), (7, (5, 1, 1)), (10, (8, 1, 1)), (11, (9, 1, 1)), (1000, (800, 100, 100)), (927, (741, 93, 93))])
def test_split_sizes(n, sizes):
    assert tuple(curate.split_sizes(n).values()) == sizes


def test_ratio_sizes():
    assert curate.ratio_sizes(143, [0.8, 0.1, 0.1]) == [115, 14, 14]
    assert curate.ratio_sizes(2, [0.7, 0.2, 0.1]) == [1, 1, 0]


@given(st.integers(0, 5000))
@settings(max_examples=50, deadline=None)
def test_sizes_sum(n):
    assert sum(curate.split_sizes(n).values()) == n == sum(curate.ratio_sizes(n, [0.7, 0.2, 0.1]))


@pytest.mark.parametrize(("groups", "fraction", "n"), [(1, 0.2, 0), (10, 0, 0), (10, 0.25, 2), (2, 0.9, 1), (3, 0.01, 1)])
def test_validation_size(groups, fraction, n):
    assert curate.validation_size(groups, fraction) == n


def test_seeded_split_is_independent_of_order(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("g"))
    made = [curate.seeded_split(r.withColumn("d", ordering(7, F.col("g"))), "d", tuple(curate.split_sizes(1000).items())) for r in (rows, rows.orderBy(F.desc("g")).repartition(7))]
    a, b = ({(r.g, r.split) for r in m.collect()} for m in made)
    assert a == b and len(a) == 1000
    want = sorted((ordering_digest(g), g) for g, _ in a)
    assert {g for _, g in want[:800]} == {g for g, s in a if s == "train"}


def ordering_digest(g):
    import hashlib

    return hashlib.sha256(f"7:{g}".encode()).hexdigest()


def test_first_wins(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y"), (None, 4, "z"), (None, 5, "z")], "g string, n int, v string")
    assert {(r.g, r.n) for r in curate.first_wins(rows, "g", ["n"]).collect()} == {("a", 1), ("b", 3), (None, 4)}


def test_normal_forms(spark):
    texts = ["  Große  Straße\n", "ABC", "ＡＢＣ １２", "ﬁne\u2003Ⅳ", "e\u0301té", "ΣΑΣ", "\x1ca\x1f b", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.a for r in rows.select(normal(F.col("t")).alias("a")).collect()]
    assert got == [fold(t) for t in texts] and got[:5] == ["grosse strasse", "abc", "abc 12", "fine iv", "été"]
    table = dict(folding_table())
    by_table = lambda t: " ".join(unicodedata.normalize("NFC", "".join(table.get(c, c.lower()) for c in t)).split())
    assert [by_table(t) for t in texts[:-1]] == got[:-1]


@pytest.mark.parametrize(("length", "start", "size", "overlap"), [(40, 10, 128, 32), (300, 90, 128, 32), (800, 250, 128, 32), (500, 128, 128, 32), (700, 512, 128, 32), (129, 1, 128, 127)])
def test_windows_label_each_answer_token_once(spark, length, start, size, overlap):
    rows = spark.createDataFrame([(list(range(1, length + 1)), start)], "ids array<int>, start int")
    made = windows.assistant_windows(rows, "ids", "start", F.lit(size), F.lit(overlap)).orderBy("window").collect()
    labelled = [x for r in made for x in r.labels if x != windows.UNLABELLED]
    assert labelled == list(range(start + 1, length + 1))
    assert all(len(r.input_ids) == len(r.labels) <= size and r.labels[0] == windows.UNLABELLED for r in made)


def test_windows_refuse_bad_rows(spark):
    rows = spark.createDataFrame([([1, 2], 0), ([1, 2], 2), ([], 1), (None, 1)], "ids array<int>, start int")
    kept = windows.assistant_windows(rows, "ids", "start", F.lit(8), F.lit(2), strict=False).collect()
    assert [r.error for r in kept] == ["the answer doesn't begin within the tokens"] * 4 and all(r.input_ids is None and r.window is None for r in kept)
    with pytest.raises(Exception, match="doesn't begin"):
        windows.assistant_windows(rows, "ids", "start", F.lit(8), F.lit(2)).collect()
    long = spark.createDataFrame([(list(range(20)), 3)], "ids array<int>, start int")
    errors = lambda *a: [r.error for r in windows.assistant_windows(long, "ids", "start", *map(F.lit, a), strict=False).collect()]
    assert errors(8, 2, "error") == ["the sequence is longer than a window"] and errors(20, 2, "error") == [None]
    assert errors(8, 8, "error")[0].startswith("the overlap") and errors(8, 2, "x") == ["the policy is unknown"] and errors(8, 2, "chunk_assistant") == [None] * 3
    padded = spark.createDataFrame([([1, 2],)], "ids array<int>").select(windows.padded("ids", F.lit(4), 0).alias("p"))
    assert padded.first().p == [1, 2, 0, 0]


def test_audits(spark):
    log = spark.createDataFrame([(1, i, s, c) for i, (s, c) in enumerate([("e", 1), ("e", 2), ("ok", 4), ("e", 1), ("e", 1), ("e", 9), ("ok", 1)])], "a int, seq int, s string, c int")
    bad = F.col("s") == "e"
    assert audit.breakers(log, "a", ["seq"], bad).collect()[0].first == 5
    assert audit.within_budget(log, "a", ["seq"], F.col("c"), 7).count() == 3
    assert audit.until_stop(log, "a", ["seq"], F.col("s") == "ok").count() == 3
    assert audit.latest(log.withColumn("s", F.when(F.col("seq") < 6, F.col("s"))), "a", ["seq"], "s").collect()[0].s is None


RECORD = {
    "run_id": "r", "deep": {"world": {"objects": [None, {"id": "a", "attributes": {"tags": "lone"}}, {"id": "b", "attributes": {"tags": ["x", None, "y"]}}, {"id": "b"}], "relations": {"source": "a", "target": "zz"}}},
    "expectations": {"object_counts": [{"object_type": "tree", "count": 2}], "minimum_relations": {"near": 1}},
}


def test_nested_children(spark):
    inner = json.dumps({"world": json.dumps(RECORD["deep"]["world"])})
    texts = [("1", json.dumps(RECORD)), ("1", json.dumps(RECORD)), ("2", inner), ("3", "[]"), ("4", None), ("5", "{cut"), ("6", ""), (None, "{}")]
    rows = spark.createDataFrame([(*t, "clash", 9) for t in texts], "run_id string, record string, tab string, ord int")
    got = sorted((r.run_id, r.child, r.pos, r["sub"], r.label) for r in nested.world_children(rows).collect())
    world = [("object", 1, 0, "a"), ("object", 2, 0, "b"), ("object", 3, 0, "b"), ("relation", 0, 0, "a>zz"), ("tag", 1, 0, "lone"), ("tag", 2, 0, "x"), ("tag", 2, 2, "y")]
    counts = [("minimum_relation", 0, 1, "near"), ("object_count", 0, 2, "tree")]
    assert got == sorted([("1", *c) for c in world + counts] + [("2", *c) for c in world])
    assert nested.world_children(rows.limit(0)).count() == 0


def test_nested_links(spark):
    rows = spark.createDataFrame([("1", json.dumps({"a": {"b": [{"c": 1, "d": {"e": 2}}, {"c": 3}]}, "n": {"n": {"v": 1}}}))], "k string, j string")
    plan = nested.layout(nested.schema_graph(rows, "j"))
    assert "b" in plan.tables and "n" in plan.tables and "a" not in plan.tables and "d" not in plan.tables
    flat = nested.flatten(rows, "k", "j", plan).collect()
    keys = {r.row_id for r in flat}
    assert all(r.parent_id is None or r.parent_id in keys for r in flat) and len(keys) == len(flat)
    assert [r.fields.get("d.e") for r in flat if r.tab == "b"] == ["2", None]


def test_flat_tables_are_typed(spark):
    texts = [("1", json.dumps({"title": "a", "row_id": 7, "size": {"w": 1, "h": 2.5}, "parts": [{"n": 1, "ok": True}, None, {"n": 2, "ok": None, "more": {"deep": "x"}}], "tags": [1, 2.5]})), ("2", json.dumps({"title": 5, "parts": {"n": 3}})), ("3", "[]")]
    made = nested.flat_tables(spark.createDataFrame(texts, "k string, j string"), "k", "j")
    assert set(made) == {"$", "parts", "tags"}
    kinds = {t: {f.name: f.dataType.simpleString() for f in made[t].schema if f.name not in ("k", "row_id", "parent_tab", "parent_id", "ord")} for t in made}
    assert kinds == {"$": {"row_id_": "bigint", "size_w": "bigint", "size_h": "double", "title": "string"}, "parts": {"n": "bigint", "ok": "boolean", "more_deep": "string"}, "tags": {"value": "double"}}
    assert sorted((r.k, r.ord, r.n, r.ok, r.more_deep) for r in made["parts"].collect()) == [("1", 0, 1, True, None), ("1", 2, 2, None, "x"), ("2", 0, 3, None, None)]
    linked = made["parts"].alias("p").join(made["$"].alias("r"), F.expr("p.k = r.k AND p.parent_id = r.row_id AND p.parent_tab = '$'"))
    assert linked.count() == 3 and sorted(r.value for r in made["tags"].collect()) == [1.0, 2.5]
    assert {r.title for r in made["$"].collect()} == {"a", "5"}


def test_join_with_hot_key(spark, monkeypatch):
    import tessera.runtime as runtime

    left = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    keys = runtime.hot_keys(left, "k", 1000, 100)
    assert [tuple(r) for r in keys.collect()] == [("hot", runtime.SALTS)] and runtime.hot_keys(left, "k", 100, 100) is None
    hot = runtime.hot_keys
    monkeypatch.setattr(runtime, "hot_keys", lambda df, key, total: hot(df, key, total, 100))
    assert join_unique(left, right, "k", 1000).count() == 1000
    monkeypatch.setattr(runtime, "MOST_NAMED", 0)
    assert join_unique(left, right, "k", 1000).count() == 1000
    assert join_unique(left, right.where("v > 3"), "k", 1000, "left").where("v IS NULL").count() == 1000 - left.where("length(k) > 3").count()


def test_stored_tables(spark):
    import tessera.runtime as runtime

    kept = runtime.store(spark.range(5), "five")
    assert kept.rows == 5 and sorted(r["id"] for r in runtime.read_folder(kept.folder)) == [0, 1, 2, 3, 4]
    kept.drop()
    assert not documents.exists(spark, kept.folder)


def test_sources_and_sinks(spark, tmp_path):
    lines = tmp_path / "p.jsonl"
    lines.write_bytes("\ufeff{\"id\": \"b\", \"prompt\": \"Two lines\"}\r\n\n{\"id\": \"a\", \"prompt\": \"One\"}\n".encode())
    found = documents.prompts(spark, str(lines))
    assert found.count() == 2 and documents.prompts(spark, str(lines), 1).first().id == "a"
    with pytest.raises(ValueError):
        documents.prompts(spark, str(lines), 3)
    (tmp_path / "q.jsonl").write_text('{"id": "b", "prompt": "Two"}\n{"id": "a", "prompt": " two "}\n')
    with pytest.raises(ValueError):
        documents.prompts(spark, str(tmp_path / "q.jsonl"))
    rows = found.select("id", "prompt")
    place = str(tmp_path / "once")
    assert sinks.write_once(rows, place) == sinks.write_once(rows.orderBy(F.desc("id")), place)
    with pytest.raises(ValueError):
        sinks.write_once(rows.limit(1), place)
    for n in ("run_2", "run_1"):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "record.json").write_text('{"x": 1}' if n == "run_1" else "{")
    assert [str(r.reason) for r in documents.run_records(spark, str(tmp_path / "runs")).collect()] == ["None", "the record can't be read"]
    assert documents.resolve(spark, str(tmp_path)).count() == 1
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 1}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 3}}')
    assert documents.config(tmp_path / "own.json") == {"a": {"x": 1, "y": 3}, "b": 1}
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        documents.config(tmp_path / "loop.json")
    chat = spark.createDataFrame([("a", "g", "train", [("system", "s"), ("user", "u"), ("assistant", "r")])], "id string, prompt_group string, split string, messages array<struct<role:string,content:string>>")
    assert sinks.export(chat, str(tmp_path / "out"))["counts"] == {"train": 1}
    assert spark.read.json(str(tmp_path / "out/alpaca")).first().instruction == "u"
    assert "| accuracy | 50.00% | n/a | n/a |" in sinks.comparison({"accuracy": [0.5, None]}, ["a", "b"])
    with pytest.raises(ValueError):
        documents.replay(rows, {"One": "1"})


def test_contract_and_lock(tmp_path):
    sinks.freeze(tmp_path / "c.json", {"seed": 1})
    sinks.freeze(tmp_path / "c.json", {"seed": 1})
    with pytest.raises(ValueError):
        sinks.freeze(tmp_path / "c.json", {"seed": 2})
    with sinks.single_writer(tmp_path), pytest.raises(RuntimeError), sinks.single_writer(tmp_path):
        pass
    with sinks.single_writer(tmp_path):
        pass


def test_attempts(spark):
    record = json.dumps({"run_id": "r", "attempts": [{"number": 1, "status": "invalid", "provider": {"requested_model": "m", "usage": {"total_tokens": 5}}}, {"number": 2, "status": None, "provider": {"usage": None}}]})
    made = runs.reported(runs.attempts_of(spark.createDataFrame([("r", record), ("q", "{}"), ("p", None)], "run_id string, record string")))
    assert [tuple(r) for r in made.collect()] == [("r", 2, 5, 1, None)]
    reasons = spark.createDataFrame([("success", ["a"]), ("failed", ["b", "a", "b"]), ("failed", None), (None, None)], "s string, c array<string>").select(runs.failure_reasons(F.col("s"), F.col("c")).alias("r"))
    assert [r.r for r in reasons.collect()] == [[], ["a", "b"], ["failed"], ["interrupted"]]


def test_verdicts(spark):
    world = {"scene": "mill", "objects": [{"object_type": "house", "id": "a", "position": [1, 1]}]}
    bad = world | {"relations": [{"relation_type": "near", "source": "a", "target": "a"}]}
    wants = ({"house": 1}, None, {})
    rows = [("ok", json.dumps(world), wants), ("free", json.dumps(world), None), ("count", json.dumps(world), ({"tree": 1, "house": 1}, None, None)), ("map", json.dumps(world), (None, (8, 8, "city"), None)), ("few", json.dumps(world), (None, None, {"near": 1})), ("geo", json.dumps(bad), wants), ("json", "{", wants), ("null", None, wants)]
    frame = spark.createDataFrame(rows, "k string, raw string, e struct<object_counts:map<string,int>,map_spec:struct<width:int,height:int,biome:string>,minimum_relations:map<string,int>>")
    got = {r.k: (r.status, r.codes) for r in evaluate.verdicts(frame, "raw", "e").collect()}
    assert got == {"ok": ("valid", []), "free": ("valid", []), "count": ("invalid_expectations", ["object_count"]), "map": ("invalid_expectations", ["map_mismatch"]), "few": ("invalid_expectations", ["relation_count"]), "geo": ("invalid_spatial", ["self_relation"]), "json": ("invalid_schema", ["json_invalid"]), "null": ("invalid_schema", ["json_invalid"])}
    assert evaluate.rates(evaluate.verdicts(frame.withColumn("v", F.lit(1)), "raw", "e"), "v").first().expectations_rate == 0.125


def test_generators(spark):
    one, two = generate.inventory(spark, 70, 3), generate.inventory(spark, 20, 3)
    assert one.select("prompt").distinct().count() == 70 and two.join(one, ["id", "prompt"]).count() == 20
    assert {r.n for r in one.groupBy("theme").agg(F.count("*").alias("n")).collect()} == {10}
    with pytest.raises(ValueError):
        generate.inventory(spark, 0, 1)
    made = generate.tasks(spark, 9, 5)
    same = lambda df: sorted(map(str, df.collect()))
    assert made.where("witness IS NOT NULL").count() == 9 and same(made) == same(generate.tasks(spark, 9, 5).repartition(3))
    assert {(r.difficulty, r.objects, r.relations) for r in made.collect()} == {("easy", 3, 1), ("medium", 5, 2), ("hard", 9, 3)}
    frozen = generate.benchmark(spark, 20, 1)
    assert {r.difficulty: r.n for r in frozen.groupBy("difficulty").agg(F.count("*").alias("n")).collect()} == {"easy": 6, "medium": 8, "hard": 6}
    assert decoded(frozen, "witness").where("schema_ok").count() == 20
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "y")], "n int, g string, f string")
    assert sorted(r.n for r in generate.greedy_distinct(rows, "n", ("g", "f")).collect()) == [1, 4]
    rng = random.Random(2)
    many = [(i, f"g{rng.randrange(40)}", rng.choice([None, *(f"f{j}" for j in range(40))])) for i in range(200)]
    seen, want = (set(), set()), []
    for i, g, f in many:
        if g not in seen[0] and f not in seen[1]:
            want.append(i)
            seen[0].add(g)
            seen[1].add(f)
    assert sorted(r.n for r in generate.greedy_distinct(spark.createDataFrame(many, "n int, g string, f string"), "n", ("g", "f")).collect()) == want
    wanted = spark.createDataFrame([(1, "a", "x", True), (2, "p", "y", True), (3, "b", "k", True), (4, "c", "x", True), (5, "d", "z", False)], "seq int, grp string, fingerprint string, valid boolean")
    good, bad = generate.curriculum(wanted, spark.createDataFrame([("p",)], "grp string"), spark.createDataFrame([("k",)], "fingerprint string"))
    assert [r.seq for r in good.collect()] == [1] and {r.seq: r.reason for r in bad.collect()} == {2: "protected_prompt", 3: "known_world", 4: "duplicate", 5: "invalid"}
    cases = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, prompt string")
    backend = lambda prompts, feedback: [p if f is None else p + f for p, f in zip(prompts, feedback)]
    judge = lambda raws: raws.select("id", (F.col("raw") != "q").alias("passed"), F.lit("!").alias("feedback"))
    assert sorted(tuple(r) for r in generate.repair_rounds(cases, backend, judge).collect()) == [("a", 1, "p", True), ("b", 1, "q", False), ("b", 2, "q!", True)]


def test_batch_goes_on_and_stops(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{i}", "good" if i < 4 else "bad") for i in range(10)], "id string, prompt string")
    backend = lambda prompts, feedback: list(prompts)
    judge = lambda raws: raws.select("id", (F.col("raw") == "good").alias("passed"), F.lit("!").alias("feedback"))
    place = str(tmp_path / "run")
    first = batch.run_batch(cases, backend, judge, place, block=2, attempts=2, budget=3)
    assert first == {"reason": "budget", "planned": 10, "passed": 4, "failed": 0, "not_run": 6, "attempts": 4}
    (tmp_path / "run/stop").write_text("")
    assert batch.run_batch(cases, backend, judge, place, block=2)["reason"] == "stopped"
    (tmp_path / "run/stop").unlink()
    assert batch.run_batch(cases, backend, judge, place, block=2, attempts=1, breaker=2) == {"reason": "breaker", "planned": 10, "passed": 4, "failed": 4, "not_run": 2, "attempts": 8}
    assert batch.run_batch(cases, backend, judge, place, block=5, attempts=1)["reason"] == "finished"
    assert spark.read.parquet(f"{place}/blocks").count() == 10


def test_sample_worlds_are_sound(spark):
    made = local.with_issues(evaluate.as_rows(decoded(samples.sample_worlds(spark), "raw")))
    assert [(r.schema_ok, r.issues) for r in made.collect()] == [(True, [])] * 5


def test_snapshot_and_benchmark(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", "success", ["m"]), ("b", "val", "success", ["m"]), ("c", None, "failed", ["m"]), ("d", "train", None, None)], "id string, split string, status string, messages array<string>")
    made = sinks.export_snapshot(rows, str(tmp_path / "s"))
    assert {k: v["rows"] for k, v in made.items()} == {"train": 1, "val": 1, "test": 0, "valid": 2, "failed": 2, "membership": 2}
    assert "messages" not in spark.read.json(str(tmp_path / "s/failed")).columns and json.loads((tmp_path / "s/manifest.json").read_text()) == made
    grown = sinks.export_snapshot(rows.withColumn("split", F.lit("test")), str(tmp_path / "t"))
    assert grown["test"]["rows"] == 2 and grown["valid"] == made["valid"]
    tasks = generate.benchmark(spark, 10, 1)
    assert sinks.freeze_benchmark(tasks, str(tmp_path / "b")) == sinks.freeze_benchmark(tasks, str(tmp_path / "b"))
    assert "witness" not in spark.read.parquet(str(tmp_path / "b")).columns
    with pytest.raises(ValueError):
        sinks.freeze_benchmark(generate.benchmark(spark, 10, 2), str(tmp_path / "b"))


def test_ingest_admits_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), (None, 3)], "id string, v int")
    rows.coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, rows.schema, target, str(tmp_path / "cp"), "id").awaitTermination()
    spark.createDataFrame([("b", 2), ("c", 3)], rows.schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, rows.schema, target, str(tmp_path / "cp"), "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_state_log(spark):
    log = spark.createDataFrame([("a", "running", 1), ("a", "finished", 2), ("b", "running", 3), ("c", "finished", 4), ("a", "finished", 5)], "id string, state string, seq int")
    assert {(r.id, r.seq) for r in ingest.illegal_transitions(log).collect()} == {("c", 4), ("a", 5)}
    assert [r.id for r in ingest.recover(log).collect()] == ["b"]
    cases = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in ingest.pending(cases, log).collect()] == ["z"]
