"""Gates, feedback, scalars, single worlds, chat encoding."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import admission, windows
from tessera.sources import documents


def test_gates(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/w.json").write_bytes(b"{}")
    good = hashlib.sha256(b"{}").hexdigest()
    chat = [("system", "s"), ("user", "u"), ("assistant", "a")]
    rows = [(1, "llm", chat, "a/w.json", good.upper()), (2, "hand", chat, "a/w.json", good), (3, "llm", chat[1:], "a/w.json", good), (4, "llm", chat, "../w.json", good), (5, "llm", chat, "a/x.json", good), (6, "llm", chat, "a/w.json", "0"), (7, "llm", None, None, None)]
    samples = spark.createDataFrame(rows, "k int, source string, messages array<struct<role:string,content:string>>, world_path string, world_sha256 string")
    made = admission.admitted(samples, admission.artefacts(spark, str(tmp_path), "*.json"), {"source": F.lit("llm")})
    assert {r.k: r.reason for r in made.collect()} == {1: None, 2: "source", 3: "roles", 4: "path", 5: "artefact", 6: "checksum", 7: "roles"}


def test_paths_and_magic(spark):
    rows = spark.createDataFrame([("a/b",), ("/a",), ("a/../../b",), ("C:\\x",), ("",), (None,)], "p string")
    assert [r.g for r in rows.select(admission.is_contained(F.col("p")).alias("g")).collect()] == [True, False, False, False, False, False]
    images = spark.createDataFrame([(bytes.fromhex(admission.PNG_MAGIC) + b"x",), (b"GIF89a",), (b"",)], "c binary")
    assert [r.g for r in images.select(admission.is_png(F.col("c")).alias("g")).collect()] == [True, False, False]


def test_feedback(spark):
    rows = spark.createDataFrame([(["hint"], [("overlap", "a, b")], [("a", 1, 2, 3, 4)]), (None, None, None), (["x" * 9000], [], [])], "h array<string>, i array<struct<code:string,message:string>>, b array<struct<id:string,x:int,y:int,r:int,b:int>>")
    got = [r.t for r in rows.select(admission.feedback(F.col("h"), F.col("i"), F.col("b")).alias("t")).collect()]
    assert got[0].split("\n")[0] == "hint" and got[0].endswith("a [1,2,3,4]") and got[1] == "" and len(got[2]) == admission.FEEDBACK_CHARS


def test_scalars(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-01-01T00:00:01.5Z"), ("2026-01-02", "2026-01-01"), ("x", "2026-01-01"), (None, None)], "a string, b string")
    assert [r.s for r in rows.select(scalars.seconds_between(F.col("a"), F.col("b")).alias("s")).collect()] == [1.5, None, None, None]
    made = spark.createDataFrame([(2.5,), (float("nan"),), (float("inf"),), (None,)], "v double").select(scalars.finite(F.col("v")).alias("f"), scalars.seed_of(F.lit("x"), 16).alias("s"))
    assert [r.f for r in made.collect()] == [True, False, False, False]
    assert int(made.first().s) == int(hashlib.sha256(b"x").hexdigest()[:16], 16)


def test_world_file(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"scene": "mill", "objects": [{"object_type": "house", "id": "a", "position": [31, 1], "attributes": {"size": [2, 1]}}]}))
    made = documents.load_world(spark, str(tmp_path / "w.json"))
    assert [i.code for i in made.first().issues] == ["out_of_bounds"]
    documents.save_world(made, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).first().value
    back = documents.load_world(spark, str(tmp_path / "out"))
    assert back.select("world", "issues").collect() == made.select("world", "issues").collect() and back.first().schema_ok
    assert json.loads(again)["map"] == {"width": 32, "height": 24, "biome": "forest"}


def test_chat_encoding():
    template = lambda messages, open_: [x for m in messages for x in (ord(m["role"][0]), len(m["content"]))] + ([ord("a")] if open_ else [])
    chat = [{"role": r, "content": "x"} for r in ("system", "user", "assistant")]
    assert windows.encode_chat(chat, template) == ([115, 1, 117, 1, 97, 1], 5)
    with pytest.raises(ValueError):
        windows.encode_chat(chat[:2], template)
    with pytest.raises(ValueError):
        windows.encode_chat(chat, lambda m, o: [len(m)])
