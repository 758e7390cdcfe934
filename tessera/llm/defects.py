"""Problem 2: broken prompt and response pairs.

The answers are parsed where they lie, without a shuffle. Only those that could repeat their question or be in another
language are brought together with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.answers import ending, ends_with_question, in_other_language, is_copied, is_empty, is_refusal
from tessera.runtime import join_unique

DEFECTS = ("refusal", "empty", "truncated", "copied", "other_language")


def questions(messages: DataFrame, suite: DataFrame) -> DataFrame:
    """(id, question): the first user turn of each id that has content, or the prompt of its suite case."""
    asked = messages.where("role = 'user' AND content IS NOT NULL AND id IS NOT NULL")
    asked = asked.groupBy("id").agg(F.min(F.struct("turn", "message_key", "content")).alias("m")).select("id", F.col("m.content").alias("question"))
    cases = suite.where("id IS NOT NULL AND prompt IS NOT NULL").groupBy("id").agg(F.min("prompt").alias("question"))
    return asked.unionByName(cases).groupBy("id").agg(F.max("question").alias("question"))


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The verdict that needs no question; `ask` with the kind and the text where it does."""
    for frame in frames:
        out = []
        for key, name, text, error in zip(frame["prediction_key"], frame["id"], frame["raw_response"], frame["error"]):
            if is_refusal(text, error):
                out.append((key, name, "refusal", None, None))
            elif is_empty(text):
                out.append((key, name, "empty", None, None))
            else:
                kind, verdict = ending(text)
                if verdict == "cut":
                    out.append((key, name, "truncated", None, None))
                elif kind != "world":
                    out.append((key, name, "ask", f"{kind} {verdict}", text))
        yield pd.DataFrame(out, columns=["prediction_key", "id", "defect", "kind", "text"])


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for key, defect, kind, text, question in zip(frame["prediction_key"], frame["defect"], frame["kind"], frame["text"], frame["question"]):
            if defect != "ask":
                out.append((key, defect))
                continue
            question = question if isinstance(question, str) and question.strip() else None
            if kind.endswith("open") and not (question and ends_with_question(text, question)):
                out.append((key, "truncated"))
            elif question and is_copied(text, question):
                out.append((key, "copied"))
            elif question and kind.startswith("prose") and in_other_language(text, question):
                out.append((key, "other_language"))
        yield pd.DataFrame(out, columns=["prediction_key", "defect"])


def broken_pairs(predictions: DataFrame, messages: DataFrame, suite: DataFrame) -> DataFrame:
    """(prediction_key, defect): one row for each broken pair. The first defect of DEFECTS that applies is given.
    A row delivered twice is one pair; without a question a pair can be refusal, empty or truncated only; null keys
    have no row; an empty table gives none."""
    rows = predictions.where("prediction_key IS NOT NULL").select("prediction_key", "id", "raw_response", "error")
    key = predictions.schema["prediction_key"].dataType.simpleString()
    parsed = rows.mapInPandas(_parse, f"prediction_key {key}, id string, defect string, kind string, text string")
    # The answers are parsed once. Decided rows go along under keys of their own, which match no question and part evenly.
    parsed = parsed.withColumn("id", F.when((F.col("defect") == "ask") & F.col("id").isNotNull(), F.col("id")).otherwise(F.concat(F.lit("\x00"), "prediction_key")))
    joined = join_unique(parsed, questions(messages, suite), "id", predictions.count(), "left", counted=predictions.select("id"))
    compared = joined.select("prediction_key", "defect", "kind", "text", "question").mapInPandas(_compare, f"prediction_key {key}, defect string")
    return compared.dropDuplicates(["prediction_key"])
