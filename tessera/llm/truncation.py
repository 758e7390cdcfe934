"""Problem 4: text cut off by field limits.

The length of every answer is recomputed under the encodings a store may count in (characters, bytes, escaped forms,
converted line ends) and grouped: a length at which a source's answers pile up and beyond which it has none is a hidden
limit. The endings of the answers are then inspected together with the limits they lie at: a clear ending decides by
itself, one that may be the whole of a repeated question or a part of it is a cut where the answer lies at a limit. The
limit also names the cause.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.answers import ending, ends_with_question, is_empty, repeats_last_words
from tessera.llm.defects import questions
from tessera.runtime import cut, join_unique

#: A limit is exposed where at least this share of a source's answers, and this many, have the greatest length.
LEAST_SHARE, LEAST_COUNT = 0.03, 3
TOKEN_CHARS = 4


#: What stores may count in, in the order of lengths().
MEASURES = ("characters", "utf8_bytes", "utf16_units", "html_escaped", "json_escaped", "crlf")


def lengths(text: str) -> tuple[int, ...]:
    """The length of a text as stores count it; a replacement character at the end, left of a torn one, is left out."""
    text = text.rstrip("\ufffd")
    chars = len(text)
    octets = chars if text.isascii() else len(text.encode("utf-8", "replace"))
    units = chars if octets == chars else len(text.encode("utf-16-le", "replace")) // 2
    lines, quotes = text.count("\n"), text.count('"')
    html = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes
    json = lines + quotes + text.count("\\") + text.count("\t") + text.count("\r")
    return chars, octets, units, chars + html, chars + json, chars + lines - (text.count("\r\n") if "\r" in text else 0)


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"source": frame["source"].to_numpy(object)} | dict(zip(MEASURES, np.array([lengths(t) for t in frame["raw_response"]], np.int64).reshape(-1, len(MEASURES)).T)))


_COLUMNS = ", ".join(f"{m} long" for m in MEASURES)


def hidden_limits(predictions: DataFrame) -> DataFrame:
    """(source, measure, limit, at_limit, answers): the greatest length of each source's answers under each measure, where
    answers pile up at it. Null answers and sources take no part."""
    texts = predictions.where("raw_response IS NOT NULL AND source IS NOT NULL").select("source", "raw_response")
    return limits_of(texts.mapInPandas(_measure, f"source string, {_COLUMNS}"))


def limits_of(measured: DataFrame) -> DataFrame:
    """hidden_limits() of a table that has the lengths as columns."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])
    each = measured.where("source IS NOT NULL").select("source", F.inline(measures)).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("source", "measure").agg(F.max("length").alias("limit"), F.max_by("n", "length").alias("at_limit"), F.sum("n").alias("answers"))
    return top.where((F.col("at_limit") >= LEAST_COUNT) & (F.col("at_limit") >= LEAST_SHARE * F.col("answers")))


def _inspect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lengths of all answers; with the kind of those that may be cut, and the text where a question and the limits must
    decide."""
    for frame in frames:
        sizes, kinds, texts = [], [], []
        for text in frame["raw_response"]:
            kind, verdict = (None, "whole") if is_empty(text) else ending(text)
            sizes.append(lengths(text))
            kinds.append(None if verdict == "whole" else kind)
            texts.append(text if verdict == "open" else None)
        made = {c: frame[c].to_numpy(object) for c in ("prediction_key", "id", "source", "model")}
        made |= dict(zip(MEASURES, np.array(sizes, np.int64).reshape(-1, len(MEASURES)).T))
        yield pd.DataFrame(made | {"kind": np.array(kinds, object), "text": np.array(texts, object)})


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = np.array([is_cut(t, q, bool(at)) for t, q, at in zip(frame["text"], frame["question"], frame["at_limit"])], bool)
        yield pd.DataFrame({c: frame[c].to_numpy(object)[keep] for c in ("prediction_key", "source", "kind", "cause")})


def is_cut(text: object, question: object, at_limit: bool) -> bool:
    """Whether an answer that isn't whole by itself is cut. Without text its ending has decided. A repetition of a question
    that has no end mark is whole; one that breaks off at a limit with words of the question still to come is not."""
    if not isinstance(text, str) or not isinstance(question, str) or not ends_with_question(text, question):
        return True
    return at_limit and not repeats_last_words(text, question)


def cut_answers(predictions: DataFrame, providers: DataFrame, messages: DataFrame, suite: DataFrame) -> DataFrame:
    """(prediction_key, source, kind, cause): answers that end inside a word, a sentence, a list item or an object.
    cause is `model` at the model's max_tokens, `source` at a hidden limit of the source under any measure, else
    `transfer`. Whole answers of any length are left out, and so are empty ones and repetitions of a question that has no
    end mark either, unless they lie at a limit before its end. A row delivered twice is one answer; null keys have no row."""
    rows = predictions.where("prediction_key IS NOT NULL AND raw_response IS NOT NULL").select("prediction_key", "id", "source", "model", "raw_response")
    key = predictions.schema["prediction_key"].dataType.simpleString()
    # Answers are read once: limits need the lengths of all before any can be judged.
    every = cut(rows.mapInPandas(_inspect, f"prediction_key {key}, id string, source string, model string, {_COLUMNS}, kind string, text string"))
    seen = every.where("kind IS NOT NULL")
    # Limits have a row for each source, models one for each model; the planner checks their size.
    limits = limits_of(every).groupBy("source").agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"limit_{m}") for m in MEASURES])
    models = providers.where("model IS NOT NULL").groupBy("model").agg(F.max("max_tokens").alias("max_tokens"))
    seen = seen.join(limits, "source", "left").join(models, "model", "left")
    # A torn character leaves up to three bytes of a limit in bytes unused.
    at_source = reduce(Column.__or__, [F.col(m).between(F.col(f"limit_{m}") - (3 if m == "utf8_bytes" else 0), F.col(f"limit_{m}")) for m in MEASURES])
    cause = F.when(F.col("characters") >= F.col("max_tokens") * TOKEN_CHARS, "model").when(at_source, "source").otherwise("transfer")
    seen = seen.select("prediction_key", "id", "source", "kind", cause.alias("cause"), "text").withColumn("at_limit", F.col("cause") != "transfer")
    seen = seen.withColumn("id", F.when(F.col("text").isNotNull() & F.col("id").isNotNull(), F.col("id")).otherwise(F.concat(F.lit("\x00"), "prediction_key")))
    joined = join_unique(seen, questions(messages, suite), "id", every.count(), "left", counted=every.where("text IS NOT NULL").select("id"))
    return joined.mapInPandas(_decide, f"prediction_key {key}, source string, kind string, cause string").dropDuplicates(["prediction_key"])


def by_source(predictions: DataFrame, providers: DataFrame, messages: DataFrame, suite: DataFrame) -> DataFrame:
    """(source, answers, truncated, share): how often each source truncates, among its answers that aren't null; a null
    source is its own group."""
    answers = predictions.where("raw_response IS NOT NULL AND prediction_key IS NOT NULL").select("prediction_key", "source").dropDuplicates(["prediction_key"]).groupBy("source").agg(F.count(F.lit(1)).alias("answers"))
    cut = cut_answers(predictions, providers, messages, suite).groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    joined = answers.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "answers", F.coalesce("n", F.lit(0)).alias("truncated"), F.round(F.coalesce("n", F.lit(0)) / F.col("answers"), 6).alias("share"))
