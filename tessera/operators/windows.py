"""Overlapping token windows that label every answer token exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of a position that isn't learned.
UNLABELLED = -100


#: What is done with a sequence that is longer than a window.
POLICIES = ("chunk_assistant", "error")


def window_error(size: Column, start: Column, max_length: Column, overlap: Column, policy: Column) -> Column:
    """Why a sequence can't be parted into windows, null if it can."""
    return (
        F.when(~F.coalesce((start > 0) & (start < size), F.lit(False)), "the answer doesn't begin within the tokens")
        .when(~F.coalesce((overlap >= 1) & (overlap < max_length), F.lit(False)), "the overlap isn't between one and the length")
        .when(~F.coalesce(policy.isin(*POLICIES), F.lit(False)), "the policy is unknown")
        .when((policy == "error") & (size > max_length), "the sequence is longer than a window")
    )


def assistant_windows(rows: DataFrame, ids: str, start: str, max_length: Column, overlap: Column, policy: Column | None = None, strict: bool = True) -> DataFrame:
    """rows with window, begin, input_ids, labels: windows of at most max_length tokens that overlap by `overlap`. A token is
    labelled in the first window it comes in, but never at a window's first place; a window without a label is left out.
    All in column expressions. A row that window_error() speaks against fails the query; unless `strict` is false: then it
    is kept as one row with its error and without a window."""
    size = F.size(ids)
    step = max_length - overlap
    error = window_error(size, F.col(start), max_length, overlap, F.lit(POLICIES[0]) if policy is None else policy)
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    made = rows.withColumn("error", error)
    count = F.when(F.col("error").isNull(), 1 + F.ceil(F.greatest(size - max_length, F.lit(0)) / step)).otherwise(1)
    each = made.withColumn("window", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    good = F.col("error").isNull()
    each = each.withColumn("begin", F.when(good, (F.col("window") * step).cast("int")))
    each = each.withColumn("_end", F.least(F.col("begin") + max_length, size).cast("int"))
    # What the windows before have labelled ends where the one before this ends.
    covered = F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("begin") - step + max_length)
    each = each.withColumn("_first", F.greatest(F.col(start), covered, F.col("begin") + 1).cast("int")).where(~good | (F.col("_first") < F.col("_end")))
    tokens = F.when(good, F.slice(F.col(ids), F.coalesce(F.col("begin"), F.lit(0)) + 1, F.coalesce(F.col("_end") - F.col("begin"), F.lit(0))))
    labels = F.transform(tokens, lambda t, i: F.when(i + F.col("begin") < F.col("_first"), UNLABELLED).otherwise(t))
    return each.withColumns({"window": F.when(good, F.col("window")), "input_ids": tokens, "labels": labels}).drop("_end", "_first")


def padded(column: str, length: Column, fill: int) -> Column:
    """An array filled up to a length."""
    return F.concat(F.col(column), F.array_repeat(F.lit(fill), F.greatest(length - F.size(column), F.lit(0)).cast("int")))


def encode_chat(messages: list[dict], template: Callable[[list[dict], bool], list[int]]) -> tuple[list[int], int]:
    """Token ids of a chat and the place where its answer begins. template(messages, open) gives the ids of messages, with an
    open answer if asked; the chat with its answer must go on from the ids before it."""
    if [m.get("role") for m in messages] != ["system", "user", "assistant"]:
        raise ValueError("a training chat has a system, a user and an assistant turn")
    before, whole = template(messages[:2], True), template(messages, False)
    if whole[: len(before)] != before or len(whole) <= len(before):
        raise ValueError("the template doesn't keep what comes before the answer")
    return whole, len(before)
