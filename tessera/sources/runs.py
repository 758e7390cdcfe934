"""Audited runs and their attempts, as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempts_of(runs: DataFrame) -> DataFrame:
    """(run_id, number, status, model, tokens): the attempts in runs(run_id, record), from the record wherever it holds them;
    usage that is missing or no number is null."""
    from tessera.operators import nested

    plan = nested.layout(nested.schema_graph(runs, "record"), always=("attempts",))
    flat = nested.flatten(runs, "run_id", "record", plan, ("attempts", "provider", "usage"))
    field = F.col("fields")
    rows = flat.where("tab = 'attempts'").select(
        "run_id", field["number"].try_cast("int").alias("number"), field["status"].alias("status"),
        F.coalesce(field["provider.requested_model"], field["provider.actual_model"]).alias("model"), field["provider.usage.total_tokens"].try_cast("long").alias("tokens"),
    )
    return rows.where("number IS NOT NULL")


def reported(attempts: DataFrame) -> DataFrame:
    """(run_id, attempts, tokens, without_usage, last_status): of each run, the status being the last attempt's, even a null."""
    return attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("without_usage"),
        F.max_by(F.struct("status"), "number")["status"].alias("last_status"),
    )


def failure_reasons(status: Column, codes: Column) -> Column:
    """Sorted distinct codes of a failed run, its status if it has none; nothing for a success."""
    found = F.array_sort(F.array_distinct(F.coalesce(codes, F.array().cast("array<string>"))))
    return F.when(status == "success", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.coalesce(status, F.lit("interrupted")))).otherwise(found)


def accepted_response(finish_reason: Column, content: Column, refusal: Column, choices: Column | None = None) -> Column:
    """Why a provider's response is not taken, null if it is: without choices (where their number is given), refused, not
    finished, or without content."""
    none = F.lit(False) if choices is None else F.coalesce(choices, F.lit(0)) == 0
    return F.when(none, "no_choices").when(refusal.isNotNull(), "refusal").when(~finish_reason.eqNullSafe("stop"), "unfinished").when(content.isNull() | ~content.rlike(r"(?U)\S"), "empty")
