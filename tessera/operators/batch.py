"""A batch of generated samples, block by block: it goes on where a broken run stopped, and stops by file, budget or breaker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.generate import repair_rounds
from tessera.runtime import cut
from tessera.sources.documents import exists


def committed(cases: DataFrame, folder: str) -> DataFrame | None:
    """The attempts that earlier blocks have committed under folder, None if there are none. A block is a folder of its own that
    is renamed into place, so a broken one has left nothing."""
    spark = cases.sparkSession
    return spark.read.parquet(f"{folder}/blocks") if exists(spark, f"{folder}/blocks") else None


def run_batch(
    cases: DataFrame, backend: Callable[[list[str], list[str | None]], list[str]], validate: Callable[[DataFrame], DataFrame], folder: str,
    block: int = 1000, attempts: int = 3, budget: int | None = None, breaker: int = 3,
) -> dict:
    """Runs cases(id, prompt) in order of their ids, `block` at a time, and appends (id, attempt, raw, passed) of each block to
    folder. A case that is there already isn't run again. It ends when no case is left (`finished`), when a file `stop` lies in
    folder (`stopped`), when a block would begin beyond the budget of attempts (`budget`), or after `breaker` blocks in a row
    without a passed case (`breaker`). Returns the reason and the counts of planned, passed, failed and not run cases."""
    spark = cases.sparkSession
    planned = cut(cases.where("id IS NOT NULL").select("id", "prompt").dropDuplicates(["id"]))
    bad = 0
    while True:
        done = committed(cases, folder)
        left = planned if done is None else planned.join(done.select("id"), "id", "left_anti")
        spent = 0 if done is None else done.count()
        chosen = cut(left.orderBy("id").limit(block))
        reason = (
            "stopped" if exists(spark, f"{folder}/stop")
            else "finished" if not chosen.limit(1).count()
            else "budget" if budget is not None and spent >= budget
            else "breaker" if bad >= breaker
            else None
        )
        if reason:
            break
        made = cut(repair_rounds(chosen, backend, validate, attempts))
        made.write.mode("append").parquet(f"{folder}/blocks")
        bad = 0 if made.where("passed").limit(1).count() else bad + 1
    passed = 0 if done is None else done.where("passed").select("id").distinct().count()
    run = 0 if done is None else done.select("id").distinct().count()
    total = planned.count()
    return {"reason": reason, "planned": total, "passed": passed, "failed": run - passed, "not_run": total - run, "attempts": spent}
