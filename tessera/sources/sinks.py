"""Sinks: files of JSON lines with digests, write-once inventories, exports by split, manifests, reports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(path: str | Path, value: object) -> None:
    """A JSON document, complete or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
    aside = target.with_name(f".{target.name}.tmp")
    with aside.open("w", encoding="utf-8") as out:
        out.write(text + "\n")
        out.flush()
        os.fsync(out.fileno())
    aside.replace(target)


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """write_json() to whatever file system the path names: written aside, then renamed."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, aside = hadoop.Path(path), hadoop.Path(f"{path}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"{path} could not be written")


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON with its members by name, nulls included."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def digest(rows: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or partition: the hash of the sums of the parts of all
    row digests, and of the number of rows. One pass, and a single row comes back."""
    h = F.sha2("value", 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    row = json_rows(rows).agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x or 0) for x in row).encode()).hexdigest()


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A folder of JSON lines, committed as a whole, and its digest."""
    json_rows(rows).write.mode(mode).text(path)
    return digest(rows)


def write_once(rows: DataFrame, path: str) -> str:
    """An inventory that is written once: the same content again changes nothing, other content is refused."""
    spark = rows.sparkSession
    wanted = digest(rows)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        rows.write.parquet(path)
    elif digest(spark.read.schema(rows.schema).parquet(path)) != wanted:
        raise ValueError(f"{path} holds something else")
    return wanted


def append_routed(rows: DataFrame, path: str) -> None:
    """Appends rows to the folders outcome=valid and outcome=failed by their status."""
    rows.withColumn("outcome", F.when(F.col("status") == "success", "valid").otherwise("failed")).write.mode("append").partitionBy("outcome").parquet(path)


def rebuild_routed(samples: DataFrame, path: str) -> None:
    """Both folders anew from the committed samples."""
    samples.withColumn("outcome", F.when(F.col("status") == "success", "valid").otherwise("failed")).write.mode("overwrite").partitionBy("outcome").parquet(path)


def export(samples: DataFrame, path: str) -> dict:
    """Training files of samples(id, prompt_group, split, messages) in two forms, messages and instruction, a folder for each
    split; the membership; and a manifest with counts and digests, which is returned."""
    at = lambda i: F.get("messages", F.lit(i))["content"]
    alpaca = samples.select("split", at(1).alias("instruction"), F.lit("").alias("input"), at(2).alias("output"), at(0).alias("system"))
    samples.select("split", "messages").write.partitionBy("split").json(f"{path}/messages")
    alpaca.write.partitionBy("split").json(f"{path}/alpaca")
    member = samples.select("id", "prompt_group", "split")
    member.write.parquet(f"{path}/membership")
    counts = {r.split: r.n for r in member.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"counts": counts, "digests": {"membership": digest(member), "alpaca": digest(alpaca)}, "columns": {"instruction": "user turn", "output": "assistant turn", "system": "system turn"}}
    write_document(samples.sparkSession, f"{path}/manifest.json", manifest)
    return manifest


#: The files of a snapshot.
SNAPSHOT = ("train", "val", "test", "valid", "failed")


def export_snapshot(samples: DataFrame, path: str) -> dict[str, dict]:
    """The snapshot of samples(id, split, status, ...): folders of JSON lines for each split, all valid and all failed ones,
    and the membership; returns rows and digest by file. Failed samples have no split and keep neither messages nor counts.
    Splits are those of the samples, so they are made anew whenever the snapshot grows."""
    good = F.col("status") == "success"
    bare = [c for c in samples.columns if c not in ("messages", "object_counts", "split")]
    parts = {n: samples.where(good & (F.col("split") == n)).drop("split") for n in SNAPSHOT[:3]}
    parts |= {"valid": samples.where(good).drop("split"), "failed": samples.where(~F.coalesce(good, F.lit(False))).select(*bare)}
    parts["membership"] = samples.where(good).select("id", "split")
    made = {}
    for name, rows in parts.items():
        made[name] = {"digest": write_lines(rows, f"{path}/{name}"), "rows": rows.count()}
    write_document(samples.sparkSession, f"{path}/manifest.json", made)
    return made


def freeze_benchmark(tasks: DataFrame, path: str) -> dict:
    """A benchmark of generate.benchmark() as an inventory that is written once, without its witnesses; other content is
    refused. Returns its composition and digest."""
    rows = tasks.drop("witness").withColumn("evaluation_only", F.lit(True))
    signature = write_once(rows, path)
    counts = {f"{r.difficulty} {r.relation}": r.n for r in rows.groupBy("difficulty", "relation").agg(F.count(F.lit(1)).alias("n")).orderBy("difficulty", "relation").collect()}
    return {"tasks": sum(counts.values()), "composition": counts, "digest": signature}


def write_runs(attempts: DataFrame, path: str) -> None:
    """Audited runs: attempts(run_id, number, request, response, issues, provider) appended as they are, with the digest of each
    response; and the run's end, with its number of attempts and the digest over all, in order of the attempts."""
    audited = attempts.withColumn("response_sha256", F.sha2(F.coalesce("response", F.lit("")), 256))
    audited.write.mode("append").parquet(f"{path}/attempts")
    ends = audited.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "response_sha256"))), lambda a: a["response_sha256"]), ",").alias("all"), F.max_by("issues", "number").alias("issues"))
    status = F.when(F.col("issues").isNull(), "interrupted").when(F.size("issues") == 0, "success").otherwise("invalid")
    ends.select("run_id", "attempts", status.alias("status"), F.sha2("all", 256).alias("sha256")).write.mode("append").parquet(f"{path}/runs")


def percent(value: float | None, signed: bool = False) -> str:
    """Two places, n/a for null."""
    return "n/a" if value is None else f"{value * 100:{'+' if signed else ''}.2f}%"


def comparison(metrics: Mapping[str, Sequence[float | None]], names: Sequence[str]) -> str:
    """A Markdown table of metrics by variant, with the change from the first to the last."""
    lines = [f"| metric | {' | '.join(names)} | change |", "|" + "---|" * (len(names) + 2)]
    for metric, values in metrics.items():
        change = None if values[0] is None or values[-1] is None else values[-1] - values[0]
        lines.append(f"| {metric} | {' | '.join(map(percent, values))} | {percent(change, True)} |")
    return "\n".join(lines) + "\n"


def freeze(path: str | Path, contract: Mapping[str, object]) -> None:
    """The contract of a run: written at its beginning, and the same in every run that goes on with it."""
    target = Path(path)
    if not target.exists():
        write_json(target, dict(contract))
        return
    known = json.loads(target.read_text(encoding="utf-8"))
    changed = sorted(k for k in known.keys() | contract.keys() if known.get(k) != contract.get(k))
    if changed:
        raise ValueError(f"the contract has changed: {', '.join(changed)}")


@contextmanager
def single_writer(folder: str | Path) -> Iterator[None]:
    """Holds a folder against a second writer."""
    lock = Path(folder) / ".lock"
    lock.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"{folder} has a writer") from None
    try:
        yield
    finally:
        os.close(handle)
        lock.unlink()
