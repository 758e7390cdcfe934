"""Sources of prompts, runs, worlds and protected items."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.domain import LIMITS
from tessera.functions.text import prompt_group

EXPECTATIONS = T.StructType(
    [
        T.StructField("object_counts", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("map", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("biome", T.StringType())])),
        T.StructField("minimum_relations", T.MapType(T.StringType(), T.IntegerType())),
    ]
)
PROMPT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("theme", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("expectations", EXPECTATIONS),
        T.StructField("descriptors", T.MapType(T.StringType(), T.StringType())),
    ]
)
CASE = T.StructType([T.StructField("id", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("expectations", EXPECTATIONS)])
SCENARIO = T.StructType([T.StructField("name", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("expected_counts", T.MapType(T.StringType(), T.IntegerType()))])


def read_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """One JSON object a line. Blank lines are passed over, a byte order mark is too; a bad line fails the query. Only line
    feeds end a line, so other line marks may stand within strings."""
    text = spark.read.option("lineSep", "\n").text(paths).select(F.regexp_replace("value", r"^\x{FEFF}|\r$", "").alias("line")).where(F.trim("line") != "")
    parsed = text.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON array of objects in a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def require(df: DataFrame, message: str) -> None:
    """Fails if df, the rows that break a rule, has any."""
    if df.limit(1).count():
        raise ValueError(message)


def prompts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The prompt inventory of a .json array or of JSON lines: ids and normalised prompts are unique, prompts have 1 to 8000
    characters. With `most`, the first so many by id; a shortfall is an error."""
    found = read_array(spark, path, PROMPT) if path.endswith(".json") else read_lines(spark, path, PROMPT)
    require(found.where("id IS NULL OR prompt IS NULL OR trim(prompt) = ''").select("id"), "a prompt or its id is missing")
    require(found.where(F.char_length("prompt") > LIMITS["prompt"]), "a prompt is too long")
    require(found.groupBy("id").count().where("count > 1"), "an id comes twice")
    require(found.groupBy(prompt_group(F.col("prompt")).alias("g")).count().where("count > 1"), "a prompt comes twice")
    return first(found, "id", most)


def first(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first `most` rows in an order; fewer are an error, None means all."""
    if most is None:
        return rows
    if isinstance(most, bool) or most < 1:
        raise ValueError("a limit is a positive number")
    chosen = rows.orderBy(order).limit(most)
    n = chosen.count()
    if n < most:
        raise ValueError(f"{most} rows are wanted, there are {n}")
    return chosen


def cases(spark: SparkSession, path: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Test cases of a JSON array, all or the given ids; an unknown id is an error."""
    found = read_array(spark, path, CASE)
    require(found.where("id IS NULL OR prompt IS NULL OR trim(prompt) = ''"), "a case has no id or prompt")
    require(found.groupBy("id").count().where("count > 1"), "an id comes twice")
    if ids is None:
        return found
    wanted = sorted(set(ids))
    chosen = found.where(F.col("id").isin(wanted))
    if chosen.count() < len(wanted):
        raise ValueError("an id is unknown")
    return chosen


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios: name, prompt, expected counts."""
    return read_array(spark, path, SCENARIO)


def run_records(spark: SparkSession, root: str, name: str = "record.json") -> DataFrame:
    """(path, record, reason): one row for each run directory under root, in order of the paths; unreadable records keep
    their row with a reason."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))
    return rows.withColumn("reason", F.when(F.try_parse_json("record").isNull(), "the record can't be read")).orderBy("path")


def snapshot(log: DataFrame, most: int = -1) -> DataFrame:
    """Finished samples of a state log(id, state, seq, ...), each with its latest state, in order of commitment; the first
    `most` of them, -1 for all, a shortfall is an error."""
    latest = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), "seq").alias("s")).select("s.*").where("state = 'finished'")
    return latest.orderBy("seq") if most == -1 else first(latest, "seq", most)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def resolve(spark: SparkSession, root: str) -> DataFrame:
    """The records under root, from a state log, run directories or a file of valid samples, whichever is there first; as
    (origin, record) with the record as JSON text."""
    if exists(spark, f"{root}/samples"):
        return snapshot(spark.read.parquet(f"{root}/samples")).select(F.lit("samples").alias("origin"), F.col("result").alias("record"))
    if exists(spark, f"{root}/runs"):
        return run_records(spark, f"{root}/runs").where("reason IS NULL").select(F.lit("runs").alias("origin"), "record")
    if exists(spark, f"{root}/valid.jsonl"):
        return spark.read.option("lineSep", "\n").text(f"{root}/valid.jsonl").select(F.lit("valid").alias("origin"), F.col("value").alias("record"))
    raise ValueError(f"no records are known under {root}")


def protected_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(grp): the digests of all prompts in files of JSON lines, from `prompt` or the first user message."""
    message = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    rows = read_lines(spark, paths, T.StructType([T.StructField("prompt", T.StringType()), T.StructField("messages", message)]))
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return rows.select(prompt_group(F.coalesce("prompt", asked)).alias("grp")).where("grp IS NOT NULL").distinct()


def replay(prompts_asked: DataFrame, stored: Mapping[str, str]) -> DataFrame:
    """prompts_asked with the stored answer of exactly this prompt; one without answer is an error. The planner decides by
    the answers' size how they are joined."""
    answers = prompts_asked.sparkSession.createDataFrame(list(stored.items()) or [], "prompt string, answer string")
    joined = prompts_asked.join(answers, "prompt", "left")
    require(joined.where("answer IS NULL"), "a prompt has no stored answer")
    return joined


def config(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """A JSON configuration with everything it extends merged in: nested objects member by member, else the extending file
    wins. A file that extends itself is an error."""
    here = Path(path).resolve()
    if here in seen:
        raise ValueError(f"{here} extends itself")
    own = json.loads(here.read_text(encoding="utf-8-sig"))
    base = own.pop("extends", None)
    return merged(config(here.parent / base, (*seen, here)), own) if base else own


def merged(low: dict, high: dict) -> dict:
    """low with the members of high, recursively."""
    out = dict(low)
    for key, value in high.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def load_world(spark: SparkSession, path: str) -> DataFrame:
    """(json_ok, schema_ok, schema_issues, world, issues): the world in a file, decoded strictly and checked."""
    from tessera.functions.decode import decoded
    from tessera.operators import evaluate, local

    rows = decoded(spark.read.option("wholetext", True).text(path), "value").drop("value")
    return local.with_issues(evaluate.as_rows(rows)).drop("width", "height", "objects", "relations")


def save_world(worlds: DataFrame, path: str) -> None:
    """Worlds as documents, one a line, defaults written out; what load_world() reads."""
    from tessera.functions.decode import document

    worlds.where("world IS NOT NULL").select(document(F.col("world")).alias("value")).write.text(path)
