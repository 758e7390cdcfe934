"""What operators need from the cluster: durable lineage cuts, tables in the shared folder and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task takes well; a key with more is hot and salted. SALTS is the least number of its parts.
HOT_ROWS = 20_000
SALTS = 32
#: So many hot keys are named in the plan; more are joined as a table, so that the driver holds none.
MOST_NAMED = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session. Where that is unset, a local session (tests, a
    single machine) gets a temporary folder that goes with the process; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, True)
        context.setCheckpointDir(made)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and forgets its lineage; the files outlive a lost executor."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and its full path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """The full address of a folder of its own in the shared folder, not yet made."""
    return _path(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")[1].toString()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    system, path = _path(spark, folder)
    system.delete(path, True)


@dataclass
class Stored:
    """A table written to the shared folder: df reads it, rows counts it."""

    df: DataFrame
    folder: str

    @cached_property
    def rows(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        """Deletes the table; nothing that reads it may run afterwards."""
        drop_folder(self.df.sparkSession, self.folder)


def store(df: DataFrame, name: str) -> Stored:
    """Writes df to a folder of its own in the shared folder. Like cut(), but columnar, and it can be deleted."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(folder), folder)


def read_folder(folder: str) -> list[dict]:
    """The rows of a small Parquet table, read by a task itself. Addresses are those of new_folder()."""
    import pyarrow.parquet as parquet
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file" or not rest:
        system, path = fs.LocalFileSystem(), "/" + (rest or folder).lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(f"s3:{rest}" if scheme == "s3a" else folder)
    return parquet.read_table(path, filesystem=system, partitioning=None).to_pylist()


def hot_keys(df: DataFrame, key: str, total: int, least: int = HOT_ROWS) -> DataFrame | None:
    """(key, parts): the keys of df, which has `total` rows, that have more than `least`, with the number of parts
    to make of each. None where there can't be any."""
    if total <= least:
        return None
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return counted.select(key, F.greatest(F.lit(SALTS), F.ceil(F.col("n") / least)).cast("int").alias("_parts"))


def join_unique(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left ⋈ right on `key`, unique in right. Rows of a hot key on the left are spread over tasks by a hash of the row, so
    that a task that is run again gives the same; the one matching row on the right is copied to each part; all other
    keys join as usual. `counted` may name a cheaper frame with the same keys, to look for the hot ones; `total` is the
    number of its rows."""
    hot = hot_keys(left if counted is None else counted, key, total)
    if hot is None:
        return left.join(right, key, how)
    named = hot.limit(MOST_NAMED + 1).collect()
    if not named:
        return left.join(right, key, how)
    if len(named) <= MOST_NAMED:
        known = F.create_map(*chain.from_iterable((F.lit(r[0]), F.lit(r[1])) for r in named))
        left, right = (side.withColumn("_parts", F.element_at(known, F.col(key))) for side in (left, right))
    else:
        hot = cut(hot)
        left, right = left.join(hot, key, "left"), right.join(hot, key, "left")
    plain = [c.name for c in left.schema if "map<" not in c.dataType.simpleString()]
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int")).otherwise(F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    salted = right.withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.withColumn("_salt", salt).drop("_parts").join(salted, [key, "_salt"], how).drop("_salt")
