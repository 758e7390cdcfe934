"""Problem 3: duplicates hidden by formatting.

Each text is brought to its canonical form and hashed to 128 bits. A second, independent hash of 64 bits goes with
the first as collision check: texts that share the first and differ in the second are kept apart and reported.
Copies are counted by hash with map-side combining, so a hot text costs one row for each map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.canon import canon_column
from tessera.runtime import cut, join_unique


def keyed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, key, proof, segs) of each row with a word; key is 128 bits in hex, proof the independent check."""
    form = texts.select(F.col(key).alias("id"), canon_column(F.col(text)).alias("f")).where("id IS NOT NULL AND f.canon IS NOT NULL")
    return form.select("id", F.md5("f.canon").alias("key"), F.xxhash64("f.canon", F.length("f.canon")).alias("proof"), F.col("f.segs").alias("segs"))


def distinct_texts(texts: DataFrame, key: str = "id", text: str = "prompt") -> DataFrame:
    """(keep_id, copies): one row for each distinct text, its smallest id and the number of ids that carry it.
    Repeated rows of one id count once. Null, blank and wordless texts are no records; an empty table gives none."""
    rows = keyed(texts, key, text).groupBy("id", "key", "proof").agg(F.count(F.lit(1)).alias("rows"))
    return rows.groupBy("key", "proof").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).select("keep_id", "copies")


def collisions(texts: DataFrame, key: str = "id", text: str = "prompt") -> DataFrame:
    """(key, texts): hashes of 128 bits that stand for more than one text by the independent check; normally none."""
    return keyed(texts, key, text).groupBy("key").agg(F.min("proof").alias("a"), F.max("proof").alias("b"), F.count(F.lit(1)).alias("texts")).where("a <> b").select("key", "texts")


def copies(texts: DataFrame, key: str = "id", text: str = "prompt") -> DataFrame:
    """(keep_id, copy_id): in each set of equal texts the smallest id with each other one. Ties cannot occur, ids are
    compared as strings; repeated rows of one id are one record."""
    rows = cut(keyed(texts, key, text).select(F.col("id").cast("string").alias("id"), F.concat("key", F.hex("proof")).alias("k")).distinct())
    kept = rows.groupBy("k").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "keep_id")
    return join_unique(rows, kept, "k", rows.count()).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
