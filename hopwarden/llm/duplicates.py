"""Duplicates hidden by formatting: group rows by a canonical key of any size of group.

The key is computed once and kept as 128 bits beside the identifier. Hot keys are found exactly from partial counts: rows
are first counted per hash bucket (map-side combined), only keys in buckets that could hold a hot key are then counted
themselves. Hot keys go through two levels with a salt, all others through a single shuffle. The row with the least
identifier represents its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.session import cut_lineage, wide_hash

#: A key is hot that holds 1/HOT_IN_TASK of the rows of an average shuffle task or more, but never one of fewer rows than
#: HOT_ROWS; so there are at most HOT_IN_TASK hot keys a shuffle task.
HOT_IN_TASK = 16
HOT_ROWS = 100
SALTS = 64


def canonical_text(text: Column) -> Column:
    """Lower case, punctuation and runs of white space as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\p{Z}\s]+", " "))


def unordered(*columns: Column) -> Column:
    """Fields whose order does not matter as one array; null is kept as a value of its own."""
    return F.array_sort(F.array(*columns))


def keyed(df: DataFrame, id_column: str, key: list[Column]) -> DataFrame:
    """(id, k1, k2): the identifier and 128 bits of the canonical key; nulls in the key agree with nulls. Written once (24 bytes a row)."""
    k1, k2 = wide_hash(*key)
    return cut_lineage(df.select(F.col(f"`{id_column}`").alias("id"), k1.alias("k1"), k2.alias("k2")))


def hot_keys(rows: DataFrame, hot_rows: int = HOT_ROWS, hot_parts: int | None = None) -> DataFrame:
    """(k1, k2) of every key with at least max(hot_rows, rows / hot_parts) rows; at most hot_parts of them."""
    n = rows.count()
    hot_parts = hot_parts or HOT_IN_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(hot_rows, -(-n // hot_parts))
    buckets = 1 << max(12, (16 * n // least).bit_length())
    bucket = F.pmod(F.col("k1"), F.lit(buckets))
    full = rows.groupBy(bucket.alias("__b")).count().filter(F.col("count") >= least).select("__b")  # at most n / least
    inside = rows.withColumn("__b", bucket).join(F.broadcast(full), "__b", "left_semi")
    return inside.groupBy("k1", "k2").count().filter(F.col("count") >= least).select("k1", "k2")


def _split_hot(rows: DataFrame, hot_rows: int, hot_parts: int | None) -> tuple[DataFrame, DataFrame]:
    hot = F.broadcast(cut_lineage(hot_keys(rows, hot_rows, hot_parts).withColumn("__hot", F.lit(True))))
    marked = rows.join(hot, ["k1", "k2"], "left")
    return marked.filter("__hot").drop("__hot"), marked.filter("__hot is null").drop("__hot")


def _two_level(hot: DataFrame) -> DataFrame:
    salted = hot.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("__salt"))
    first = salted.agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return first.groupBy("k1", "k2").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def collapse(df: DataFrame, id_column: str, key: list[Column], hot_rows: int = HOT_ROWS, hot_parts: int | None = None) -> DataFrame:
    """(first_id, copies): one record per group, its least id and its number of rows (repeated ids counted each)."""
    hot, rest = _split_hot(keyed(df, id_column, key), hot_rows, hot_parts)
    one_level = rest.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return _two_level(hot).unionByName(one_level).select("first_id", "copies")


def copies(df: DataFrame, id_column: str, key: list[Column], hot_rows: int = HOT_ROWS, hot_parts: int | None = None) -> DataFrame:
    """(first_id, copy_id): for each group its least id with each other id of the group.

    Rows with a null id group with the others but are neither first nor copy; a repeated id gives a row each time
    it is not the first. Groups of one and empty inputs give no rows.
    """
    hot, rest = _split_hot(keyed(df, id_column, key), hot_rows, hot_parts)
    first = F.broadcast(_two_level(hot).select("k1", "k2", "first_id"))  # at most hot_parts rows
    of_hot = hot.join(first, ["k1", "k2"])
    of_rest = rest.withColumn("first_id", F.min("id").over(Window.partitionBy("k1", "k2")))
    both = of_hot.select("first_id", "id").unionByName(of_rest.select("first_id", "id"))
    return both.filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
