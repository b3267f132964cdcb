"""Looking rows up in a table with one row per key, when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, or from 1/HOT_PARTS of all rows if that is more.
HOT_ROWS = 20_000
HOT_PARTS = 5_000


#: Up to this many bytes a table is broadcast whole.
SENT_BYTES = 64 << 20


def attach(rows: DataFrame, right: DataFrame, key: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """Join of `rows` to `right`, which has each key at most once and about `row_bytes` bytes a row.

    `right` is counted: up to SENT_BYTES it is broadcast, beyond that `lookup` splits the hot keys.
    """
    if right.count() * row_bytes <= SENT_BYTES:
        return rows.join(F.broadcast(right), key, how)
    return lookup(rows, right, key, how=how)


def lookup(rows: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, hot_parts: int = HOT_PARTS, how: str = "inner") -> DataFrame:
    """Join (inner or left) of `rows` to `right`, which has each key at most once.

    Rows of hot keys (exactly those with at least max(hot_rows, rows / hot_parts) rows, so at most hot_parts keys) meet
    a broadcast of their few right rows; all others are joined by one shuffle. Null keys match nothing.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    hot = counts.filter(F.col("count") >= max(hot_rows, -(-total // hot_parts))).select(key, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    of_hot = F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi"))
    near = marked.filter("__hot").drop("__hot").join(of_hot, key, how)
    far = marked.filter("__hot is null").drop("__hot").join(right, key, how)
    return near.unionByName(far)
