"""What changed between consecutive full snapshots, in a single aggregation shuffle.

Every row plays the new side of its own snapshot and the old side of the next one. Grouped by (snapshot, key),
each side keeps its latest record as (order column, 64-bit row hash); the two hashes classify the key. The pair is packed
into one decimal, so that the states are of fixed width and the aggregation hashes instead of sorting. Two different rows
of a key have the same hash once in 2^64 comparisons.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwarden.session import null_safe

#: The chain of snapshots (one row per delivery) is broadcast up to this many; beyond it, it is joined by shuffle.
MAX_BROADCAST_SNAPSHOTS = 100_000


def snapshot_chain(df: DataFrame, snapshot: str) -> DataFrame:
    """(__day, __roles): for each snapshot the sides it plays, as (later snapshot of the pair, is_new)."""
    days = df.select(F.col(f"`{snapshot}`").alias("__day")).filter("__day is not null").distinct()
    w = Window.orderBy("__day")
    sides = days.select("__day", F.lag("__day").over(w).alias("__before"), F.lead("__day").over(w).alias("__after"))
    roles = F.array_compact(
        F.array(
            F.when(F.col("__before").isNotNull(), F.struct(F.col("__day").alias("pair"), F.lit(True).alias("is_new"))),
            F.when(F.col("__after").isNotNull(), F.struct(F.col("__after").alias("pair"), F.lit(False).alias("is_new"))),
        )
    )
    return sides.select("__day", roles.alias("__roles"))


def _rank(order: Column, kind: T.DataType, h: Column) -> Column:
    """The order value and a 64-bit hash as one decimal of 38 digits, comparing as the pair does; a null order comes first."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(order.cast("timestamp"))  # within 18 digits for the years 1 to 9999
    elif isinstance(kind, T.DateType):
        number = F.unix_date(order).cast("bigint")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        number = order.cast("bigint")
    else:
        raise TypeError(f"snapshots are ordered by times, dates or ints, not by {kind.simpleString()}")
    unsigned = h.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    return F.coalesce(number, F.lit(1 - 10**18)).cast("decimal(18,0)") * F.lit(Decimal(10**20)) + unsigned.cast("decimal(20,0)")


def snapshot_changes(df: DataFrame, snapshot: str, keys: dict[str, str], attributes: list[str], order: str) -> DataFrame:
    """One row per changed key and pair of consecutive snapshots.

    keys: result name -> column. Result: snapshot_day (the later snapshot), the keys, change_kind
    ('added', 'removed', 'changed').

    Rows with a null key or snapshot are no records. Of several rows of a key in one snapshot, the one with the
    latest `order` is the record (null orders come first; on a tie the row with the greater row hash, so the result
    does not depend on the order of rows). Attributes are compared exactly, null being a value of its own; columns
    not named are ignored. A snapshot whose rows all lack keys still is a snapshot. The first snapshot has no rows.
    """
    chain = snapshot_chain(df, snapshot)
    if chain.count() <= MAX_BROADCAST_SNAPSHOTS:
        chain = F.broadcast(chain)
    h = F.xxhash64(*null_safe(*[F.col(f"`{a}`") for a in attributes]))
    rows = df.select(
        F.col(f"`{snapshot}`").alias("__day"),
        *[F.col(f"`{c}`").alias(f"__k_{k}") for k, c in keys.items()],
        _rank(F.col(f"`{order}`"), df.schema[order].dataType, h).cast("decimal(38,0)").alias("__rank"),
    ).dropna(subset=["__day", *[f"__k_{k}" for k in keys]])
    sided = rows.join(chain, "__day").withColumn("__role", F.explode("__roles"))
    pairs = sided.groupBy(F.col("__role.pair").alias("snapshot_day"), *[f"__k_{k}" for k in keys]).agg(
        F.max(F.when(~F.col("__role.is_new"), F.col("__rank"))).alias("__old"),
        F.max(F.when(F.col("__role.is_new"), F.col("__rank"))).alias("__new"),
    )
    row_hash = lambda rank: F.pmod(F.col(rank), F.lit(Decimal(10**20)))
    kind = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(row_hash("__old") != row_hash("__new"), "changed")
    )
    return (
        pairs.withColumn("change_kind", kind)
        .filter("change_kind is not null")
        .select("snapshot_day", *[F.col(f"__k_{k}").alias(k) for k in keys], "change_kind")
    )
