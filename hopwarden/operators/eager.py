"""Per-key results when a few keys hold most rows: aggregate before the join, never after it.

Both inputs shrink to one compact state per key (map-side combined, so a hot key is one row per map task),
the states are joined, and counts and sums of the joined pairs follow algebraically: a key with l rows on the
left and r on the right has l*r pairs, and a left sum S contributes S*r. No task ever sees the rows of a key.
Sums of whole numbers and all products are decimals of 38 digits: a key with 10^12 rows on either side has 10^24 pairs,
more than a bigint holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _states(df: DataFrame, keys: dict[str, Column], by: dict[str, Column], sums: dict[str, Column], n: str) -> DataFrame:
    names = [*keys, *by]
    picked = df.select(*[c.alias(k) for k, c in {**keys, **by}.items()], *[c.alias(f"__{s}") for s, c in sums.items()])
    whole = {n for n, t in picked.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    picked = picked.withColumns({f"__{s}": F.col(f"__{s}").cast(WIDE) for s in sums if f"__{s}" in whole}) if sums else picked
    return picked.groupBy(*names).agg(F.count(F.lit(1)).alias(n), *[F.sum(f"__{s}").alias(s) for s in sums])


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, tuple[Column, Column]],
    left_by: dict[str, Column] | None = None,
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    how: str = "inner",
    small_right: bool = False,
) -> DataFrame:
    """Counts and sums over the join of left and right, grouped by the keys and `left_by`.

    Result: keys, left_by, n_left, n_right (bigint), n_pairs (decimal) and each sum taken over the joined pairs.
    Null keys match nothing: inner drops them, left keeps them with n_right 0, where each left row counts as one
    pair and right sums are null. Columns of the inputs that are not named play no part, whatever their names.
    small_right: the caller knows that the right side has few keys (a bound it can prove), so its states are broadcast.
    Empty inputs give an empty result. Sums skip nulls and are null where all values are.
    """
    left_by, left_sums, right_sums = left_by or {}, left_sums or {}, right_sums or {}
    l = _states(left, {k: a for k, (a, _) in keys.items()}, left_by, left_sums, "n_left")
    r = _states(right, {f"__r_{k}": b for k, (_, b) in keys.items()}, {}, right_sums, "__n_right")
    if small_right:
        r = F.broadcast(r)
    on = [l[k] == r[f"__r_{k}"] for k in keys]
    joined = l.join(r, on, how)
    n_right = F.coalesce(F.col("__n_right"), F.lit(0).cast("bigint"))
    matched = F.greatest(n_right, F.lit(1)).cast(WIDE)
    return joined.select(
        *keys,
        *left_by,
        "n_left",
        n_right.alias("n_right"),
        (F.col("n_left").cast(WIDE) * matched).alias("n_pairs"),
        *[(F.col(s) * matched).alias(s) for s in left_sums],
        *[(F.col(s) * F.col("n_left").cast(WIDE)).alias(s) for s in right_sums],
    )


def stack_fields(df: DataFrame, fields: list[str], name: str = "field_name", value: str = "value", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row and field: the field's name and its value, and what is kept of the row."""
    pairs = F.array(*[F.struct(F.lit(f).alias(name), F.col(f"`{f}`").alias(value)) for f in fields])
    return df.select(*[c.alias(k) for k, c in (keep or {}).items()], F.inline(pairs))


def hot_keys(df: DataFrame, fields: list[str], share: float, value: str = "asn") -> DataFrame:
    """Values that stand on at least `share` of all rows of their field; null is no value but its rows count.

    The states per (field, value) are joined to the one state per field that holds the number of rows.
    """
    stacked = stack_fields(df, fields, "field_name", value)
    total = stacked.select("field_name")
    states = eager_join_aggregate(
        stacked.filter(F.col(value).isNotNull()),
        total,
        {"field_name": (F.col("field_name"), F.col("field_name"))},
        left_by={value: F.col(value)},
        small_right=True,  # one state per field
    )
    return states.filter(F.col("n_left") >= F.lit(share) * F.col("n_right")).select("field_name", value, F.col("n_left").alias("n"))
