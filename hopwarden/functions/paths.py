"""AS paths as arrays. A path is array<struct<grouped, members>> (see packed.path_positions) or array<bigint> of first members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopwarden.functions.packed import path_positions

#: Reserved AS numbers, first and last of the closed range and the start of the open one.
RESERVED_FIRST, RESERVED_LAST, RESERVED_HIGH = 64496, 131071, 4200000000
#: Bounds of the degree buckets.
DEGREE_BOUNDS = (0, 10, 50, 100, 500, 1000, 1500, 3000, 5000, 100000)
#: Fixed value: columns of a pattern window.
WINDOW = 6


def hops(as_path: Column) -> Column:
    """array<bigint>: the first member of every position, repeats included."""
    return F.transform(path_positions(as_path), lambda v: F.get(v["members"], F.lit(0)))


def collapse(a: Column) -> Column:
    """Drop elements equal to the one right before; null for null. The array is named outside the lambda only."""
    before = F.concat(F.slice(F.transform(a, lambda x: F.lit(None)), 1, 1), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    both = F.zip_with(a, before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(both, lambda p: p["y"].isNull() | (p["x"] != p["y"]))["x"]


def is_reserved(asn: Column, inclusive: bool = True) -> Column:
    if inclusive:
        return asn.between(RESERVED_FIRST, RESERVED_LAST) | (asn >= RESERVED_HIGH)
    return ((asn > RESERVED_FIRST) & (asn < RESERVED_LAST)) | (asn > RESERVED_HIGH)


def clean(path: Column, exchanges: Column | None = None, inclusive: bool = True) -> Column:
    """Without reserved numbers and exchange ASNs (array<bigint>), then without repeats of the last hop kept."""

    def kept(x: Column) -> Column:
        bad = is_reserved(x, inclusive)
        return ~(bad if exchanges is None else bad | F.array_contains(exchanges, x))

    return collapse(F.filter(path, kept))


def joined(path: Column, sep: str = " ") -> Column:
    return F.array_join(path.cast("array<string>"), sep)


def pairs(path: Column) -> Column:
    """array<struct<a, b>>: adjacent hops, in order."""
    n = F.size(path)
    left = F.when(n > 1, F.slice(path, 1, n - 1)).otherwise(F.slice(path, 1, 0))
    right = F.when(n > 1, F.slice(path, 2, n - 1)).otherwise(F.slice(path, 1, 0))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def set_pairs(positions: Column) -> Column:
    """array<struct<a, b>> of adjacent positions, every member of one with every member of the other."""
    return F.flatten(
        F.transform(
            pairs(positions),
            lambda p: F.flatten(
                F.transform(
                    p["a"]["members"],
                    lambda a: F.transform(p["b"]["members"], lambda b: F.struct(a.alias("a"), b.alias("b"))),
                )
            ),
        )
    )


def prune(path: Column, as1: Column, as2: Column) -> Column:
    """The path up to and with the first adjacent pair (as1, as2) in either order; null if there is none."""
    found = F.transform(
        pairs(path), lambda p: ((p["a"] == as1) & (p["b"] == as2)) | ((p["a"] == as2) & (p["b"] == as1))
    )
    at = F.array_position(found, F.lit(True))
    return F.when(at > 0, F.slice(path, 1, (at + 1).cast("int")))


def fixed_window(values: Column, size: int = WINDOW) -> Column:
    """The last `size` values, with zeros before them if there are fewer."""
    return F.slice(F.concat(F.array_repeat(F.lit(0).cast("bigint"), size), values), -size, size)


def _place(path: Column, asn: Column) -> Column:
    at = F.array_position(path, asn)
    return F.when(at > 0, at)


def hijack_type(path: Column, as1: Column, as2: Column) -> Column:
    """Hops from the nearer end of the link to the origin; null if neither end is on the path."""
    return (F.size(path) - F.least(_place(path, as1), _place(path, as2))).cast("int")


def attacker(path: Column, as1: Column, as2: Column) -> Column:
    """Whichever end of the link comes first on the path; null if neither is on it."""
    p1, p2 = _place(path, as1), _place(path, as2)
    return F.when(p1.isNotNull() & (p2.isNull() | (p1 < p2)), as1).when(p2.isNotNull(), as2)


def victim(path: Column) -> Column:
    """The origin: the last hop; null for an empty path."""
    return F.when(F.size(path) > 0, F.get(path, F.size(path) - 1))


def degree_bucket(degree: Column, strict: bool = False) -> Column:
    """Number of the bucket [t_i, t_i+1) a degree falls into, 0 if none; strict leaves the bounds themselves out."""
    out = F.lit(0)
    for i in range(len(DEGREE_BOUNDS) - 1, 0, -1):
        low, high = DEGREE_BOUNDS[i - 1], DEGREE_BOUNDS[i]
        inside = (degree > low) & (degree < high) if strict else (degree >= low) & (degree < high)
        out = F.when(inside, F.lit(i - 1)).otherwise(out)
    return out
