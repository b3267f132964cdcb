"""IP prefixes as (family, high, low, len): the network address as two bigints of 32 bits (v4) or 2 x 64 bits (v6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_V4 = rf"^\s*(?:{_OCTET}\.){{3}}{_OCTET}/[0-9]{{1,2}}\s*$"
_V6 = r"^\s*(?=.*:)(?!.*::.*::)[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){1,8}/[0-9]{1,3}\s*$"


def _v4_number(prefix: Column) -> Column:
    parts = F.split(F.trim(prefix), "[./]")
    hexed = F.transform(F.slice(parts, 1, 4), lambda o: F.lpad(F.hex(o.try_cast("bigint")), 2, "0"))
    return F.conv(F.array_join(hexed, ""), 16, 10).cast("bigint")


def _v6_hex(address: Column) -> Column:
    """32 hexadecimal digits of an address, '::' filled up with zeros; other lengths mean that it is none."""
    halves = F.transform(F.split(address, "::"), lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
    groups = F.flatten(F.transform(halves, lambda h, i: F.when(i == 1, F.concat(F.array(F.lit("*")), h)).otherwise(h)))
    padded = F.transform(groups, lambda g: F.when(g == "*", g).otherwise(F.lpad(g, 4, "0")))
    text = F.array_join(padded, "")
    return F.replace(text, F.lit("*"), F.repeat(F.lit("0"), F.greatest(F.lit(33) - F.length(text), F.lit(0))))


def parsed(prefix: Column) -> Column:
    """struct<family int, high bigint, low bigint, len int> with host bits cleared; null for what is no prefix."""
    number, len4 = _v4_number(prefix), F.get(F.split(F.trim(prefix), "/"), F.lit(1)).try_cast("int")
    v4 = F.struct(
        F.lit(4).alias("family"),
        masked_v4(number, len4).alias("high"),
        F.lit(0).cast("bigint").alias("low"),
        len4.alias("len"),
    )
    parts = F.split(F.trim(F.lower(prefix)), "/")
    digits, len6 = _v6_hex(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
    high, low = (F.conv(F.substring(digits, i, 16), 16, -10).cast("bigint") for i in (1, 17))
    v6 = F.struct(
        F.lit(6).alias("family"), _masked_64(high, len6).alias("high"), _masked_64(low, len6 - 64).alias("low"), len6.alias("len")
    )
    good4 = prefix.rlike(_V4) & (len4 <= 32)
    good6 = prefix.rlike(_V6) & (F.length(digits) == 32) & len6.between(0, 128)
    return F.when(good4, v4).when(good6, v6)


def masked_v4(number: Column, length: Column) -> Column:
    size = F.expr("1L")
    return number - number % F.call_function("shiftleft", size, F.lit(32) - length)


def _masked_64(word: Column, length: Column) -> Column:
    """The first `length` bits of a 64-bit word (all for 64 and more, none for 0 and less)."""
    some = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - length).cast("int"))
    none, all_ = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    return word.bitwiseAND(F.when(length <= 0, none).when(length >= 64, all_).otherwise(some))


def ancestors(p: Column, lengths: set[tuple[int, int]] | None = None) -> Column:
    """array of structs like p: the prefix itself and every shorter one that covers it.

    lengths: (family, len) of the only ones wanted.
    """
    if lengths is None:
        wanted = F.sequence(F.lit(0), p["len"])
    else:
        of = {f: F.array(*[F.lit(n) for n in sorted(n for g, n in lengths if g == f)]).cast("array<int>") for f in (4, 6)}
        wanted = F.filter(F.when(p["family"] == 4, of[4]).otherwise(of[6]), lambda n: n <= p["len"])
    return F.transform(
        wanted,
        lambda n: F.struct(
            p["family"].alias("family"),
            F.when(p["family"] == 4, masked_v4(p["high"], n)).otherwise(_masked_64(p["high"], n)).alias("high"),
            F.when(p["family"] == 4, F.lit(0).cast("bigint")).otherwise(_masked_64(p["low"], n - 64)).alias("low"),
            n.alias("len"),
        ),
    )


def covers(outer: Column, inner: Column) -> Column:
    """Whether the outer prefix equals or contains the inner one."""
    same4 = masked_v4(inner["high"], outer["len"]) == outer["high"]
    same6 = (_masked_64(inner["high"], outer["len"]) == outer["high"]) & (_masked_64(inner["low"], outer["len"] - 64) == outer["low"])
    return (
        (outer["family"] == inner["family"])
        & (outer["len"] <= inner["len"])
        & F.when(outer["family"] == 4, same4).otherwise(same6)
    )
