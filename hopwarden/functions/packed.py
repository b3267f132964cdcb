"""Several values packed into one string field.

The field is split on quote characters: pieces at odd places were quoted and are literals, pieces at even places are
split on delimiters. The pieces are put together again with one separator between values, so literals keep their
delimiters. A group in braces keeps one ordinal.
All of it is array expressions inside the JVM; the cost is linear in the length of the field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    """How a field packs its values.

    delimiters, quotes: regular expressions of one character class each.
    open/close: characters around an unordered group that has a single position, or None; they count inside quotes too.
    quoted_lists: a field that is one quoted piece as a whole is a list in quotes (as exporters of tables write it): it
        is split; all other quoted pieces are one literal value each.
    strip: regular expression removed wherever it stands before a value (a unit or type prefix).
    """

    delimiters: str = r"[\s,;|]"
    quotes: str = r"[\"']"
    open: str | None = None
    close: str | None = None
    quoted_lists: bool = False
    strip: str | None = None


#: AS paths: anything but letters, digits, quotes and braces separates; "AS"/"ASN" may stand before a number.
AS_PATH = Packing(
    delimiters=r"[^0-9A-Za-z\"'{}]", open="{", close="}", quoted_lists=True, strip=r"(?i)asn?[\s\p{Z}]*(?=[0-9])"
)

_SEPARATOR = "\x01"


def _reassembled(text: Column, how: Packing) -> Column:
    """The field without quotes, its values separated by _SEPARATOR.

    Split on quotes, the odd pieces are literals; a last piece whose quote is never closed is no literal.
    """
    pieces = F.split(text, how.quotes)
    n = F.size(pieces)
    literal = lambda i: (i % 2 == 1) & (i < n - 1)
    if how.quoted_lists:
        blank = lambda i: F.regexp_replace(F.get(pieces, F.lit(i)), how.delimiters, "") == ""
        envelope = (n == 3) & blank(0) & blank(2)
        return F.array_join(
            F.transform(pieces, lambda p, i: F.when(literal(i) & ~envelope, p).otherwise(F.regexp_replace(p, how.delimiters, _SEPARATOR))), _SEPARATOR
        )
    return F.array_join(F.transform(pieces, lambda p, i: F.when(literal(i), p).otherwise(F.regexp_replace(p, how.delimiters, _SEPARATOR))), _SEPARATOR)


def _positions(text: Column, delimiters: str, in_groups: str, how: Packing) -> Column:
    def words(piece: Column, regex: str) -> Column:
        return F.filter(F.split(piece, regex), lambda w: w != "")

    def single(piece: Column) -> Column:
        return F.transform(words(piece, delimiters), lambda w: F.struct(F.lit(False).alias("grouped"), F.array(w).alias("members")))

    if how.open is None:
        return single(text)

    def group(piece: Column) -> Column:
        one = F.array(F.struct(F.lit(True).alias("grouped"), words(piece, in_groups).alias("members")))
        return F.filter(one, lambda g: F.size(g["members"]) > 0)

    pieces = F.split(text, "[" + "".join("\\" + c for c in (how.open, how.close)) + "]")
    folded = F.flatten(F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, group(piece)).otherwise(single(piece))))
    return F.when(text.contains(how.open), folded).otherwise(single(text))


def packed_values(column: Column, how: Packing = Packing()) -> Column:
    """array<struct<grouped boolean, members array<string>>>: the values of the field, one element per position.

    Null, empty and blank fields give an empty array. An ungrouped value has one member.
    An unclosed group reaches to the end of the field; a group without members takes no position.
    """
    text = F.coalesce(column, F.lit(""))
    if how.strip:
        text = F.regexp_replace(text, how.strip, "")
    plain = _positions(text, how.delimiters, how.delimiters, how)
    in_groups = f"(?:{how.delimiters}|{_SEPARATOR})"
    quoted = _positions(_reassembled(text, how), _SEPARATOR, in_groups, how)
    return F.when(text.rlike(how.quotes), quoted).otherwise(plain)


def path_positions(as_path: Column) -> Column:
    """array<struct<grouped, members array<bigint>>> of an AS path; pieces that are no numbers are no values."""
    bare = F.transform(
        packed_values(as_path, AS_PATH),
        lambda v: F.struct(
            v["grouped"].alias("grouped"),
            F.filter(F.transform(v["members"], lambda m: m.try_cast("bigint")), lambda m: m.isNotNull()).alias("members"),
        ),
    )
    return F.filter(bare, lambda v: F.size(v["members"]) > 0)


def canonical_path(as_path: Column) -> Column:
    """One spelling per path: numbers in order, sets in braces with their distinct members ascending."""
    return F.array_join(
        F.transform(
            path_positions(as_path),
            lambda v: F.when(
                v["grouped"], F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(v["members"])), ","), F.lit("}"))
            ).otherwise(F.get(v["members"], F.lit(0)).cast("string")),
        ),
        " ",
    )


def explode_packed(df: DataFrame, column: str, keep: list[str], how: Packing = Packing(), value: str = "value") -> DataFrame:
    """One row per value: the kept columns, `pos` from 1 and the value as text. Members of a group share a position."""
    at = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(packed_values(F.col(f"`{column}`"), how)).alias("__at", "__v"))
    return at.select(*[F.col(f"`{c}`") for c in keep], (F.col("__at") + 1).cast("int").alias("pos"), F.explode("__v.members").alias(value))


def explode_path(df: DataFrame, column: str = "as_path", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per hop of every path: the kept columns, `pos` (int, from 1, repeats included) and `hop` (bigint).

    Rows without hops (null, blank or junk paths) give no rows.
    """
    at = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(path_positions(F.col(f"`{column}`"))).alias("__at", "__v"))
    return at.select(*[F.col(f"`{c}`") for c in keep], (F.col("__at") + 1).cast("int").alias("pos"), F.explode("__v.members").alias("hop"))
