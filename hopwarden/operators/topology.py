"""Set algebra over links: undirected and directed unions of days, degrees, day counts, new links, as-of lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_columns(a: str = "as1", b: str = "as2") -> list[Column]:
    return [F.least(a, b).alias("as1"), F.greatest(a, b).alias("as2")]


def undirected(links: DataFrame, a: str = "as1", b: str = "as2") -> DataFrame:
    """Distinct (as1, as2) with as1 < as2; self-links and links with a null end are no links."""
    return links.filter(F.col(a) != F.col(b)).select(*link_columns(a, b)).distinct()


def between(df: DataFrame, column: str, first: Column | date, last: Column | date) -> DataFrame:
    """Rows of the closed range of days; the filter reaches the scan (or prunes partitions)."""
    return df.filter(F.col(column).between(first, last))


def sliding_union(updates: DataFrame, ribs: DataFrame, day: date | Column, days: int) -> DataFrame:
    """Undirected links of the updates and monthly tables of the closed window [day - days, day].

    updates: (obs_date, as1, as2, ...); ribs: (month, as1, as2).
    """
    first = F.date_sub(F.lit(day), days)
    both = between(updates, "obs_date", first, F.lit(day)).select("as1", "as2").unionByName(
        between(ribs, "month", first, F.lit(day)).select("as1", "as2")
    )
    return undirected(both)


def monthly_union(updates: DataFrame, ribs: DataFrame, day: date) -> DataFrame:
    """Directed links of the updates from the first of the month before up to (without) the day, and of that month's table."""
    first = F.add_months(F.trunc(F.lit(day), "month"), -1)
    seen = updates.filter((F.col("obs_date") >= first) & (F.col("obs_date") < F.lit(day)))
    known = ribs.filter(F.col("month") == first)
    both = seen.select("as1", "as2").unionByName(known.select("as1", "as2"))
    return both.filter("as1 <> as2").distinct()


def directed_union(*links: DataFrame) -> DataFrame:
    """Distinct directed (as1, as2) of all the frames, self-links left out."""
    out = links[0].select("as1", "as2")
    for other in links[1:]:
        out = out.unionByName(other.select("as1", "as2"))
    return out.filter("as1 <> as2").distinct()


def neighbours(links: DataFrame) -> DataFrame:
    """(asn, other): every undirected link from both its ends."""
    ends = F.array(F.struct(F.col("as1").alias("asn"), F.col("as2").alias("other")), F.struct(F.col("as2").alias("asn"), F.col("as1").alias("other")))
    return links.select(F.inline(ends))


def degrees(links: DataFrame) -> DataFrame:
    """(asn, degree) over distinct undirected links."""
    return links.select(F.explode(F.array("as1", "as2")).alias("asn")).groupBy("asn").agg(F.count(F.lit(1)).alias("degree"))


def day_counts(links: DataFrame) -> DataFrame:
    """(as1, as2, n_days) of directed links: on how many days each was seen."""
    distinct = links.filter("as1 <> as2").select("obs_date", "as1", "as2").distinct()
    return distinct.groupBy("as1", "as2").agg(F.count("obs_date").alias("n_days"))


def new_links(today: DataFrame, baseline: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """Rows of today (as1, as2, vp_ip) whose undirected link is not in the baseline less the quarantined links.

    Direction and observers are kept; self-links and links with a null end are left out.
    """
    known = baseline if quarantined is None else baseline.join(quarantined.select("as1", "as2"), ["as1", "as2"], "left_anti")
    sides = today.filter("as1 <> as2").withColumns({"__a": F.least("as1", "as2"), "__b": F.greatest("as1", "as2")})
    keys = known.select(F.col("as1").alias("__a"), F.col("as2").alias("__b"))
    return sides.join(keys, ["__a", "__b"], "left_anti").select("as1", "as2", "vp_ip").distinct()


def latest_not_after(days: DataFrame, versions: DataFrame, day: str, version: str) -> DataFrame:
    """For each row of `days` the newest version not after its day (null if none).

    Both lists are merged into one order and the last version is carried forward: a sort, no join of ranges.
    """
    marks = days.select(F.col(day).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("v")).unionByName(
        versions.select(F.col(version).alias("at"), F.lit(0).alias("kind"), F.col(version).alias("v"))
    )
    w = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)  # one row per day and version
    return marks.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("kind = 1").select(F.col("at").alias(day), F.col("v").alias(version))


def completeness(present: DataFrame, datasets: DataFrame, days: DataFrame) -> DataFrame:
    """(dataset, day) expected but not present. datasets: (dataset); days: (day) - both short lists."""
    expected = days.select("day").distinct().join(F.broadcast(datasets.select(F.collect_set("dataset").alias("__all"))))
    return expected.select(F.explode("__all").alias("dataset"), "day").join(present, ["dataset", "day"], "left_anti")


def complete_days(present: DataFrame, n_datasets: int) -> DataFrame:
    """Days on which all datasets are present."""
    return present.groupBy("day").agg(F.count_distinct("dataset").alias("n")).filter(F.col("n") == n_datasets).select("day")


def degree_and_cone(links: DataFrame, registry: DataFrame, cones: DataFrame) -> DataFrame:
    """(asn, degree, cone) of every AS of the links or the registry links; a missing degree or cone counts as 1."""
    nodes = links.unionByName(registry).select(F.explode(F.array("as1", "as2")).alias("asn")).distinct()
    both = degrees(links).join(cones, "asn", "full_outer").join(nodes, "asn", "right")
    one = F.lit(1).cast("bigint")
    return both.select("asn", F.coalesce("degree", one).alias("degree"), F.coalesce("cone", one).alias("cone"))
