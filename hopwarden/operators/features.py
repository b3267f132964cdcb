"""Feature families: both directions seen, neighbouring observers, attribute vectors and their cosine, path patterns."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.functions.paths import WINDOW, collapse, fixed_window
from hopwarden.operators.skew import attach
from hopwarden.operators.topology import day_counts, neighbours
from hopwarden.session import cut_lineage, once

#: The distance of ASes of which one has no attributes; days in which both directions of a link must be seen.
NO_DISTANCE, BIDI_DAYS = -1.0, 31


def bidirectional(links: DataFrame, seen: DataFrame, ribs: DataFrame, least_days: int = 1) -> DataFrame:
    """(as1, as2, bidi): 1 if both directions occur, each on at least `least_days` days of `seen`, or both in `ribs`.

    seen: (obs_date, as1, as2), directed; ribs: (as1, as2), directed.
    """
    often = day_counts(seen).filter(F.col("n_days") >= least_days).select("as1", "as2")

    def both(directed: DataFrame) -> DataFrame:
        sides = directed.filter("as1 <> as2").distinct()
        pairs = sides.groupBy(F.least("as1", "as2").alias("as1"), F.greatest("as1", "as2").alias("as2")).agg(F.count(F.lit(1)).alias("n"))
        return pairs.filter("n = 2").select("as1", "as2")

    found = both(often).unionByName(both(ribs.select("as1", "as2"))).distinct().withColumn("bidi", F.lit(1))
    return links.select("as1", "as2").join(found, ["as1", "as2"], "left").select("as1", "as2", F.coalesce("bidi", F.lit(0)).alias("bidi"))


def neighbouring_observers(links: DataFrame, graph: DataFrame, observers: DataFrame) -> DataFrame:
    """(as1, as2, nb_vps): the smaller number of neighbours with an observer of the two ends; 0 for an unknown end."""
    per_as = neighbours(graph).join(observers.select(F.col("asn").alias("other")).distinct(), "other", "left_semi").groupBy("asn").agg(F.count(F.lit(1)).alias("n"))
    n1, n2 = (per_as.select(F.col("asn").alias(a), F.col("n").alias(f"n_{a}")) for a in ("as1", "as2"))
    both = links.select("as1", "as2").join(n1, "as1", "left").join(n2, "as2", "left")
    zero = F.lit(0).cast("bigint")
    return both.select("as1", "as2", F.least(F.coalesce("n_as1", zero), F.coalesce("n_as2", zero)).alias("nb_vps"))


def attribute_vectors(graph: DataFrame, attributes: DataFrame) -> DataFrame:
    """(asn, attr, cnt): for every AS how many of its neighbours have each attribute. attributes: (asn, attr), a set per AS.

    Attributes that give every AS the same share carry nothing and are dropped; with sparse vectors that is an attribute
    whose normalised value is the same for all ASes of the graph.
    """
    distinct = attributes.filter("asn is not null and attr is not null").select(F.col("asn").alias("other"), "attr").distinct()
    counts = cut_lineage(neighbours(graph).join(distinct, "other").groupBy("asn", "attr").agg(F.count(F.lit(1)).alias("cnt")))
    norms = counts.groupBy("asn").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("norm"))
    n = graph.select(F.explode(F.array("as1", "as2")).alias("asn")).distinct().agg(F.count(F.lit(1)).alias("n"))
    shares = counts.join(norms, "asn").groupBy("attr").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.round(F.col("cnt") / F.col("norm"), 12)).alias("lo"), F.max(F.round(F.col("cnt") / F.col("norm"), 12)).alias("hi")
    )
    useful = shares.join(F.broadcast(n)).filter("k < n or lo < hi").select("attr")
    return counts.join(useful, "attr", "left_semi")


def cosine_distance(links: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """(as1, as2, <name>): 1 - cosine of the ends' vectors; NO_DISTANCE where an end has none."""
    norms = vectors.groupBy("asn").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("norm"))
    pairs = links.select("as1", "as2").distinct()
    left = pairs.join(vectors.select(F.col("asn").alias("as1"), "attr", F.col("cnt").alias("c1")), "as1")
    dots = left.join(vectors.select(F.col("asn").alias("as2"), "attr", F.col("cnt").alias("c2")), ["as2", "attr"])
    dots = dots.groupBy("as1", "as2").agg(F.sum(F.col("c1") * F.col("c2")).cast("double").alias("dot"))
    n1, n2 = (norms.select(F.col("asn").alias(a), F.col("norm").alias(f"n_{a}")) for a in ("as1", "as2"))
    full = pairs.join(n1, "as1", "left").join(n2, "as2", "left").join(dots, ["as1", "as2"], "left")
    value = 1 - F.coalesce("dot", F.lit(0.0)) / (F.col("n_as1") * F.col("n_as2"))
    return full.select("as1", "as2", F.round(F.coalesce(value, F.lit(NO_DISTANCE)), 6).alias(name))


def relative_metrics(paths: DataFrame, id_column: str, path: str, metrics: dict[str, DataFrame]) -> DataFrame:
    """(id, <metric> array<bigint> for each): for each step of a path the metric of the hop before less that of the hop.

    An AS without the metric counts as 1. paths: one row per id; path: array<bigint> of collapsed hops; metrics: frames
    of (asn, <name>), one row per AS. Paths of fewer than two hops have no steps.
    """
    known = paths.select(id_column, F.posexplode(path).alias("pos", "asn"))
    every = reduce(lambda a, b: a.join(b, "asn", "full_outer"), [m.select("asn", F.col(name)) for name, m in metrics.items()])
    known = attach(known, every.filter("asn is not null"), "asn", 16 * (1 + len(metrics)), "left").fillna(1, list(metrics))
    ordered = known.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", *metrics))).alias("__ms"))
    full, empty = paths.select(id_column).join(ordered, id_column, "left"), F.array().cast("array<bigint>")

    def steps(name: str) -> Column:
        values = F.col(f"__ms.{name}")
        n = F.greatest(F.size(values) - 1, F.lit(0))
        return F.coalesce(F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: a - b), empty)

    return full.select(id_column, *[steps(name).alias(name) for name in metrics])


def pattern_features(paths: DataFrame, id_column: str, path: str, metrics: dict[str, DataFrame]) -> DataFrame:
    """(id, <metric>_1 ... <metric>_6 for each metric): the fixed windows of the relative metrics, interleaved."""
    steps = relative_metrics(paths.select(id_column, once(collapse(F.col(path))).alias("__p")), id_column, "__p", metrics)
    windows = steps.select(id_column, *[fixed_window(F.col(name)).alias(name) for name in metrics])
    columns: list[Column] = [F.col(name)[i].alias(f"{name}_{i + 1}") for i in range(WINDOW) for name in metrics]
    return windows.select(id_column, *columns)


def join_families(families: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    """Feature families joined on the link (and the label, for training); the path family has several rows per link."""
    return reduce(lambda a, b: a.join(b, on, how), families)


def training_frame(positive: dict[str, DataFrame], negative: dict[str, DataFrame]) -> DataFrame:
    """Labelled rows of a day: each family with missing values as 1.0, one row per link but for paths, labels 1 and 0.

    An empty frame of the right columns if a family is missing on either side (the day is skipped).
    """

    def side(families: dict[str, DataFrame], label: int) -> DataFrame:
        ready = []
        for name, f in families.items():
            f = f.fillna(1.0)
            ready.append(f if name == "aspath" else f.dropDuplicates(["as1", "as2"]))
        return join_families(ready, ["as1", "as2"]).withColumn("label", F.lit(label))

    return side(negative, 0).unionByName(side(positive, 1))


def training_window(samples: DataFrame, day: date, days: int) -> DataFrame:
    """Samples (day, label, ...) of the day and the `days` before it; days that lack one of the labels are left out."""
    inside = samples.filter(F.col("day").between(F.date_sub(F.lit(day), days), F.lit(day)))
    whole = inside.groupBy("day").agg(F.count_distinct("label").alias("n")).filter("n = 2").select("day")
    return inside.join(F.broadcast(whole), "day", "left_semi")  # one row per day of the window


def exclude_features(df: DataFrame, excluded: list[str]) -> DataFrame:
    """Without the excluded features, be they of the link or of its ends."""
    names = {n for f in excluded for n in (f, f"{f}_as1", f"{f}_as2")}
    return df.drop(*[c for c in df.columns if c in names])


def category_probability(counts: DataFrame, k: float) -> DataFrame:
    """counts: (c1, c2, n) -> p: the damped share (n / N) ** k of each category, summing to 1."""
    every = Window.partitionBy(F.lit(0))  # one row per category pair
    raw = F.pow(F.col("n") / F.sum("n").over(every), F.lit(k))
    return counts.withColumn("__r", raw).withColumn("p", F.col("__r") / F.sum("__r").over(every)).drop("__r")
