"""Evaluation tables: confusion matrices, rates per category pair, contingency shares, distributions by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """by + tp, fn, fp, tn, accuracy, tpr, fpr (per cent, 2 decimals; 0 where there is nothing to divide by)."""
    n = lambda l, p: F.sum(((F.col(label) == l) & (F.col(predicted) == p)).cast("bigint"))
    c = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"))
    rate = lambda a, b: F.when(b > 0, F.round(100 * a / F.when(b > 0, b), 2)).otherwise(0.0)
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select(*by, tp, fn, fp, tn, rate(tp + tn, tp + fn + fp + tn).alias("accuracy"), rate(tp, tp + fn).alias("tpr"), rate(fp, fp + tn).alias("fpr"))


def contingency(links: DataFrame) -> DataFrame:
    """(c1, c2, share): symmetric table of the categories of both ends, as shares of all links, 5 decimals."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per category pair
    counts = links.groupBy(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / total, 5))
    sides = F.when(F.col("c1") == F.col("c2"), F.array(F.struct("c1", "c2"))).otherwise(
        F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    )
    return shares.select(F.explode(sides).alias("s"), "share").select("s.c1", "s.c2", "share")


def rates_by_category(df: DataFrame, empty: float = 0.0, digits: int = 4) -> DataFrame:
    """(c1, c2, tpr, fpr) per category pair; rows without a category are left out."""
    n = lambda l, p: F.sum(((F.col("label") == l) & (F.col("predicted") == p)).cast("bigint"))
    known = df.filter("c1 is not null and c2 is not null")
    c = known.groupBy(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    rate = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.round(F.col(x) / (F.col(x) + F.col(y)), digits)).otherwise(empty)
    return c.select("c1", "c2", rate("a", "b").alias("tpr"), rate("c", "d").alias("fpr"))


def cluster_summary(df: DataFrame) -> DataFrame:
    """(cluster, n, and the quartiles of degree and cone) - what a box plot of a cluster shows."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = [F.count(F.lit(1)).alias("n")]
    for c in ("degree", "cone"):
        out += [F.min(c).alias(f"{c}_min"), q(c, 0.25).alias(f"{c}_q1"), q(c, 0.5).alias(f"{c}_median"), q(c, 0.75).alias(f"{c}_q3"), F.max(c).alias(f"{c}_max")]
    return df.groupBy("cluster").agg(*out)


def by_size(results: DataFrame) -> DataFrame:
    """(size, runs, quartiles of tpr and fpr): how results spread with the size of the training set."""
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 4)
    return results.groupBy("size").agg(
        F.count(F.lit(1)).alias("runs"), *[q(c, p).alias(f"{c}_{int(p * 100)}") for c in ("tpr", "fpr") for p in (0.25, 0.5, 0.75)]
    )
