"""Training samples: existing links (negative) and forged links (positive), drawn by hashes, so any engine draws the same."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.operators.features import category_probability
from hopwarden.operators.graph import bridges
from hopwarden.session import cut_lineage

#: Cones above this are left to themselves, as are the ASes the caller lists as the top of the hierarchy.
LARGE_CONE, FIRST_K, LEAST_MEMBERS = 4400, 20, 10


def uniform(*text: Column) -> Column:
    """A number in (0, 1] from an MD5 of the columns."""
    digits = F.substring(F.md5(F.concat_ws(" ", *text)), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def weighted_sample(df: DataFrame, weight: Column, draw: Column, n: int, ties: list[str]) -> DataFrame:
    """n rows without replacement, each step in proportion to the weights: the least -ln(u)/w win."""
    return df.withColumn("__k", -F.log(draw) / weight).filter(weight > 0).orderBy("__k", *ties).limit(n).drop("__k")


def categories(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(as1, as2, c1, c2), c1 <= c2: links with the labels of both ends; links with an unlabelled end are left out."""
    x, y = (labels.select(F.col("asn").alias(a), F.col("label").alias(f"l_{a}")) for a in ("as1", "as2"))
    return links.join(x, "as1").join(y, "as2").select("as1", "as2", F.least("l_as1", "l_as2").alias("c1"), F.greatest("l_as1", "l_as2").alias("c2"))


def negative_links(links: DataFrame, labels: DataFrame, carried: DataFrame, size: int, k: float = 1.0, seed: str = "0") -> DataFrame:
    """(as1, as2): existing links by damped category probability, no bridges, of those in `carried` (as1, as2).

    links are read several times. Probabilities count bridges too; they are found once, in the whole graph. Fewer links than
    wanted: all of them.
    """
    named = cut_lineage(categories(links, labels).join(carried.select("as1", "as2").distinct(), ["as1", "as2"], "left_semi"))
    counts = named.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    weights = F.broadcast(category_probability(counts, k).select("c1", "c2", (F.col("p") / F.col("n")).alias("w")))  # one row per category pair
    kept = named.join(weights, ["c1", "c2"]).join(bridges(links), ["as1", "as2"], "left_anti")
    return weighted_sample(kept, F.col("w"), uniform(F.lit(seed), "as1", "as2"), size, ["as1", "as2"]).select("as1", "as2")


def negative_sample(links: DataFrame, labels: DataFrame, carried: DataFrame, size: int, k: float = 1.0, seed: str = "0") -> DataFrame:
    """(as1, as2, path): negative_links, each with a path that runs over it.

    carried: (as1, as2, path) with at least one path per link to be drawn.
    """
    chosen = negative_links(cut_lineage(links), labels, carried, size, k, seed)
    return chosen.join(carried, ["as1", "as2"]).groupBy("as1", "as2").agg(F.min_by("path", F.md5(F.concat_ws(" ", F.lit(seed), "path"))).alias("path"))


def forged_links(labels: DataFrame, probabilities: DataFrame, links: DataFrame, registry: DataFrame, origins: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """positive_sample of forged_pairs, with four times as many draws as long as too few pairs are left of them.

    It is shorter than `size` only if a fourfold number of draws names no more pairs.
    """
    draws, before = 4, -1
    while True:
        pairs = cut_lineage(forged_pairs(labels, probabilities, size, seed, draws))
        found = cut_lineage(positive_sample(pairs, links, registry, origins, size, seed))
        n = pairs.count()
        if found.count() >= size or n == before:
            return found
        draws, before = 4 * draws, n


def forged_pairs(labels: DataFrame, probabilities: DataFrame, size: int, seed: str = "0", draws_each: int = 4) -> DataFrame:
    """(a, b): pairs of ASes drawn by category pair and, within it, uniformly; `draws_each` times `size` draws, distinct.

    Nodes are numbered within their label, a draw names a number on each side, so two equality joins find the pair.
    """
    numbered = labels.select("asn", "label", (F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat_ws(" ", F.lit(seed), "asn")))) - 1).alias("i"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    draws = probabilities.select("c1", "c2", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("p") * draws_each * size).cast("int")))).alias("draw"))
    for side in ("1", "2"):
        picked = F.least(F.floor(uniform(F.lit(seed + side), f"c{side}", "c1", "c2", "draw") * F.col("m")), F.col("m") - 1).cast("int")
        draws = draws.join(sizes.withColumnRenamed("label", f"c{side}"), f"c{side}").withColumn(f"i{side}", picked).drop("m")
        draws = draws.join(numbered.select(F.col("label").alias(f"c{side}"), F.col("i").alias(f"i{side}"), F.col("asn").alias(f"n{side}")), [f"c{side}", f"i{side}"])
    return draws.filter("n1 <> n2").select(F.col("n1").alias("a"), F.col("n2").alias("b")).distinct()


def positive_sample(pairs: DataFrame, links: DataFrame, registry: DataFrame, origins: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """(as1, as2, attacker, victim, path): forged links: a real path to its origin `attacker`, the victim appended.

    pairs: (a, b); links and registry: (as1, as2) that exist; origins: (origin, path) of paths with three hops or more.
    Of two ends that both originate paths the one whose text is smaller attacks.
    """
    start = origins.groupBy("origin").agg(F.min_by("path", F.md5(F.concat_ws(" ", F.lit(seed), "path"))).alias("path"))
    keyed = pairs.select("a", "b", F.least("a", "b").alias("as1"), F.greatest("a", "b").alias("as2"))
    for known in (links, registry):
        keyed = keyed.join(known.select("as1", "as2"), ["as1", "as2"], "left_anti")
    keyed = keyed.groupBy("as1", "as2").agg(F.min("a").alias("a"))  # a pair drawn in both orders is one
    x, y = (start.select(F.col("origin").alias(c), F.col("path").alias(f"p_{c}")) for c in ("as1", "as2"))
    both = keyed.join(x, "as1", "left").join(y, "as2", "left").filter("p_as1 is not null or p_as2 is not null")
    first = F.col("p_as1").isNotNull() & (F.col("p_as2").isNull() | (F.col("as1").cast("string") < F.col("as2").cast("string")))
    attacker, victim = F.when(first, F.col("as1")).otherwise(F.col("as2")), F.when(first, F.col("as2")).otherwise(F.col("as1"))
    path = F.concat_ws(" ", F.when(first, F.col("p_as1")).otherwise(F.col("p_as2")), victim)
    rows = both.select("as1", "as2", attacker.alias("attacker"), victim.alias("victim"), path.alias("path"))
    return rows.orderBy(uniform(F.lit(seed), "as1", "as2"), "as1", "as2").limit(size)


def balanced_sample(named: DataFrame, per_category: int = 100, seed: str = "0") -> DataFrame:
    """Up to `per_category` links of each category pair, drawn uniformly; all if there are fewer."""
    w = Window.partitionBy("c1", "c2").orderBy(uniform(F.lit(seed), "as1", "as2"), "as1", "as2")
    return named.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_category).drop("__r")


def clusterable(nodes: DataFrame, top: list[int]) -> DataFrame:
    """Nodes (asn, degree, cone) without those of `top` and those with a cone above LARGE_CONE."""
    return nodes.filter(~F.col("asn").isin(top) & (F.col("cone") <= LARGE_CONE))


def cluster_ases(nodes: DataFrame, top: list[int] | None = None, seed: int = 1) -> DataFrame:
    """(asn, label): k-means on (degree, cone), from k = FIRST_K down until every cluster has LEAST_MEMBERS members.

    `top` and ASes with a cone above LARGE_CONE are left out; the top ones get a label of their own, the number of
    clusters. Fewer ASes than members wanted: one cluster.
    """
    top = top or []
    small = clusterable(nodes, top)
    ready = VectorAssembler(inputCols=["degree", "cone"], outputCol="x").transform(small).persist()
    k = max(1, min(FIRST_K, small.count() // LEAST_MEMBERS))
    while True:
        model = KMeans(k=max(k, 2), seed=seed, featuresCol="x", predictionCol="label").fit(ready) if k > 1 else None
        found = model.transform(ready).select("asn", "label") if model else ready.select("asn", F.lit(0).alias("label"))
        sizes = [r["count"] for r in found.groupBy("label").count().collect()]  # k rows
        if k == 1 or len(sizes) == k and min(sizes) >= LEAST_MEMBERS:
            break
        k -= 1
    ready.unpersist()
    return found.unionByName(nodes.filter(F.col("asn").isin(top)).select("asn", F.lit(k).alias("label")))
