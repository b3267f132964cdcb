"""Mixing sources to target weights, with balanced sampling by the cube method.

Every source with documents gets its share of the largest total that no source's cap forbids. A document of a source
that is to be used r times on average is taken floor(r) times, and once more with probability p = r - floor(r). The
extra copies are drawn by the cube method, balanced on the number of documents and on their tokens: the vector of
probabilities moves through the null space of the constraints until it lies at 0 or 1 in all but a few places, so both
totals of every source come out as wanted, not just on average.

The flight runs in blocks of one source each, on all tasks. Each block leaves at most three documents undecided; those
of a source are flown once more together, and only the last two are landed, by the nearest total.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block of the flight phase.
BLOCK = 50_000
_EDGE = 1e-9


def flight(sizes: list[float], p: list[float], seed: int) -> list[float]:
    """Move p to 0 or 1 in all but at most two places, keeping sum(p) and sum(p * size) as they are.

    Three undecided units at a time: the null space of the two constraints over them is one direction.
    """
    rng = random.Random(seed)
    p = list(p)
    open_: list[int] = []
    for i in range(len(p) + 1):
        while len(open_) == 3 or (i == len(p) and len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]):
            a, b = open_[0], open_[1]
            c = open_[2] if len(open_) == 3 else None
            if c is None:
                u = (1.0, -1.0)
            else:
                u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            up = min(((1 - p[k]) if s > 0 else p[k]) / abs(s) for k, s in zip(open_, u) if s)
            down = min((p[k] if s > 0 else (1 - p[k])) / abs(s) for k, s in zip(open_, u) if s)
            step = up if rng.random() * (up + down) < down else -down
            for k, s in zip(open_, u):
                p[k] += step * s
                p[k] = 0.0 if p[k] < _EDGE else 1.0 if p[k] > 1 - _EDGE else p[k]
            left = [k for k in open_ if 0 < p[k] < 1]
            if len(left) == len(open_):
                p[left[0]] = round(p[left[0]])  # numerical stand-still
                left = left[1:]
            open_ = left
        if i < len(p) and _EDGE < p[i] < 1 - _EDGE:
            open_.append(i)
        elif i < len(p):
            p[i] = float(round(p[i]))
    return p


def land(sizes: list[float], p: list[float]) -> list[int]:
    """Decide what the flight left open: of all 0/1 choices (two units at most) the one nearest to the wanted size."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    wanted = sum(sizes[i] * p[i] for i in open_)
    choices = range(1 << len(open_))
    total = [sum(sizes[i] for k, i in enumerate(open_) if c >> k & 1) for c in choices]
    best = min(choices, key=lambda c: (abs(total[c] - wanted), c))
    out = [int(x) for x in p]
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    return out


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per named source: weight, max_repeats, n_docs, n_tokens, target_share, reachable_share, repeats (average copies of a
    document) and binds: whether its cap is the one that limits the total of all.

    sizes: (source, n_tokens), one row per document. A source named twice counts with its summed weight and least cap.
    Sources without tokens cannot contribute; the others share their weight in proportion (target_share keeps the
    wish as given). A null, zero or negative weight or cap gives nothing. Documents without tokens are not used.
    """
    have = sizes.filter("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    wish = targets.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    every = Window.partitionBy(F.lit(0))  # one row per named source
    joined = wish.join(have, "source", "left").select(
        "source",
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
        F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"),
    )
    usable = (F.col("n_tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    limit = F.when(usable, F.col("max_repeats") * F.col("n_tokens") / F.col("weight"))
    scaled = joined.withColumn("__scale", F.min(limit).over(every)).withColumn("__all", F.sum("weight").over(every))
    return scaled.select(
        "source",
        "weight",
        "max_repeats",
        "n_docs",
        "n_tokens",
        (F.col("weight") / F.col("__all")).alias("target_share"),
        F.coalesce(F.when(usable, F.col("weight")) / F.sum(F.when(usable, F.col("weight"))).over(every), F.lit(0.0)).alias("reachable_share"),
        F.coalesce(limit <= F.col("__scale"), F.lit(False)).alias("binds"),
        F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("__scale") * F.col("weight") / F.col("n_tokens")))
        .otherwise(0.0)
        .alias("repeats"),
    )


_FLOWN = "doc_id bigint, source string, n_tokens bigint, base int, p double"


def _fly(seed: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "n_tokens"], ignore_index=True)
        sizes = block["n_tokens"].astype(float).tolist()
        p = flight(sizes, block["p"].tolist(), seed)
        block["p"] = [float(x) for x in land(sizes, p)] if last else p
        return block[["doc_id", "source", "n_tokens", "base", "p"]]

    return run


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, copies): every document that is used, with how often.

    sizes: (doc_id, source, n_tokens). Documents of null or unnamed sources and without tokens are not used. Copies
    never exceed the source's max_repeats. The draw depends on the seed and the ids alone, not on partitions.
    """
    shares = plan(sizes, targets).select(
        "source", F.floor("repeats").cast("int").alias("base"), "n_docs", (F.col("repeats") - F.floor("repeats")).alias("p")
    )
    # one row per named source: the target table's size, which is given by hand
    used = sizes.filter("n_tokens > 0").join(F.broadcast(shares), "source").filter("base > 0 or p > 0")
    whole = used.filter(F.col("p") <= _EDGE).select("doc_id", "source", "n_tokens", "base", F.lit(0.0).alias("p"))
    blocks = F.ceil(F.col("n_docs") / block)
    drawn = used.filter(F.col("p") > _EDGE).withColumn("__block", F.pmod(F.xxhash64("doc_id"), blocks))
    flown = drawn.groupBy("source", "__block").applyInPandas(_fly(seed, last=False), _FLOWN)
    decided = flown.filter("p = 0 or p = 1")
    open_ = flown.filter("p > 0 and p < 1")  # at most two a block
    landed = open_.groupBy("source").applyInPandas(_fly(seed + 1, last=True), _FLOWN)
    both = whole.unionByName(decided).unionByName(landed)
    return both.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per named source: what was wanted, what there was, and the share of all tokens really reached."""
    got = mixed.groupBy("source").agg(
        F.sum("copies").cast("bigint").alias("used_docs"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"),
        F.max("copies").alias("most_copies"),
    )
    every = Window.partitionBy(F.lit(0))
    joined = plan(sizes, targets).join(got, "source", "left")
    used = F.coalesce("used_tokens", F.lit(0).cast("bigint"))
    return joined.select(
        "source",
        "target_share",
        "reachable_share",
        "binds",
        "max_repeats",
        "n_docs",
        "n_tokens",
        F.coalesce("used_docs", F.lit(0).cast("bigint")).alias("used_docs"),
        used.alias("used_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(used / F.nullif(F.sum(used).over(every), F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )
