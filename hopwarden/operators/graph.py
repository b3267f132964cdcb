"""Topological features of candidate links: what adding the link changes in the graph without it.

G is a set of undirected links. For a candidate e = (as1, as2) `before` is a feature of G without e, `after` of G with e;
the result is after - before. Counts after the addition follow from counts before it: degrees grow by one, triangles by
the common neighbours, and a distance from as1 becomes min(d1, 1 + d2). So one look at G and two searches do for all.
Where an end is not in G, or no path joins the ends without e, `before` is zero for every feature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwarden.operators.topology import degrees, neighbours
from hopwarden.session import cut_lineage

#: Up to this many bytes the graph is sent to the tasks as two arrays, beyond it searches run as joins; both give the same.
SENT_BYTES, BYTES_A_LINK = 64 << 20, 32
MAX_ROUNDS = 64
#: Searches run at once: one for each bit of a bigint.
WORD = 64

LINK = ["as1", "as2"]


def common_neighbours(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(as1, as2, w): the common neighbours of each pair; only the end of lower degree is expanded."""
    deg = degrees(links)
    d1, d2 = (deg.select(F.col("asn").alias(a), F.col("degree").alias(f"__d{a}")) for a in LINK)
    sized = pairs.select(*LINK).join(d1, "as1").join(d2, "as2")
    small = F.when(F.col("__das1") <= F.col("__das2"), F.col("as1")).otherwise(F.col("as2"))
    big = F.when(F.col("__das1") <= F.col("__das2"), F.col("as2")).otherwise(F.col("as1"))
    wide = sized.select(*LINK, small.alias("asn"), big.alias("__big")).join(neighbours(links), "asn")
    wide = wide.filter("other <> __big").withColumns({"__a": F.least("other", "__big"), "__b": F.greatest("other", "__big")})
    have = links.select(F.col("as1").alias("__a"), F.col("as2").alias("__b"))
    return wide.join(have, ["__a", "__b"], "left_semi").select(*LINK, F.col("other").alias("w"))


def triangles(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(asn, triangles): triangles through each AS that has any, or through those of `of` (asn), without looking at others."""
    if of is None:
        per_link = common_neighbours(links, links).groupBy(*LINK).agg(F.count(F.lit(1)).alias("n"))
        return per_link.select(F.explode(F.array(*LINK)).alias("asn"), "n").groupBy("asn").agg((F.sum("n") / 2).cast("bigint").alias("triangles"))
    mine = neighbours(links).join(of.select("asn"), "asn", "left_semi")
    own = mine.select(F.least("asn", "other").alias("as1"), F.greatest("asn", "other").alias("as2"))
    per_link = common_neighbours(own.distinct(), links).groupBy(*LINK).agg(F.count(F.lit(1)).alias("n"))
    sides = per_link.select(F.explode(F.array(*LINK)).alias("asn"), "n").join(of.select("asn"), "asn", "left_semi")
    return sides.groupBy("asn").agg((F.sum("n") / 2).cast("bigint").alias("triangles"))


def neighbour_degree_sums(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(asn, degree, degree_sum): degree and the sum of the neighbours' degrees, of all ASes or of those of `of` (asn)."""
    deg, near = degrees(links), neighbours(links)
    near = near if of is None else near.join(of.select("asn"), "asn", "left_semi")
    each = near.join(deg.select(F.col("asn").alias("other"), F.col("degree").alias("d")), "other")
    return each.groupBy("asn").agg(F.count(F.lit(1)).alias("degree"), F.sum("d").alias("degree_sum"))


# --- searches -------------------------------------------------------------------------------------------------------

_REACH = "as1 long, as2 long, apart int, " + ", ".join(
    f"{w}_r{i} long, {w}_s{i} long, {w}_h{i} double, {w}_e{i} long" for w in ("before", "after") for i in (1, 2)
)


def _summaries(within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reach, distance sum, harmonic sum and greatest distance of each search. within: nodes within 0, 1, ... steps, a row each."""
    grown, k = np.diff(within, axis=0, prepend=0), np.arange(len(within))[:, None]
    return within[-1], (grown * k).sum(axis=0), (grown[1:] / k[1:]).sum(axis=0), np.where(grown > 0, k, 0).max(axis=0)


def _bit_sums(words: np.ndarray, m: int) -> np.ndarray:
    """How many words have each of the bits 0 ... m - 1."""
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[:m]


def _searched(nodes: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
    """The rows of _REACH for up to WORD candidates, searched together: a node has a bit for each that reached it."""
    n, m = len(nodes), len(pairs)
    at = np.searchsorted(nodes, pairs)
    there = at < n
    there[there] = nodes[at[there]] == pairs[there]
    at = np.where(there, at, n + np.arange(2 * m).reshape(m, 2))  # an end that is not in the graph has no links
    bits = np.uint64(1) << np.arange(m, dtype=np.uint64)
    own, barred = [], []  # a candidate's own link is no way, from either end
    for (u, v), bit in zip(at[there.all(axis=1)], bits[there.all(axis=1)]):
        for x, y in ((u, v), (v, u)):
            for i in starts[x] + np.flatnonzero(ends[starts[x] : starts[x + 1]] == y):
                own.append(i)
                barred.append(~bit)
    own, barred = np.array(own, np.int64), np.array(barred, np.uint64)
    seen = np.zeros((2, n + 2 * m), np.uint64)
    for i in (0, 1):
        np.bitwise_or.at(seen[i], at[:, i], bits)
    fresh, apart, within = seen.copy(), np.full(m, -1), []
    while True:
        earlier = seen & ~fresh  # within k of an end after the addition: within k of it, or k - 1 of the other, without the link
        within.append([_bit_sums(x, m) for x in (seen[0], seen[1], seen[0] | earlier[1], seen[1] | earlier[0])])
        apart[(fresh[0][at[:, 1]] & bits != 0) & there.all(axis=1)] = len(within) - 1
        if not fresh.any():
            break
        for i in (0, 1):
            given = fresh[i][ends]
            np.bitwise_and.at(given, own, barred)
            got = np.bitwise_or.reduceat(given, starts[:-1]) if n else given  # every node has a link
            fresh[i] = 0
            fresh[i][:n] = got & ~seen[i][:n]
            seen[i] |= fresh[i]
    sums = [_summaries(x) for x in np.array(within).transpose(1, 0, 2)]
    before = [x * there[:, i] for i in (0, 1) for x in sums[i]]
    columns = [pairs[:, 0], pairs[:, 1], apart, *before, *sums[2], *sums[3]]
    return pd.DataFrame(dict(zip((c.split()[0] for c in _REACH.split(", ")), columns)))


def _searcher(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = batch[LINK].to_numpy(np.int64)
            for i in range(0, len(pairs), WORD):
                yield _searched(*sent.value, pairs[i : i + WORD])

    return run


def as_arrays(links: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ASes in order, where the neighbours of each begin, and the neighbours by their place in that order."""
    t = neighbours(links).toArrow()
    return _arrays(*(t.column(c).to_numpy() for c in ("asn", "other")))


def _arrays(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = np.unique(a)
    src, dst = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    order = np.argsort(src, kind="stable")
    starts = np.searchsorted(src[order], np.arange(len(nodes) + 1))
    return nodes, starts, dst[order]


def reach_by_arrays(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Reach, distance sum, harmonic sum and greatest distance of both ends, before and after, by searches in arrays.

    The caller has checked that the links take at most SENT_BYTES.
    """
    context = links.sparkSession.sparkContext
    sent = context.broadcast(as_arrays(links))
    return candidates.select(*LINK).repartition(context.defaultParallelism, *LINK).mapInPandas(_searcher(sent), _REACH)


def reach_by_joins(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The same as reach_by_arrays for graphs of any size: WORD candidates are searched at once, a bit each.

    A row is a node and a word of candidates with the bits that reached it from either end, so a round joins the links to
    nodes x candidates / WORD rows. Rounds are checkpointed; counts by distance are taken from them afterwards.
    """
    near = neighbours(links).select(F.col("asn").alias("node"), "other")
    numbered = cut_lineage(candidates.select(*LINK).withColumn("__n", F.monotonically_increasing_id()))
    one = F.expr(f"shiftleft(1L, cast(__n % {WORD} as int))")
    numbered = numbered.select(*LINK, F.expr(f"__n div {WORD}").alias("word"), F.expr(f"cast(__n % {WORD} as int)").alias("bit"), one.alias("mask"))
    zero = F.lit(0).cast("bigint")
    seeds = [numbered.select("word", F.col(a).alias("node"), *[(F.col("mask") if a == x else zero).alias(f"f{i}") for i, x in ((1, "as1"), (2, "as2"))]) for a in LINK]
    state = seeds[0].unionByName(seeds[1]).groupBy("word", "node").agg(F.bit_or("f1").alias("f1"), F.bit_or("f2").alias("f2"))
    state = cut_lineage(state.select("word", "node", F.col("f1").alias("s1"), F.col("f2").alias("s2"), "f1", "f2"))
    ends = [numbered.select("word", F.col(a).alias("node"), F.col(b).alias("other"), "mask") for a, b in (LINK, LINK[::-1])]
    own = ends[0].unionByName(ends[1]).groupBy("word", "node", "other").agg(F.bit_or("mask").alias("barred"))  # a candidate's own link is no way
    found, states = True, [state]
    while found:
        if len(states) > MAX_ROUNDS:
            raise RuntimeError(f"a search took more than {MAX_ROUNDS} rounds")
        sent = states[-1].filter("f1 <> 0 or f2 <> 0").select("word", "node", "f1", "f2").join(near, "node").join(own, ["word", "node", "other"], "left")
        free = F.bitwise_not(F.coalesce("barred", zero))
        got = sent.groupBy("word", F.col("other").alias("node")).agg(*[F.bit_or(F.col(f"f{i}").bitwiseAND(free)).alias(f"g{i}") for i in (1, 2)])
        both = states[-1].select("word", "node", "s1", "s2").join(got, ["word", "node"], "full_outer")
        was = {i: F.coalesce(f"s{i}", zero) for i in (1, 2)}
        fresh = {i: F.coalesce(f"g{i}", zero).bitwiseAND(F.bitwise_not(was[i])) for i in (1, 2)}
        states.append(cut_lineage(both.select("word", "node", *[was[i].bitwiseOR(fresh[i]).alias(f"s{i}") for i in (1, 2)], *[fresh[i].alias(f"f{i}") for i in (1, 2)])))
        found = not states[-1].filter("f1 <> 0 or f2 <> 0").isEmpty()
    # within distance k of an end after the addition: what is within k of it, or within k - 1 of the other, without the link
    counted, met = [], []
    for k, at in enumerate(states):
        earlier = {i: F.col(f"s{i}").bitwiseAND(F.bitwise_not(F.col(f"f{i}"))) for i in (1, 2)}
        sets = {"before1": F.col("s1"), "before2": F.col("s2"), "after1": F.col("s1").bitwiseOR(earlier[2]), "after2": F.col("s2").bitwiseOR(earlier[1])}
        sums = [F.array(*[F.sum(F.call_function("getbit", c, F.lit(b)).cast("bigint")) for b in range(WORD)]).alias(n) for n, c in sets.items()]
        counted.append(at.groupBy("word").agg(*sums).withColumn("k", F.lit(k)))
        hit = numbered.join(at.select("word", F.col("node").alias("as2"), "f1"), ["word", "as2"]).filter(F.col("f1").bitwiseAND(F.col("mask")) != 0)
        met.append(hit.select(*LINK, F.lit(k).alias("apart")))
    levels, apart = counted[0], met[0]
    for c, m in zip(counted[1:], met[1:]):
        levels, apart = levels.unionByName(c), apart.unionByName(m)
    each = numbered.join(cut_lineage(levels), "word")
    each = each.select(*LINK, "k", *[F.get(n, F.col("bit")).alias(n) for n in ("before1", "before2", "after1", "after2")])
    by_k = each.groupBy(*LINK).agg(F.array_sort(F.collect_list(F.struct("k", "before1", "before2", "after1", "after2"))).alias("x"))  # one per round
    out: list[Column] = []
    for w in ("before", "after"):
        for i in (1, 2):
            out += _from_counts(F.col(f"x.{w}{i}"), f"{w}_", i)
    joined = by_k.join(apart, LINK, "left")
    there = links.select(F.explode(F.array(*LINK)).alias("asn")).distinct()
    for i, a in ((1, "as1"), (2, "as2")):  # an end that is not in the graph reaches nothing before
        joined = joined.join(there.select(F.col("asn").alias(a), F.lit(True).alias(f"in{i}")), a, "left")
    apart_ = F.when(F.col("in1") & F.col("in2"), F.col("apart"))
    full = joined.select(*LINK, F.coalesce(apart_, F.lit(-1)).alias("apart"), "in1", "in2", *out)
    kept = [F.when(F.col(f"in{c[-1]}"), F.col(c)).otherwise(F.lit(0)).alias(c) if c.startswith("before") else F.col(c) for c in full.columns[5:]]
    return full.select(*LINK, "apart", *kept)


def _from_counts(within: Column, name: str, i: int) -> list[Column]:
    """Reach, distance sum, harmonic sum and greatest distance from the numbers of nodes within 0, 1, 2, ... steps."""
    grown = F.transform(within, lambda n, k: n - F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(within, F.greatest(k - 1, F.lit(0)))))
    far = F.transform(grown, lambda g, k: F.when(k > 0, g / F.greatest(k, F.lit(1))).otherwise(0.0))
    return [
        F.array_max(within).alias(f"{name}r{i}"),
        F.aggregate(F.transform(grown, lambda g, k: g * k), F.lit(0).cast("bigint"), lambda a, b: a + b).alias(f"{name}s{i}"),
        F.aggregate(far, F.lit(0.0), lambda a, b: a + b).alias(f"{name}h{i}"),
        F.array_max(F.transform(grown, lambda g, k: F.when(g > 0, k).otherwise(0))).cast("bigint").alias(f"{name}e{i}"),
    ]


def reach(candidates: DataFrame, links: DataFrame) -> DataFrame:
    small = links.count() * BYTES_A_LINK <= SENT_BYTES
    return (reach_by_arrays if small else reach_by_joins)(candidates, links)


def spanning_forest(links: DataFrame) -> DataFrame:
    """(asn, root, parent, depth): a breadth-first tree of every component, from its AS of most links (ties by number).

    Every AS passes the best label it knows on to its neighbours; the component's best label reaches each AS by a shortest
    path, so the round of an AS's last change is its depth. AS numbers have 32 bits. Roots have no parent and depth 0.
    """
    near = neighbours(links).select(F.col("other").alias("asn"), F.col("asn").alias("from"))
    label = (F.lit((1 << 30) - 1) - F.least("degree", F.lit((1 << 30) - 1))) * (1 << 32) + F.col("asn")
    state = cut_lineage(degrees(links).select("asn", label.alias("label"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth")))
    for k in range(1, MAX_ROUNDS + 2):
        changed = state.filter(F.col("depth") == k - 1).select(F.col("asn").alias("from"), F.col("label").alias("given"))
        if changed.isEmpty():
            return state.select("asn", (F.col("label") % (1 << 32)).alias("root"), "parent", "depth")
        best = near.join(changed, "from").groupBy("asn").agg(F.min("given").alias("given"), F.min_by("from", "given").alias("from"))
        better = F.col("given") < F.col("label")
        pick = lambda new, old: F.when(better, new).otherwise(F.col(old)).alias(old)
        state = cut_lineage(state.join(best, "asn", "left").select("asn", pick(F.col("given"), "label"), pick(F.col("from"), "parent"), pick(F.lit(k), "depth")))
    raise RuntimeError(f"a component is deeper than {MAX_ROUNDS} rounds")


def _roots(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least node of the component of each: nodes and their roots take the least root among their neighbours."""
    root = np.arange(len(starts) - 1)
    while True:
        near = np.minimum.reduceat(root[ends], starts[:-1])  # every node has a link
        new = np.minimum(root, near)
        np.minimum.at(new, root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bridges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all bridges, by the labels of links outside a breadth-first tree as in `bridges`."""
    root = _roots(starts, ends)
    n = len(root)
    parent, seen, levels = np.full(n, -1), root == np.arange(n), []
    front = np.flatnonzero(seen)
    while len(front):
        levels.append(front)
        counts = starts[front + 1] - starts[front]
        near = ends[np.repeat(starts[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        giver = np.repeat(front, counts)[~seen[near]]
        front, first = np.unique(near[~seen[near]], return_index=True)
        parent[front], seen[front] = giver[first], True
    a, b = np.repeat(np.arange(n), np.diff(starts)), ends
    outside = (a < b) & (parent[a] != b) & (parent[b] != a)
    x, label = np.zeros(n, np.uint64), np.random.default_rng(1).integers(0, 1 << 64, outside.sum(), np.uint64)
    for end in (a, b):
        np.bitwise_xor.at(x, end[outside], label)
    for level in levels[:0:-1]:
        np.bitwise_xor.at(x, parent[level], x[level])
    cut = np.flatnonzero((parent >= 0) & (x == 0))
    return cut, parent[cut]


def bridges_by_arrays(links: DataFrame) -> DataFrame:
    """The same as bridges, by one task; the caller has checked that the links take at most SENT_BYTES."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch[LINK].to_numpy(np.int64) for batch in batches]
        if sum(map(len, parts)):
            a, b = np.concatenate(parts).T
            nodes, starts, ends = _arrays(np.concatenate([a, b]), np.concatenate([b, a]))
            found = np.sort(nodes[np.stack(_bridges(starts, ends), axis=1)], axis=1)
            yield pd.DataFrame(found, columns=LINK)

    return links.select(*LINK).repartition(1).mapInPandas(find, "as1 long, as2 long")


def bridges(links: DataFrame, forest: DataFrame | None = None) -> DataFrame:
    """(as1, as2): the links whose ends fall apart without them, all found together in time linear in the links.

    Without a forest, links of up to SENT_BYTES are searched in arrays. Each link outside the spanning forest gets a random 64-bit label, each AS the xor of its links' labels. A tree link is a
    bridge where the xor over the subtree below it is 0: then no outside link leaves the subtree. That another sum of labels
    is 0 by chance has a probability of 2^-64 a link.
    """
    if forest is None and links.count() * BYTES_A_LINK <= SENT_BYTES:
        return bridges_by_arrays(links)
    forest = spanning_forest(links) if forest is None else forest
    tree = forest.filter("parent is not null").select(F.least("asn", "parent").alias("as1"), F.greatest("asn", "parent").alias("as2"))
    outside = links.select(*LINK).join(tree, LINK, "left_anti").select(F.explode(F.array(*LINK)).alias("asn"), F.xxhash64(F.lit(1), *LINK).alias("x"))
    own = outside.groupBy("asn").agg(F.bit_xor("x").alias("x"))
    nodes = cut_lineage(forest.join(own, "asn", "left").select("asn", "parent", "depth", F.coalesce("x", F.lit(0).cast("bigint")).alias("x")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below, found = None, []  # (asn, x): sums of the children, by their parent
    for depth in range(deepest, 0, -1):
        at = nodes.filter(F.col("depth") == depth)
        summed = at if below is None else at.join(below, "asn", "left").select("asn", "parent", "depth", F.col("x").bitwiseXOR(F.coalesce("below", F.lit(0).cast("bigint"))).alias("x"))
        summed = cut_lineage(summed) if depth > 1 else summed  # read by its own level and the one above
        found.append(summed.filter("x = 0").select(F.least("asn", "parent").alias("as1"), F.greatest("asn", "parent").alias("as2")))
        below = summed.groupBy(F.col("parent").alias("asn")).agg(F.bit_xor("x").alias("below"))
    out = tree.limit(0)
    for f in found:
        out = out.unionByName(f)
    return out


# --- all features ---------------------------------------------------------------------------------------------------

def topological_features(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """(as1, as2, <end feature>_as1, <end feature>_as2, <link feature>): after - before of every candidate.

    candidates, links: distinct (as1, as2), as1 < as2. Candidates may be part of the links or not.
    """
    candidates = cut_lineage(candidates.select(*LINK))
    n = links.select(F.explode(F.array(*LINK)).alias("asn")).distinct().agg(F.count(F.lit(1)).alias("n"))
    base = candidates
    ends = candidates.select(F.explode(F.array(*LINK)).alias("asn")).distinct()
    local = cut_lineage(neighbour_degree_sums(links, ends).join(triangles(links, ends), "asn", "left"))
    for i, a in ((1, "as1"), (2, "as2")):
        own = local.select(F.col("asn").alias(a), F.col("degree").alias(f"d{i}"), F.col("degree_sum").alias(f"s{i}"), F.coalesce("triangles", F.lit(0)).alias(f"t{i}"))
        base = base.join(own, a, "left")
    shared = common_neighbours(candidates, links).join(degrees(links).withColumnRenamed("asn", "w"), "w")
    cn = shared.groupBy(*LINK).agg(F.count(F.lit(1)).alias("cn"), F.sum(1 / F.log(F.col("degree").cast("double"))).alias("aa"))
    inside = links.select(*LINK, F.lit(1).alias("inside"))
    base = base.join(cn, LINK, "left").join(inside, LINK, "left").join(reach(candidates, links), LINK).join(F.broadcast(n))
    base = cut_lineage(base)  # else the driver plans the long expressions below anew after each stage of the joins
    zero = F.lit(0).cast("bigint")
    base = base.withColumn("absent", F.col("d1").isNull().cast("bigint") + F.col("d2").isNull().cast("bigint"))
    base = base.select("*", *[F.coalesce(c, zero).alias(f"_{c}") for c in ("d1", "d2", "s1", "s2", "t1", "t2", "cn")], F.coalesce("inside", F.lit(0)).alias("_in"), F.coalesce("aa", F.lit(0.0)).alias("_aa"))
    valid = (F.col("absent") == 0) & (F.col("apart") >= 0)
    out: list[Column] = [F.col("as1"), F.col("as2")]

    def delta(after: Column, before: Column, name: str) -> None:
        out.append(F.round(after - F.when(valid, before).otherwise(0.0), 6).alias(name))

    dd = lambda x: x.cast("double")
    n0, n1 = dd(F.col("n")), dd(F.col("n") + F.col("absent"))
    minus = {i: F.col(f"_d{i}") - F.col("_in") for i in (1, 2)}
    for i, j, a in ((1, 2, "as1"), (2, 1, "as2")):
        d0, d1 = minus[i], minus[i] + 1
        sum0 = F.col(f"_s{i}") - F.col("_in") * F.col(f"_d{j}")
        sum1 = sum0 + minus[j] + 1
        t0 = F.col(f"_t{i}") - F.col("_in") * F.col("_cn")
        t1 = t0 + F.col("_cn")
        ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(dd(x) / F.when(y == 0, 1).otherwise(y))
        delta(ratio(d1, n1 - 1), ratio(d0, n0 - 1), f"degree_centrality_{a}")
        delta(ratio(sum1, d1), ratio(sum0, d0), f"average_neighbor_degree_{a}")
        delta(dd(t1), dd(t0), f"triangles_{a}")
        delta(ratio(2 * t1, d1 * (d1 - 1)), ratio(2 * t0, d0 * (d0 - 1)), f"clustering_{a}")
        delta(dd(F.col(f"after_e{i}")), dd(F.col(f"before_e{i}")), f"eccentricity_{a}")
        delta(F.col(f"after_h{i}"), F.col(f"before_h{i}"), f"harmonic_centrality_{a}")

        def close(w: str, total: Column, i: int = i) -> Column:
            r, s = dd(F.col(f"{w}_r{i}")) - 1, dd(F.col(f"{w}_s{i}"))
            return F.when((s <= 0) | (total <= 1), 0.0).otherwise(r / F.when(s <= 0, 1.0).otherwise(s) * r / F.when(total <= 1, 1.0).otherwise(total - 1))

        delta(close("after", n1), close("before", n0), f"closeness_centrality_{a}")
    union0 = minus[1] + minus[2] - F.col("_cn")
    delta(F.lit(2.0), dd(F.col("apart") + 1), "shortest_path")
    delta(dd(F.col("_cn")) / (union0 + 2), F.when(union0 == 0, 0.0).otherwise(dd(F.col("_cn")) / F.when(union0 == 0, 1).otherwise(union0)), "jaccard")
    delta(F.col("_aa"), F.col("_aa"), "adamic_adar")
    delta(dd((minus[1] + 1) * (minus[2] + 1)), dd(minus[1] * minus[2]), "preferential_attachement")
    return base.select(*out)


def on_a_cycle(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """(as1, as2, connected): whether the ends are connected without the link; candidates may be part of the links or not.

    A link of the graph is so unless it is a bridge, any other pair if both ends are in one component.
    """
    forest = cut_lineage(spanning_forest(links))
    x, y = (forest.select(F.col("asn").alias(a), F.col("root").alias(f"__r{a}")) for a in LINK)
    marked = candidates.select(*LINK).join(bridges(links, forest).withColumn("__cut", F.lit(True)), LINK, "left").join(x, "as1", "left").join(y, "as2", "left")
    together = F.coalesce(F.col("__ras1") == F.col("__ras2"), F.lit(False))
    return marked.select(*LINK, (together & F.col("__cut").isNull()).alias("connected"))


# --- optional centralities ------------------------------------------------------------------------------------------


def pagerank(links: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(asn, pagerank) after a fixed number of rounds; every AS of an undirected graph has a neighbour, so none dangles."""
    near = neighbours(links).join(degrees(links), "asn")
    n = degrees(links).count()
    rank = degrees(links).select("asn", F.lit(1.0 / max(n, 1)).alias("pagerank"))
    for i in range(rounds):
        given = near.join(rank, "asn").groupBy(F.col("other").alias("asn")).agg(F.sum(F.col("pagerank") / F.col("degree")).alias("in"))
        rank = given.select("asn", ((1 - damping) / max(n, 1) + damping * F.col("in")).alias("pagerank"))
        if i % 5 == 4:
            rank = cut_lineage(rank)
    return rank


def eigenvector_centrality(links: DataFrame, rounds: int = 20) -> DataFrame:
    """(asn, centrality): power iteration on A + I, normalised to length one each round."""
    near = neighbours(links).select("asn", "other")
    rank = degrees(links).select("asn", F.lit(1.0).alias("x"))
    for i in range(rounds):
        given = near.join(rank, "asn").select(F.col("other").alias("asn"), "x").unionByName(rank)
        rank = given.groupBy("asn").agg(F.sum("x").alias("x"))
        if i % 2 == 1 or i == rounds - 1:  # its length is the same for every AS, so it need not be divided out each round
            rank = cut_lineage(rank)
            norm = rank.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            rank = rank.join(F.broadcast(norm)).select("asn", (F.col("x") / F.col("norm")).alias("x"))
    return rank.withColumnRenamed("x", "centrality")


def square_clustering(links: DataFrame) -> DataFrame:
    """(asn, square_clustering): squares through an AS against the possible ones.

    Summed over the pairs of an AS's d neighbours, the possible ones are (d - 1) times the neighbours' degrees less d (d - 1)
    less the squares less twice the triangles. A square is found at its corner of the highest degree (ties by number): two-step
    paths down from it, by their far end, so no AS's neighbours are all paired and the work is links times their square root.
    """
    near, deg = neighbours(links), degrees(links)
    ranked = near.join(deg, "asn").select("asn", "other", F.struct("degree", "asn").alias("ra"))
    ranked = ranked.join(deg.select(F.col("asn").alias("other"), F.col("degree").alias("do")), "other").select("asn", "other", "ra", F.struct(F.col("do"), F.col("other")).alias("ro"))
    down = ranked.filter("ra > ro").select(F.col("asn").alias("top"), F.col("other").alias("mid"), F.col("ra").alias("rt"))
    paths = down.join(ranked.select(F.col("asn").alias("mid"), F.col("other").alias("far"), F.col("ro").alias("rf")), "mid").filter("rf < rt").select("top", "mid", "far")
    shared = paths.groupBy("top", "far").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    corners = shared.select(F.explode(F.array("top", "far")).alias("asn"), F.expr("c * (c - 1) div 2").alias("s"))
    sides = paths.join(shared, ["top", "far"]).select(F.col("mid").alias("asn"), (F.col("c") - 1).alias("s"))
    squares = corners.unionByName(sides).groupBy("asn").agg(F.sum("s").alias("s"))
    full = neighbour_degree_sums(links).join(squares, "asn", "left").join(triangles(links), "asn", "left")
    zero = F.lit(0).cast("bigint")
    s_, d = F.coalesce("s", zero), F.col("degree")
    possible = (d - 1) * F.col("degree_sum") - d * (d - 1) - s_ - 2 * F.coalesce("triangles", zero)
    return full.select("asn", F.when(possible > 0, s_ / possible).otherwise(0.0).alias("square_clustering"))


def _maximal_cliques(near: dict[int, set[int]], candidates: set[int], excluded: set[int]) -> Iterator[set[int]]:
    """Cliques among the candidates that nothing of candidates or excluded extends: depth-first with pivots, on a stack."""
    stack = [(set(), candidates, excluded)]
    while stack:
        clique, open_, shut = stack.pop()
        if not open_:
            if not shut:
                yield clique
            continue
        pivot = max(open_ | shut, key=lambda v: len(near[v] & open_))
        for v in list(open_ - near[pivot]):
            stack.append((clique | {v}, open_ & near[v], shut & near[v]))
            open_ = open_ - {v}
            shut = shut | {v}


def number_of_cliques(links: DataFrame) -> DataFrame:
    """(asn, number_of_cliques): maximal cliques that contain each AS.

    A clique is found once, at its AS of the lowest degree (ties by number), among that AS's neighbours of higher order - at
    most the square root of twice the links, however many neighbours there are; lower neighbours only tell whether it could
    be extended. So a task's part is the triangles of one AS that hold a higher neighbour. Off by default, as the count can
    explode with dense cores.
    """
    deg = degrees(links)
    rank = {x: deg.select(F.col("asn").alias(x), F.struct("degree", "asn").alias(f"r{x}")) for x in ("asn", "a", "b")}
    edges = common_neighbours(links, links).select(F.col("w").alias("asn"), F.col("as1").alias("a"), F.col("as2").alias("b"))
    edges = edges.join(rank["asn"], "asn").join(rank["a"], "a").join(rank["b"], "b").filter("ra > rasn or rb > rasn")
    edges = edges.select("asn", "a", "b", F.expr("ra > rasn").alias("up_a"), F.expr("rb > rasn").alias("up_b"))
    alone = neighbours(links).withColumnRenamed("other", "a").join(rank["asn"], "asn").join(rank["a"], "a").filter("ra > rasn")
    alone = alone.select("asn", "a", F.lit(None).cast("bigint").alias("b"), F.lit(True).alias("up_a"), F.lit(None).cast("boolean").alias("up_b"))

    def find(ego: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        open_, shut = set(), set()
        for row in ego[["a", "b", "up_a", "up_b"]].to_numpy(object, na_value=None):
            for v, up in ((row[0], row[2]), (row[1], row[3])):
                if v is not None:
                    near.setdefault(v, set())
                    (open_ if up else shut).add(v)
            if row[1] is not None:
                near[row[0]].add(row[1])
                near[row[1]].add(row[0])
        counts = Counter(v for clique in _maximal_cliques(near, open_, shut) for v in [*clique, None])
        own = int(ego["asn"].iloc[0])
        return pd.DataFrame({"asn": [own if v is None else int(v) for v in counts], "number_of_cliques": list(counts.values())})

    found = edges.unionByName(alone).groupBy("asn").applyInPandas(find, "asn long, number_of_cliques long")
    return found.groupBy("asn").agg(F.sum("number_of_cliques").alias("number_of_cliques"))
