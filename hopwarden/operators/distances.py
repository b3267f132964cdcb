"""Distances of the ends' attribute vectors for several families of attributes at once.

The vector of an AS counts its neighbours by attribute. Most attributes of a family touch most ASes once a graph has hubs, so
the vectors as rows are many times the input. Instead a task takes a few attributes, counts them for all ASes in a dense
block and adds the products up for every link; nothing but these sums leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwarden.operators.features import NO_DISTANCE, attribute_vectors, cosine_distance, join_families
from hopwarden.operators.graph import BYTES_A_LINK, LINK, SENT_BYTES, as_arrays
from hopwarden.session import cut_lineage

#: Attributes of a block, bytes of a block of counts, neighbours counted at once (one attribute at least), sums of a row.
WIDTH, BLOCK_BYTES, BLOCK_STEPS, CHUNK = 64, 32 << 20, 1 << 20, 8192
#: Kinds of sums: products over the links, squares over the ASes; an attribute that every AS has.
DOTS, SQUARES, EVERYWHERE = 0, 1, 2

_SUMS = "family int, kind int, part int, attr string, sums array<bigint>"


def attribute_distances(links: DataFrame, graph: DataFrame, of: dict[str, DataFrame]) -> DataFrame:
    """(as1, as2, <name> for each of `of`): 1 - cosine of the ends' attribute vectors. of: (asn, attr) by name."""
    small = max(links.count(), graph.count()) * BYTES_A_LINK <= SENT_BYTES
    return (distances_by_arrays if small else distances_by_joins)(links, graph, of)


def distances_by_joins(links: DataFrame, graph: DataFrame, of: dict[str, DataFrame]) -> DataFrame:
    """For graphs of any size: the vectors as rows."""
    return join_families([cosine_distance(links, attribute_vectors(graph, a), name) for name, a in of.items()], LINK)


def _counts(starts: np.ndarray, ends: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """(nodes x attributes): how many neighbours of each node have each attribute. members: the nodes of each attribute."""
    at = np.concatenate(members)
    column = np.repeat(np.arange(len(members)), [len(m) for m in members])
    degree = starts[at + 1] - starts[at]
    offsets = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(degree)[:-1])), degree) if len(at) else at
    near = ends[offsets + np.arange(degree.sum())]
    n, w = len(starts) - 1, len(members)
    return np.bincount(near * w + np.repeat(column, degree), minlength=n * w).reshape(n, w)


def _blocks(batches: Iterator[pd.DataFrame], sent) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(family, attributes, counts) of the attributes (family, attr, asns), a few of one family at a time."""
    nodes, starts, ends = sent.value[:3]
    most = max(1, min(WIDTH, BLOCK_BYTES // (8 * max(len(nodes), 1))))
    family, attrs, members, steps = None, [], [], 0
    for batch in batches:
        for f, attr, asns in zip(batch["family"], batch["attr"], batch["asns"]):
            asns = np.asarray(asns, np.int64)
            at = np.searchsorted(nodes, asns)
            there = at < len(nodes)
            mine = at[there][nodes[at[there]] == asns[there]]
            more = int((starts[mine + 1] - starts[mine]).sum())
            if attrs and (f != family or len(attrs) == most or steps + more > BLOCK_STEPS):
                yield family, attrs, _counts(starts, ends, members)
                attrs, members, steps = [], [], 0
            family, steps = int(f), steps + more
            attrs.append(attr)
            members.append(mine)
    if attrs:
        yield family, attrs, _counts(starts, ends, members)


def _adder(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, _, _, links, u, v = sent.value
        dots, squares, everywhere = {}, {}, []
        for f, attrs, counts in _blocks(batches, sent):
            if f not in dots:
                dots[f], squares[f] = np.zeros(len(links), np.int64), np.zeros(len(nodes), np.int64)
            everywhere += [(f, EVERYWHERE, 0, attrs[i], []) for i in np.flatnonzero((counts > 0).all(axis=0)) if len(nodes)]
            squares[f] += np.einsum("ij,ij->i", counts, counts)
            wide = counts.astype(np.float64)  # products of a block are whole numbers far below 2^53
            step = max(1, CHUNK * 8 // counts.shape[1])
            for i in range(0, len(u), step):
                x, y = wide.take(u[i : i + step], axis=0), wide.take(v[i : i + step], axis=0)
                dots[f][i : i + step] += np.einsum("ij,ij->i", x, y).astype(np.int64)
        rows = everywhere
        for kind, sums in ((DOTS, dots), (SQUARES, squares)):
            rows += [(f, kind, i // CHUNK, "", s[i : i + CHUNK]) for f, s in sums.items() for i in range(0, len(s), CHUNK)]
        yield pd.DataFrame(rows, columns=["family", "kind", "part", "attr", "sums"])

    return run


def _spread(sent, norms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, attrs, counts in _blocks(batches, sent):
            share = counts / norms.value[f][:, None]
            yield pd.DataFrame({"family": f, "attr": attrs, "lo": share.min(axis=0), "hi": share.max(axis=0)})

    return run


def distances_by_arrays(links: DataFrame, graph: DataFrame, of: dict[str, DataFrame]) -> DataFrame:
    """The same by counts in arrays; the caller has checked that links and graph take at most SENT_BYTES each."""
    spark, names = links.sparkSession, list(of)
    nodes, starts, ends = as_arrays(graph)
    pairs = links.select(*LINK).distinct().toArrow()
    ids = np.stack([pairs.column(c).to_numpy().astype(np.int64) for c in LINK], axis=1)
    known = np.isin(ids, nodes).all(axis=1)  # the others have no distance
    at = np.searchsorted(nodes, ids[known])
    order = np.lexsort((at[:, 1], at[:, 0]))  # the blocks are read in this order
    ids, at = ids[known][order], at[order]
    sent = spark.sparkContext.broadcast((nodes, starts, ends, ids, at[:, 0].copy(), at[:, 1].copy()))

    rows = None
    for i, a in enumerate(of.values()):
        mine = a.filter("asn is not null and attr is not null").select(F.lit(i).alias("family"), F.col("asn").cast("bigint").alias("asn"), F.col("attr").cast("string").alias("attr"))
        rows = mine if rows is None else rows.unionByName(mine)
    members = cut_lineage(rows.distinct().groupBy("family", "attr").agg(F.collect_list("asn").alias("asns")))
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-members.count() // WIDTH)))

    def add(useful: DataFrame) -> tuple[DataFrame, np.ndarray]:
        parts = useful.repartitionByRange(tasks, "family", F.xxhash64("attr"), "attr").sortWithinPartitions("family")
        sums = cut_lineage(parts.mapInPandas(_adder(sent), _SUMS))
        squares = np.zeros((len(names), len(nodes)), np.int64)
        t = sums.filter(F.col("kind") == SQUARES).select("family", "part", "sums").toArrow()
        for f, part, s in zip(t.column("family").to_pylist(), t.column("part").to_pylist(), t.column("sums")):
            squares[f, part * CHUNK : (part + 1) * CHUNK] += s.values.to_numpy()
        return sums, squares

    sums, squares = add(members)
    everywhere = sums.filter(F.col("kind") == EVERYWHERE).select("family", "attr")
    if not everywhere.isEmpty():  # those that give every AS the same share are dropped
        norms = spark.sparkContext.broadcast(np.sqrt(squares.astype(np.float64)))
        shares = members.join(everywhere, ["family", "attr"], "left_semi").mapInPandas(_spread(sent, norms), "family int, attr string, lo double, hi double")
        useless = cut_lineage(shares.filter(F.round("lo", 12) >= F.round("hi", 12)).select("family", "attr"))
        if not useless.isEmpty():
            sums, squares = add(members.join(useless, ["family", "attr"], "left_anti"))
    ends_squares = spark.sparkContext.broadcast(squares)

    def by_link(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["part"].iloc[0]) * CHUNK
        own = slice(first, first + CHUNK)
        (ids_, u, v), s = (x[own] for x in sent.value[3:]), ends_squares.value
        out = {"as1": ids_[:, 0], "as2": ids_[:, 1]}
        dots = np.zeros((len(s), len(u)), np.int64)
        for f, x in zip(rows["family"], rows["sums"]):
            if f >= 0:
                dots[f] += np.asarray(x, np.int64)
        for i in range(len(s)):
            out |= {f"d{i}": dots[i], f"p{i}": s[i][u], f"q{i}": s[i][v]}
        return pd.DataFrame(out)

    every = spark.range(-(-len(ids) // CHUNK)).select(F.lit(-1).alias("family"), F.col("id").cast("int").alias("part"), F.array().cast("array<bigint>").alias("sums"))
    schema = "as1 long, as2 long, " + ", ".join(f"d{i} long, p{i} long, q{i} long" for i in range(len(names)))
    found = sums.filter(F.col("kind") == DOTS).select("family", "part", "sums").unionByName(every).groupBy("part").applyInPandas(by_link, schema)
    root = lambda c: F.sqrt(F.col(c).cast("double"))
    values = [F.when(F.expr(f"p{i} > 0 and q{i} > 0"), 1 - F.col(f"d{i}").cast("double") / (root(f"p{i}") * root(f"q{i}"))).alias(n) for i, n in enumerate(names)]
    full = links.select(*LINK).distinct().join(found.select(*LINK, *values), LINK, "left")
    return full.select(*LINK, *[F.round(F.coalesce(n, F.lit(NO_DISTANCE)), 6).alias(n) for n in names])
