"""Searches of many candidates in one large graph, together."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hopwarden.operators import graph


def test_searches_in_time():
    rng = np.random.default_rng(4)
    n = 20_000
    edges = np.unique(np.sort(np.stack([(n * rng.random(200_000) ** 2).astype(np.int64), rng.integers(0, n, 200_000)], axis=1), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    both = np.concatenate([edges, edges[:, ::-1]])
    nodes, at = np.unique(both, return_inverse=True)
    at = at.reshape(both.shape)
    order = np.argsort(at[:, 0], kind="stable")
    sent = SimpleNamespace(value=(nodes, np.searchsorted(at[order, 0], np.arange(len(nodes) + 1)), at[order, 1]))
    cand = pd.DataFrame(np.concatenate([edges[:: len(edges) // 190][:190], [[1, n + 7], [n + 8, n + 9]]]), columns=["as1", "as2"])
    began = time.time()
    got = pd.concat(graph._searcher(sent)([cand]), ignore_index=True)
    assert time.time() - began < 6
    near = {}
    for a, b in both.tolist():
        near.setdefault(a, []).append(b)
    for i in (0, 100):
        own = set(cand.loc[i])
        dist, front = {int(cand.as1[i]): 0}, [int(cand.as1[i])]
        while front:
            front = sorted({y for x in front for y in near[x] if {x, y} != own and y not in dist and not dist.update({y: dist[x] + 1})})
        assert (got.before_r1[i], got.before_s1[i], got.before_e1[i]) == (len(dist), sum(dist.values()), max(dist.values()))
        assert got.apart[i] == dist.get(int(cand.as2[i]), -1)
    assert got.iloc[-2][["before_r2", "apart"]].tolist() == [0, -1] and got.iloc[-1][["before_r1", "after_r1", "after_s1"]].tolist() == [0, 2, 1]


def _by_removal(edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The links whose ends fall apart without them, each tried."""
    found = set()
    for cut in edges:
        reached, front = {cut[0]}, [cut[0]]
        while front:
            front = [y for x in front for e in edges if e != cut and x in e for y in e if y not in reached and not reached.add(y)]
        if cut[1] not in reached:
            found.add(cut)
    return found


def test_bridges_in_arrays(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(1, 41), 2))) for _ in range(45)}
    edges = sorted(edges | {(i, i + 1) for i in range(100, 180)} | {(100, 140), (500, 501), (600, 601), (601, 602), (600, 602)})
    links = spark.createDataFrame(edges, "as1 bigint, as2 bigint")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(graph.bridges_by_arrays(links)) == _by_removal(edges)
    assert rows(graph.bridges(links, graph.spanning_forest(links))) == rows(graph.bridges(links)) == _by_removal(edges)
    assert rows(graph.bridges_by_arrays(links.limit(0))) == set()


def test_training_rows_read_paths_once(spark, monkeypatch):
    """Of the links and origins of the paths only what is asked; one reading for both."""
    from hopwarden.plans import model_queries as models

    read = []

    def given(spark, d):
        read.append(d)
        return spark.createDataFrame([([1, 2, 3],), ([3, 2, 9],), ([4, 5, 2, 1],)], "a array<bigint>").withColumn("path", F.lit(""))

    monkeypatch.setattr(models, "_paths", given)
    known = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "as1 bigint, as2 bigint")
    labels = spark.createDataFrame([(a, 0) for a in (1, 2, 3, 4, 5)], "asn bigint, label int")
    carried, origins = models._met(spark, "", known, labels)
    assert {tuple(r) for r in carried.collect()} == {(1, 2), (2, 3), (4, 5)} and {r.origin for r in origins.collect()} == {1, 3} and len(read) == 1
