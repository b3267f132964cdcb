"""Samples, forests, optional centralities: properties on small data."""

import random

import pytest
from pyspark.sql import functions as F

from hopwarden.operators import accuracy, features, graph, learning, sampling


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(1, 31), 2))) for _ in range(70)} | {(1, 100), (100, 101)})
    return edges, spark.createDataFrame(edges, "as1 bigint, as2 bigint")


def test_cliques(spark, small):
    edges, links = small
    nodes, cliques = sorted({x for e in edges for x in e}), []
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in nodes}

    def grow(r, p, x):
        if not p and not x:
            cliques.append(r)
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(nodes), set())
    got = {r.asn: r.number_of_cliques for r in graph.number_of_cliques(links).collect()}
    assert got == {v: sum(v in c for c in cliques) for v in nodes}


def test_centralities(spark, small):
    _, links = small
    assert graph.pagerank(links).agg(F.sum("pagerank")).first()[0] == pytest.approx(1)
    assert graph.eigenvector_centrality(links).agg(F.sum(F.col("centrality") ** 2)).first()[0] == pytest.approx(1)
    square = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "as1 bigint, as2 bigint")
    assert {r.square_clustering for r in graph.square_clustering(square).collect()} == {1.0}


def test_negative_sample(spark, small):
    edges, links = small
    labels = spark.createDataFrame([(a, a % 2) for a in {x for e in edges for x in e}], "asn bigint, label int")
    carried = links.withColumn("path", F.concat_ws(" ", F.lit("9"), "as1", "as2"))
    got = [tuple(r) for r in sampling.negative_sample(links, labels, carried, 20).collect()]
    assert len(got) == len({r[:2] for r in got}) == 20 and {r[:2] for r in got} <= set(edges) - {(1, 100), (100, 101)}
    every = sampling.negative_sample(links, labels, carried, 10_000)
    assert {tuple(r)[:2] for r in every.collect()}.isdisjoint({(1, 100), (100, 101)})


def test_positive_sample(spark, small):
    edges, links = small
    labels = spark.createDataFrame([(a, a % 2) for a in {x for e in edges for x in e}], "asn bigint, label int")
    p = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.5), (1, 1, 0.3)], "c1 int, c2 int, p double")
    origins = spark.createDataFrame([(a, f"7 8 {a}") for a in range(1, 20)], "origin bigint, path string")
    got = sampling.positive_sample(sampling.forged_pairs(labels, p, 40), links, links.limit(0), origins, 30).collect()
    assert 0 < len(got) <= 30 and len({(r.as1, r.as2) for r in got}) == len(got)
    for r in got:
        assert (r.as1, r.as2) not in set(edges) and r.as1 < r.as2 and {r.attacker, r.victim} == {r.as1, r.as2}
        assert r.path == f"7 8 {r.attacker} {r.victim}"


def test_clusters(spark):
    rows = [(i, 1 + i % 3, 1) for i in range(60)] + [(100 + i, 500, 2000 + i) for i in range(15)] + [(900, 9000, 9000), (901, 5, 5000)]
    found = sampling.cluster_ases(spark.createDataFrame(rows, "asn bigint, degree bigint, cone bigint"), top=[900])
    sizes = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    top = found.filter("asn = 900").first().label
    assert found.filter("asn = 901").count() == 0 and top == len(sizes) - 1 and all(n >= 10 for label, n in sizes.items() if label != top)


def test_forests(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 2) + rng.random() * 0.4, rng.random(), None if i % 9 == 0 else 1.0, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, good double, noise double, gap double, label int")
    names = ["good", "noise", "gap"]
    models = learning.train_all(df, names, (1, 10), trees=5, depth=4)
    out = learning.infer(df, models, names)
    assert out.count() == 800 and out.columns == ["id", "label", "proba", "sensitivity"] and out.filter("proba < 0.5").count() == 0
    assert max(learning.importance(models[1], names).items(), key=lambda x: x[1])[0] == "good"
    loss = learning.permutation_importance(models[1], df.fillna(1.0), ["good", "noise"])
    assert loss["good"] > 0.2 > abs(loss["noise"])
    r = learning.evaluate(df, names, trees=5).first()
    assert r.tpr >= 95 and r.fpr <= 5
    with pytest.raises(ValueError):
        learning.infer(df.drop("gap"), models, names)
    scored = learning.path_scores(df.fillna(1.0), df.fillna(1.0), {"cone": ["good"], "cone&degree": ["good", "noise"]}, trees=5)
    assert scored.filter("(cone > 0.5) <> (label = 1)").count() <= 4 and "cone&degree" in scored.columns


def test_frames(spark):
    f = spark.createDataFrame([(1, 2, None, 5.0), (1, 2, 7.0, 5.0)], "as1 bigint, as2 bigint, f_as1 double, g double")
    path = spark.createDataFrame([(1, 2, 0.1), (1, 2, 0.2)], "as1 bigint, as2 bigint, cone double")
    both = features.training_frame({"t": f, "aspath": path}, {"t": f, "aspath": path})
    assert both.count() == 4 and both.filter("f_as1 is null").count() == 0
    assert features.exclude_features(f, ["f"]).columns == ["as1", "as2", "g"]
    sizes = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 0), (1, None, 1, 1)], "c1 int, c2 int, label int, predicted int")
    assert accuracy.rates_by_category(sizes).first()[2:] == (0.5, 0.0)
