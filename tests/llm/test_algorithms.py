"""Distinct counts, frequent items, duplicates: brute force on small data; nulls, blanks, ties, repeats, empty tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopwarden.llm import distinct, duplicates, frequent



def groups():
    return {"g": F.col("g"), "h": F.col("h")}


def test_distinct_within_error(spark):
    rng = random.Random(1)
    data = [("a" if i % 3 else None, i % 2 == 0, f"v{rng.randint(0, 4000)}" if i % 7 else None) for i in range(20_000)]
    df = spark.createDataFrame(data, "g string, h boolean, v string").withColumn("word", F.lit("clash"))
    m = distinct.bitmap_bits(20_000, 0.02)
    partials = distinct.bitmaps(df, groups(), {"v": F.col("v")}, m)
    got = {(r.grouping_set, r.g, r.h): r for r in distinct.estimates(partials, ["g", "h"], ["v"], m).collect()}
    assert len(got) == 4 + 2 + 2 + 1
    for (mask, g, h), r in got.items():
        true = len({v for a, b, v in data if v is not None and (mask & 2 or a == g) and (mask & 1 or b == h)})
        assert abs(r.n_v - true) <= 5 * 0.02 * true, (mask, g, h, r.n_v, true)
        assert r.err_v <= 0.02


def test_distinct_partials_join(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.lit(True).alias("h"), F.md5(F.col("id").cast("string")).alias("v"))
    m = distinct.bitmap_bits(3000, 0.02)
    part = lambda x: distinct.bitmaps(x, groups(), {"v": F.col("v")}, m)
    whole = sorted(distinct.merge_bitmaps(part(df), m=m).collect(), key=repr)
    merged = distinct.merge_bitmaps(part(df.filter("g < 2")), part(df.filter("g > 0")), m=m)
    assert sorted(merged.collect(), key=repr) == whole and len(whole) == 3 + 3 + 1 + 1


def test_distinct_slices_and_many_states(spark, monkeypatch):
    # 20,000 bits in slices of 1,024, states of 100 rows: sparse and dense states of one key meet, more of them than are held
    df = spark.range(6000).select(F.lit("a").alias("g"), (F.col("id") % 3000).cast("string").alias("v")).repartition(3)
    g = {"g": F.col("g")}
    want = [r.n_v for r in distinct.estimates(distinct.bitmaps(df, g, {"v": F.col("v")}, 1 << 15), ["g"], ["v"], 1 << 15).collect()]
    monkeypatch.setattr(distinct, "SLICE", 1024)
    monkeypatch.setattr(distinct, "FLUSH_AT", 100)
    monkeypatch.setattr(distinct, "UNITE_AT", 3)
    run = distinct._mapper(["g"], ["v"], {0: 1 << 15})
    batches = df.select("g", distinct._hash(F.col("v")).alias("h")).toArrow().to_batches(max_chunksize=100)
    states = pa.Table.from_batches(list(run(iter(batches))))
    assert {b[0] for b in states.column("bits").to_pylist()} == {2} and states.num_rows > 300
    keys = ["grouping_set", "g", "field", "slice_no"]
    merge = lambda counts: distinct._merger(keys, {0: 1 << 15}, counts)
    ordered = states.sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=7)
    ones = pa.Table.from_batches(list(merge(True)(iter(ordered)))).column("ones").to_pylist()
    again = pa.Table.from_batches(list(merge(False)(iter(ordered))))
    assert len(ones) == again.num_rows == 32
    assert {b[0] for b in again.column("bits").to_pylist()} <= {1, 2} and 1 in {b[0] for b in again.column("bits").to_pylist()}
    twice = pa.concat_tables([again, again]).sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=5)
    assert pa.Table.from_batches(list(merge(True)(iter(twice)))).column("ones").to_pylist() == ones
    assert want == [round(-(1 << 15) * math.log(1 - sum(ones) / (1 << 15)))] * 2


def test_distinct_error_of_all_groups(spark):
    """On the given links, 99 % of the groups of all levels are within three standard errors (and rounding) of the true counts."""
    links = spark.read.parquet("/root/testdata/sf0.1/new_link.parquet")
    groups = {"day": F.to_date("observed_at"), "peer_asn": F.col("peer_asn"), "is_recurrent": F.col("is_recurrent")}
    m = distinct.level_bits(links, groups, 0.01)
    assert m[0] < m[7]  # the finest level has smaller bitmaps than the coarsest
    fields = {"prefix": F.col("prefix"), "as_path": F.col("as_path")}
    got = distinct.estimates(distinct.bitmaps(links, groups, fields, m), list(groups), list(fields), m)
    true = links.cube(*[c.alias(g) for g, c in groups.items()]).agg(*[F.count_distinct(f).alias(f"t_{f}") for f in fields], F.grouping_id().alias("level"))
    on = [true["level"] == got["grouping_set"], *[true[g].eqNullSafe(got[g]) for g in groups]]
    both = true.join(got, on).collect()
    assert len(both) == true.count()
    off = [abs(r[f"n_{f}"] - r[f"t_{f}"]) / max(1, r[f"t_{f}"]) > 3 * r[f"err_{f}"] + 0.5 / max(1, r[f"t_{f}"]) for r in both for f in fields]
    assert sum(off) <= 0.01 * len(off) and max(r[f"err_{f}"] for r in both for f in fields) <= 0.01


def test_distinct_edges(spark):
    empty = spark.createDataFrame([], "g string, h boolean, v string")
    assert distinct.estimates(distinct.bitmaps(empty, groups(), {"v": F.col("v")}, 64), ["g", "h"], ["v"], 64).count() == 0
    nulls = spark.createDataFrame([("a", True, None), ("b", None, "")], "g string, h boolean, v string")
    got = {(r.g, r.grouping_set): r.n_v for r in distinct.estimates(distinct.bitmaps(nulls, groups(), {"v": F.col("v")}, 64), ["g", "h"], ["v"], 64).collect()}
    assert got["a", 0] == 0 and got["b", 0] == 1
    full = spark.range(5000).select(F.lit("a").alias("g"), F.lit(True).alias("h"), F.col("id").cast("string").alias("v"))
    assert {r.n_v for r in distinct.estimates(distinct.bitmaps(full, groups(), {"v": F.col("v")}, 64), ["g", "h"], ["v"], 64).collect()} == {-1}
    assert distinct.bitmap_bits(0, 0.01) == 64 and distinct.relative_error(0, 64) == 0
    for n in (1000, 10**6, 10**9):
        assert distinct.relative_error(n, distinct.bitmap_bits(n, 0.01)) <= 0.01


def test_sketch_never_low():
    rng = np.random.default_rng(2)
    sketch, true = frequent.ConservativeSketch(256, 4), Counter()
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    other = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for _ in range(20):
        at = rng.choice(3000, 500, replace=False)
        n = rng.integers(1, 5, 500)
        estimate = sketch.add(keys[at], other[at], n)
        true.update(dict(zip(at.tolist(), n.tolist())))
        assert all(e >= true[i] for i, e in zip(at.tolist(), estimate.tolist()))


def test_frequent_items(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"x{rng.randint(0, 9000)}" if i % 5 else None, i % 4) for i in range(30_000)]
    df = spark.createDataFrame(data, "p string, q int").withColumn("item", F.lit("clash")).repartition(6)
    got = {(r.field_name, r.item): r.n for r in frequent.frequent_items(df, ["p", "q"], 0.01, keep=150, width=1 << 10).collect()}
    true = {("p", v): n for v, n in Counter(p for p, _ in data).items() if v is not None and n >= 300} | {("q", str(v)): n for v, n in Counter(q for _, q in data).items()}
    assert got == true
    top = [(r.field_name, r["rank"], r.item) for r in frequent.top_items(df, ["p", "q"], 2).orderBy("field_name", "rank").collect()]
    assert top[0] == ("p", 1, "hot") and [x[2] for x in top[2:]] == ["0", "1"]


def test_small_shares_and_long_tops(spark):
    """Shares and ranks far beyond a fixed heap: 4,000 values on one row in 10,000 each, in one partition."""
    df = spark.range(40_000).select((F.col("id") % 4000).cast("string").alias("p")).coalesce(1)
    assert frequent.frequent_items(df.repartition(1), ["p"], 1e-4).count() == 4000
    top = frequent.top_items(df.repartition(1), ["p"], 3000, error=1e-5).agg(F.count("item"), F.min("n"), F.max(F.col("n") - F.col("most_over"))).first()
    assert top[0] == 3000 and top[1] == 10 and top[2] <= 10
    for bad in (lambda: frequent.frequent_items(df, ["p"], 1e-4, keep=1024), lambda: frequent.frequent_items(df, ["p"], 1e-4, width=1 << 10), lambda: frequent.top_items(df, ["p"], 20, keep=10)):
        with pytest.raises(ValueError):
            bad()


def test_top_within_its_bound(spark):
    links = spark.read.parquet("/root/testdata/sf0.1/new_link.parquet")
    top = frequent.top_items(links, ["prefix", "peer_asn"], 20).collect()
    true = {f: {r[0]: r["count"] for r in links.groupBy(F.col(f).cast("string")).count().collect()} for f in ("prefix", "peer_asn")}
    assert len(top) == 40 and all(0 <= r.n - true[r.field_name][r.item] <= r.most_over for r in top)
    for f in true:
        least = sorted((n for v, n in true[f].items() if v is not None), reverse=True)[19]
        assert all(true[f][r.item] >= least - r.most_over for r in top if r.field_name == f)


def test_frequent_edges(spark):
    empty = spark.createDataFrame([], "p string")
    assert frequent.frequent_items(empty, ["p"], 0.1).count() == 0 and frequent.top_items(empty, ["p"], 3).count() == 0
    nulls = spark.createDataFrame([(None,), (None,), ("",), ("é" * 5000,)], "p string")
    assert sorted(r.item for r in frequent.frequent_items(nulls, ["p"], 0.25).collect()) == ["", "é" * 5000]
    assert frequent.frequent_items(nulls, ["p"], 0.3).count() == 0


def brute(data):
    groups: dict = {}
    for i, a, b, t in data:
        key = (tuple(sorted([a, b], key=lambda x: (x is not None, x or 0))), t)
        groups.setdefault(key, []).append(i)
    return groups


def test_duplicates(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([1, 2, None]), rng.choice([1, 2, 3]), rng.choice(["x", None, ""])) for i in range(600)] + [(1000 + i, 9, 8, "hot") for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, a int, b int, t string").withColumn("k1", F.lit("clash")).withColumn("copies", F.lit(1))
    key = [duplicates.unordered(F.col("a"), F.col("b")), F.col("t")]
    groups = brute(data)
    for hot in (50_000, 60):  # without and with hot keys
        got = {(r.first_id, r.copy_id) for r in duplicates.copies(df, "id", key, hot_rows=hot, hot_parts=100).collect()}
        assert got == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
        kept = {r.first_id: r.copies for r in duplicates.collapse(df, "id", key, hot_rows=hot, hot_parts=100).collect()}
        assert kept == {min(g): len(g) for g in groups.values()}
    assert duplicates.copies(df.limit(0), "id", key).count() == 0 and duplicates.collapse(df.limit(0), "id", key).count() == 0


def test_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "A  b!"), (3, "a B"), (3, "a,b"), (5, None), (6, ""), (7, "x" * 100_000), (8, "X" * 100_000)], "id bigint, t string")
    key = [duplicates.canonical_text(F.col("t"))]
    assert sorted(tuple(r) for r in duplicates.copies(df, "id", key).collect()) == [(7, 8)]
    assert sorted((r.first_id, r.copies) for r in duplicates.collapse(df, "id", key).collect()) == [(3, 3), (5, 1), (6, 1), (7, 2)]
