"""Problems 3, 4 and 6: nulls, blanks, ties, repeats, empty tables, clashing names."""

from datetime import date, datetime

import pytest

from pyspark.sql import functions as F

from hopwarden.functions.packed import AS_PATH, Packing, canonical_path, explode_packed, explode_path
from hopwarden.operators.eager import eager_join_aggregate, hot_keys
from hopwarden.operators.skew import lookup
from hopwarden.operators.snapshots import snapshot_changes
from hopwarden.session import checkpoint_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_explode_path_spellings(spark):
    texts = {
        1: "1 2 3", 2: "AS1|as2||ASN3|", 3: "'1';'2';'3'", 4: '"1, 2, 3', 5: " 1 2　3\t", 6: "[1,2,3]", 7: "AS 1,AS 2,AS 3",
        8: "1 -> 2 > 3.", 9: None, 10: "", 11: "  ;;", 12: "1 1 {3,2 AS4} 5", 13: "{7}", 14: "1 {} 2", 15: "{8;9", 16: "007", 17: "x y", 18: "9" * 40,
    }
    df = spark.createDataFrame(list(texts.items()), "id int, as_path string").withColumn("pos", F.lit("clash")).withColumn("hop", F.lit(0))
    got: dict = {}
    for i, pos, hop in explode_path(df).collect():
        got.setdefault(i, []).append((pos, hop))
    for i in range(1, 9):
        assert sorted(got[i]) == [(1, 1), (2, 2), (3, 3)], (i, got.get(i))
    assert not set(got) & {9, 10, 11, 17, 18}
    assert sorted(got[12]) == [(1, 1), (2, 1), (3, 2), (3, 3), (3, 4), (4, 5)]
    assert got[13] == [(1, 7)] and sorted(got[14]) == [(1, 1), (2, 2)] and sorted(got[15]) == [(1, 8), (1, 9)] and got[16] == [(1, 7)]
    assert explode_path(df.limit(0)).count() == 0


def test_canonical_path(spark):
    df = spark.createDataFrame([("1 {3,2,3}",), ("AS1|{2 3}",), ("1 {2}",), ("1 2",), (None,)], "p string")
    assert [r[0] for r in df.select(canonical_path(F.col("p"))).collect()] == ["1 {2,3}", "1 {2,3}", "1 {2}", "1 2", ""]


def test_quotes_decide(spark):
    texts = {1: '"1 2 3"', 2: "'1', '2','3'", 3: '"1 2 3', 4: "1 2 3'", 5: "'1' '{2,3}' 4", 6: "{'2';'3'}|'4'", 7: "1 '2 3' 4"}
    df = spark.createDataFrame(list(texts.items()), "id int, p string")
    got = {r.id: r.v for r in df.select("id", canonical_path(F.col("p")).alias("v")).collect()}
    # in the last one the quoted piece is one literal value, which is no number
    assert got == {1: "1 2 3", 2: "1 2 3", 3: "1 2 3", 4: "1 2 3", 5: "1 {2,3} 4", 6: "{2,3} 4", 7: "1 4"}


def test_long_path(spark):
    text = " ".join(str(i) for i in range(1, 20_001))
    df = spark.createDataFrame([(1, text)], "id int, as_path string")
    assert explode_path(df).agg(F.max("pos"), F.sum("hop")).first()[:] == (20_000, 20_000 * 20_001 // 2)


def test_quoted_literals(spark):
    df = spark.createDataFrame([(1, 'a,"b, c";d'), (2, None), (3, "'x y'")], "id int, v string")
    assert rows(explode_packed(df, "v", ["id"], Packing())) == [(1, 1, "a"), (1, 2, "b, c"), (1, 3, "d"), (3, 1, "x y")]
    assert AS_PATH.quoted_lists


def test_eager_join(spark):
    left = spark.createDataFrame([(1, 10, "x"), (1, None, "x"), (1, 5, "y"), (2, 7, "x"), (None, 1, "x"), (3, 4, "x")], "k int, v int, n_pairs string")
    right = spark.createDataFrame([(1, 2), (1, 3), (2, None), (None, 9)], "k int, v int")
    keys = {"k": (F.col("k"), F.col("k"))}
    sums = {"left_sums": {"sl": F.col("v")}, "right_sums": {"sr": F.col("v")}}
    inner = eager_join_aggregate(left, right, keys, **sums)
    assert rows(inner) == [(1, 3, 2, 6, 30, 15), (2, 1, 1, 1, 7, None)]
    outer = eager_join_aggregate(left, right, keys, how="left", **sums)
    assert rows(outer) == sorted([(1, 3, 2, 6, 30, 15), (2, 1, 1, 1, 7, None), (3, 1, 0, 1, 4, None), (None, 1, 0, 1, 1, None)], key=repr)
    assert eager_join_aggregate(left.limit(0), right, keys).count() == 0


def test_products_beyond_a_bigint(spark):
    big = spark.createDataFrame([(1, 2**62)] * 3, "k int, v bigint")
    keys = {"k": (F.col("k"), F.col("k"))}
    got = eager_join_aggregate(big, big, keys, left_sums={"l": F.col("v")}, right_sums={"r": F.col("v")}).first()
    assert (got.n_pairs, int(got.l), int(got.r)) == (9, 9 * 2**62, 9 * 2**62)


def test_checkpoints_need_a_shared_folder():
    assert checkpoint_folder("yarn", "hdfs:///c") == "hdfs:///c" and "hopwarden-" in checkpoint_folder("local[4]", None)
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(master, None)


def test_only_the_subpackage_is_optional(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def missing(gone):
        def load(name, *rest):
            if name == "hopwarden.llm.queries":
                raise ModuleNotFoundError(name=gone)
            return real(name, *rest)

        return load

    monkeypatch.setattr(builtins, "__import__", missing("hopwarden.llm"))
    assert "p3_found" in e.queries() and "p1_distinct" not in e.queries()
    monkeypatch.setattr(builtins, "__import__", missing("numpy"))
    with pytest.raises(ModuleNotFoundError):
        e.queries()


def test_hot_keys(spark):
    data = [(1, 9)] * 50 + [(2, 9)] * 2 + [(None, 9)] * 48
    df = spark.createDataFrame(data, "asn1 bigint, peer_asn bigint").withColumn("field_name", F.lit("clash"))
    assert rows(hot_keys(df, ["asn1", "peer_asn"], 0.02)) == [("asn1", 1, 50), ("asn1", 2, 2), ("peer_asn", 9, 100)]
    assert hot_keys(df.limit(0), ["asn1"], 0.02).count() == 0


def test_lookup_hot(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (None, 0), (9, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, w string")
    got = lookup(df, right, "k", hot_rows=100, hot_parts=2).groupBy("k", "w").count()
    assert rows(got) == [(1, "a", 300), (2, "b", 1)]


def test_snapshot_changes(spark):
    d1, d2, d3 = date(2025, 1, 1), date(2025, 1, 9), date(2025, 2, 1)
    t = lambda h: datetime(2024, 1, 1, h)
    data = [
        (d1, 1, 1, "a", None, t(1)), (d2, 1, 1, None, "a", t(1)), (d3, 1, 1, None, "a", t(5)),  # changed by place, then only the time
        (d1, 2, 1, "b", "c", t(1)), (d1, 2, 1, "old", "c", t(0)), (d2, 2, 1, "b", "c", t(2)),  # outdated row; removed
        (d2, 3, 1, "n", "c", t(2)), (d2, 3, 1, "n", "c", t(2)), (d3, 3, 1, "n", "c", None),  # repeated; added
        (d1, None, 1, "x", "c", t(1)), (d2, 4, None, "x", "c", t(1)), (None, 5, 5, "x", "c", t(1)),
    ]
    df = spark.createDataFrame(data, "day date, k int, f int, a string, b string, at timestamp").withColumn("change_kind", F.lit("clash"))
    got = snapshot_changes(df, "day", {"asn": "k", "place": "f"}, ["a", "b"], "at")
    assert rows(got) == sorted([(d2, 1, 1, "changed"), (d2, 3, 1, "added"), (d3, 2, 1, "removed")], key=repr)
    assert snapshot_changes(df.limit(0), "day", {"asn": "k"}, ["a"], "at").count() == 0
    ties = spark.createDataFrame([(d1, 1, "a", t(1)), (d1, 1, "b", t(1)), (d2, 1, "b", t(1)), (d2, 1, "a", t(1))], "day date, k int, a string, at timestamp")
    assert snapshot_changes(ties, "day", {"k": "k"}, ["a"], "at").count() == 0


def test_registered_once():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p3_found" in e.queries()
