"""Attribute distances: counts in arrays against vectors as rows, and a graph whose vectors are many times its size."""

import random
import time
from datetime import date

from pyspark.sql import functions as F

from hopwarden.operators import distances


def test_arrays_and_joins_agree(spark, monkeypatch):
    monkeypatch.setattr(distances, "WIDTH", 3)
    monkeypatch.setattr(distances, "CHUNK", 16)
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(1, 31), 2))) for _ in range(90)} | {(1, x) for x in range(2, 31)} | {(2, x) for x in range(3, 31)})
    graph = spark.createDataFrame(edges, "as1 bigint, as2 bigint")
    links = spark.createDataFrame([*edges[::2], (7, 900), (901, 902)], "as1 bigint, as2 bigint")
    some = [(rng.randrange(1, 40), rng.choice("abcdefghij")) for _ in range(60)] + [(None, "a"), (3, None), (3, "x"), (3, "x")]
    # every AS has two hubs among its neighbours but the hubs, which have each other; all shares of "only" are 1
    of = {
        "some": spark.createDataFrame(some, "asn bigint, attr string"),
        "only": spark.createDataFrame([(x, "only") for x in range(1, 31)], "asn bigint, attr string"),
        "wide": spark.createDataFrame([(x, a) for x in (1, 2) for a in "pq"] + some, "asn bigint, attr string"),
        "none": spark.createDataFrame([], "asn bigint, attr string"),
    }
    got, want = (sorted(tuple(r) for r in f(links, graph, of).collect()) for f in (distances.distances_by_arrays, distances.distances_by_joins))
    assert got == want and len(got) == len(edges[::2]) + 2
    assert {r[3] for r in got} == {-1.0} == {r[5] for r in got} and len({r[2] for r in got}) > 10 < len({r[4] for r in got})
    nothing = distances.distances_by_arrays(links, graph.limit(0), of).collect()
    assert len(nothing) == len(got) and {x for r in nothing for x in r[2:]} == {-1.0}


def test_hubs_in_time(spark, tmp_path):
    """Eight hubs with 1,500 facilities each: every leaf's vector has them all, 18 million products of vectors as rows."""
    from hopwarden.plans.feature_queries import ref_d05_attribute_distances

    links = spark.range(8).select(F.col("id").alias("as1")).crossJoin(spark.range(100, 1600).select(F.col("id").alias("as2")))
    links.select(F.lit(date(2025, 1, 1)).alias("obs_date"), "as1", "as2", F.lit("v").alias("vp_ip")).write.parquet(f"{tmp_path}/updates_links.parquet")
    own = spark.range(1500).select(F.col("id").alias("fac_id"), F.explode(F.expr("sequence(0L, 7L)")).alias("local_asn"))
    leaves = spark.range(100, 1600).select(((F.col("id") - 100) % 1400).alias("fac_id"), F.col("id").alias("local_asn"))
    rows = own.unionByName(leaves).select("fac_id", "local_asn", F.lit("X").alias("country"), F.col("fac_id").cast("string").alias("city"), F.lit(date(2025, 1, 1)).alias("snapshot_day"))
    rows.write.parquet(f"{tmp_path}/netfac.parquet")
    rows.select(F.col("local_asn").alias("asn"), F.col("fac_id").alias("ix_id"), "snapshot_day").write.parquet(f"{tmp_path}/netixlan.parquet")
    began = time.time()
    got = ref_d05_attribute_distances(spark, str(tmp_path)).collect()
    took = time.time() - began
    assert len(got) == 12_000 and {(r.country_dist, r.facility_country_dist) for r in got} == {(-1.0, -1.0)}
    assert {(r.facility_fac_dist, r.facility_cities_dist, r.ixp_dist) for r in got} == {(0.060664,) * 3}  # 1 - sqrt(1500 / 1700)
    assert took < 60
