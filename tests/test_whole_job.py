"""Registered queries do the whole job: tables made so that a shorter window or a smaller setting changes the result."""

from datetime import date, timedelta

import __spark_entry__ as entry
from hopwarden.operators import learning, verdict
from hopwarden.plans import graph_queries

LAST = date(2025, 3, 20)


def write(spark, path, updates, sightings=(), verdicts=()):
    """updates: (days before LAST, as1, as2, vp_ip); sightings: peer_asn; verdicts: (days before LAST, asn1, asn2, verdict)."""
    made = {
        "updates_links": ([(LAST - timedelta(n), *r) for n, *r in updates], "obs_date date, as1 bigint, as2 bigint, vp_ip string"),
        "new_link": ([(a,) for a in sightings], "peer_asn bigint"),
        "inference_summary": ([(LAST - timedelta(n), *r) for n, *r in verdicts], "observed_at date, asn1 bigint, asn2 bigint, classification string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_bidirectional_over_31_days(spark, tmp_path):
    # directions 30 days apart (both within 31 days), 31 days apart (one outside), and one direction only
    d = write(spark, tmp_path, [(30, 1, 2, "v"), (0, 2, 1, "v"), (31, 3, 4, "v"), (0, 4, 3, "v"), (0, 5, 6, "v")])
    got = {(r.as1, r.as2): r.bidi for r in entry.queries()["ref_b01_bidirectionality"](spark, d).collect()}
    assert got == {(1, 2): 1, (3, 4): 0, (5, 6): 0}


def test_baseline_goes_back_300_days(spark, tmp_path):
    # yesterday's union has 301 days, so a link last seen 301 days ago is known and one of 302 days ago is not; monthly rows count
    d = write(spark, tmp_path, [(15, 2, 1, "v"), (301, 3, 4, "v"), (302, 5, 6, "v"), (40, 7, 8, None), *[(0, a, a + 1, "v") for a in (1, 3, 5, 7, 9)]])
    got = {tuple(r) for r in entry.queries()["ref_u01_sliding_union"](spark, d).collect()}
    assert got == {(1, 2), (3, 4), (7, 8)}


def test_new_links_with_quarantine(spark, tmp_path):
    links = [(1, 2), (3, 4), (5, 6), (7, 8)]
    # suspicious yesterday; suspicious 32 days ago; cleared since; judged on the day itself
    verdicts = [(1, 2, 1, "sus"), (32, 3, 4, "sus"), (2, 5, 6, "sus"), (1, 5, 6, "leg"), (0, 7, 8, "sus")]
    d = write(spark, tmp_path, [(n, a, b, "v") for n in (20, 0) for a, b in links], (), verdicts)
    assert [tuple(r) for r in entry.queries()["ref_j01_new_links"](spark, d).collect()] == [(1, 2, "v")]


def test_models_of_all_weights_and_full_size(spark, monkeypatch):
    made, train = [], learning.train

    def seen(*args, **settings):
        made.append(train(*args, **settings))
        return made[-1]

    monkeypatch.setattr(learning, "train", seen)
    d, q = "/root/testdata/sf0.001", entry.queries()
    n = graph_queries.fresh_links(spark, d).count()
    got = q["ref_m05_inference"](spark, d).groupBy("sensitivity").count().collect()
    assert {r.sensitivity: r["count"] for r in got} == {w: n for w in range(1, 11)}
    q["ref_m07_evaluation"](spark, d).collect()
    assert [m.stages[-1].getNumTrees for m in made] == [100] * 11


def test_ten_observers_a_link(spark, tmp_path):
    d = write(spark, tmp_path, [(0, 1, 2, f"v{i:02}") for i in range(12)])
    assert sorted(r.vp_ip for r in entry.queries()["ref_n04_observers"](spark, d).collect()) == [f"v{i:02}" for i in range(10)]


def test_live_origin_rule(spark):
    roas = spark.createDataFrame([(1, "10.0.0.0/8"), (2, "10.0.0.0/8"), (3, "10.1.0.0/16")], "asn bigint, prefix string")
    said = [(1, "10.0.0.0/8"), (3, "10.0.0.0/8"), (9, "10.1.0.0/24")]  # named, not named, only covered
    got = verdict.exact_validity(spark.createDataFrame(said, "origin bigint, prefix string"), roas).collect()
    assert {(r.origin, r.prefix): r.valid for r in got} == dict(zip(said, (True, False, True)))


def test_daily_job(spark, tmp_path):
    """From updates to the three result tables; a second run leaves the same."""
    from pyspark.sql import functions as F

    from hopwarden import jobs, schemas

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    updates = frame([(LAST - timedelta(5), 1, 2, "v"), (LAST, 2, 1, "v"), (LAST, 4, 3, "v"), (LAST, 5, 6, "v")], "obs_date date, as1 bigint, as2 bigint, vp_ip string")
    ribs = frame([], "month date, as1 bigint, as2 bigint")
    judged = frame([(1, 2, LAST - timedelta(1), "leg")], "as1 bigint, as2 bigint, day date, verdict string")
    seen = [(1, 4, 3, "9 4 3", "10.0.0.0/8", 9, False), (2, 3, 4, "8 4 3", "10.0.0.0/8", 8, True), (3, 1, 2, "1 2", "10.0.0.0/8", 1, False), (4, 6, 5, None, None, None, None)]
    sightings = frame(seen, "id bigint, asn1 bigint, asn2 bigint, as_path string, prefix string, peer_asn bigint, is_recurrent boolean")
    sightings = sightings.withColumns({"observed_at": F.lit(LAST).cast("timestamp"), "peer_ip": F.lit("p")})
    roas = frame([(3, "10.0.0.0/8", None)], "asn bigint, prefix string, max_length int")
    susp = lambda rows: rows.select("as1", "as2", F.explode(F.array(F.lit(1), F.lit(2))).alias("sensitivity"), F.lit(1).alias("label"))
    for _ in range(2):
        jobs.run_day(updates, ribs, judged, sightings, roas, LAST, susp, str(tmp_path))
        read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")  # noqa: E731, B023
        got = {(r.asn1, r.asn2): r for r in read("inference_summary").collect()}
        r = got[3, 4]
        assert set(got) == {(3, 4), (5, 6)} and (r.classification, r.confidence_level, r.num_paths, r.attackers, r.victims) == ("sus", 2, 2, [4], [3])
        assert r.is_origin_rpki_valid and r.is_recurrent and got[5, 6].is_origin_rpki_valid is None
        assert read("inference_details").count() == 4 and {x.inference_id for x in read("new_link").filter("asn1 in (3, 4)").collect()} == {r.id}
    schemas.create_tables(spark, str(tmp_path / "made"), ("roa",))
    assert spark.table("roa").columns == ["asn", "prefix", "max_length", "roa_date"]
    spark.sql("drop table roa")


def test_model_cache(spark, tmp_path, monkeypatch):
    rows, names = spark.createDataFrame([(float(i), i % 2) for i in range(60)], "f double, label int"), ["peeringdb", "topological", "bidirectionality"]
    get = lambda families, **more: learning.cached_models(rows, ["f"], families, str(tmp_path), (1, 2), trees=2, depth=2, **more)
    first, made, train = get(names), [], learning.train
    monkeypatch.setattr(learning, "train", lambda *a, **s: made.append(1) or train(*a, **s))
    assert [m.stages[-1].toDebugString.split("\n")[1:] for m in get(names).values()] == [m.stages[-1].toDebugString.split("\n")[1:] for m in first.values()] and not made
    get(names, override=True)
    get(names[:1])
    get(names[:1])
    assert len(made) == 6


def test_path_scores_of_all_sightings(spark):
    d = "/root/testdata/sf0.001"
    got = entry.queries()["ref_c04_path_scores"](spark, d)
    found = got.collect()
    assert got.columns == ["id", "degree", "cone", "cone&degree"] and len(found) == spark.read.parquet(f"{d}/new_link.parquet").count()
    assert all(0 <= x <= 1 for r in found for x in r[1:]) and len({r[1:] for r in found}) > 1
