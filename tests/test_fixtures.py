"""Hand-worked cases of the reference's operators."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from hopwarden.functions import paths, prefixes
from hopwarden.functions.packed import canonical_path
from hopwarden.operators import api, features, graph, newedge, topology, verdict
from hopwarden.sources import readers, registries


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*xs):
    return F.array(*[F.lit(x).cast("bigint") for x in xs])


def test_cleaning(spark):
    ix = arr(24029, 50384, 24115)
    assert one(spark, paths.clean(arr(24029, 50384, 1, 2, 3, 4, 5, 5, 5, 70000, 70000, 5, 24115, 10, 11), ix)) == [1, 2, 3, 4, 5, 10, 11]
    assert one(spark, paths.clean(arr(24029, 50384), ix)) == []
    edge = arr(64496, 1, 131071, 1, 2, 4200000000)
    assert one(spark, paths.clean(edge)) == [1, 2]
    assert one(spark, paths.clean(edge, inclusive=False)) == [64496, 1, 131071, 1, 2, 4200000000]


@pytest.mark.parametrize("tail,want", [([], [1, 2, 3, 4, 5, 6]), ([7], [1, 2, 3, 4, 5, 6]), ([7, 8], [1, 2, 3, 4, 5, 6])])
def test_prune(spark, tail, want):
    assert one(spark, paths.prune(arr(1, 2, 3, 4, 5, 6, *tail), F.lit(6), F.lit(5))) == want


def test_path_parts(spark):
    assert one(spark, paths.prune(arr(1, 2, 3, 4, 6, 7, 8), F.lit(5), F.lit(6))) is None
    assert one(spark, paths.collapse(F.split(canonical_path(F.lit("10 10 {7,8} 9 9")), " "))) == ["10", "{7,8}", "9"]
    p, a, b = arr(7, 2, 1, 9), F.lit(1), F.lit(2)
    assert (one(spark, paths.attacker(p, a, b)), one(spark, paths.victim(p)), one(spark, paths.hijack_type(p, a, b))) == (2, 9, 2)
    assert one(spark, paths.attacker(arr(5), a, b)) is None and one(spark, paths.victim(F.array().cast("array<bigint>"))) is None


def test_patterns(spark):
    p = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [5])], "id int, p array<bigint>")
    cone = spark.createDataFrame([(1, 5), (3, 9)], "asn bigint, cone bigint")
    got = {r[0]: list(r[1:]) for r in features.pattern_features(p, "id", "p", {"cone": cone}).collect()}
    assert got == {1: [0, 0, 0, 0, 4, -8], 2: [0] * 6, 3: [0] * 6}


def test_votes(spark):
    labels = [(1, 2, m, x) for m, xs in ((1, (0, 0, 1)), (2, (1, 1, 0)), (3, (0, 0, 0))) for x in xs] + [(3, 4, 1, 0), (3, 4, 1, 1)]
    df = spark.createDataFrame(labels, "as1 bigint, as2 bigint, sensitivity int, label int")
    got = {r["as1"]: r for r in verdict.verdicts(verdict.votes(df)).collect()}
    r = got[1]
    assert (r.num_legit_inf, r.num_susp_inf, r.classification, r.confidence_level, r.num_paths) == (2, 1, "sus", 2, 3)
    assert got[3].classification == "sus"


def test_origin_validity(spark):
    roas = spark.createDataFrame([(1, "10.0.0.0/8", 8), (2, "10.1.0.0/16", None), (5, "2001:db8::/32", 48), (1, "junk", 1)], "asn bigint, prefix string, max_length int")
    asked = [(1, "10.1.2.0/24"), (1, "10.1.0.0/16"), (1, "10.9.0.0/16"), (1, "11.0.0.0/8"), (5, "2001:db8:1::/48"), (5, "2001:db9::/48"), (1, "nonsense"), (None, "10.0.0.0/8")]
    df = spark.createDataFrame(asked, "origin bigint, prefix string")
    got = {(r[0], r[1]): r[2] for r in verdict.origin_validity(df, roas).collect()}
    assert [got[a] for a in asked[:7]] == [True, False, True, False, True, False, False] and len(got) == 7
    strict = {r[1]: r[2] for r in verdict.origin_validity(df, roas, rfc6811=True).collect()}
    assert not strict["10.9.0.0/16"] and strict["2001:db8:1::/48"]


def test_local(spark):
    rows = [(1, 2, [5, 1, 2], 1), (3, 4, [3, 4], 3), (3, 4, [3, 4], 6), (5, 6, [5, 6], 5)]
    df = spark.createDataFrame(rows, "as1 bigint, as2 bigint, path array<bigint>, peer_asn bigint")
    assert {r.as1: r.is_local for r in verdict.tags(df).collect()} == {1: True, 3: False, 5: True}


def test_observers(spark):
    seen = [(1, 2, "a"), (3, 4, "a"), (4, 3, "b"), (3, 4, "c"), (5, 6, "b"), (5, 6, "c"), (5, 6, "d"), (5, 6, None)]
    df = spark.createDataFrame(seen, "as1 bigint, as2 bigint, vp_ip string")
    assert sorted(r[0] for r in newedge.choose_observers(df, 2).collect()) == ["a", "b", "c"]


def _greedy(links, m):
    chosen = {v for vs in links if len(vs) <= m for v in vs}
    left = [(set(vs) - chosen, m - len(set(vs) & chosen)) for vs in links if len(vs) > m and len(set(vs) & chosen) < m]
    count: dict = {}
    for vs, _ in left:
        for v in vs:
            count[v] = count.get(v, 0) + 1
    for v in sorted(count, key=lambda v: (-count[v], v)):
        if all(n <= 0 for _, n in left):
            break
        chosen.add(v)
        left = [(vs, n - (v in vs)) for vs, n in left]
    return chosen


def test_observers_greedy(spark):
    rng = random.Random(3)
    for _ in range(4):
        links = [rng.sample("abcdefghij", rng.randint(1, 7)) for _ in range(15)]
        df = spark.createDataFrame([(i, i + 100, v) for i, vs in enumerate(links) for v in vs], "as1 bigint, as2 bigint, vp_ip string")
        assert {r[0] for r in newedge.choose_observers(df, 3).collect()} == _greedy(links, 3)


def test_ledger(spark):
    d = lambda n: date(2025, 1, n)
    rows = [(1, 2, d(1), "sus"), (1, 2, d(3), "leg"), (1, 2, d(5), "sus"), (3, 4, d(1), "sus"), (3, 4, d(3), "leg")]
    got = newedge.ledger(spark.createDataFrame(rows, "as1 bigint, as2 bigint, day date, verdict string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2, d(5))]


def test_earliest(spark):
    rows = [(1, 2, "p", 20, "x", "q", 1), (1, 2, "p", 10, "z", "q", 1), (1, 2, "p", 10, "y", "q", 1), (1, 2, "p", None, "a", "q", 1)]
    df = spark.createDataFrame(rows, "as1 bigint, as2 bigint, path string, observed_at int, peer_ip string, prefix string, peer_asn bigint")
    assert newedge.earliest_sightings(df, ["as1", "as2", "path"]).first()[3:5] == (10, "y")


def test_bidirectional(spark):
    seen = spark.createDataFrame([(date(2025, 1, 1), 1, 2), (date(2025, 1, 6), 2, 1), (date(2025, 1, 1), 3, 4), (date(2025, 1, 1), 5, 6)], "obs_date date, as1 bigint, as2 bigint")
    ribs = spark.createDataFrame([(3, 4), (4, 3)], "as1 bigint, as2 bigint")
    links = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "as1 bigint, as2 bigint")
    assert {r[0]: r[2] for r in features.bidirectional(links, seen, ribs).collect()} == {1: 1, 3: 1, 5: 0}


def test_cosine(spark):
    v = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 1), (3, "y", 2)], "asn bigint, attr string, cnt bigint")
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 9)], "as1 bigint, as2 bigint")
    got = {(r[0], r[1]): r[2] for r in features.cosine_distance(links, v, "d").collect()}
    assert got == {(1, 2): 0.292893, (2, 3): 1.0, (2, 9): -1.0}


EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 3), (5, 6)]
WANT = {
    "degree_centrality": (0.2, 0.2), "average_neighbor_degree": (0.166667, 0.5), "triangles": (0, 0), "clustering": (-0.666667, 0.0), "eccentricity": (-2, -1),
    "harmonic_centrality": (0.916667, 0.833333), "closeness_centrality": (0.25974, 0.214286),
}


def test_topological_features(spark):
    links = spark.createDataFrame(EDGES, "as1 bigint, as2 bigint")
    cand = spark.createDataFrame([(2, 5), (2, 99), (98, 99), (5, 6)], "as1 bigint, as2 bigint")
    got = {(r["as1"], r["as2"]): r.asDict() for r in graph.topological_features(cand, links).collect()}
    r = got[2, 5]
    for name, (a, b) in WANT.items():
        assert (r[f"{name}_as1"], r[f"{name}_as2"]) == pytest.approx((a, b), abs=2e-6), name
    assert (r["shortest_path"], r["jaccard"], r["adamic_adar"], r["preferential_attachement"]) == (-2, 0, 0, 5)
    r = got[2, 99]
    assert (r["shortest_path"], r["degree_centrality_as1"]) == (2, 0.5)
    assert got[5, 6]["shortest_path"] == 2 and got[98, 99]["eccentricity_as1"] == 1


def test_searches_agree(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(18), 2))) for _ in range(24)}
    links = spark.createDataFrame(sorted(edges), "as1 bigint, as2 bigint")
    cand = spark.createDataFrame(sorted({tuple(sorted(rng.sample(range(20), 2))) for _ in range(12)}), "as1 bigint, as2 bigint")
    a, b = (sorted(tuple(round(x, 9) for x in r) for r in f(cand, links).collect()) for f in (graph.reach_by_arrays, graph.reach_by_joins))
    assert a == b


def test_new_links_and_quarantine(spark):
    today = spark.createDataFrame([(2, 1, "v"), (5, 6, "v"), (7, 8, None), (9, 9, "v"), (None, 1, "v")], "as1 bigint, as2 bigint, vp_ip string")
    base = spark.createDataFrame([(1, 2), (5, 6)], "as1 bigint, as2 bigint")
    out = spark.createDataFrame([(5, 6)], "as1 bigint, as2 bigint")
    assert sorted(tuple(r)[:2] for r in topology.new_links(today, base, out).collect()) == [(5, 6), (7, 8)]


def test_registry(spark):
    POLICY = """as-set: AS-FOO
members: AS1, AS2,
  AS-BAR

as-set: AS-BAR
members: AS3, AS-FOO

aut-num: AS10
import: from AS20 accept ANY
export: to AS30 announce AS-FOO
export: to AS-FOO announce AS10
mp-export: to AS-ANY announce AS10"""
    objects = spark.createDataFrame([(x,) for x in POLICY.split("\n\n")], "value string")
    assert sorted(tuple(r) for r in registries.policy_links(objects).collect()) == [(10, 1), (10, 2), (10, 3), (10, 20), (10, 30)]


def test_dump(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"netfac": {"data": [{"local_asn": 1, "fac_id": 2, "name": "n", "country": "XA", "city": "c"}, {"local_asn": 1, "fac_id": 2, "name": "n", "country": "XA", "city": "c"}]},'
        '"netixlan": {"data": [{"asn": 1, "ix_id": 3, "name": "i"}]}, "net": {"data": [{"asn": 1, "org_id": 7, "info_type": "Non-Profit"}, {"asn": 2, "org_id": 8, "info_type": "ISP"}]},'
        '"org": {"data": [{"id": 7, "country": "XB"}, {"id": 8, "country": " "}]}}'
    )
    dump = registries.read_dump(spark, str(tmp_path / "d.json"))
    assert registries.facilities(dump).count() == 1 and registries.exchanges(dump).count() == 1
    listed = spark.createDataFrame([(1,), (2,)], "asn bigint")
    assert [r[0] for r in registries.exchange_asns(dump, listed).collect()] == [1]
    orgs = spark.createDataFrame([(1, "o"), (2, "o")], "asn bigint, org string")
    got = registries.countries(dump, orgs, spark.createDataFrame([("o", "XC")], "org string, country string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "XB", "dump"), (2, "XC", "list")]


def _page(offset, size):
    return [(i, i * 2) for i in range(offset, min(offset + size, 25))]


def test_readers(spark, tmp_path):
    lines = spark.createDataFrame([("2 1,3 2 1,i,True",), ("# x",), ("1 x,p",), ("",), ("4 5,p",)], "value string")
    assert sorted(tuple(r)[:3] for r in readers.parse_link_lines(lines).collect()) == [(1, 2, "3 2 1"), (4, 5, "p")]
    assert [tuple(r) for r in readers.literal_links(spark, "2-1").collect()] == [(1, 2)]
    assert readers.literal_features(spark, "a=1|b=2.5,a=3").first()[0] == {"a": 1.0, "b": 2.5}
    assert [tuple(r) for r in readers.literal_paths(spark, "1 2,3 1 2-4 5,5 4").collect()] == [(1, 2, "3 1 2"), (4, 5, "5 4")]
    (tmp_path / "l.txt").write_text("# c\n1 2 v\nbad\n3 4 w\n")
    assert readers.read_links(spark, str(tmp_path / "l.txt"), observers=True).count() == 2
    out = str(tmp_path / "t")
    for v in (1, 2):
        readers.write_day(spark.createDataFrame([(v, "2025-01-01")], "v int, date string"), out)
    readers.write_day(spark.createDataFrame([(3, "2025-01-02")], "v int, date string"), out)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [2, 3] and readers.has_day(spark, out, "date", "2025-01-01")
    assert readers.latest_partition(spark, out, "date", "2025-01-05").first()[0] == 3
    spark.dataSource.register(readers.PagedCones)
    paged = spark.read.format("paged_cones").option("total", "25").option("page", "10").option("fetch", "test_fixtures._page").load()
    assert paged.agg(F.count("*"), F.sum("cone")).first()[:] == (25, 600)


def test_prefixes(spark):
    df = spark.createDataFrame([("10.1.2.3/16",), ("2001:DB8::1/32",), ("300.1.1.1/8",), ("10.0.0.0/33",), ("::/0",), (None,), ("",)], "p string")
    got = [r[0] for r in df.select(prefixes.parsed(F.col("p"))).collect()]
    assert tuple(got[0]) == (4, (10 << 24) + (1 << 16), 0, 16) and tuple(got[1])[0::3] == (6, 32) and tuple(got[4]) == (6, 0, 0, 0)
    assert got[2] is None and got[3] is None and got[5] is None and got[6] is None


def test_validation():
    for bad in (["x"], [4294967296], list(range(11))):
        with pytest.raises(ValueError):
            api.asns(bad)
    with pytest.raises(ValueError):
        api.boolean("maybe")
    assert api.boolean("TRUE") and api.pages(101) == 3 and api.prefix_list(["10.0.0.0/8"]) == ["10.0.0.0/8"]
