"""Queries of the new-link finder and of the feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions import paths
from hopwarden.operators import features, newedge, topology
from hopwarden.operators.distances import attribute_distances
from hopwarden.plans import graph_queries
from hopwarden.plans.graph_queries import SQL_DAYS, SQL_GRAPH, SQL_VERDICTS, last_day, ribs, today_and_baseline, verdicts, whole_graph
from hopwarden.plans.path_queries import SQL_TOKENS, _collapse_sql, links_with_hops
from hopwarden.plans.registry import Registry
from hopwarden.session import cut_lineage, once, table

R = Registry()


SQL_LEDGER = f"v as ({SQL_VERDICTS}), {graph_queries.SQL_LEDGER}"


@R.query(f"with {SQL_LEDGER}, q as (select max(day) as d from v) select as1, as2, since, date_diff('day', since, d) <= 31 as quarantined from ledger, q")
def ref_n01_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Suspicious links by their latest verdict, since when, and whether they are still kept out."""
    found = verdicts(spark, d)
    day = found.agg(F.max("day").alias("d"))
    kept = F.datediff("d", "since") <= newedge.QUARANTINE_DAYS
    return newedge.ledger(found).join(F.broadcast(day)).select("as1", "as2", "since", kept.alias("quarantined"))


@R.query(
    f"""with {SQL_LEDGER}, r as (select distinct least(asn1, asn2) as as1, greatest(asn1, asn2) as as2 from new_link)
    select r.as1, r.as2, l.since is not null as recurrent from r left join ledger l using (as1, as2)"""
)
def ref_n06_recurrent(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "new_link").select(F.least("asn1", "asn2").alias("as1"), F.greatest("asn1", "asn2").alias("as2")).distinct()
    return links.join(newedge.ledger(verdicts(spark, d)), ["as1", "as2"], "left").select("as1", "as2", F.col("since").isNotNull().alias("recurrent"))


SQL_OBSERVERS = """
    seen as (select distinct least(as1, as2) as a, greatest(as1, as2) as b, vp_ip from updates_links where vp_ip is not null and as1 <> as2),
    per as (select *, count(*) over (partition by a, b) as n from seen),
    s1 as (select distinct vp_ip from per where n <= {m}),
    lft as (select p.*, s.vp_ip is not null as have from per p left join s1 s using (vp_ip) where n > {m}),
    need as (select *, {m} - count(*) filter (have) over (partition by a, b) as need from lft),
    short as (select * from need where need > 0 and not have),
    ranks as (select vp_ip, row_number() over (order by count(*) desc, vp_ip) as r from short group by vp_ip),
    placed as (select s.*, r, row_number() over (partition by a, b order by r) as place from short s join ranks using (vp_ip)),
    stop as (select coalesce(max(r), 0) as stop from placed where place = need)"""


@R.query("with " + SQL_OBSERVERS.format(m=newedge.OBSERVERS) + " select vp_ip from s1 union all select vp_ip from ranks, stop where r <= stop")
def ref_n04_observers(spark: SparkSession, d: str) -> DataFrame:
    """Observers that cover every link as often as wanted."""
    return newedge.choose_observers(table(spark, d, "updates_links").filter("as1 <> as2"))


@R.query(
    f"""
    with t as ({SQL_TOKENS}), c as (select *, {_collapse_sql("hops")} as p from t)
    select distinct id from (select c.id, unnest(list_zip(p[1:len(p)-1], p[2:])) as z from c where len(p) > 1) x
    semi join (select distinct least(asn1, asn2) as a, greatest(asn1, asn2) as b from inference_summary where classification = 'sus') w
      on least(x.z[1], x.z[2]) = w.a and greatest(x.z[1], x.z[2]) = w.b"""
)
def ref_f02_watched_paths(spark: SparkSession, d: str) -> DataFrame:
    """Sightings whose path runs over a link judged suspicious."""
    watched = verdicts(spark, d).filter("verdict = 'sus'").select("as1", "as2").distinct()
    rows = links_with_hops(spark, d).withColumn("p", once(paths.collapse(F.col("hops"))))
    return newedge.touching_paths(rows, "id", paths.pairs(F.col("p")), watched)


@R.query(
    f"""
    with t as ({SQL_TOKENS}), c as (select *, array_to_string({_collapse_sql("hops")}, ' ') as path, least(asn1, asn2) as as1, greatest(asn1, asn2) as as2 from t)
    select as1, as2, path, observed_at, peer_ip, prefix, peer_asn from c
    qualify row_number() over (partition by as1, as2, path order by observed_at nulls last, peer_ip nulls first, prefix nulls first, peer_asn nulls first) = 1"""
)
def ref_a03_earliest(spark: SparkSession, d: str) -> DataFrame:
    """Earliest sighting per link and path."""
    rows = links_with_hops(spark, d).select(
        F.least("asn1", "asn2").alias("as1"), F.greatest("asn1", "asn2").alias("as2"), once(paths.joined(paths.collapse(F.col("hops")))).alias("path"), "observed_at", "peer_ip", "prefix", "peer_asn"
    )
    return newedge.earliest_sightings(rows, ["as1", "as2", "path"])


@R.query(
    f"""
    with {SQL_DAYS}, {SQL_GRAPH},
    seen as (select as1, as2, count(distinct obs_date) as n from updates_links, lim where obs_date > d - {features.BIDI_DAYS} and as1 <> as2 group by all),
    rib as (select distinct as1, as2 from updates_links where vp_ip is null and as1 <> as2)
    select g.as1, g.as2, cast(case when (exists (select 1 from seen s where s.as1 = g.as1 and s.as2 = g.as2) and exists (select 1 from seen s where s.as1 = g.as2 and s.as2 = g.as1))
      or (exists (select 1 from rib s where s.as1 = g.as1 and s.as2 = g.as2) and exists (select 1 from rib s where s.as1 = g.as2 and s.as2 = g.as1)) then 1 else 0 end as int) as bidi,
      least((select count(*) from near n where n.asn = g.as1 and n.other in (select distinct peer_asn from new_link)),
            (select count(*) from near n where n.asn = g.as2 and n.other in (select distinct peer_asn from new_link))) as nb_vps from g"""
)
def ref_b01_bidirectionality(spark: SparkSession, d: str) -> DataFrame:
    """Both directions seen, and neighbouring observers, of every link."""
    graph, day = whole_graph(spark, d), last_day(spark, d)
    recent = table(spark, d, "updates_links").filter(F.col("obs_date") > F.date_sub(F.lit(day), features.BIDI_DAYS))
    observers = table(spark, d, "new_link").select(F.col("peer_asn").alias("asn")).distinct()
    bidi = features.bidirectional(graph, recent, ribs(spark, d))
    return features.join_families([bidi, features.neighbouring_observers(graph, graph, observers)], ["as1", "as2"], "left")


_ATTRIBUTES = {
    "country_dist": ("netfac", "local_asn", "min(country)"),
    "facility_fac_dist": ("netfac", "local_asn", "fac_id"),
    "facility_country_dist": ("netfac", "local_asn", "country"),
    "facility_cities_dist": ("netfac", "local_asn", "city"),
    "ixp_dist": ("netixlan", "asn", "ix_id"),
}


def _distance_sql() -> str:
    ctes, joins, columns = [], [], []
    for i, (name, (t, asn, attr)) in enumerate(_ATTRIBUTES.items()):
        newest = f"snapshot_day = (select max(snapshot_day) from {t})"
        src = (
            f"select {asn} as asn, min(country)::varchar as attr from {t} where {newest} group by {asn}"
            if "min" in attr
            else f"select distinct {asn} as asn, {attr}::varchar as attr from {t} where {newest}"
        )
        ctes.append(
            f"""at{i} as (select * from ({src}) where asn is not null and attr is not null),
            ct{i} as (select n.asn, attr, count(*) as cnt from near n join at{i} a on n.other = a.asn group by all),
            nm{i} as (select asn, sqrt(sum(cnt * cnt)::double) as norm from ct{i} group by asn),
            us{i} as (select attr from ct{i} join nm{i} using (asn) group by attr having count(*) < (select count(*) from deg) or min(round(cnt / norm, 12)) < max(round(cnt / norm, 12))),
            vc{i} as (select ct{i}.* from ct{i} semi join us{i} using (attr)), nn{i} as (select asn, sqrt(sum(cnt * cnt)::double) as norm from vc{i} group by asn),
            dt{i} as (select g.as1, g.as2, sum(x.cnt * y.cnt)::double as dot from g join vc{i} x on x.asn = g.as1 join vc{i} y on y.asn = g.as2 and x.attr = y.attr group by all)"""
        )
        joins.append(f"left join nn{i} p{i} on p{i}.asn = g.as1 left join nn{i} q{i} on q{i}.asn = g.as2 left join dt{i} on dt{i}.as1 = g.as1 and dt{i}.as2 = g.as2")
        columns.append(f"round(coalesce(1 - coalesce(dt{i}.dot, 0) / (p{i}.norm * q{i}.norm), -1), 6) as {name}")
    return f"with {SQL_GRAPH}, {', '.join(ctes)} select g.as1, g.as2, {', '.join(columns)} from g {' '.join(joins)}"


def _newest(spark: SparkSession, d: str, t: str) -> DataFrame:
    rows = table(spark, d, t)
    return rows.join(F.broadcast(rows.agg(F.max("snapshot_day").alias("snapshot_day"))), "snapshot_day")


@R.query(_distance_sql())
def ref_d05_attribute_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the ends' neighbourhoods by country, facility, facility country, facility city and exchange."""
    graph = cut_lineage(whole_graph(spark, d))
    return attribute_distances(graph, graph, attributes(spark, d))


def attributes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """(asn, attr) of the newest snapshots by the name of their distance."""
    found = {}
    for name, (t, asn, attr) in _ATTRIBUTES.items():
        rows = _newest(spark, d, t)
        if "min" in attr:
            pairs = rows.groupBy(F.col(asn).alias("asn")).agg(F.min("country").alias("attr"))
        else:
            pairs = rows.select(F.col(asn).alias("asn"), F.col(attr).cast("string").alias("attr"))
        found[name] = pairs
    return found


def _pattern_sql() -> str:
    columns = ", ".join(f"{m}w[{i}] as {m}_{i}" for i in range(1, 7) for m in ("degree", "cone"))
    win = lambda m: f"(list_concat([0, 0, 0, 0, 0, 0], list_transform(list_zip({m}s[1:len({m}s)-1], {m}s[2:]), lambda z: z[1] - z[2])))[-6:] as {m}w"
    return f"""
    with {SQL_GRAPH}, t as ({SQL_TOKENS}), c as (select id, {_collapse_sql("hops")} as p from t),
    cones as (select asn, cone from as_cone where cone_month = (select max(cone_month) from as_cone)),
    x as (select id, unnest(p) as asn, unnest(range(len(p))) as pos from c),
    m as (select id, list(coalesce(degree, 1) order by pos) as degrees, list(coalesce(cone, 1) order by pos) as cones
          from x left join deg using (asn) left join cones using (asn) group by id),
    f as (select c.id, coalesce(degrees, []) as degrees, coalesce(cones, []) as cones from c left join m using (id)),
    w as (select id, {win("degree")}, {win("cone")} from f) select id, {columns} from w"""


@R.query(_pattern_sql())
def ref_c01_path_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Windows of degree and cone steps of every path."""
    cones = table(spark, d, "as_cone")
    newest = cones.join(F.broadcast(cones.agg(F.max("cone_month").alias("cone_month"))), "cone_month").select("asn", "cone")
    return features.pattern_features(links_with_hops(spark, d), "id", "hops", {"degree": topology.degrees(whole_graph(spark, d)), "cone": newest})


@R.query(
    f"""with {SQL_GRAPH}, lab as (select asn, cast(case when degree<10 then 0 when degree<50 then 1 when degree<100 then 2 when degree<500 then 3 else 4 end as int) as c from deg),
    n as (select least(x.c, y.c) as c1, greatest(x.c, y.c) as c2, count(*) as n from g join lab x on g.as1 = x.asn join lab y on g.as2 = y.asn group by all),
    r as (select *, pow(n / (select sum(n) from n)::double, 0.75) as r from n)
    select c1, c2, n, round(r / sum(r) over (), 6) as p from r"""
)
def ref_a10_category_probability(spark: SparkSession, d: str) -> DataFrame:
    """Links per pair of degree categories and their damped probabilities."""
    graph = whole_graph(spark, d)
    lab = topology.degrees(graph).select("asn", F.least(paths.degree_bucket(F.col("degree")), F.lit(4)).alias("c"))
    x, y = (lab.select(F.col("asn").alias(a), F.col("c").alias(f"c_{a}")) for a in ("as1", "as2"))
    pairs = graph.join(x, "as1").join(y, "as2").groupBy(F.least("c_as1", "c_as2").alias("c1"), F.greatest("c_as1", "c_as2").alias("c2"))
    return features.category_probability(pairs.agg(F.count(F.lit(1)).alias("n")), 0.75).select("c1", "c2", "n", F.round("p", 6).alias("p"))
