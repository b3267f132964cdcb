"""Queries over the link graph: unions, degrees, new links, topological features, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.operators import graph, newedge, topology
from hopwarden.plans.registry import Registry
from hopwarden.session import table

R = Registry()

SQL_DAYS = "lim as (select max(obs_date) as d from updates_links)"
SQL_RIBS = "ribs as (select cast(date_trunc('month', obs_date) as date) as month, as1, as2 from updates_links where vp_ip is null)"


def ribs(spark: SparkSession, d: str) -> DataFrame:
    """Links without an observer stand in for the monthly tables."""
    month = F.trunc("obs_date", "month").alias("month")
    return table(spark, d, "updates_links").filter("vp_ip is null").select(month, "as1", "as2")


def last_day(spark: SparkSession, d: str):
    return table(spark, d, "updates_links").agg(F.max("obs_date")).first()[0]


def today_and_baseline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = last_day(spark, d)
    updates = table(spark, d, "updates_links")
    return updates.filter(F.col("obs_date") == F.lit(day)), topology.sliding_union(updates, ribs(spark, d), F.date_sub(F.lit(day), 1), newedge.HISTORY_DAYS)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inference_summary").select(
        F.least("asn1", "asn2").alias("as1"), F.greatest("asn1", "asn2").alias("as2"), F.to_date("observed_at").alias("day"), F.col("classification").alias("verdict")
    )


def kept_out(spark: SparkSession, d: str) -> DataFrame:
    """Links in quarantine on the last day, by the verdicts of the history before it."""
    day = last_day(spark, d)
    before = verdicts(spark, d).filter((F.col("day") >= F.date_sub(F.lit(day), newedge.HISTORY_DAYS)) & (F.col("day") < F.lit(day)))
    return newedge.quarantined(newedge.ledger(before), day)


SQL_BASE = f"""
    with {SQL_DAYS}, {SQL_RIBS},
    base as (select distinct least(as1, as2) as as1, greatest(as1, as2) as as2 from (
      select as1, as2 from updates_links, lim where obs_date between d - 1 - {newedge.HISTORY_DAYS} and d - 1
      union all select as1, as2 from ribs, lim where month between d - 1 - {newedge.HISTORY_DAYS} and d - 1) where as1 <> as2),
    today as (select distinct as1, as2, vp_ip from updates_links, lim where obs_date = d and as1 <> as2),
    fresh as (select t.* from today t anti join base b on least(t.as1, t.as2) = b.as1 and greatest(t.as1, t.as2) = b.as2)"""


@R.query(SQL_BASE + " select as1, as2 from base")
def ref_u01_sliding_union(spark: SparkSession, d: str) -> DataFrame:
    """Links of the history up to the day before the last."""
    return today_and_baseline(spark, d)[1]


@R.query(
    f"""
    with {SQL_DAYS}, {SQL_RIBS}
    select distinct as1, as2 from (
      select as1, as2 from updates_links, lim where obs_date >= date_trunc('month', d) - interval 1 month and obs_date < d
      union all select as1, as2 from ribs, lim where month = date_trunc('month', d) - interval 1 month) where as1 <> as2"""
)
def ref_u02_monthly_union(spark: SparkSession, d: str) -> DataFrame:
    return topology.monthly_union(table(spark, d, "updates_links"), ribs(spark, d), last_day(spark, d))


SQL_LEDGER = """
    l as (select as1, as2, max(day) filter (verdict = 'leg') as leg, max(day) filter (verdict = 'sus') as sus from v group by all),
    ledger as (select l.as1, l.as2, min(v.day) as since from l join v using (as1, as2)
      where sus is not null and (leg is null or sus >= leg) and v.verdict = 'sus' and (leg is null or v.day >= leg) group by all)"""
SQL_VERDICTS = "select least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, cast(observed_at as date) as day, classification as verdict from inference_summary"
SQL_KEPT_OUT = f"""
    v as (select x.* from ({SQL_VERDICTS}) x, lim where day >= d - {newedge.HISTORY_DAYS} and day < d), {SQL_LEDGER},
    kept_out as (select as1, as2 from ledger, lim where date_diff('day', since, d) <= {newedge.QUARANTINE_DAYS})"""
#: New links of the last day, those in quarantine being no part of the known ones.
SQL_FRESH = f"""{SQL_BASE}, {SQL_KEPT_OUT}, known as (select * from base anti join kept_out using (as1, as2)),
    news as (select t.* from today t anti join known b on least(t.as1, t.as2) = b.as1 and greatest(t.as1, t.as2) = b.as2)"""


@R.query(SQL_FRESH + " select as1, as2, vp_ip from news")
def ref_j01_new_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the last day that the history before it, less the links in quarantine, did not have, with direction and observers."""
    return topology.new_links(*today_and_baseline(spark, d), kept_out(spark, d))


@R.query("select as1, as2, count(distinct obs_date) as n_days from updates_links where as1 <> as2 group by as1, as2")
def ref_a02_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return topology.day_counts(table(spark, d, "updates_links"))


@R.query(
    """
    select d.snapshot_day as day, (select max(v.snapshot_day) from (select distinct snapshot_day from netixlan) v
      where v.snapshot_day <= d.snapshot_day) as version from (select distinct snapshot_day from netfac) d"""
)
def ref_s19_latest_not_after(spark: SparkSession, d: str) -> DataFrame:
    """For each facility snapshot the newest exchange snapshot not after it."""
    days = table(spark, d, "netfac").select(F.col("snapshot_day").alias("day")).distinct()
    versions = table(spark, d, "netixlan").select(F.col("snapshot_day").alias("version")).distinct()
    return topology.latest_not_after(days, versions, "day", "version")


SQL_PRESENT = """
    present as (select distinct 'updates' as dataset, obs_date as day from updates_links union select 'roa', roa_date from roa
      union select 'cone', cone_month from as_cone union select 'sightings', cast(observed_at as date) from new_link),
    days as (select distinct obs_date as day from updates_links)"""


def present(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.lit(n).alias("dataset"), F.to_date(c).alias("day")).distinct()
        for n, t, c in (("updates", "updates_links", "obs_date"), ("roa", "roa", "roa_date"), ("cone", "as_cone", "cone_month"), ("sightings", "new_link", "observed_at"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@R.query(
    f"""with {SQL_PRESENT} select e.dataset, e.day from (select dataset, day from (select distinct dataset from present), days) e
    anti join present p on e.dataset = p.dataset and e.day = p.day"""
)
def ref_s22_missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    found = present(spark, d)
    return topology.completeness(found, found.select("dataset").distinct(), table(spark, d, "updates_links").select(F.col("obs_date").alias("day")))


@R.query(
    f"with {SQL_PRESENT} select max(day) as day from (select day from present where dataset <> 'roa' and dataset <> 'cone' group by day having count(distinct dataset) = 2)"
)
def ref_s23_last_complete_day(spark: SparkSession, d: str) -> DataFrame:
    daily = present(spark, d).filter("dataset in ('updates', 'sightings')")
    return topology.complete_days(daily, 2).agg(F.max("day").alias("day"))


SQL_GRAPH = """
    g as (select distinct least(as1, as2) as as1, greatest(as1, as2) as as2 from updates_links where as1 <> as2),
    near as (select as1 as asn, as2 as other from g union all select as2, as1 from g),
    deg as (select asn, count(*) as degree from near group by asn)"""


def whole_graph(spark: SparkSession, d: str) -> DataFrame:
    return topology.undirected(table(spark, d, "updates_links"))


@R.query(
    f"""with {SQL_GRAPH}, cones as (select asn, cone from as_cone where cone_month = (select max(cone_month) from as_cone)),
    reg as (select distinct as1, as2 from updates_links where vp_ip is null and as1 <> as2),
    nodes as (select asn from deg union select as1 from reg union select as2 from reg)
    select n.asn, coalesce(degree, 1) as degree, coalesce(cone, 1) as cone from nodes n left join deg using (asn) left join cones using (asn)"""
)
def ref_j07_degree_and_cone(spark: SparkSession, d: str) -> DataFrame:
    cones = table(spark, d, "as_cone")
    newest = cones.agg(F.max("cone_month").alias("cone_month"))
    registry = ribs(spark, d).select("as1", "as2").filter("as1 <> as2").distinct()
    return topology.degree_and_cone(whole_graph(spark, d), registry, cones.join(F.broadcast(newest), "cone_month").select("asn", "cone"))


@R.query(
    f"""with {SQL_GRAPH}, tri as (select a.asn, count(*) // 2 as t from near a join near b on a.asn = b.asn join near c on c.asn = a.other and c.other = b.other group by a.asn),
    s as (select n.asn, sum(d.degree) as s from near n join deg d on n.other = d.asn group by n.asn)
    select deg.asn, cast(degree as bigint) as degree, round(degree / ((select count(*) from deg) - 1.0::double), 6) as degree_centrality,
      round(s / degree::double, 6) as average_neighbor_degree, cast(coalesce(t, 0) as bigint) as triangles,
      case when degree < 2 then 0.0 else round(2 * coalesce(t, 0) / (degree * (degree - 1.0::double)), 6) end as clustering
    from deg join s on deg.asn = s.asn left join tri on deg.asn = tri.asn"""
)
def ref_g01_local_features(spark: SparkSession, d: str) -> DataFrame:
    """Degree centrality, average neighbour degree, triangles and clustering of every AS."""
    links = whole_graph(spark, d)
    n = topology.degrees(links).agg(F.count(F.lit(1)).alias("n"))
    own = graph.neighbour_degree_sums(links).join(graph.triangles(links), "asn", "left").join(F.broadcast(n))
    t, deg = F.coalesce("triangles", F.lit(0).cast("bigint")), F.col("degree")
    return own.select(
        "asn",
        "degree",
        F.round(deg / (F.col("n") - 1), 6).alias("degree_centrality"),
        F.round(F.col("degree_sum") / deg, 6).alias("average_neighbor_degree"),
        t.alias("triangles"),
        F.when(deg < 2, 0.0).otherwise(F.round(2 * t / (deg * (deg - 1)), 6)).alias("clustering"),
    )


@R.query(
    f"""with {SQL_GRAPH}, cn as (select g.as1, g.as2, count(*) as cn, sum(1 / ln(d.degree::double)) as aa from g join near a on g.as1 = a.asn
      join near b on g.as2 = b.asn and a.other = b.other join deg d on d.asn = a.other group by all)
    select g.as1, g.as2, cast(coalesce(cn, 0) as bigint) as common, round(coalesce(cn, 0) / (x.degree + y.degree - coalesce(cn, 0))::double, 6) as jaccard,
      round(coalesce(aa, 0), 6) as adamic_adar, x.degree * y.degree as preferential_attachement
    from g left join cn using (as1, as2) join deg x on g.as1 = x.asn join deg y on g.as2 = y.asn"""
)
def ref_g09_link_features(spark: SparkSession, d: str) -> DataFrame:
    """Common neighbours, Jaccard, Adamic-Adar and preferential attachment of every link."""
    links = whole_graph(spark, d)
    deg = topology.degrees(links)
    shared = graph.common_neighbours(links, links).join(deg.withColumnRenamed("asn", "w"), "w")
    cn = shared.groupBy("as1", "as2").agg(F.count(F.lit(1)).alias("cn"), F.sum(1 / F.log(F.col("degree").cast("double"))).alias("aa"))
    full = links.join(cn, ["as1", "as2"], "left")
    for a in ("as1", "as2"):
        full = full.join(deg.select(F.col("asn").alias(a), F.col("degree").alias(f"d_{a}")), a)
    n = F.coalesce("cn", F.lit(0).cast("bigint"))
    return full.select(
        "as1",
        "as2",
        n.alias("common"),
        F.round(n / (F.col("d_as1") + F.col("d_as2") - n), 6).alias("jaccard"),
        F.round(F.coalesce("aa", F.lit(0.0)), 6).alias("adamic_adar"),
        (F.col("d_as1") * F.col("d_as2")).alias("preferential_attachement"),
    )


def _features_sql() -> str:
    ends = []
    for i, j in ((1, 2), (2, 1)):
        a = f"as{i}"
        ends += [
            f"round((d{i} + 1) / (n1 - 1) - if(ok, d{i} / (n0 - 1), 0), 6) as degree_centrality_{a}",
            f"round((s{i} + d{j} + 1) / (d{i} + 1) - if(ok, s{i} / greatest(d{i}, 1), 0), 6) as average_neighbor_degree_{a}",
            f"round(t{i} + cn - if(ok, t{i}, 0), 6) as triangles_{a}",
            f"round(if(d{i} < 1, 0, 2 * (t{i} + cn) / ((d{i} + 1) * greatest(d{i}, 1))) - if(ok, if(d{i} < 2, 0, 2 * t{i} / (d{i} * greatest(d{i} - 1, 1))), 0), 6) as clustering_{a}",
            f"round(ae{i} - if(ok, be{i}, 0), 6) as eccentricity_{a}",
            f"round(ah{i} - if(ok, bh{i}, 0), 6) as harmonic_centrality_{a}",
            f"round((ar{i} - 1) * (ar{i} - 1) / (greatest(ay{i}, 1) * (n1 - 1)) - if(ok, (br{i} - 1) * (br{i} - 1) / (greatest(by{i}, 1) * (n0 - 1)), 0), 6) as closeness_centrality_{a}",
        ]
    sums = ", ".join(
        f"count({w}{i}) ::double as {w}r{i}, coalesce(sum({w}{i}), 0)::double as {w}y{i}, coalesce(sum(case when {w}{i} > 0 then 1.0::double / {w}{i} end), 0) as {w}h{i}, coalesce(max({w}{i}), 0)::double as {w}e{i}"
        for w in "ba" for i in (1, 2)
    )
    return f"""
    with recursive {SQL_DAYS}, {SQL_GRAPH},
    cand as (select distinct least(as1, as2) as as1, greatest(as1, as2) as as2 from updates_links, lim where as1 <> as2 group by all having min(obs_date) = max(d)),
    bfs as (select as1, as2, 1 as side, as1 as node, 0 as dist from cand union select as1, as2, 2, as2, 0 from cand
      union select b.as1, b.as2, b.side, n.other, b.dist + 1 from bfs b join near n on b.node = n.asn
      where b.dist < 9 and not (n.asn in (b.as1, b.as2) and n.other in (b.as1, b.as2))),
    dist as (select as1, as2, node, min(dist) filter (side = 1) as b1, min(dist) filter (side = 2) as b2 from bfs group by all),
    after_ as (select *, case when node = as1 then 0 when node = as2 then 1 else least(b1, b2 + 1) end as a1,
                       case when node = as2 then 0 when node = as1 then 1 else least(b2, b1 + 1) end as a2 from dist),
    reach as (select as1, as2, max(b1) filter (node = as2) as apart, {sums} from after_ group by as1, as2),
    near0 as (select c.as1, c.as2, n.asn, n.other from cand c join near n on n.asn in (c.as1, c.as2) where not (n.asn in (c.as1, c.as2) and n.other in (c.as1, c.as2))),
    loc as (select as1, as2,
        (select count(*) from near0 x where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as1)::double as d1,
        (select count(*) from near0 x where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as2)::double as d2,
        (select coalesce(sum(degree), 0) from near0 x join deg on x.other = deg.asn where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as1)::double as s1,
        (select coalesce(sum(degree), 0) from near0 x join deg on x.other = deg.asn where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as2)::double as s2,
        (select count(*) from near0 x join near0 y on x.other = y.other where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as1 and y.as1 = c.as1 and y.as2 = c.as2 and y.asn = c.as2)::double as cn,
        (select coalesce(sum(1 / ln(degree::double)), 0) from near0 x join near0 y on x.other = y.other join deg on deg.asn = x.other where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as1 and y.as1 = c.as1 and y.as2 = c.as2 and y.asn = c.as2) as aa,
        (select count(*) / 2 from near0 x join near0 y on x.as1 = y.as1 and x.as2 = y.as2 and x.asn = y.asn join near z on z.asn = x.other and z.other = y.other where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as1)::double as t1,
        (select count(*) / 2 from near0 x join near0 y on x.as1 = y.as1 and x.as2 = y.as2 and x.asn = y.asn join near z on z.asn = x.other and z.other = y.other where x.as1 = c.as1 and x.as2 = c.as2 and x.asn = c.as2)::double as t2
      from cand c),
    f as (select *, apart is not null as ok, (select count(*) from deg)::double as n0, (select count(*) from deg)::double as n1 from loc join reach using (as1, as2))
    select as1, as2, {", ".join(ends)}, round(2.0::double - if(ok, apart + 1, 0), 6) as shortest_path,
      round(cn / (d1 + d2 - cn + 2) - if(ok, if(d1 + d2 = 0, 0, cn / greatest(d1 + d2 - cn, 1)), 0), 6) as jaccard,
      round(aa - if(ok, aa, 0), 6) as adamic_adar, round((d1 + 1) * (d2 + 1) - if(ok, d1 * d2, 0), 6) as preferential_attachement from f"""


def fresh_links(spark: SparkSession, d: str) -> DataFrame:
    """Links first seen on the last day, undirected."""
    seen = table(spark, d, "updates_links").filter("as1 <> as2").groupBy(*topology.link_columns()).agg(F.min("obs_date").alias("first"))
    return seen.filter(F.col("first") == F.lit(last_day(spark, d))).select("as1", "as2")


@R.query(_features_sql())
def ref_g05_topological_features(spark: SparkSession, d: str) -> DataFrame:
    """All topological features of the links first seen on the last day: with the link less without it."""
    return graph.topological_features(fresh_links(spark, d), whole_graph(spark, d))


@R.query(
    f"""with recursive {SQL_DAYS}, {SQL_GRAPH},
    cand as (select distinct least(as1, as2) as as1, greatest(as1, as2) as as2 from updates_links, lim where as1 <> as2 group by all having min(obs_date) = max(d)),
    bfs as (select as1, as2, as1 as node from cand union select b.as1, b.as2, n.other from bfs b join near n on b.node = n.asn
      where not (n.asn in (b.as1, b.as2) and n.other in (b.as1, b.as2)))
    select c.as1, c.as2, exists (select 1 from bfs b where b.as1 = c.as1 and b.as2 = c.as2 and b.node = c.as2) as connected from cand c"""
)
def ref_g19_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ends of the links first seen on the last day stay connected without them."""
    return graph.on_a_cycle(fresh_links(spark, d), whole_graph(spark, d))


ROUNDS = 20


def _rounds_sql(first: str, step: str, last: str) -> str:
    steps = ", ".join(f"r{i + 1} as materialized ({step.format(r=f'r{i}')})" for i in range(ROUNDS))
    return f"with {SQL_GRAPH}, n as (select count(*)::double as n from deg), r0 as ({first}), {steps} {last.format(r=f'r{ROUNDS}')}"


@R.query(
    _rounds_sql(
        "select asn, 1 / n as x from deg, n",
        "select w.other as asn, 0.15::double / n + 0.85::double * sum(x / degree) as x from near w join {r} on w.asn = {r}.asn join deg on deg.asn = w.asn, n group by w.other, n",
        "select asn, round(x, 9) as pagerank from {r}",
    )
)
def ref_g13_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(whole_graph(spark, d), rounds=ROUNDS).select("asn", F.round("pagerank", 9).alias("pagerank"))


@R.query(
    _rounds_sql(
        "select asn, 1::double as x from deg",
        "select asn, sum(x) as x from (select w.other as asn, x from near w join {r} on w.asn = {r}.asn union all select asn, x from {r}) group by asn",
        "select asn, round(x / (select sqrt(sum(x * x)) from {r}), 8) as centrality from {r}",
    )
)
def ref_g14_eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return graph.eigenvector_centrality(whole_graph(spark, d), rounds=ROUNDS).select("asn", F.round("centrality", 8).alias("centrality"))


@R.query(
    f"""with {SQL_GRAPH}, two as (select a.asn as mid, a.other as u, b.other as v from near a join near b on a.asn = b.asn and a.other < b.other),
    meets as (select u, v, count(*) - 1 as q from two group by all),
    x as (select mid, q, greatest(x.degree + y.degree - 2 - q - 2 * (g.as1 is not null)::int, 0) as p from two join meets using (u, v)
          join deg x on x.asn = u join deg y on y.asn = v left join g on g.as1 = u and g.as2 = v)
    select deg.asn, round(coalesce(case when sum(p) > 0 then sum(q) / sum(p)::double end, 0), 9) as square_clustering from deg left join x on x.mid = deg.asn group by deg.asn"""
)
def ref_g16_square_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.square_clustering(whole_graph(spark, d)).select("asn", F.round("square_clustering", 9).alias("square_clustering"))


@R.query(
    f"""with recursive {SQL_GRAPH}, adj as materialized (select asn, list(other) as os from near group by asn),
    c as (select [asn] as ms from adj union all
          select list_append(ms, o.asn) from (select ms, unnest(os) as nxt from c join adj on adj.asn = ms[len(ms)]) x join adj o on o.asn = nxt
          where nxt > ms[len(ms)] and list_has_all(o.os, ms)),
    m as (select ms from c anti join (select distinct ms as bigger from (select ms, unnest(os) as z from c join adj on adj.asn = ms[1]) x join adj o on o.asn = z where list_has_all(o.os, ms)) b on c.ms = b.bigger)
    select asn, count(*) as number_of_cliques from (select unnest(ms) as asn from m) group by asn"""
)
def ref_g15_cliques(spark: SparkSession, d: str) -> DataFrame:
    return graph.number_of_cliques(whole_graph(spark, d))
