"""Queries of what the collectors land and of the day's results: scans, lines, registries, dumps, filters, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden import jobs
from hopwarden.functions import paths
from hopwarden.operators import features, newedge, sampling, topology, verdict
from hopwarden.plans import model_queries as models
from hopwarden.plans.graph_queries import SQL_DAYS, SQL_GRAPH, last_day, ribs, whole_graph
from hopwarden.plans.path_queries import SQL_TOKENS, links_with_hops
from hopwarden.plans.registry import Registry
from hopwarden.plans.verdict_queries import SQL_LINKS, _validity_sql, labels
from hopwarden.session import table
from hopwarden.sources import readers, registries
from hopwarden.streaming import live

R = Registry()

_RESERVED = "(x between 64496 and 131071 or x >= 4200000000)"


@R.query("select distinct least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, cast(observed_at as date) as day from new_link where asn1 is not null and asn2 is not null")
def ref_s14_links_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Links of each day, undirected."""
    rows = table(spark, d, "new_link").filter("asn1 is not null and asn2 is not null")
    return rows.select(*topology.link_columns("asn1", "asn2"), F.to_date("observed_at").alias("day")).distinct()


@R.query("select id, least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, as_path from new_link where cast(observed_at as date) = date '2025-03-10'")
def ref_s15_paths_of_day(spark: SparkSession, d: str) -> DataFrame:
    """Links with their paths of one day; the filter of the day reaches the scan."""
    at = F.col("observed_at")
    rows = table(spark, d, "new_link").filter((at >= F.lit("2025-03-10").cast("timestamp_ntz")) & (at < F.lit("2025-03-11").cast("timestamp_ntz")))
    return rows.select("id", *topology.link_columns("asn1", "asn2"), "as_path")


@R.query(
    f"""with {SQL_DAYS} select distinct as1, as2 from (select as1, as2 from updates_links, lim where obs_date = d and vp_ip is not null
      union all select as1, as2 from updates_links where vp_ip is null) where as1 <> as2"""
)
def ref_u03_day_and_registry(spark: SparkSession, d: str) -> DataFrame:
    """Directed links of the last day and of the registry."""
    rows = table(spark, d, "updates_links")
    today = rows.filter((F.col("obs_date") == F.lit(last_day(spark, d))) & F.col("vp_ip").isNotNull())
    return topology.directed_union(today, ribs(spark, d))


@R.query("select least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, bool_or(is_recurrent) as is_recurrent from new_link where asn1 is not null and asn2 is not null group by all")
def ref_t05_recurrent(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recurrent(jobs.with_paths(table(spark, d, "new_link")))


@R.query(
    f"""with {SQL_DAYS}, vp as (select vp_ip from updates_links, lim where vp_ip is not null group by vp_ip, d having max(obs_date) >= d - 7)
    select obs_date, as1, as2, vp_ip, count(*) as n from updates_links semi join vp using (vp_ip) group by all"""
)
def ref_f04_active_observers(spark: SparkSession, d: str) -> DataFrame:
    """Links of observers that were still heard in the last week."""
    rows = table(spark, d, "updates_links")
    first = F.date_sub(F.lit(last_day(spark, d)), 7)
    observers = rows.groupBy("vp_ip").agg((F.max("obs_date") >= first).alias("is_active"))
    return newedge.of_active_observers(rows, observers).groupBy("obs_date", "as1", "as2", "vp_ip").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    f"""with {SQL_GRAPH}, cones as (select asn, cone from as_cone where cone_month = (select max(cone_month) from as_cone)),
    top as (select asn from deg order by degree desc, asn limit 15)
    select asn, degree, coalesce(cone, 1) as cone from deg left join cones using (asn) where coalesce(cone, 1) <= {sampling.LARGE_CONE} and asn not in (select asn from top)"""
)
def ref_f05_without_the_top(spark: SparkSession, d: str) -> DataFrame:
    """ASes to be clustered: without the top of the hierarchy (here the fifteen of most links) and large cones."""
    nodes = topology.degrees(whole_graph(spark, d)).join(models.newest_cones(spark, d), "asn", "left").withColumn("cone", F.coalesce("cone", F.lit(1).cast("bigint")))
    top = [r.asn for r in nodes.orderBy(F.desc("degree"), "asn").limit(15).collect()]
    return sampling.clusterable(nodes, top)


@R.query(f"with {SQL_GRAPH} select g.as1, g.as2, y.degree as degree_as2_kept from g join deg y on g.as2 = y.asn")
def ref_f06_excluded_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of links and of their ends left out by name."""
    deg, rows = topology.degrees(whole_graph(spark, d)), whole_graph(spark, d)
    for a in ("as1", "as2"):
        rows = rows.join(deg.select(F.col("asn").alias(a), F.col("degree").alias(f"degree_{a}")), a)
    rows = rows.withColumns({"jaccard": F.lit(0.0), "degree_as2_kept": F.col("degree_as2")})
    return features.exclude_features(rows, ["degree", "jaccard"])


@R.query(f"with r as (select id, asn1, asn2 from new_link) select id from r where not {_RESERVED.replace('x', 'asn1')} and not {_RESERVED.replace('x', 'asn2')}")
def ref_f08_public_links(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of links without private or reserved ends."""
    return table(spark, d, "new_link").filter(~paths.is_reserved(F.col("asn1")) & ~paths.is_reserved(F.col("asn2"))).select("id")


@R.query(
    f"""with t as ({SQL_TOKENS}) select least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, array_to_string(hops, ' ') as as_path, id::varchar as info, coalesce(is_recurrent, false) as is_recurrent
    from t where asn1 is not null and asn2 is not null"""
)
def ref_s12_link_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sightings written as 'as1 as2,path,info,recurrent' lines and read back."""
    text = F.concat_ws(",", F.concat_ws(" ", "asn1", "asn2"), paths.joined(F.col("hops")), F.col("id").cast("string"), F.coalesce("is_recurrent", F.lit(False)).cast("string"))
    rows = links_with_hops(spark, d).filter("asn1 is not null and asn2 is not null").select(text.alias("value"))
    return readers.parse_link_lines(rows)


@R.query(
    r"""select id, array_to_string(list_transform(regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+'),
      lambda t: array_to_string(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: x::bigint), ',')), '|') as path from new_link"""
)
def ref_p10_piped_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths that survive space-separated files (P10)."""
    return table(spark, d, "new_link").select("id", readers.pipe_path(F.col("as_path")).alias("path"))


@R.query(
    """select vp_ip as peer, 64500::bigint as peer_asn, epoch(obs_date)::double as ts, '10.' || (as1 % 256) || '.0.0/16' as prefix, as1 || ' ' || as2 as as_path
    from updates_links where vp_ip is not null and as1 is not null and as2 is not null and as1 % 5 <> 0"""
)
def ref_w03_update_lines(spark: SparkSession, d: str) -> DataFrame:
    """Update lines written from the daily links, every fifth AS a withdrawal, parsed."""
    kind = F.when(F.col("as1") % 5 == 0, "W").otherwise("U")
    prefix = F.concat(F.lit("10."), (F.col("as1") % 256).cast("string"), F.lit(".0.0/16"))
    line = F.concat_ws("|", F.lit("live"), "vp_ip", F.lit("64500"), F.unix_date("obs_date").cast("bigint") * 86400, kind, prefix, F.concat_ws(" ", "as1", "as2"))
    rows = table(spark, d, "updates_links").filter("vp_ip is not null and as1 is not null and as2 is not null")
    return live.parse_lines(rows.select(line.alias("value")))


@R.query(
    """select id, asn1 as as1, asn2 as as2 from new_link n where asn1 <> asn2 and not exists
      (select 1 from updates_links u where (u.as1 = n.asn1 and u.as2 = n.asn2) or (u.as1 = n.asn2 and u.as2 = n.asn1))"""
)
def ref_w04_unknown_links(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of links the topology does not have, in either direction."""
    rows = table(spark, d, "new_link").select("id", F.col("asn1").alias("as1"), F.col("asn2").alias("as2"))
    return live.unknown_links(rows, whole_graph(spark, d))


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshots as pieces of a dump, each of bounded size."""
    def part(t: str, asn: str, name: str, row: list) -> DataFrame:
        rows = models.newest(spark, d, t)
        return rows.groupBy(F.pmod(F.xxhash64(asn), F.lit(64)).alias("piece")).agg(F.struct(F.collect_list(F.struct(*row)).alias("data")).alias(name))

    places = part("netfac", "local_asn", "netfac", ["local_asn", "fac_id", F.col("fac_name").alias("name"), "country", "city"])
    ports = part("netixlan", "asn", "netixlan", ["asn", "ix_id", F.col("ix_name").alias("name")])
    kind = F.when(F.col("asn") % 7 == 0, "Route Server").when(F.col("asn") % 7 == 1, "Non-Profit").otherwise("NSP")
    nets = part("netixlan", "asn", "net", ["asn", (F.col("asn") % 50).alias("org_id"), kind.alias("info_type")])
    orgs = spark.range(50).select(F.lit(0).cast("bigint").alias("piece"), F.struct("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("C"), F.col("id").cast("string"))).otherwise("").alias("country")).alias("o"))
    orgs = orgs.groupBy("piece").agg(F.struct(F.collect_list("o").alias("data")).alias("org"))
    return places.join(ports, "piece", "full_outer").join(nets, "piece", "full_outer").join(orgs, "piece", "full_outer")


_NEWEST = "(select * from {0} where snapshot_day = (select max(snapshot_day) from {0}))"


@R.query(f"select distinct local_asn as asn, fac_id, fac_name as name, country, city from {_NEWEST.format('netfac')}")
def ref_p19_facilities(spark: SparkSession, d: str) -> DataFrame:
    return registries.facilities(_dump(spark, d))


@R.query(f"select distinct asn, ix_id, ix_name as name from {_NEWEST.format('netixlan')}")
def ref_p20_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return registries.exchanges(_dump(spark, d))


@R.query(f"select distinct asn from {_NEWEST.format('netixlan')} where asn % 7 in (0, 1) and asn in (select as1 from updates_links union select as2 from updates_links)")
def ref_p21_exchange_asns(spark: SparkSession, d: str) -> DataFrame:
    """Networks run by an exchange that a list also has (P21, U06); the list is the graph's ASes."""
    listed = whole_graph(spark, d).select(F.explode(F.array("as1", "as2")).alias("asn")).distinct()
    return registries.exchange_asns(_dump(spark, d), listed)


@R.query(
    f"""with x as (select distinct asn from {_NEWEST.format('netixlan')} where asn is not null), l as (select asn, 'L' || asn % 11 as c1 from (select as1 as asn from updates_links union select as2 from updates_links) where asn % 4 <> 0)
    select asn, coalesce(c2, c1) as country, if(c2 is not null, 'dump', 'list') as source from l full join (select asn, 'C' || asn % 50 as c2 from x where asn % 50 % 3 <> 0) using (asn) where asn is not null"""
)
def ref_p22_countries(spark: SparkSession, d: str) -> DataFrame:
    """Countries by organisation list, overridden by the dump's."""
    asns = table(spark, d, "updates_links").select(F.explode(F.array("as1", "as2")).alias("asn")).distinct().filter("asn % 4 <> 0")
    as_org = asns.select("asn", (F.col("asn") % 11).cast("string").alias("org"))
    org_country = spark.range(11).select(F.col("id").cast("string").alias("org"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("country"))
    return registries.countries(_dump(spark, d), as_org, org_country).distinct()


SETS = 997


@R.query(
    f"""with recursive u as (select distinct as1, as2 from updates_links where as1 is not null and as2 is not null),
    mem as (select distinct as2 % {SETS} as s, as2 as asn from u),
    reach as (select s, s as inner_, 0 as k from (select distinct s from mem) union select s, (inner_ * 2 + 1) % {SETS}, k + 1 from reach where k < {registries.CLOSURE_ROUNDS} and inner_ in (select s from mem))
    select distinct src, dst from (select as1 as src, as2 as dst from u union all
      select as1, asn from (select distinct as1 from u) a join reach on reach.s = a.as1 % {SETS} join mem on mem.s = reach.inner_)"""
)
def ref_p25_policy_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of routing-policy objects whose sets are nested and cyclic, written as text from the daily links."""
    links = table(spark, d, "updates_links").filter("as1 is not null and as2 is not null").select("as1", "as2").distinct()
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = lambda c: F.col(c).cast("string")
    group = lambda c: ((F.col(c) % SETS)).cast("string")
    lines = links.groupBy("as1").agg(F.array_join(F.collect_list(text("import: from AS", number("as2"), " accept ANY")), "\n").alias("lines"))
    asns = lines.select(text("aut-num: AS", number("as1"), "\n", F.col("lines"), "\nexport: to AS-G", group("as1"), " announce AS", number("as1"), "\nmp-export: to AS-ANY announce ANY").alias("value"))
    sets = links.select((F.col("as2") % SETS).alias("s"), "as2").distinct().groupBy("s").agg(F.array_join(F.collect_list(text("AS", number("as2"))), ",\n  ").alias("m"))
    nested = ((F.col("s") * 2 + 1) % SETS).cast("string")
    return registries.policy_links(asns.unionByName(sets.select(text("as-set: AS-G", number("s"), "\nmembers: ", F.col("m"), ",\n  AS-G", nested).alias("value"))))


SQL_ONE_LABEL = "lab as (select asn, 0::int as label from deg)"


def _one_label(spark: SparkSession, d: str) -> DataFrame:
    return topology.degrees(whole_graph(spark, d)).select("asn", F.lit(0).alias("label"))


@R.query(models.NEGATIVE_SQL.replace(models.SQL_LABELS, SQL_ONE_LABEL))
def ref_k07_plain_negative(spark: SparkSession, d: str) -> DataFrame:
    """Existing links drawn uniformly, no bridges, each with a path."""
    return sampling.negative_sample(whole_graph(spark, d), _one_label(spark, d), models._carried(spark, d), models.SAMPLE)


@R.query(models.POSITIVE_SQL.replace(models.SQL_LABELS, SQL_ONE_LABEL))
def ref_k06_random_positive(spark: SparkSession, d: str) -> DataFrame:
    """Forged links of uniform pairs."""
    labels_ = _one_label(spark, d)
    one = spark.createDataFrame([(0, 0, 1.0)], "c1 int, c2 int, p double")
    origins = models._paths(spark, d).select(paths.victim(F.col("a")).alias("origin"), "path")
    return sampling.forged_links(labels_, one, whole_graph(spark, d), topology.undirected(ribs(spark, d)), origins, models.SAMPLE)


@R.query(
    f"""with {SQL_GRAPH}, tt as ({SQL_TOKENS}), {models.SQL_PATHS},
    c as (select distinct least(z[1], z[2]) as as1, greatest(z[1], z[2]) as as2, path from (select path, unnest(list_zip(a[1:len(a)-1], a[2:])) as z from p where len(a) > 3) where z[1] <> z[2])
    select as1, as2, count(*) as n_paths, min(path) as first_path from c group by all"""
)
def ref_k09_paths_of_links(spark: SparkSession, d: str) -> DataFrame:
    """Paths of more than three hops by the links they run over."""
    long = models._carried(spark, d, longer_than=3)
    return long.groupBy("as1", "as2").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))


@R.query(
    f"""with x as (select *, 0 as label from ({models.NEGATIVE_SQL}) union all select as1, as2, path, 1 from ({models.POSITIVE_SQL})), {SQL_GRAPH}
    select x.as1, x.as2, coalesce(a.degree, 1)::double as degree_as1, coalesce(b.degree, 1)::double as degree_as2, len(string_split(path, ' '))::double as n_hops, label
    from x left join deg a on a.asn = x.as1 left join deg b on b.asn = x.as2"""
)
def ref_m01_training_frame(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of forged and existing links from two families, missing values as 1."""
    deg = topology.degrees(whole_graph(spark, d))

    def families(rows: DataFrame) -> dict[str, DataFrame]:
        degree = rows.select("as1", "as2")
        for a in ("as1", "as2"):
            degree = degree.join(deg.select(F.col("asn").alias(a), F.col("degree").cast("double").alias(f"degree_{a}")), a, "left")
        return {"topological": degree, "aspath": rows.select("as1", "as2", F.size(F.split("path", " ")).cast("double").alias("n_hops"))}

    return features.training_frame(families(models.ref_k04_positive_sample(spark, d)), families(models.ref_k03_negative_sample(spark, d)))


@R.query(
    f"""with {SQL_LINKS}, v as ({_validity_sql('case when e then eo else co end')}),
    lv as (select as1, as2, bool_and(valid) as is_origin_rpki_valid from rows join v on v.origin = hops[len(hops)] and v.prefix = rows.prefix group by all),
    r0 as (select as1, as2, peer_asn, nullif(coalesce(list_position(path, as1), 0), 0) as p1, nullif(coalesce(list_position(path, as2), 0), 0) as p2, path from rows),
    x as (select as1, as2, peer_asn, case when p1 is not null and (p2 is null or p1 < p2) then as1 when p2 is not null then as2 end as att, path[len(path)] as vic, len(path) - least(p1, p2) as typ from r0),
    s as (select as1, as2, coalesce(list_sort(list(distinct att) filter (att is not null)), []) as attackers, coalesce(list_sort(list(distinct vic) filter (vic is not null)), []) as victims,
            coalesce(list_sort(list(distinct typ) filter (typ is not null)), []) as types, coalesce(list_sort(list(distinct peer_asn) filter (peer_asn is not null)), []) as peers from x group by all),
    rec as (select as1, as2, bool_or(is_recurrent) as is_recurrent from rows group by all),
    w as (select as1, as2, cast(count(*) filter (n_legit > n_susp) as int) as num_legit_inf, cast(count(*) filter (n_legit <= n_susp) as int) as num_susp_inf,
      cast(coalesce(max(sensitivity) filter (n_susp > 0), 0) as int) as confidence_level, max(n_legit + n_susp) as num_paths from votes group by as1, as2)
    select w.*, if(num_susp_inf > 0, 'sus', 'leg') as classification, array_to_string(attackers, ' ') as attackers, array_to_string(victims, ' ') as victims, array_to_string(types, ' ') as hijack_types,
      len(attackers) = 1 and len(peers) = 1 and attackers = peers as is_local, is_origin_rpki_valid, is_recurrent
    from w left join s using (as1, as2) left join lv using (as1, as2) left join rec using (as1, as2)"""
)
def ref_t08_results(spark: SparkSession, d: str) -> DataFrame:
    """The result rows of all links: verdict, tags, validity, recurrence; hashes stand in for the models' labels."""
    found = jobs.summary(jobs.with_paths(table(spark, d, "new_link")), verdict.votes(labels(spark, d)), table(spark, d, "roa"))
    return found.select("*", *[paths.joined(F.col(c)).alias(f"_{c}") for c in ("attackers", "victims", "hijack_types")]).drop("attackers", "victims", "hijack_types").withColumnsRenamed({f"_{c}": c for c in ("attackers", "victims", "hijack_types")})
