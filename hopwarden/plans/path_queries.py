"""Queries over paths: parsing, cleaning, links, pruning, windows, roles of the ASes, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions import dates, paths
from hopwarden.functions.packed import canonical_path, path_positions
from hopwarden.operators.skew import attach
from hopwarden.plans.registry import Registry
from hopwarden.session import once, table

R = Registry()

SQL_TOKENS = r"""select *, list_transform(regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+'), lambda t:
        case when t like '{%' then '{' || array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+')::bigint[])), ',') || '}'
             else t::bigint::varchar end) as toks,
      list_transform(regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+'), lambda t: regexp_extract(t, '[0-9]+')::bigint) as hops
      from new_link"""
SQL_EXCHANGES = "(select list(asn) from (select distinct asn from netixlan where asn is not null))"
SQL_RESERVED = "((x between 64496 and 131071) or x >= 4200000000)"


def _collapse_sql(a: str) -> str:
    return f"list_filter({a}, lambda x, i: i = 1 or x <> {a}[i - 1])"


def links_with_hops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "new_link").withColumn("hops", once(paths.hops(F.col("as_path"))))


@R.query(f"with t as ({SQL_TOKENS}) select id, array_to_string({_collapse_sql('toks')}, '|') as path from t")
def ref_p01_parsed_path(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.split(canonical_path(F.col("as_path")), " ")
    return table(spark, d, "new_link").select("id", F.array_join(paths.collapse(tokens), "|").alias("path"))


@R.query(f"with t as ({SQL_TOKENS}) select id, array_to_string(hops, ' ') as path from t")
def ref_p02_path_text(spark: SparkSession, d: str) -> DataFrame:
    return links_with_hops(spark, d).select("id", paths.joined(F.col("hops")).alias("path"))


def _clean_sql(reserved: str) -> str:
    return f"""
    with t as ({SQL_TOKENS}), e as (select {SQL_EXCHANGES} as ix),
    k as (select id, list_filter(hops, lambda x: not ({reserved}) and not list_contains(ix, x)) as a from t, e)
    select id, array_to_string({_collapse_sql("a")}, ' ') as path, cast(len({_collapse_sql("a")}) as int) as n from k"""


def _cleaned(spark: SparkSession, d: str, inclusive: bool) -> DataFrame:
    """Paths without reserved numbers and the ASNs of all exchange ports; a path that loses all its hops is empty."""
    listed = table(spark, d, "netixlan").filter("asn is not null").select(F.col("asn").alias("x"), F.lit(True).alias("listed")).distinct()
    rows = links_with_hops(spark, d).select("id", "hops")
    kept = attach(rows.select("id", F.posexplode("hops").alias("pos", "x")), listed, "x", 16, "left").filter("listed is null")
    ordered = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("a"))
    full = rows.select("id").join(ordered, "id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<bigint>")))
    p = once(paths.clean(F.col("a"), inclusive=inclusive)).alias("p")
    return full.select("id", p).select("id", paths.joined(F.col("p")).alias("path"), F.size("p").alias("n"))


@R.query(_clean_sql(SQL_RESERVED))
def ref_p03_clean_path(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d, True)


@R.query(_clean_sql("(x > 64496 and x < 131071) or x > 4200000000"))
def ref_p04_clean_path_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d, False)


@R.query(
    r"""
    with t as (select id, list_transform(regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+'),
                 lambda t: regexp_extract_all(t, '[0-9]+')::bigint[]) as p from new_link),
    s as (select id, unnest(list_zip(p[1:len(p)-1], p[2:])) as z from t where len(p) > 1),
    a as (select id, unnest(z[1]) as x, z[2] as q from s), b as (select id, x, unnest(q) as y from a)
    select least(x, y) as as1, greatest(x, y) as as2, count(*) as n, count(distinct id) as n_paths from b where x <> y group by all"""
)
def ref_p05_links_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """Links of all paths, sets crossed, both ends in numeric order."""
    rows = table(spark, d, "new_link").select("id", once(path_positions(F.col("as_path"))).alias("p"))
    linked = rows.select("id", once(paths.set_pairs(F.col("p"))).alias("z")).select("id", F.inline("z"))
    link = [F.least("a", "b").alias("as1"), F.greatest("a", "b").alias("as2")]
    return (
        linked.filter("a <> b").groupBy(*link).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_paths"))
    )


@R.query(
    f"""
    with t as ({SQL_TOKENS}), c as (select *, {_collapse_sql("hops")} as p from t),
    z as (select *, list_transform(list_zip(p[1:len(p)-1], p[2:]),
            lambda z: (z[1] = asn1 and z[2] = asn2) or (z[1] = asn2 and z[2] = asn1)) as hit from c)
    select id, case when list_contains(hit, true) then array_to_string(p[1:list_position(hit, true) + 1], ' ') end as path from z"""
)
def ref_p07_pruned_path(spark: SparkSession, d: str) -> DataFrame:
    pruned = paths.prune(F.col("p"), F.col("asn1"), F.col("asn2"))
    return links_with_hops(spark, d).withColumn("p", once(paths.collapse(F.col("hops")))).select("id", paths.joined(pruned).alias("path"))


@R.query(
    f"""
    with t as ({SQL_TOKENS}), c as (select *, {_collapse_sql("hops")} as p from t)
    select id, array_to_string((list_concat([0, 0, 0, 0, 0, 0], p))[-6:], ' ') as win, len(p) >= 3 as long_enough from c"""
)
def ref_p09_window(spark: SparkSession, d: str) -> DataFrame:
    """The last six hops with zeros before them, and whether the path has the three hops sampling asks for."""
    p = F.col("p")
    return links_with_hops(spark, d).withColumn("p", once(paths.collapse(F.col("hops")))).select("id", paths.joined(paths.fixed_window(p)).alias("win"), (F.size(p) >= 3).alias("long_enough"))


@R.query(
    f"""
    with t as ({SQL_TOKENS}), c as (select *, {_collapse_sql("hops")} as p from t),
    q as (select *, nullif(coalesce(list_position(p, asn1), 0), 0) as p1, nullif(coalesce(list_position(p, asn2), 0), 0) as p2 from c)
    select id, cast(len(p) - least(p1, p2) as int) as hijack_type,
      case when p1 is not null and (p2 is null or p1 < p2) then asn1 when p2 is not null then asn2 end as attacker,
      p[len(p)] as victim from q"""
)
def ref_p11_roles(spark: SparkSession, d: str) -> DataFrame:
    """Hijack type, attacker and victim of every row."""
    p, a, b = F.col("p"), F.col("asn1"), F.col("asn2")
    rows = links_with_hops(spark, d).withColumn("p", once(paths.collapse(F.col("hops"))))
    return rows.select(
        "id",
        paths.hijack_type(p, a, b).alias("hijack_type"),
        paths.attacker(p, a, b).alias("attacker"),
        paths.victim(p).alias("victim"),
    )


@R.query(
    """
    with g as (select least(as1, as2) as a, greatest(as1, as2) as b from updates_links where as1 <> as2 group by all),
    deg as (select asn, count(*) as n from (select a as asn from g union all select b from g) group by asn)
    select asn, n,
      cast(case when n<10 then 0 when n<50 then 1 when n<100 then 2 when n<500 then 3 when n<1000 then 4 when n<1500 then 5
           when n<3000 then 6 when n<5000 then 7 when n<100000 then 8 else 0 end as int) as bucket,
      cast(case when n in (10,50,100,500,1000,1500,3000,5000) then 0 when n<10 then 0 when n<50 then 1 when n<100 then 2 when n<500 then 3
           when n<1000 then 4 when n<1500 then 5 when n<3000 then 6 when n<5000 then 7 when n<100000 then 8 else 0 end as int) as strict_bucket
    from deg"""
)
def ref_p13_degree_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every AS and its bucket, closed below and strict."""
    from hopwarden.operators import topology

    deg = topology.degrees(topology.undirected(table(spark, d, "updates_links")))
    return deg.select(
        "asn",
        F.col("degree").alias("n"),
        paths.degree_bucket(F.col("degree")).alias("bucket"),
        paths.degree_bucket(F.col("degree"), strict=True).alias("strict_bucket"),
    )


@R.query(
    """
    select distinct obs_date as day, cast(date_trunc('month', obs_date) - interval 1 month as date) as previous_month,
      cast(date_trunc('month', obs_date) + interval 1 month as date) as next_month, cast(date_trunc('quarter', obs_date) as date) as quarter,
      obs_date - 7 as week_first, obs_date - 1 as week_last, cast(7 as int) as week_days,
      cast(date_diff('day', date_trunc('month', obs_date), obs_date) as int) as days_before,
      cast(24 as int) as hours, cast(obs_date as timestamp) + interval 23 hour as last_hour
    from updates_links where obs_date is not null"""
)
def ref_p15_dates(spark: SparkSession, d: str) -> DataFrame:
    """Months, quarter, last days, day ranges and hourly windows of each day."""
    day = F.col("obs_date")
    hours = dates.hourly_windows(day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz"))
    week = dates.last_days(day, 7)
    return (
        table(spark, d, "updates_links")
        .filter(day.isNotNull())
        .select("obs_date")
        .distinct()
        .select(
            day.alias("day"),
            dates.first_of_previous_month(day).alias("previous_month"),
            dates.first_of_next_month(day).alias("next_month"),
            dates.quarter_start(day).alias("quarter"),
            week[0].alias("week_first"),
            week[6].alias("week_last"),
            F.size(week).alias("week_days"),
            F.size(dates.days_between(F.trunc(day, "month"), day, closed=False)).alias("days_before"),
            F.size(hours).alias("hours"),
            F.element_at(hours, -1)["begin"].alias("last_hour"),
        )
    )
