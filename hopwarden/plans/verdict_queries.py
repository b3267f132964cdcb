"""Queries of verdicts, origin validity, evaluation and the query interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions import paths
from hopwarden.operators import accuracy, api, topology, verdict
from hopwarden.plans.graph_queries import SQL_GRAPH, whole_graph
from hopwarden.plans.path_queries import SQL_TOKENS, _collapse_sql, links_with_hops
from hopwarden.plans.registry import Registry
from hopwarden.session import once, table

R = Registry()

#: Stands in for a model: the label of a path grows more likely suspicious with the sensitivity.
MODELS = 10


def uniform(text: Column) -> Column:
    """A number in [0, 1) from an MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


SQL_LINKS = f"""
    t as ({SQL_TOKENS}),
    rows as (select *, least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, {_collapse_sql("hops")} as path from t where asn1 is not null and asn2 is not null),
    labels as (select as1, as2, p, s as sensitivity, cast(('0x' || substr(md5(as1 || ' ' || as2 || ' ' || p), 1, 8))::ubigint::double / 4294967296.0::double * 20 < s as int) as label
      from (select distinct as1, as2, array_to_string(path, ' ') as p from rows), range(1, {MODELS + 1}) r(s)),
    votes as (select as1, as2, sensitivity, count(*) filter (label = 0) as n_legit, count(*) filter (label = 1) as n_susp from labels group by all)"""


def sightings(spark: SparkSession, d: str) -> DataFrame:
    rows = links_with_hops(spark, d).filter("asn1 is not null and asn2 is not null")
    return rows.select("*", F.least("asn1", "asn2").alias("as1"), F.greatest("asn1", "asn2").alias("as2"), once(paths.collapse(F.col("hops"))).alias("path"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    distinct = sightings(spark, d).select("as1", "as2", paths.joined(F.col("path")).alias("p")).distinct()
    each = distinct.select("*", F.explode(F.sequence(F.lit(1), F.lit(MODELS))).alias("sensitivity"))
    drawn = uniform(F.concat_ws(" ", "as1", "as2", "p"))
    return each.select("as1", "as2", "sensitivity", (drawn * 20 < F.col("sensitivity")).cast("int").alias("label"))


@R.query(
    f"""with {SQL_LINKS}
    select as1, as2, cast(count(*) filter (n_legit > n_susp) as int) as num_legit_inf, cast(count(*) filter (n_legit <= n_susp) as int) as num_susp_inf,
      cast(coalesce(max(sensitivity) filter (n_susp > 0), 0) as int) as confidence_level, max(n_legit + n_susp) as num_paths,
      case when count(*) filter (n_legit <= n_susp) > 0 then 'sus' else 'leg' end as classification from votes group by as1, as2"""
)
def ref_t01_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Votes of all models to verdicts."""
    return verdict.verdicts(verdict.votes(labels(spark, d)))


@R.query(
    f"""with {SQL_LINKS}, v as (select as1, as2, count(*) filter (n_legit > n_susp) as l, count(*) filter (n_legit <= n_susp) as s, max(n_legit + n_susp) as n from votes group by all)
    select as1, as2, 0::int as line_no, '!' || if(s > 0, 'sus', 'leg') || ' ' || as1 || ' ' || as2 || ' ' || l || ' ' || s || ' ' || n as line from v
    union all select as1, as2, sensitivity::int, as1 || ' ' || as2 || ' ' || sensitivity || ' ' || n_legit || ' ' || n_susp from votes"""
)
def ref_t06_case_lines(spark: SparkSession, d: str) -> DataFrame:
    votes = verdict.votes(labels(spark, d))
    return verdict.case_lines(verdict.verdicts(votes), votes)


@R.query(
    f"""with {SQL_LINKS},
    r as (select as1, as2, peer_asn, nullif(coalesce(list_position(path, as1), 0), 0) as p1, nullif(coalesce(list_position(path, as2), 0), 0) as p2, path from rows),
    x as (select as1, as2, peer_asn, case when p1 is not null and (p2 is null or p1 < p2) then as1 when p2 is not null then as2 end as att,
            path[len(path)] as vic, len(path) - least(p1, p2) as typ from r),
    s as (select as1, as2, coalesce(list_sort(list(distinct att) filter (att is not null)), []) as attackers, coalesce(list_sort(list(distinct vic) filter (vic is not null)), []) as victims,
            coalesce(list_sort(list(distinct typ) filter (typ is not null)), []) as types, coalesce(list_sort(list(distinct peer_asn) filter (peer_asn is not null)), []) as peers from x group by all)
    select as1, as2, array_to_string(attackers, ' ') as attackers, array_to_string(victims, ' ') as victims, array_to_string(types, ' ') as hijack_types,
      len(attackers) = 1 and len(peers) = 1 and attackers = peers as is_local from s"""
)
def ref_t02_tags(spark: SparkSession, d: str) -> DataFrame:
    """Attackers, victims, types and locality of every link."""
    found = verdict.tags(sightings(spark, d).select("as1", "as2", "path", "peer_asn"))
    return found.select("as1", "as2", *[paths.joined(F.col(c)).alias(c) for c in ("attackers", "victims", "hijack_types")], "is_local")


@R.query("select asn, prefix, max(max_length) as max_length from roa where asn is not null and prefix is not null group by all")
def ref_s09_roas(spark: SparkSession, d: str) -> DataFrame:
    return verdict.deduplicated_roas(table(spark, d, "roa"))


#: DuckDB: a prefix as family, length and the bits of its network address.
SQL_BITS = r"""
    case when p like '%.%' then list_aggregate(list_transform(string_split(split_part(p, '/', 1), '.'), lambda o: lpad(bin(o::int), 8, '0')), 'string_agg', '')
    else list_aggregate(list_transform(string_split(
        case when split_part(p, '/', 1) like '%::%' then
          split_part(split_part(p, '/', 1), '::', 1) || repeat(':0', 8 - len(list_filter(string_split(replace(split_part(p, '/', 1), '::', ':'), ':'), lambda g: g <> '')))
            || if(split_part(split_part(p, '/', 1), '::', 2) = '', '', ':' || split_part(split_part(p, '/', 1), '::', 2))
        else split_part(p, '/', 1) end, ':'), lambda g: lpad(bin(('0x' || g)::int), 16, '0')), 'string_agg', '') end"""


def _validity_sql(columns: str) -> str:
    return f"""
    with t as ({SQL_TOKENS}), pairs as (select distinct hops[len(hops)] as origin, prefix from t where len(hops) > 0 and prefix is not null),
    b as (select origin, prefix, p like '%.%' as v4, split_part(p, '/', 2)::int as n, left({SQL_BITS}, split_part(p, '/', 2)::int) as bits from (select *, prefix as p from pairs)),
    r as (select asn, max_length, p like '%.%' as v4, split_part(p, '/', 2)::int as n, left({SQL_BITS}, split_part(p, '/', 2)::int) as bits
          from (select *, prefix as p from roa where asn is not null and prefix is not null)),
    m as (select b.origin, b.prefix, r.asn = b.origin as own, r.n = b.n as exact, coalesce(r.max_length, r.n) >= b.n as allowed
          from b join (select distinct n from r) ns on ns.n <= b.n join r on r.v4 = b.v4 and r.n = ns.n and r.bits = left(b.bits, ns.n)),
    f as (select origin, prefix, bool_or(exact) as e, bool_or(exact and own) as eo, bool_or(own) as co, bool_or(own and allowed) as ro from m group by all)
    select p.origin, p.prefix, coalesce({columns}, false) as valid from pairs p left join f on p.origin = f.origin and p.prefix = f.prefix"""


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return links_with_hops(spark, d).withColumn("origin", paths.victim(F.col("hops")))


@R.query(_validity_sql("case when e then eo else co end"))
def ref_t03_origin_validity(spark: SparkSession, d: str) -> DataFrame:
    """Origin validity of every announced pair by covering authorisations."""
    return verdict.origin_validity(_origins(spark, d), verdict.deduplicated_roas(table(spark, d, "roa")))


@R.query(_validity_sql("ro").replace("select asn, max_length, p like", "select asn, max_length, p like"))
def ref_t03_rfc6811(spark: SparkSession, d: str) -> DataFrame:
    return verdict.origin_validity(_origins(spark, d), table(spark, d, "roa"), rfc6811=True)


@R.query(
    f"""
    with t as ({SQL_TOKENS}), pairs as (select distinct hops[len(hops)] as origin, prefix from t where len(hops) > 0 and prefix is not null)
    select origin, p.prefix, coalesce(bool_or(r.asn = origin), true) as valid from pairs p left join roa r on r.prefix = p.prefix and r.asn is not null group by all"""
)
def ref_t09_live_validity(spark: SparkSession, d: str) -> DataFrame:
    """Origin validity of every announced pair by the live parser's rule."""
    return verdict.exact_validity(_origins(spark, d), table(spark, d, "roa"))


@R.query(
    f"with v as ({_validity_sql('case when e then eo else co end')}), t as ({SQL_TOKENS}) "
    "select least(asn1, asn2) as as1, greatest(asn1, asn2) as as2, bool_and(valid) as is_origin_rpki_valid from t join v on v.origin = hops[len(hops)] and v.prefix = t.prefix group by all"
)
def ref_t04_link_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = _origins(spark, d).select(F.least("asn1", "asn2").alias("as1"), F.greatest("asn1", "asn2").alias("as2"), "origin", "prefix")
    return verdict.link_validity(rows, verdict.origin_validity(rows, verdict.deduplicated_roas(table(spark, d, "roa"))))


@R.query(
    """select n.id, (select min(s.id) from inference_summary s where least(s.asn1, s.asn2) = least(n.asn1, n.asn2) and greatest(s.asn1, s.asn2) = greatest(n.asn1, n.asn2)
      and cast(s.observed_at as date) = cast(n.observed_at as date)) as inference_id from new_link n"""
)
def ref_t08_back_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "new_link").drop("inference_id")
    return verdict.back_fill(rows, table(spark, d, "inference_summary"), F.to_date("observed_at")).select("id", "inference_id")


SQL_JUDGED = """
    j as (select id, asn1 % 4 as c1, asn2 % 4 as c2, confidence_level as size, cast(classification = 'sus' as int) as label, cast(num_susp_inf >= 2 as int) as predicted from inference_summary)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inference_summary").select(
        "id",
        (F.col("asn1") % 4).alias("c1"),
        (F.col("asn2") % 4).alias("c2"),
        F.col("confidence_level").alias("size"),
        (F.col("classification") == "sus").cast("int").alias("label"),
        (F.col("num_susp_inf") >= 2).cast("int").alias("predicted"),
    )


@R.query(
    f"""with {SQL_JUDGED}, c as (select c1, count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 1 and predicted = 0) as fn,
      count(*) filter (label = 0 and predicted = 1) as fp, count(*) filter (label = 0 and predicted = 0) as tn from j group by c1)
    select *, round(100 * (tp + tn) / (tp + fn + fp + tn)::double, 2) as accuracy, case when tp + fn > 0 then round(100 * tp / (tp + fn)::double, 2) else 0.0 end as tpr,
      case when fp + tn > 0 then round(100 * fp / (fp + tn)::double, 2) else 0.0 end as fpr from c"""
)
def ref_a13_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix and rates per group."""
    return accuracy.confusion(judged(spark, d), ["c1"])


@R.query(
    f"""with {SQL_JUDGED}, n as (select least(c1, c2) as a, greatest(c1, c2) as b, count(*) as n from j group by all), s as (select a, b, round(n / sum(n) over ()::double, 5) as share from n)
    select a as c1, b as c2, share from s union all select b, a, share from s where a <> b"""
)
def ref_a11_contingency(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.contingency(judged(spark, d))


@R.query(
    f"""with {SQL_JUDGED}, n as (select least(c1, c2) as c1, greatest(c1, c2) as c2, count(*) filter (label = 1 and predicted = 1) as a, count(*) filter (label = 1 and predicted = 0) as b,
      count(*) filter (label = 0 and predicted = 1) as c, count(*) filter (label = 0 and predicted = 0) as d from j group by all)
    select c1, c2, case when a + b > 0 then round(a / (a + b)::double, 4) else 0.0 end as tpr, case when c + d > 0 then round(c / (c + d)::double, 4) else 0.0 end as fpr from n"""
)
def ref_a12_rates(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.rates_by_category(judged(spark, d))


@R.query(
    f"""with {SQL_GRAPH}, cones as (select asn, cone from as_cone where cone_month = (select max(cone_month) from as_cone)),
    x as (select deg.asn % 5 as cluster, degree, coalesce(cone, 1) as cone from deg left join cones using (asn))
    select cluster, count(*) as n, min(degree) as degree_min, quantile_cont(degree, 0.25) as degree_q1, quantile_cont(degree, 0.5) as degree_median, quantile_cont(degree, 0.75) as degree_q3, max(degree) as degree_max,
      min(cone) as cone_min, quantile_cont(cone, 0.25) as cone_q1, quantile_cont(cone, 0.5) as cone_median, quantile_cont(cone, 0.75) as cone_q3, max(cone) as cone_max from x group by cluster"""
)
def ref_a15_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    cones = table(spark, d, "as_cone")
    newest = cones.join(F.broadcast(cones.agg(F.max("cone_month").alias("cone_month"))), "cone_month").select("asn", "cone")
    both = topology.degrees(whole_graph(spark, d)).join(newest, "asn", "left")
    return accuracy.cluster_summary(both.select((F.col("asn") % 5).alias("cluster"), "degree", F.coalesce("cone", F.lit(1).cast("bigint")).alias("cone")))


@R.query(
    """with r as (select confidence_level as size, num_legit_inf::double as tpr, num_susp_inf::double as fpr from inference_summary)
    select size, count(*) as runs, round(quantile_cont(tpr, 0.25), 4) as tpr_25, round(quantile_cont(tpr, 0.5), 4) as tpr_50, round(quantile_cont(tpr, 0.75), 4) as tpr_75,
      round(quantile_cont(fpr, 0.25), 4) as fpr_25, round(quantile_cont(fpr, 0.5), 4) as fpr_50, round(quantile_cont(fpr, 0.75), 4) as fpr_75 from r group by size"""
)
def ref_a16_by_size(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "inference_summary")
    return accuracy.by_size(rows.select(F.col("confidence_level").alias("size"), F.col("num_legit_inf").cast("double").alias("tpr"), F.col("num_susp_inf").cast("double").alias("fpr")))


SQL_HITS = """
    select s.id, s.observed_at, s.asn1 || ' ' || s.asn2 as link, s.num_paths, s.classification, s.num_susp_inf as confidence, count(*) as n_links, min(n.id) as first_link, max(n.id) as last_link
    from inference_summary s join new_link n on n.inference_id = s.id where {} group by all"""


def _hits(spark: SparkSession, d: str, **filters: object) -> DataFrame:
    found = api.forged_origin_hijacks(table(spark, d, "inference_summary"), table(spark, d, "new_link"), **filters)
    ids = F.from_json("new_links", "array<struct<link_id: bigint>>")["link_id"]
    kept = [c for c in found.columns if c != "new_links"]
    return found.select(*kept, F.size(ids).cast("bigint").alias("n_links"), F.array_min(ids).alias("first_link"), F.array_max(ids).alias("last_link"))


@R.query(SQL_HITS.format("classification = 'sus' and list_contains(hijack_types, 2) and not s.is_recurrent and not is_local and s.observed_at > timestamp '2025-03-05' and s.observed_at < timestamp '2025-03-28'"))
def ref_q01_hijacks(spark: SparkSession, d: str) -> DataFrame:
    """Suspicious type-2 inferences of a period that neither recur nor are local."""
    return _hits(spark, d, classification="sus", hijack_type=2, is_recurrent="false", is_local=False, after="2025-03-05", before="2025-03-28")


@R.query(SQL_HITS.format("(s.asn1 in (504162, 820028) or s.asn2 in (504162, 820028)) and list_has_any(attackers, [504162, 896633])"))
def ref_q02_by_asn(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, asn=[504162, "820028"], attackers=[504162, 896633])


@R.query(
    SQL_HITS.format(
        "n.prefix like '%.%' and split_part(n.prefix, '/', 2)::int >= 5 and (string_split(split_part(n.prefix, '/', 1), '.')[1]::int & 248) = 248"
    )
)
def ref_q05_more_specific(spark: SparkSession, d: str) -> DataFrame:
    """Inferences with links for prefixes inside 248.0.0.0/5 (Q05)."""
    return _hits(spark, d, prefix=["248.0.0.0/5"], match="more_specific")


@R.query(SQL_HITS.format("n.peer_asn in (680977, 724823) and list_contains(regexp_extract_all(coalesce(n.as_path, ''), '[0-9]+'), '820028') and list_contains(list_transform(regexp_extract_all(coalesce(n.as_path, ''), '\\{[^}]*\\}?|[0-9]+'), lambda t: regexp_extract(t, '[0-9]+')), '820028')"))
def ref_q08_path_contains(spark: SparkSession, d: str) -> DataFrame:
    """Links seen by given observers over a given AS, wherever it stands on the path (Q06, Q08)."""
    return _hits(spark, d, peer_asns=[680977, 724823], path_contains=[820028])


@R.query(
    """select id, observed_at, asn1, asn2, case classification when 'leg' then 'legitimate' when 'sus' then 'suspicious' else 'unknown' end as result, confidence_level, num_paths,
      array_to_string(attackers, ' ') as attackers, array_to_string(victims, ' ') as victims, is_recurrent
    from inference_summary where cast(observed_at as date) between date '2025-03-03' and date '2025-03-20' and confidence_level >= 1 and num_paths between 2 and 100"""
)
def ref_q09_new_links(spark: SparkSession, d: str) -> DataFrame:
    found = api.new_links(table(spark, d, "inference_summary"), start="2025-03-03", stop="2025-03-20", min_confidence=1, min_paths=2, max_paths=100)
    return found.withColumns({c: paths.joined(F.col(c)) for c in ("attackers", "victims")})


@R.query(
    """select s.id, count(*) as n, max(n.observed_at) as latest, case classification when 'leg' then 'legitimate' else 'suspicious' end as verdict,
      case when is_origin_rpki_valid then 'RPKI valid' when not is_origin_rpki_valid and not is_local then 'RPKI invalid,Origin invalid' when not is_origin_rpki_valid then 'RPKI invalid' else '' end as prefix_tags
    from inference_summary s join new_link n on n.inference_id = s.id group by s.id, classification, is_origin_rpki_valid, is_local"""
)
def ref_q10_details(spark: SparkSession, d: str) -> DataFrame:
    """Details of all inferences, read off the nested result."""
    found = api.inference_details(table(spark, d, "inference_summary"), table(spark, d, "new_link"))
    x = F.get("details", F.lit(0))
    return found.select("id", F.size("details").cast("bigint").alias("n"), F.array_max(F.col("details.observed_at")).alias("latest"), x["verdict"].alias("verdict"), F.array_join(x["prefix_tags"], ",").alias("prefix_tags"))


@R.query("select id, observed_at from inference_summary where id is not null order by observed_at desc, id desc limit 50 offset 50")
def ref_q11_second_page(spark: SparkSession, d: str) -> DataFrame:
    return api.page(api.complete_rows(table(spark, d, "inference_summary"), ["id"]), 2).select("id", "observed_at")
