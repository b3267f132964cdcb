"""Queries of the problems of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions.packed import canonical_path
from hopwarden.llm import bpe, distinct, duplicates, frequent, mixing, truncation
from hopwarden.plans.registry import Registry
from hopwarden.session import cut_lineage, table

R = Registry()

DISTINCT_ERROR = 0.01
FREQUENT_SHARE = 0.005
TOP = 20

#: Levels by DuckDB's number of grouping(day, peer_asn, is_recurrent), each with the bits its largest group needs.
SQL_BITMAPS = f"""
      with keyed as (select cast(observed_at as date) as day, peer_asn, is_recurrent,
                       ('0x' || substr(md5(prefix), 1, 15))::bigint as h1, ('0x' || substr(md5(as_path), 1, 15))::bigint as h2 from new_link),
      level as (select grouping_set, max(n) as n from (select grouping(day, peer_asn, is_recurrent) as grouping_set, count(*) as n
                 from keyed group by cube (day, peer_asn, is_recurrent)) group by grouping_set),
      bits as (select grouping_set, min(m) as m from (select 1::bigint << i as m from range(6, 50) t(i)), level
               where n = 0 or (n <= {distinct.FULLEST} * m and sqrt(m * (exp(n::double / m) - n::double / m - 1)) / n <= {DISTINCT_ERROR}) group by grouping_set),
      sets as (select grouping_set, m, if(grouping_set & 4 = 0, day, null) as day, if(grouping_set & 2 = 0, peer_asn, null) as peer_asn,
                 if(grouping_set & 1 = 0, is_recurrent, null) as is_recurrent, count(distinct h1 % m) as ones1, count(distinct h2 % m) as ones2
               from keyed, bits group by all)"""


def _sql_estimates(where: str) -> str:
    err = "case when n_{0} > 0 then round(sqrt(m * (exp(n_{0}::double / m) - n_{0}::double / m - 1)) / n_{0}, 6) else 0.0 end as err_{0}"
    return f"""
    select grouping_set, day, peer_asn, is_recurrent, n_prefix, {err.format("prefix")}, n_as_path, {err.format("as_path")} from (
      {SQL_BITMAPS}
      select grouping_set, day, peer_asn, is_recurrent, m,
             cast(round(-m * ln((m - ones1)::double / m)) as bigint) as n_prefix,
             cast(round(-m * ln((m - ones2)::double / m)) as bigint) as n_as_path
      from sets where {where})"""


def _day() -> dict[str, Column]:
    return {"day": F.to_date("observed_at"), "peer_asn": F.col("peer_asn"), "is_recurrent": F.col("is_recurrent")}


def _identifiers() -> dict[str, Column]:
    return {"prefix": F.col("prefix"), "as_path": F.col("as_path")}


@R.query(_sql_estimates("true"))
def p1_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct prefixes and paths per day, observer, recurrence and every combination, from bitmaps."""
    links = table(spark, d, "new_link")
    m = distinct.level_bits(links, _day(), DISTINCT_ERROR)
    partials = distinct.bitmaps(links, _day(), _identifiers(), m)
    return distinct.estimates(partials, list(_day()), list(_identifiers()), m)


@R.query(_sql_estimates("grouping_set = 3"))
def p1_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same per day, from partial results of the recurrent and the other links joined afterwards."""
    links = table(spark, d, "new_link")
    day = {"day": F.to_date("observed_at")}
    m = {0: distinct.level_bits(links, day, DISTINCT_ERROR)[0]}
    parts = [
        distinct.bitmaps(links.filter(where), day, _identifiers(), m)
        for where in ("is_recurrent", "not is_recurrent or is_recurrent is null")
    ]
    found = distinct.estimates(distinct.merge_bitmaps(*parts, m=m), ["day"], list(_identifiers()), m)
    return found.select(
        F.lit(3).cast("bigint").alias("grouping_set"),
        "day",
        F.lit(None).cast("bigint").alias("peer_asn"),
        F.lit(None).cast("boolean").alias("is_recurrent"),
        "n_prefix",
        "err_prefix",
        "n_as_path",
        "err_as_path",
    )


@R.query(
    f"""
    select field_name, item from (
      select 'prefix' as field_name, prefix as item, count(*) as n from new_link where prefix is not null group by prefix
      union all select 'peer_asn', cast(peer_asn as varchar), count(*) from new_link where peer_asn is not null group by peer_asn)
    where n >= {FREQUENT_SHARE} * (select count(*) from new_link)"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_items(table(spark, d, "new_link"), ["prefix", "peer_asn"], FREQUENT_SHARE).select("field_name", "item")


@R.query()
def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent prefixes and observers with the sketch's approximate counts."""
    return frequent.top_items(table(spark, d, "new_link"), ["prefix", "peer_asn"], TOP)


def _sighting() -> list[Column]:
    return [
        duplicates.unordered(F.col("asn1"), F.col("asn2")),
        canonical_path(F.col("as_path")),
        F.col("observed_at"),
        F.col("prefix"),
        F.col("peer_ip"),
        F.col("peer_asn"),
    ]


SQL_SIGHTINGS = r"""
      select id, min(id) over w as first_id, count(*) over w as copies from (
        select id, least(asn1, asn2) as a, greatest(asn1, asn2) as b, observed_at, prefix, peer_ip, peer_asn,
          array_to_string(list_transform(regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+'), lambda t:
            case when t like '{%' then '{' || array_to_string(list_sort(list_distinct(
              regexp_extract_all(t, '[0-9]+')::bigint[])), ',') || '}' else t::bigint::varchar end), ' ') as hops
        from new_link)
      window w as (partition by a, b, observed_at, prefix, peer_ip, peer_asn, hops)"""


@R.query(f"select first_id, id as copy_id from ({SQL_SIGHTINGS}) where id <> first_id")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(table(spark, d, "new_link"), "id", _sighting())


@R.query(f"select first_id, copies from ({SQL_SIGHTINGS}) where id = first_id")
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per sighting with its number of copies."""
    return duplicates.collapse(table(spark, d, "new_link"), "id", _sighting())


@R.query(
    """select min(id) as first_id, count(*) as copies from new_link
       group by least(asn1, asn2), greatest(asn1, asn2), asn1 is null or asn2 is null"""
)
def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """One record per link, its ends in either order, with its number of sightings: a few links are hot keys."""
    return duplicates.collapse(table(spark, d, "new_link"), "id", [duplicates.unordered(F.col("asn1"), F.col("asn2"))])


@R.query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), ["doc_id"])


@R.query("select doc_id, true as same from documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded and decoded again: whether each comes back as it was (null as the empty text)."""
    documents = table(spark, d, "documents")
    ids = bpe.encode(documents.select("doc_id", "text", F.col("text").alias("was")), ["doc_id", "was"])
    back = bpe.decode_ids(ids, ["doc_id", "was"])
    return back.select("doc_id", (F.col("text") == F.coalesce("was", F.lit(""))).alias("same"))


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once to the shared folder: the mix reads it several times."""
    return cut_lineage(bpe.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]))


@R.query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents to use and how often, so that the sources reach their target shares of all tokens."""
    return mixing.mix(_token_sizes(spark, d), table(spark, d, "mix_target"))


@R.query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _token_sizes(spark, d), table(spark, d, "mix_target")
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


@R.query(
    """with w as (select source, sum(weight) as weight, min(max_repeats) as max_repeats from mix_target where source is not null group by source),
      n as (select source, count(*) as n_docs from documents where text <> '' group by source)
    select w.source, round(weight / sum(weight) over (), 6) as target_share, max_repeats, coalesce(n_docs, 0) as n_docs,
      round(case when n_docs > 0 and weight > 0 and max_repeats > 0 then weight / sum(case when n_docs > 0 and weight > 0 and max_repeats > 0 then weight end) over () else 0 end, 6) as reachable_share
    from w left join n on w.source = n.source"""
)
def p8_wishes(spark: SparkSession, d: str) -> DataFrame:
    """Per named source the share asked for, its cap and documents, and the share it can have beside the sources without documents."""
    wishes = mixing.plan(_token_sizes(spark, d), table(spark, d, "mix_target"))
    return wishes.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", "n_docs", F.round("reachable_share", 6).alias("reachable_share"))


@R.query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).filter("cut").select("doc_id")


@R.query()
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.truncation_report(table(spark, d, "documents"))
