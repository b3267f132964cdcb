"""Queries of the general data-pipeline problems (3, 4 and 6), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwarden.functions.packed import Packing, explode_packed, explode_path
from hopwarden.operators.eager import WIDE, eager_join_aggregate, hot_keys, stack_fields
from hopwarden.operators.snapshots import snapshot_changes
from hopwarden.plans.registry import Registry
from hopwarden.session import table

R = Registry()

HOT_SHARE = 0.02


def _whole(*names: str) -> list[Column]:
    """Decimals as the bigints of the tables; what does not fit is an error, never a wrong number."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


#: DuckDB: the positions of a path as texts, a set in braces being one of them.
SQL_POSITIONS = r"regexp_extract_all(coalesce(as_path, ''), '\{[^}]*\}?|[0-9]+')"


@R.query(
    f"""
    select field_name, asn from (
      select 'asn1' as field_name, asn1 as asn, count(*) as n from new_link where asn1 is not null group by asn1
      union all select 'asn2', asn2, count(*) from new_link where asn2 is not null group by asn2
      union all select 'peer_asn', peer_asn, count(*) from new_link where peer_asn is not null group by peer_asn)
    where n >= {HOT_SHARE} * (select count(*) from new_link)"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys(table(spark, d, "new_link"), ["asn1", "asn2", "peer_asn"], HOT_SHARE).select("field_name", "asn")


@R.query(
    """
    select n.asn1 as asn, n.is_recurrent, count(*) as n_pairs, count(distinct n.id) as n_left,
           cast(sum(n.peer_asn) as bigint) as sum_peer, cast(sum(u.as2) as bigint) as sum_far
    from new_link n join updates_links u on n.asn1 = u.as1 group by n.asn1, n.is_recurrent"""
)
def p3_pairs_updates(spark: SparkSession, d: str) -> DataFrame:
    """New links joined to the daily links of the same near AS: pairs and sums per AS, never the pairs themselves."""
    out = eager_join_aggregate(
        table(spark, d, "new_link"),
        table(spark, d, "updates_links"),
        {"asn": (F.col("asn1"), F.col("as1"))},
        left_by={"is_recurrent": F.col("is_recurrent")},
        left_sums={"sum_peer": F.col("peer_asn")},
        right_sums={"sum_far": F.col("as2")},
    )
    return out.select("asn", "is_recurrent", *_whole("n_pairs"), "n_left", *_whole("sum_peer", "sum_far"))


@R.query(
    """
    select n.peer_asn as asn, count(*) as n_pairs, count(x.asn) as n_matched, cast(sum(x.speed) as bigint) as sum_speed
    from new_link n left join netixlan x on n.peer_asn = x.asn group by n.peer_asn"""
)
def p3_pairs_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Observers joined to their exchange ports (left join): pairs and the speed over all pairs per observer."""
    out = eager_join_aggregate(
        table(spark, d, "new_link"),
        table(spark, d, "netixlan"),
        {"asn": (F.col("peer_asn"), F.col("asn"))},
        right_sums={"sum_speed": F.col("speed")},
        how="left",
    )
    matched = F.col("n_left").cast(WIDE) * F.col("n_right").cast(WIDE)
    return out.select("asn", *_whole("n_pairs"), matched.cast("bigint").alias("n_matched"), *_whole("sum_speed"))


NEAR_FIELDS = ["asn1", "asn2", "peer_asn"]


@R.query(
    " union all ".join(
        f"""select '{f}' as field_name, n.asn, n.n_rows, n.n_recurrent, n.n_rows * coalesce(u.n, 0) as n_pairs, cast(n.n_rows * u.far as bigint) as sum_far
        from (select {f} as asn, count(*) as n_rows, cast(sum(is_recurrent::int) as bigint) as n_recurrent from new_link where {f} is not null group by {f}) n
        left join (select as1, count(*) as n, sum(as2) as far from updates_links group by as1) u on n.asn = u.as1"""
        for f in NEAR_FIELDS
    )
)
def p3_per_asn(spark: SparkSession, d: str) -> DataFrame:
    """Per ASN of asn1, of asn2 and of peer_asn: rows, recurrent rows, and pairs with the daily links of that AS and their far ends' sum."""
    rows = stack_fields(table(spark, d, "new_link"), NEAR_FIELDS, "field_name", "asn", keep={"r": F.col("is_recurrent").cast("int")})
    out = eager_join_aggregate(
        rows.filter("asn is not null"),
        table(spark, d, "updates_links"),
        {"asn": (F.col("asn"), F.col("as1"))},
        left_by={"field_name": F.col("field_name")},
        left_sums={"n_recurrent": F.col("r")},
        right_sums={"sum_far": F.col("as2")},
        how="left",
    )
    recurrent = F.expr("cast(n_recurrent div greatest(n_right, 1) as bigint)").alias("n_recurrent")  # the sum over pairs counts a row once per match
    pairs = (F.col("n_left").cast(WIDE) * F.col("n_right").cast(WIDE)).cast("bigint").alias("n_pairs")
    return out.select("field_name", "asn", F.col("n_left").alias("n_rows"), recurrent, pairs, *_whole("sum_far"))


def _changes_sql(src: str, asn: str, place: str, attributes: str) -> str:
    pick = ", ".join(f"arg_max(struct_pack(v := {a}), updated_at).v as {a}" for a in attributes.split(","))
    differ = " or ".join(f"o.{a} is distinct from n.{a}" for a in attributes.split(","))
    return f"""
    select '{src}' as src_table, strftime(snapshot_day, '%Y-%m-%d') as snapshot_day, asn, place_id, change_kind from (
      with days as (select snapshot_day as d, lead(snapshot_day) over (order by snapshot_day) as after
                    from (select distinct snapshot_day from {src})),
      rec as (select snapshot_day, {asn} as asn, {place} as place_id, {pick} from {src}
              where {asn} is not null and {place} is not null group by all),
      o as (select days.after as pair, rec.* from rec join days on rec.snapshot_day = days.d where days.after is not null),
      n as (select rec.* from rec where snapshot_day > (select min(d) from days))
      select coalesce(o.pair, n.snapshot_day) as snapshot_day, coalesce(o.asn, n.asn) as asn,
             coalesce(o.place_id, n.place_id) as place_id,
             case when o.asn is null then 'added' when n.asn is null then 'removed'
                  when {differ} then 'changed' end as change_kind
      from o full join n on o.pair = n.snapshot_day and o.asn = n.asn and o.place_id = n.place_id)
    where change_kind is not null"""


@R.query(
    _changes_sql("netfac", "local_asn", "fac_id", "fac_name,country,city")
    + " union all "
    + _changes_sql("netixlan", "asn", "ix_id", "ix_name,speed")
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for src, asn, place, attributes in (
        ("netfac", "local_asn", "fac_id", ["fac_name", "country", "city"]),
        ("netixlan", "asn", "ix_id", ["ix_name", "speed"]),
    ):
        changes = snapshot_changes(table(spark, d, src), "snapshot_day", {"asn": asn, "place_id": place}, attributes, "updated_at")
        parts.append(
            changes.select(
                F.lit(src).alias("src_table"),
                F.date_format("snapshot_day", "yyyy-MM-dd").alias("snapshot_day"),
                "asn",
                "place_id",
                "change_kind",
            )
        )
    return parts[0].unionByName(parts[1])


@R.query(
    f"""
    select id, cast(pos as int) as pos, cast(unnest(regexp_extract_all(piece, '[0-9]+')) as bigint) as hop from (
      select id, unnest(p) as piece, unnest(range(1, len(p) + 1)) as pos
      from (select id, {SQL_POSITIONS} as p from new_link))"""
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_path(table(spark, d, "new_link"), "as_path", ("id",))


_PLACE = ("fac_name", "city", "country")


@R.query(
    """
    select distinct local_asn, fac_id, cast(row_number() over (partition by k order by i) as int) as pos, value from (
      select local_asn, fac_id, snapshot_day, updated_at, unnest([1, 2, 3]) as i, unnest([trim(replace(fac_name, '"', '')), trim(replace(city, '"', '')), country]) as value,
        local_asn || ' ' || fac_id || ' ' || rowid as k from (select *, row_number() over () as rowid from netfac) where local_asn is not null and fac_id is not null)
    where value is not null and value <> ''"""
)
def p6_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Names and cities as quoted literals that hold delimiters, the country bare, packed into one field and split again."""
    quoted = [F.concat(F.lit('"'), F.trim(F.replace(F.col(c), F.lit('"'), F.lit(""))), F.lit('"')) for c in _PLACE[:2]]
    rows = table(spark, d, "netfac").filter("local_asn is not null and fac_id is not null")
    packed = rows.select("local_asn", "fac_id", F.concat_ws(" ;", *quoted, F.col("country")).alias("packed"))
    return explode_packed(packed, "packed", ["local_asn", "fac_id"], Packing(quotes='["]')).distinct()
