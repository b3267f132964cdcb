"""The query interface: every filter of the service as a column predicate, results as DataFrames."""

from __future__ import annotations

import ipaddress
import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwarden.functions import paths, prefixes
from hopwarden.operators.verdict import agreement

#: Largest AS number + 1, longest lists of ASNs and of ids, rows of a page.
ASN_END, MOST_ASNS, MOST_IDS, PAGE = 4294967296, 10, 100, 50
CLASSES = ("leg", "sus")
MATCHES = ("exact", "more_specific", "less_specific")


# --- validation: driver side, ValueError on what the service would refuse ---------------------------------------------


def asns(values: list[int | str] | None, most: int = MOST_ASNS) -> list[int] | None:
    if values is None:
        return None
    if len(values) > most:
        raise ValueError(f"at most {most} AS numbers")
    out = []
    for v in values:
        if not str(v).isdigit() or not 0 <= int(v) < ASN_END:
            raise ValueError(f"not an AS number: {v!r}")
        out.append(int(v))
    return out


def boolean(value: bool | str | None) -> bool | None:
    if value is None or isinstance(value, bool):
        return value
    if str(value).lower() in ("true", "false"):
        return str(value).lower() == "true"
    raise ValueError(f"not a boolean: {value!r}")


def prefix_list(values: list[str] | None) -> list[str] | None:
    return values and [str(ipaddress.ip_network(v)) for v in values]


def ip_list(values: list[str] | None) -> list[str] | None:
    return values and [str(ipaddress.ip_address(v)) for v in values]


def day(value: str | date | datetime | None) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    return datetime.fromisoformat(str(value))


def one_of(value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{value!r} is none of {allowed}")
    return value


def legitimacy(classification: Column) -> Column:
    return F.when(classification == "leg", "legitimate").when(classification == "sus", "suspicious").otherwise("unknown")


def prefix_match(column: Column, wanted: list[str], how: str) -> Column:
    """Whether a prefix equals, lies in or covers any of the wanted ones."""
    if how == "exact":
        return column.isin(wanted)
    own, hits = prefixes.parsed(column), []
    for w in wanted:
        other = prefixes.parsed(F.lit(w))
        hits.append(prefixes.covers(other, own) if how == "more_specific" else prefixes.covers(own, other))
    return F.coalesce(~agreement(*[~F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False))


# --- queries ----------------------------------------------------------------------------------------------------------


def forged_origin_hijacks(
    summary: DataFrame,
    new_link: DataFrame,
    *,
    asn: list | None = None,
    attackers: list | None = None,
    victims: list | None = None,
    classification: str | None = None,
    hijack_type: int | None = None,
    is_origin_rpki_valid: bool | str | None = None,
    is_recurrent: bool | str | None = None,
    is_local: bool | str | None = None,
    prefix: list[str] | None = None,
    match: str = "exact",
    peer_ips: list[str] | None = None,
    peer_asns: list | None = None,
    before: str | None = None,
    after: str | None = None,
    path_contains: list | None = None,
) -> DataFrame:
    """Inferences with their new links under all given filters.

    Result: id, observed_at, link ("a b"), num_paths, classification, confidence, new_links (JSON array ordered by id).
    Filters of new links keep an inference if any of its links passes, and only those links. Filters are applied on
    each side before the join.
    """
    one_of(classification, CLASSES)
    one_of(match, MATCHES)
    on_summary, on_link = [], []
    if asn is not None:
        listed = asns(asn)
        on_summary.append(F.col("asn1").isin(listed) | F.col("asn2").isin(listed))
    for name, given in (("attackers", attackers), ("victims", victims)):
        if given is not None:
            on_summary.append(F.arrays_overlap(name, F.lit(asns(given)).cast("array<bigint>")))
    if classification is not None:
        on_summary.append(F.col("classification") == classification)
    if hijack_type is not None:
        on_summary.append(F.array_contains("hijack_types", int(hijack_type)))
    for name, given in (("is_origin_rpki_valid", is_origin_rpki_valid), ("is_recurrent", is_recurrent), ("is_local", is_local)):
        if given is not None:
            on_summary.append(F.col(name) == boolean(given))
    if before is not None:
        on_summary.append(F.col("observed_at") < F.lit(day(before)).cast("timestamp_ntz"))
    if after is not None:
        on_summary.append(F.col("observed_at") > F.lit(day(after)).cast("timestamp_ntz"))
    if prefix is not None:
        on_link.append(prefix_match(F.col("prefix"), prefix_list(prefix), match))
    if peer_ips is not None:
        on_link.append(F.col("peer_ip").isin(ip_list(peer_ips)))
    if peer_asns is not None:
        on_link.append(F.col("peer_asn").isin(asns(peer_asns)))
    if path_contains is not None:
        on_link += [F.array_contains(paths.hops(F.col("as_path")), F.lit(a).cast("bigint")) for a in asns(path_contains)]
    found = summary.filter(agreement(*on_summary)).select(
        "id", "observed_at", F.concat_ws(" ", "asn1", "asn2").alias("link"), "num_paths", "classification", F.col("num_susp_inf").alias("confidence")
    )
    links = new_link.filter(agreement(*on_link)).filter("inference_id is not null")
    links = links.select(
        F.col("inference_id").alias("id"), F.struct(F.col("id").alias("link_id"), "as_path", "prefix", "peer_ip", "peer_asn").alias("x")
    )
    return (
        found.join(links, "id")
        .groupBy(*found.columns)
        .agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("new_links"))
    )


def new_links(
    summary: DataFrame,
    *,
    asn: list | None = None,
    attackers: list | None = None,
    victims: list | None = None,
    result: str | None = None,
    min_confidence: int | None = None,
    min_paths: int | None = None,
    max_paths: int | None = None,
    start: str | date | None = None,
    stop: str | date | None = None,
    ids: list | None = None,
) -> DataFrame:
    """Summary rows under the filters; start and stop are closed days, today and start if not given (unless ids are)."""
    one_of(result, CLASSES)
    where = []
    if ids is not None:
        where.append(F.col("id").isin(asns(ids, MOST_IDS)))
    else:
        first = day(start) or datetime.combine(date.today(), datetime.min.time())
        last = day(stop) or first
        where.append(F.to_date("observed_at").between(F.lit(first.date()), F.lit(last.date())))
    if asn is not None:
        where.append(F.col("asn1").isin(asns(asn)) | F.col("asn2").isin(asns(asn)))
    for name, given in (("attackers", attackers), ("victims", victims)):
        if given is not None:
            where.append(F.arrays_overlap(name, F.lit(asns(given)).cast("array<bigint>")))
    if result is not None:
        where.append(F.col("classification") == result)
    for column, op, given in (("confidence_level", "ge", min_confidence), ("num_paths", "ge", min_paths), ("num_paths", "le", max_paths)):
        if given is not None:
            where.append(F.col(column) >= int(given) if op == "ge" else F.col(column) <= int(given))
    return summary.filter(agreement(*where)).select(
        "id", "observed_at", "asn1", "asn2", legitimacy(F.col("classification")).alias("result"), "confidence_level", "num_paths", "attackers", "victims", "is_recurrent"
    )


def inference_details(summary: DataFrame, new_link: DataFrame, ids: list | None = None) -> DataFrame:
    """(id, details): per inference its sightings, ordered by id, with verdict, confidence, path and prefix tags."""
    chosen = summary if ids is None else summary.filter(F.col("id").isin(asns(ids, MOST_IDS)))
    rpki = F.when(F.col("is_origin_rpki_valid"), "RPKI valid").when(~F.col("is_origin_rpki_valid"), "RPKI invalid")
    invalid = F.when(~F.col("is_local") & ~F.col("is_origin_rpki_valid"), "Origin invalid")
    facts = chosen.select(
        F.col("id").alias("inference_id"),
        legitimacy(F.col("classification")).alias("verdict"),
        F.col("confidence_level").alias("confidence"),
        F.array_compact(F.array(F.when(F.col("is_recurrent"), "Recurrent"), F.when(F.col("is_local"), "Local"))).alias("path_tags"),
        F.array_compact(F.array(rpki, invalid)).alias("prefix_tags"),
    )
    rows = new_link.join(facts, "inference_id")
    x = F.struct(F.col("id").alias("link_id"), "observed_at", "asn1", "asn2", "peer_asn", "peer_ip", "as_path", "prefix", "verdict", "confidence", "path_tags", "prefix_tags")
    return rows.groupBy(F.col("inference_id").alias("id")).agg(F.array_sort(F.collect_list(x)).alias("details"))


def page(df: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of the rows, newest first (ties by descending id); pages count from 1."""
    return df.orderBy(F.desc("observed_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def pages(rows: int, size: int = PAGE) -> int:
    return math.ceil(rows / size)


def complete_rows(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)
