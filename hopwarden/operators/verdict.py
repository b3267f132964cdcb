"""From labels per path and model to verdicts per link, with tags; origin validity by covering prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwarden.functions import paths, prefixes
from hopwarden.operators.skew import attach
from hopwarden.session import once

LINK = ["as1", "as2"]


def votes(labels: DataFrame) -> DataFrame:
    """(as1, as2, sensitivity, n_legit, n_susp): labels 0 (legitimate) and 1 per link and model."""
    n = lambda v: F.sum((F.col("label") == v).cast("bigint"))
    return labels.groupBy(*LINK, "sensitivity").agg(n(0).alias("n_legit"), n(1).alias("n_susp"))


def verdicts(votes_: DataFrame) -> DataFrame:
    """Per link: num_legit_inf, num_susp_inf, classification, confidence_level, num_paths.

    A model calls a link legitimate only with a strict majority of its paths. The link is suspicious if any model says
    so; its confidence is the highest sensitivity with at least one suspicious path, 0 if there is none.
    """
    legit = F.col("n_legit") > F.col("n_susp")
    found = votes_.groupBy(*LINK).agg(
        F.sum(legit.cast("int")).cast("int").alias("num_legit_inf"),
        F.sum((~legit).cast("int")).cast("int").alias("num_susp_inf"),
        F.coalesce(F.max(F.when(F.col("n_susp") > 0, F.col("sensitivity"))), F.lit(0)).cast("int").alias("confidence_level"),
        F.max(F.col("n_legit") + F.col("n_susp")).alias("num_paths"),
    )
    return found.withColumn("classification", F.when(F.col("num_susp_inf") > 0, "sus").otherwise("leg"))


def tags(rows: DataFrame) -> DataFrame:
    """Per link the ascending sets of attackers, victims, hijack types and observers, and whether it is local.

    rows: (as1, as2, path array<bigint>, peer_asn). Local: a single attacker that is the single observer.
    """
    p, a, b = F.col("path"), F.col("as1"), F.col("as2")
    found = rows.groupBy(*LINK).agg(
        F.sort_array(F.collect_set(paths.attacker(p, a, b))).alias("attackers"),
        F.sort_array(F.collect_set(paths.victim(p))).alias("victims"),
        F.sort_array(F.collect_set(paths.hijack_type(p, a, b))).alias("hijack_types"),
        F.sort_array(F.collect_set("peer_asn")).alias("peers"),
    )
    local = (F.size("attackers") == 1) & (F.size("peers") == 1) & (F.col("attackers") == F.col("peers"))
    return found.withColumn("is_local", local)


def deduplicated_roas(roas: DataFrame) -> DataFrame:
    """(asn, prefix, max_length): one row per authorisation, its longest length (null if none is known)."""
    return roas.filter("asn is not null and prefix is not null").groupBy("asn", "prefix").agg(F.max("max_length").alias("max_length"))


def origin_validity(announced: DataFrame, roas: DataFrame, rfc6811: bool = False) -> DataFrame:
    """(origin, prefix, valid) of distinct announced pairs.

    Default: if an authorisation for exactly the prefix exists, valid means that one of them names the origin; else any
    covering one may. Nothing found is invalid, maximal lengths play no part. With rfc6811 a covering authorisation of
    the origin must also allow the length. A prefix meets its shorter ones by equality, so no ranges are compared; the
    authorisations of a prefix are one row, broadcast up to a counted size, else looked up with hot ones split. Prefixes that
    cannot be read have valid false.
    """
    pairs = announced.filter("origin is not null and prefix is not null").select("origin", "prefix").distinct()
    known = roas.select(F.col("asn").alias("__asn"), "max_length", once(prefixes.parsed(F.col("prefix"))).alias("k")).filter("k is not null")
    wide = pairs.withColumn("p", once(prefixes.parsed(F.col("prefix")))).filter("p is not null")
    # only lengths that authorisations have: at most 33 + 129 of them, whatever the number of rows
    lengths = {(r.family, r.len) for r in known.select("k.family", "k.len").distinct().collect()}
    wide = wide.select("origin", "prefix", F.col("p.len").alias("__len"), F.explode(prefixes.ancestors(F.col("p"), lengths)).alias("k"))
    of_prefix = known.groupBy("k").agg(F.collect_set(F.struct(F.col("__asn").alias("asn"), "max_length")).alias("roas"))
    met = attach(wide, of_prefix, "k", 256)
    exact = F.col("k.len") == F.col("__len")
    own = F.exists("roas", lambda r: r["asn"] == F.col("origin"))
    allowed = F.exists("roas", lambda r: (r["asn"] == F.col("origin")) & (F.coalesce(r["max_length"], F.col("k.len")) >= F.col("__len")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    met = met.select("origin", "prefix", exact.alias("exact"), own.alias("own"), allowed.alias("allowed"))
    found = met.groupBy("origin", "prefix").agg(
        any_(F.col("exact")).alias("e"), any_(F.col("exact") & F.col("own")).alias("eo"), any_(F.col("own")).alias("co"), any_(F.col("allowed")).alias("ro")
    )
    valid = F.col("ro") if rfc6811 else F.when(F.col("e"), F.col("eo")).otherwise(F.col("co"))
    return pairs.join(found.select("origin", "prefix", valid.alias("valid")), ["origin", "prefix"], "left").select(
        "origin", "prefix", F.coalesce("valid", F.lit(False)).alias("valid")
    )


def exact_validity(announced: DataFrame, roas: DataFrame) -> DataFrame:
    """(origin, prefix, valid) of distinct announced pairs by the live rule: invalid only if exactly the prefix is authorised, but not for the origin."""
    pairs = announced.filter("origin is not null and prefix is not null").select("origin", "prefix").distinct()
    met = pairs.join(roas.filter("asn is not null").select("asn", "prefix").distinct(), "prefix", "left")
    return met.groupBy("origin", "prefix").agg(F.coalesce(F.bool_or(F.col("asn") == F.col("origin")), F.lit(True)).alias("valid"))


def link_validity(rows: DataFrame, validity: DataFrame) -> DataFrame:
    """(as1, as2, is_origin_rpki_valid): whether all announced pairs of the link are valid. rows: (as1, as2, origin, prefix)."""
    return rows.join(validity, ["origin", "prefix"]).groupBy(*LINK).agg(F.bool_and("valid").alias("is_origin_rpki_valid"))


def case_lines(verdicts_: DataFrame, votes_: DataFrame) -> DataFrame:
    """(as1, as2, line_no, line): the text form, a head line per link and a line per model."""
    head = F.format_string("!%s %d %d %d %d %d", "classification", "as1", "as2", "num_legit_inf", "num_susp_inf", "num_paths")
    model = F.format_string("%d %d %d %d %d", "as1", "as2", "sensitivity", "n_legit", "n_susp")
    return verdicts_.select(*LINK, F.lit(0).alias("line_no"), head.alias("line")).unionByName(
        votes_.select(*LINK, F.col("sensitivity").cast("int").alias("line_no"), model.alias("line"))
    )


def back_fill(rows: DataFrame, summary: DataFrame, day: Column) -> DataFrame:
    """New-link rows with inference_id of the summary of their link (either direction) and day; null if there is none."""
    ids = summary.select(F.least("asn1", "asn2").alias("__a"), F.greatest("asn1", "asn2").alias("__b"), F.to_date("observed_at").alias("__d"), F.col("id").alias("__id"))
    ids = ids.groupBy("__a", "__b", "__d").agg(F.min("__id").alias("__id"))
    keyed = rows.withColumns({"__a": F.least("asn1", "asn2"), "__b": F.greatest("asn1", "asn2"), "__d": day})
    return keyed.join(ids, ["__a", "__b", "__d"], "left").withColumn("inference_id", F.col("__id")).drop("__a", "__b", "__d", "__id")


def agreement(*filters: Column) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))
