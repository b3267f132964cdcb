"""The daily job: from a day's updates and sightings to the result tables of that day."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwarden.functions import paths
from hopwarden.operators import newedge, topology, verdict
from hopwarden.schemas import conformed
from hopwarden.session import cut_lineage, once
from hopwarden.sources.readers import write_day

LINK = ["as1", "as2"]


def with_paths(rows: DataFrame) -> DataFrame:
    """Sightings (asn1, asn2, as_path, ...) with as1 < as2, `hops` and the collapsed `path`; a null end is no link."""
    known = rows.filter("asn1 is not null and asn2 is not null").withColumn("hops", once(paths.hops(F.col("as_path"))))
    return known.withColumn("path", once(paths.collapse(F.col("hops")))).withColumns({"as1": F.least("asn1", "asn2"), "as2": F.greatest("asn1", "asn2")})


def recurrent(rows: DataFrame) -> DataFrame:
    """(as1, as2, is_recurrent): whether any sighting of the link is of a link once judged suspicious; null if none tells."""
    return rows.groupBy(*LINK).agg(F.bool_or("is_recurrent").alias("is_recurrent"))


def summary(rows: DataFrame, votes: DataFrame, roas: DataFrame) -> DataFrame:
    """A row per judged link: its verdict with tags, origin validity and recurrence.

    rows: with_paths of the day's sightings; votes: verdict.votes of the models' labels. A link without a readable prefix
    has a null validity.
    """
    tags = verdict.tags(rows.select(*LINK, "path", "peer_asn")).drop("peers")
    origins = rows.select(*LINK, paths.victim(F.col("hops")).alias("origin"), "prefix").distinct()
    valid = verdict.link_validity(origins, verdict.origin_validity(origins, verdict.deduplicated_roas(roas)))
    return verdict.verdicts(votes).join(tags, LINK, "left").join(valid, LINK, "left").join(recurrent(rows), LINK, "left")


def new_links_of_day(updates: DataFrame, ribs: DataFrame, verdicts: DataFrame, day: date) -> DataFrame:
    """(as1, as2, vp_ip): links of the day that the history before it, less the links in quarantine, did not have."""
    before = verdicts.filter((F.col("day") >= F.date_sub(F.lit(day), newedge.HISTORY_DAYS)) & (F.col("day") < F.lit(day)))
    baseline = topology.sliding_union(updates, ribs, F.date_sub(F.lit(day), 1), newedge.HISTORY_DAYS)
    return topology.new_links(updates.filter(F.col("obs_date") == F.lit(day)), baseline, newedge.quarantined(newedge.ledger(before), day))


def run_day(
    updates: DataFrame,
    ribs: DataFrame,
    verdicts: DataFrame,
    sightings: DataFrame,
    roas: DataFrame,
    day: date,
    classify: Callable[[DataFrame], DataFrame],
    root: str,
) -> None:
    """Find the day's new links, judge their sightings and replace that day in the three result tables below `root`.

    sightings: rows like new_link without inference_id, of any days and links; those of the day's new links are judged.
    classify: with_paths rows -> (as1, as2, sensitivity, label), a row per path and model. A day run twice is the same.
    """
    fresh = new_links_of_day(updates, ribs, verdicts, day).select(F.least(*LINK).alias("as1"), F.greatest(*LINK).alias("as2")).distinct()
    rows = cut_lineage(with_paths(sightings.filter(F.to_date("observed_at") == F.lit(day))).join(fresh, LINK, "left_semi"))
    votes = cut_lineage(verdict.votes(classify(rows)))
    base = F.datediff(F.lit(day), F.lit("1970-01-01").cast("date")).cast("bigint") * (1 << 40)  # ids of a day are its own
    judged = summary(rows, votes, roas).withColumn("id", base + F.monotonically_increasing_id())
    seen = rows.groupBy(*LINK).agg(F.max("observed_at").cast("timestamp").alias("observed_at"))
    judged = cut_lineage(judged.join(seen, LINK).withColumn("day", F.lit(day)))
    ids = judged.select(*LINK, F.col("id").alias("inference_id"))
    tables = {
        "inference_summary": judged.withColumnsRenamed({"as1": "asn1", "as2": "asn2"}),
        "inference_details": votes.join(ids, LINK).select(
            F.lit(day).alias("day"), "inference_id", F.col("sensitivity").alias("model_id"), F.col("n_legit").alias("num_legit_paths"), F.col("n_susp").alias("num_susp_paths")
        ),
        "new_link": rows.join(ids, LINK, "left").drop(*LINK, "hops", "path").withColumn("day", F.lit(day)),
    }
    for name, df in tables.items():
        write_day(conformed(df, name), f"{root}/{name}", "day")
