"""Around new links: verdict ledger and quarantine, choice of observers, earliest sightings, watched paths."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.session import once

#: Observers wanted per link, days after which a suspicious link is let in again, days of history.
OBSERVERS, QUARANTINE_DAYS, HISTORY_DAYS = 10, 31, 300


def ledger(verdicts: DataFrame) -> DataFrame:
    """(as1, as2, since): links whose latest verdict is 'sus', since the first 'sus' after their last 'leg'.

    verdicts: (as1, as2, day, verdict). Of several verdicts of a day 'sus' counts as the later.
    """
    by = verdicts.groupBy("as1", "as2").agg(
        F.max(F.when(F.col("verdict") == "leg", F.col("day"))).alias("leg"),
        F.max(F.when(F.col("verdict") == "sus", F.col("day"))).alias("sus"),
        F.sort_array(F.collect_set(F.when(F.col("verdict") == "sus", F.col("day")))).alias("days"),  # one a day at most
    )
    open_ = by.filter(F.col("sus").isNotNull() & (F.col("leg").isNull() | (F.col("sus") >= F.col("leg"))))
    since = F.get(F.filter("days", lambda d: F.col("leg").isNull() | (d >= F.col("leg"))), F.lit(0))
    return open_.select("as1", "as2", since.alias("since"))


def quarantined(ledger_: DataFrame, day: date | Column) -> DataFrame:
    """Suspicious links that still stay out of the baseline on `day`."""
    return ledger_.filter(F.datediff(F.lit(day), F.col("since")) <= QUARANTINE_DAYS)


def of_active_observers(links: DataFrame, observers: DataFrame) -> DataFrame:
    """Links (..., vp_ip) of the observers (vp_ip, is_active) that are active; a link without an observer has none."""
    return links.join(observers.filter("is_active").select("vp_ip").distinct(), "vp_ip", "left_semi")


def choose_observers(links: DataFrame, wanted: int = OBSERVERS) -> DataFrame:
    """(vp_ip): observers to ask so that each link is covered by `wanted` of them, or by all it has.

    links: (as1, as2, vp_ip), direction ignored. All observers of links with at most `wanted` are taken; the others are
    ranked by the number of links that still need them (ties by address) and taken down to the last rank some link needs.
    """
    seen = links.filter("vp_ip is not null").select(F.least("as1", "as2").alias("a"), F.greatest("as1", "as2").alias("b"), "vp_ip").distinct()
    per_link = seen.withColumn("n", F.count("vp_ip").over(Window.partitionBy("a", "b")))
    first = per_link.filter(F.col("n") <= wanted).select("vp_ip").distinct()
    left = per_link.filter(F.col("n") > wanted).join(first.withColumn("have", F.lit(True)), "vp_ip", "left")
    short = left.withColumn("need", F.lit(wanted) - F.count("have").over(Window.partitionBy("a", "b"))).filter("need > 0 and have is null")
    ranks = short.groupBy("vp_ip").agg(F.count(F.lit(1)).alias("c"))
    ranks = ranks.select("vp_ip", F.row_number().over(Window.orderBy(F.desc("c"), "vp_ip")).alias("rank"))  # one row per observer
    placed = short.join(ranks, "vp_ip").withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("rank")))
    stop = placed.filter("place = need").agg(F.coalesce(F.max("rank"), F.lit(0)).alias("stop"))
    more = ranks.join(F.broadcast(stop)).filter("rank <= stop").select("vp_ip")
    return first.unionByName(more)


def earliest_sightings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (observed_at, peer_ip, prefix, peer_asn): the earliest sighting, ties by peer_ip then prefix.

    Null times count as latest; the minimum is map-side combined, so one hot link is no hot task.
    """
    order = F.struct(F.col("observed_at").isNull().alias("n"), "observed_at", "peer_ip", "prefix", "peer_asn")
    first = rows.groupBy(*keys).agg(F.min(order).alias("f"))
    return first.select(*keys, "f.observed_at", "f.peer_ip", "f.prefix", "f.peer_asn")


def touching_paths(paths: DataFrame, id_column: str, pairs: Column, watched: DataFrame) -> DataFrame:
    """Ids of the paths that run over a watched link in either direction. watched: (as1, as2) with as1 < as2."""
    links = paths.select(F.col(id_column), once(pairs).alias("__z")).select(id_column, F.inline("__z")).select(id_column, F.least("a", "b").alias("as1"), F.greatest("a", "b").alias("as2"))
    return links.join(watched, ["as1", "as2"], "left_semi").select(id_column).distinct()
