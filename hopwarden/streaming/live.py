"""The live path: flattening of update messages, new links against a static topology, buffering until confirmation.

A link first seen in one direction is buffered for BUFFER seconds from that sighting. If the other direction shows up
in that time the link is confirmed, else it is to be judged, by its distinct paths and observers. Confirmed or not, a session
lasts its BUFFER seconds and gives one row at its end. The same rules hold in batch (`sessions`) and as a stream on event
time with a watermark (`live_links`). Confirmed links then join the topology (`write_back`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hopwarden.operators.skew import lookup

#: Fixed value: seconds a link is buffered.
BUFFER = 300

MESSAGE = (
    "type string, data struct<timestamp: double, peer: string, peer_asn: string, path: array<string>, "
    "announcements: array<struct<next_hop: string, prefixes: array<string>>>, withdrawals: array<string>>"
)
_ROW = "array<struct<peer: string, peer_asn: bigint, ts: double, kind: string, prefix: string, as_path: string>>"


def flatten_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON update messages -> (peer, peer_asn, ts, kind 'U'/'W', prefix, as_path), a row per prefix and path.

    A path that ends in a set gives one path per member; withdrawals have no path. Bad JSON gives no rows.
    """
    m = messages.select(F.from_json(column, f"struct<{MESSAGE.replace('type string', 'type: string').replace('data struct', 'data: struct')}>").alias("m")).select("m.data.*").filter("peer is not null")
    last, head = F.element_at("path", -1), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    members = F.when(last.rlike(r"[{,\[]"), F.split(F.regexp_replace(last, r"[{}\[\]\s]", ""), ",")).otherwise(F.array(last))
    paths = F.transform(members, lambda x: F.concat_ws(" ", F.concat(head, F.array(x))))
    asn = F.col("peer_asn").try_cast("bigint")

    def row(kind: str, prefix: Column, path: Column) -> Column:
        return F.struct(F.col("peer").alias("peer"), asn.alias("peer_asn"), F.col("timestamp").alias("ts"), F.lit(kind).alias("kind"), prefix.alias("prefix"), path.alias("as_path"))

    prefixes = F.coalesce(F.flatten(F.transform("announcements", lambda a: a["prefixes"])), F.array().cast("array<string>"))
    up = F.when(F.size("path") > 0, F.flatten(F.transform(prefixes, lambda p: F.transform(paths, lambda q: row("U", p, q)))))
    down = F.transform("withdrawals", lambda p: row("W", p, F.lit(None).cast("string")))
    empty = F.array().cast(_ROW)
    return m.select(F.inline(F.concat(F.coalesce(up.cast(_ROW), empty), F.coalesce(down.cast(_ROW), empty))))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """'source|peer|asn|ts|U|prefix|path' lines -> announcements; withdrawals and malformed lines are dropped."""
    p = F.split(F.col(column), r"\|")
    rows = lines.filter(F.size(p) == 7).select(
        p[1].alias("peer"), p[2].try_cast("bigint").alias("peer_asn"), p[3].try_cast("double").alias("ts"), p[4].alias("kind"), p[5].alias("prefix"), p[6].alias("as_path")
    )
    return rows.filter("kind = 'U' and ts is not null and peer_asn is not null").drop("kind")


def unknown_links(links: DataFrame, topology: DataFrame) -> DataFrame:
    """Links (as1, as2, ...), batch or stream, whose undirected pair is not in the topology."""
    known = topology.select(F.col("as1").alias("__a"), F.col("as2").alias("__b"))
    keyed = links.filter("as1 <> as2").withColumns({"__a": F.least("as1", "as2"), "__b": F.greatest("as1", "as2")})
    return keyed.join(known, ["__a", "__b"], "left_anti").drop("__a", "__b")


def sessions(rows: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """(as1, as2, first_seen, n_rows, n_paths, n_observers, confirmed) per buffered link, in batch.

    rows: (src, dst, ts in whole seconds, path, vp). A session begins with a sighting outside any session of its link
    and lasts `buffer` seconds. Sessions follow from the distinct seconds of a link alone; rows find theirs by a lookup
    that spreads hot links.
    """
    keyed = rows.filter("src <> dst and ts is not null").withColumns({"as1": F.least("src", "dst"), "as2": F.greatest("src", "dst")})
    keyed = keyed.withColumn("__link", F.struct("as1", "as2"))
    seconds = keyed.select("__link", "ts").distinct().groupBy("__link").agg(F.array_sort(F.collect_list("ts")).alias("all"))
    starts = F.aggregate(
        "all",
        F.array().cast("array<bigint>"),
        lambda s, t: F.when((F.size(s) == 0) | (t >= F.element_at(F.when(F.size(s) > 0, s).otherwise(F.array(t)), -1) + buffer), F.array_append(s, t)).otherwise(s),
    )
    met = lookup(keyed, seconds.select("__link", starts.alias("__starts")), "__link")
    own = met.withColumn("first_seen", F.array_max(F.filter("__starts", lambda s: s <= F.col("ts"))))
    return own.groupBy("as1", "as2", "first_seen").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("path").alias("n_paths"),
        F.count_distinct("vp").alias("n_observers"),
        (F.min(F.col("src") < F.col("dst")) != F.max(F.col("src") < F.col("dst"))).alias("confirmed"),
    )


_OUT = "as1 long, as2 long, first_seen timestamp, n_rows long, n_paths long, n_observers long, confirmed boolean"
_STATE = "first_seen timestamp, forward boolean, backward boolean, n_rows long, paths array<string>, observers array<string>"


def _buffer(seconds: int):
    span = pd.Timedelta(seconds=seconds)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = state.get if state.exists else None
        first, forward, backward, n, paths, observers = (*held[:4], set(held[4]), set(held[5])) if held else (None, False, False, 0, set(), set())

        def close() -> None:
            out.append((*key, first, n, len(paths), len(observers), bool(forward and backward)))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ts", ignore_index=True)
            at = 0
            while at < len(rows):
                if first is not None and rows["ts"].iloc[at] >= first + span:
                    close()
                    first = None
                if first is None:
                    first, forward, backward, n, paths, observers = rows["ts"].iloc[at], False, False, 0, set(), set()
                end = max(at + 1, int(rows["ts"].searchsorted(first + span)))  # all rows of the session at once
                part = rows.iloc[at:end]
                up = part["src"] < part["dst"]
                forward, backward, n = bool(forward or up.any()), bool(backward or (~up).any()), n + len(part)
                paths.update(part["path"].dropna())
                observers.update(part["vp"].dropna())
                at = end
            state.update((first, forward, backward, n, sorted(paths), sorted(observers)))
            due = int(first.timestamp() * 1000) + seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def live_links(rows: DataFrame, delay: str = "60 seconds", buffer: int = BUFFER) -> DataFrame:
    """Stream of rows (src, dst, ts timestamp, path, vp) -> a row per session of a link, when its time is up.

    Event time with a watermark; null paths and observers count for rows only, as in `sessions`.
    """
    keyed = rows.filter("src <> dst").withColumns({"as1": F.least("src", "dst"), "as2": F.greatest("src", "dst")}).withWatermark("ts", delay)
    return keyed.groupBy("as1", "as2").applyInPandasWithState(_buffer(buffer), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def feedback(topology: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The topology with the confirmed links added (what a foreachBatch sink writes back)."""
    return topology.select("as1", "as2").unionByName(confirmed.filter("confirmed").select("as1", "as2")).distinct()


def write_back(topology: str, results: str):
    """A foreachBatch function for live_links: sessions of links that the topology does not have yet are written to
    `results`, confirmed ones added to the topology (parquet of as1, as2, batch).

    The topology is read anew in each batch, so what another job or an earlier batch added is known. Both are written in a
    partition of the batch's number, so a batch repeated after a loss leaves the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("as1 bigint, as2 bigint, batch bigint").parquet(topology).filter(F.col("batch") != number)
        fresh = batch.join(known.select("as1", "as2").distinct(), ["as1", "as2"], "left_anti").persist()
        try:
            fresh.write.mode("overwrite").parquet(f"{results}/batch={number}")
            fresh.filter("confirmed").select("as1", "as2").distinct().write.mode("overwrite").parquet(f"{topology}/batch={number}")
        finally:
            fresh.unpersist()

    return run
