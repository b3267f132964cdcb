"""The live path: messages, lines, and the stream against its batch form."""

import json
from datetime import datetime, timedelta

from hopwarden.streaming import live


def test_messages(spark):
    m = {"type": "ris_message", "data": {"timestamp": 1.0, "peer": "p", "peer_asn": "7", "path": [7, 8, [1, 2]], "announcements": [{"next_hop": "h", "prefixes": ["a", "b"]}], "withdrawals": ["c"]}}
    df = spark.createDataFrame([(json.dumps(m),), ("{bad",), (None,)], "value string")
    got = sorted((r.kind, r.prefix, r.as_path) for r in live.flatten_messages(df).collect())
    assert got == [("U", "a", "7 8 1"), ("U", "a", "7 8 2"), ("U", "b", "7 8 1"), ("U", "b", "7 8 2"), ("W", "c", None)]
    lines = spark.createDataFrame([("s|p|7|1.5|U|x|1 2",), ("s|p|7|1.5|W|x",), ("junk",), (None,)], "value string")
    assert [tuple(r) for r in live.parse_lines(lines).collect()] == [("p", 7, 1.5, "x", "1 2")]


def test_stream_agrees_with_batch(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    data = [(1, 2, 0, "a", "x"), (1, 2, 10, "b", "y"), (3, 4, 5, "a", "x"), (4, 3, 50, "c", "x"), (1, 2, 400, "a", "x"), (9, 9, 1, "a", "x")]
    rows = [(s, d, t0 + timedelta(seconds=t), p, v) for s, d, t, p, v in data]
    schema = "src bigint, dst bigint, ts timestamp, path string, vp string"
    late = [(7, 8, t0 + timedelta(seconds=5000), "z", "x")]
    for i, part in enumerate((rows, late, [(7, 8, t0 + timedelta(seconds=9000), "z", "x")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_links(stream).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.as1, r.as2, r.n_rows, r.n_paths, r.n_observers, r.confirmed) for r in spark.table("live_out").collect() if r.as1 < 7)
    batch = spark.createDataFrame([(s, d, t, p, v) for s, d, t, p, v in data], "src bigint, dst bigint, ts bigint, path string, vp string")
    want = sorted((r.as1, r.as2, r.n_rows, r.n_paths, r.n_observers, r.confirmed) for r in live.sessions(batch).collect())
    assert got == want == [(1, 2, 1, 1, 1, False), (1, 2, 2, 2, 2, False), (3, 4, 2, 2, 1, True)]


def test_sightings_after_confirmation_and_feedback(spark, tmp_path):
    """A confirmed link keeps its session to the end in stream and batch, then joins the topology and is known."""
    t0 = datetime(2025, 1, 1)
    data = [(3, 4, 5, "a", "x"), (4, 3, 50, "c", "x"), (3, 4, 60, "d", "y"), (4, 3, 200, None, None), (3, 4, 400, "a", "x"), (5, 6, 7, "a", "x")]
    schema = "src bigint, dst bigint, ts timestamp, path string, vp string"
    parts = [[(s, d, t0 + timedelta(seconds=t), p, v) for s, d, t, p, v in data]] + [[(7, 8, t0 + timedelta(seconds=t), "z", "x")] for t in (5000, 9000)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    top, res = str(tmp_path / "topology"), str(tmp_path / "results")
    spark.createDataFrame([(5, 6)], "as1 bigint, as2 bigint").write.parquet(f"{top}/batch=-1")
    stream = live.live_links(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(live.write_back(top, res)).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    take = lambda df: sorted((r.as1, r.as2, r.n_rows, r.n_paths, r.n_observers, r.confirmed) for r in df.collect() if r.as1 < 7)
    batch = live.sessions(spark.createDataFrame(data, "src bigint, dst bigint, ts bigint, path string, vp string"))
    assert take(batch) == [(3, 4, 1, 1, 1, False), (3, 4, 4, 3, 2, True), (5, 6, 1, 1, 1, False)]
    # the session with sightings after its confirmation is as in batch; the next one ends when the link is known, as 5-6 was
    assert take(spark.read.parquet(res)) == [(3, 4, 4, 3, 2, True)]
    assert {(r.as1, r.as2) for r in spark.read.parquet(top).collect()} >= {(3, 4), (5, 6)}


def test_stream_static_anti_join(spark):
    links = spark.createDataFrame([(2, 1), (3, 4), (5, 5)], "as1 bigint, as2 bigint")
    known = spark.createDataFrame([(1, 2)], "as1 bigint, as2 bigint")
    assert [tuple(r) for r in live.unknown_links(links, known).collect()] == [(3, 4)]
    ok = spark.createDataFrame([(3, 4, True), (6, 7, False)], "as1 bigint, as2 bigint, confirmed boolean")
    assert sorted(tuple(r) for r in live.feedback(known, ok).collect()) == [(1, 2), (3, 4)]
