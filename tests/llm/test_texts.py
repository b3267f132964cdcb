"""Encoding, mixing and truncation."""

import base64
import random
from collections import defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopwarden.llm import bpe, mixing, truncation

VOCABULARY = open(bpe.VOCABULARY, "rb").read()
ENCODER = bpe.Encoder(VOCABULARY)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
KNOWN = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", " ", "  ", "\n", "\r\n", "\t", "\xa0", "é", "Щи", "字", "😀", "'s", "'ll", "12", "00:01:02,345", " --> ", "...", "\x1c", "\x85", "​", "the", " and", "<|endoftext|>", "{12}{34}", "½"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join) | st.text(max_size=60))
def test_same_ids_as_public_encoder(text):
    ids = ENCODER.encode(text)
    assert ids == KNOWN.encode_ordinary(text)
    assert bpe.decode(ENCODER.transducer, ids) == text


def test_long_and_empty():
    text = "ab" * 200_000 + "\n" * 5000 + " x"
    assert ENCODER.encode(text) == KNOWN.encode_ordinary(text)
    assert ENCODER.encode(None) == [] and ENCODER.encode("") == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24), st.integers(0, 24))
def test_utf8_stream(data, cut):
    s = bpe.Utf8Stream()
    assert s.feed(data[:cut]) + s.feed(data[cut:], final=True) == data.decode("utf-8", "replace")


def test_encode_tables(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (3, "", 7)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, ["doc_id"]).collect()}
    assert got == {1: KNOWN.encode_ordinary("Hello world"), 2: [], 3: []}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}
    back = bpe.decode_ids(bpe.encode(df, ["doc_id"]), ["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == {1: "Hello world", 2: "", 3: ""}
    assert bpe.encode(df.limit(0), ["doc_id"]).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 2000):
        sizes = [float(rng.choice([1, 5, 5, 70, 900])) for _ in range(n)]
        p = [rng.random() for _ in range(n)]
        got = mixing.flight(sizes, p, 3)
        assert sum(0 < x < 1 for x in got) <= 2 and all(0 <= x <= 1 for x in got)
        assert sum(got) == pytest.approx(sum(p), abs=1e-3) and sum(s * x for s, x in zip(sizes, got)) == pytest.approx(sum(s * x for s, x in zip(sizes, p)), abs=1e-2)
        assert set(mixing.land(sizes, got)) <= {0, 1}


def test_flight_is_unbiased():
    sizes = [1.0, 2.0, 3.0, 10.0, 10.0, 40.0] * 3
    mean = [0.0] * len(sizes)
    for seed in range(600):
        for i, x in enumerate(mixing.flight(sizes, [0.3] * len(sizes), seed)):
            mean[i] += x / 600
    assert all(abs(m - 0.3) < 0.09 for m in mean)


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 10 < 8 else "small" if i % 10 == 8 else None, rng.randint(0, 300)) for i in range(6000)] + [(9000, "other", 10), (9001, "big", None)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 4), ("none", 0.05, 9), (None, 0.1, 1), ("off", 0.0, 3)], "source string, weight double, max_repeats int")
    mixed = mixing.mix(sizes, targets, block=500)
    got = {r.doc_id: r for r in mixed.collect()}
    assert sorted(map(tuple, got.values())) == sorted(tuple(r) for r in mixing.mix(sizes.repartition(7), targets, block=500).collect())
    cap = {"big": 1, "small": 4}
    used = defaultdict(int)
    for r in got.values():
        assert 0 < r.copies <= cap[r.source] and r.n_tokens > 0
        used[r.source] += r.copies * r.n_tokens
    assert used["big"] / (used["big"] + used["small"]) == pytest.approx(0.5 / 0.95, abs=0.002)
    report = {r.source: r for r in mixing.shares(mixed, sizes, targets).collect()}
    assert set(report) == {"big", "small", "none", "off"} and report["none"].actual_share == 0 and report["small"].most_copies <= 4
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0


def subtitles(rng, n):
    cues = []
    for i in range(n):
        body = rng.choice(["the {} is at the {}.", "did you see the {} near the {}?", "we left the {} behind the {}!"]).format(
            rng.choice(["lantern", "basket", "violin", "engine"]), rng.choice(["station", "harbour", "workshop", "chapel"])
        )
        cues.append(f"{i + 1}\n00:00:{i % 60:02},{rng.randint(100, 999)} --> 00:00:{i % 60:02},{rng.randint(100, 999)}\n{body}")
    return "\n\n".join(cues) + rng.choice(["", "\n", "\r\n", "\n\n"])


def test_truncation(spark):
    rng = random.Random(8)
    docs, cut = [], set()
    for i in range(900):
        text = subtitles(rng, rng.randint(4, 20))
        if i % 6 == 0:
            at = rng.randint(60, len(text) - 8)
            while text[:at].rstrip()[-1:] in ".!?":
                at -= 3
            text = text[:at] + rng.choice(["", "", "...", "\n"])
            cut.add(i)
        docs.append((i, text, "en", rng.choice(["s1", "s2", None])))
    docs += [(5000, None, "en", "s1"), (5001, "", None, None), (5002, " \n\t ", "en", "s1"), (5003, docs[0][1], "EN", "s2"), (5004, "No.", "en", "s1")]
    cut.add(5003)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("style", F.lit("clash")).withColumn("keys", F.lit(1))
    judged = {r.doc_id: r.cut for r in truncation.judged(df).collect()}
    assert not {5000, 5001, 5002} & set(judged) and len(judged) == 902
    found = {i for i, c in judged.items() if c}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(judged)
    assert (0 in found) == (5003 in found)
    report = truncation.truncation_report(df).collect()
    assert sum(r.n_texts for r in report) == 902 and sum(r.n_cut for r in report) == len(found)
    assert truncation.judged(df.limit(0)).count() == 0


def test_truncation_in_parts(spark, monkeypatch):
    """Bitmaps far smaller than the end contexts need: several parts, the same scores."""
    rng = random.Random(9)
    docs = [(i, subtitles(rng, rng.randint(2, 9))[: rng.choice([None, -7])]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ends = truncation.end_contexts(df)
    got = lambda: sorted((r.doc_id, r.variant, round(r.suffix, 9), r.anchor and round(r.anchor, 9), r.known) for r in truncation.scores(df, ends).collect())
    whole, parts = got(), truncation._size(ends)[1]
    monkeypatch.setattr(truncation, "MAX_BITS", 1 << 10)
    assert parts == 1 and truncation._size(ends)[1] >= 4 and truncation._size(ends)[0] <= 1 << 10
    assert got() == whole


def test_truncation_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "en", "s"), (2, "A full sentence.", None, None)], "doc_id bigint, text string, lang string, source string")
    assert truncation.judged(df).count() == 2


def test_normal_form():
    n = truncation.normal
    assert n("1\r\n00:01:02,345 --> 00:01:03,456\r\nHi there \r\nyou\r\n\r\n") == "\x01\x03hi there you"
    assert n("{1}{2}a|b\n{3}{4}c") == "\x01\x03a b\x01\x03c"
    assert n("x.\n\n2\n00:00:1") == n("x.\n\n2") == "\x01x.\x01\x03"
