"""Texts cut off by field limits or broken transfers, by a backward character n-gram model.

The model counts, over all texts, what follows a context: the last o characters (o in ORDERS) before a position, read
backwards from it. Either something ends there - the cue, or a sentence inside it - or the text goes on. For the end of
each text the model gives the log-odds of an end against a continuation, interpolated from short to long contexts.
Cues that end in a name no other text has (credits) are judged by a second context: how the cue begins, the number of
its words and the kind of its last character.

Contexts are hashed. Only those that some text ends with are counted: a first pass writes the end contexts of each text
and what else is asked of it, a second pass counts them. A bitmap tells the second pass which contexts are asked for; as
every suffix of an end context is an end context too, longer contexts are looked at only where the shorter one was marked.
The bitmap has BITS_A_KEY bits for each distinct context at least. Where that is more than MAX_BITS, places are divided by
their last three characters into parts with a bitmap and a pass each, so a task's bitmap is bounded and stays as selective
however many texts there are. All counting is vectorised over blocks of characters.

Texts that end at a length far more frequent in their source than its neighbours (a field limit) get no benefit of the
doubt from the second context. An ellipsis at the end is taken off unless the model knows it there: limits are often
marked by one. The threshold on the log-odds is learned for the column judged, per language and kind of text, at the
emptiest place between the two modes; a group's own texts are joined by PRIOR_TEXTS of all texts of the kind, so small
groups lean on those and large ones on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.operators.skew import lookup
from hopwarden.session import cut_lineage

ORDERS = (3, 4, 6, 8, 10, 12, 16)
#: Weight of the shorter context when a longer one is added.
WEIGHTS = {3: 2, 4: 2, 6: 8, 8: 8, 10: 8, 12: 8, 16: 8}
ANCHOR = 0  # the order number of the second context
ANCHOR_LENGTH = 8
KNOWN = 20  # an ellipsis belongs to the text if its context of order 8 was met this often
#: Weight of all texts of a kind in the threshold of a language, in texts.
PRIOR_TEXTS = 500
#: The threshold for texts that have the length of a limit of their source: these need less evidence.
LIMIT_THRESHOLD = -1.0
#: The second context cannot overrule log-odds below this.
TRUSTED_FROM = -13.0
#: Characters worked on at once.
BLOCK = 400_000
#: Places for contexts of their own in a counting task (a power of two).
SLOTS = 1 << 20
#: Bits of the bitmap a task gets (32 MB), and bits for each context asked for.
MAX_BITS = 1 << 28
BITS_A_KEY = 8

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(17)]
_CUE, _END, _TEXT_NEXT = 1, 2, 3
_PAD = "\x00" * 16
_CLOSERS = set(".!?…♪])>*#\"'»”")
_TERMINAL = np.array([ord(c) for c in ".!?…"], np.uint32)
_TIME_CODE = np.array([ord(c) for c in "0 :,->{}."] + list(range(32)), np.uint32)
_MARKS = np.array([ord(c) for c in "…♪»«“”’"], np.uint32)
_TIMES = re.compile(r"\x01(?:[0-9]+\n)?[0-9:.,]+[0-9](?: -{0,2}> |,)[0-9:.,]+[0-9]\n")
_FRAMES = re.compile(r"[\n\x01]\{[0-9]+\}\{[0-9]+\}")
_NO_TEXT = re.compile(r"\x01[0-9\n:., >{}\x03-]*\Z")
_LINE_END = re.compile(r"[ \t\xa0]*(?:\r\n|\r|\n)")
_DOTS = re.compile(r"[.…\s]+\Z")


def normal(text: str) -> str:
    """Lower case, line ends within a cue as spaces; trailing white space goes.

    A cue begins with one mark and, if it has them whole, another for its number and times. A last cue of which no text
    is left, be its number or times whole or not, is these two marks alone.
    """
    s = "\x01" + _LINE_END.sub("\n", text.lower().rstrip()).replace("\n\n", "\x01")
    s = _FRAMES.sub("\x01\x03", _TIMES.sub("\x01\x03", s))
    return _NO_TEXT.sub("\x01\x03", s).replace("|", " ").replace("\n", " ")


def unpunctuated(s: str) -> bool:
    """Whether most cues end without any punctuation."""
    ends = [c[-1] for c in s.split("\x01") if c]
    return sum(e in _CLOSERS for e in ends) < 0.4 * len(ends)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Block:
    """Symbols of several normalised texts in one array, with what both passes need of them."""

    def __init__(self, texts: list[str], styles: list[bool]) -> None:
        padded = [f"{_PAD}{s}\x02" for s in texts]
        a = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.a = np.where((a >= 48) & (a < 58), np.uint32(48), a)
        self.sym = _mixed(self.a.astype(np.uint64) + np.uint64(12345))
        self.short = self.sym.copy()  # hash of the shortest context at every position
        for k in range(1, ORDERS[0]):
            self.short[k:] += self.sym[:-k] * _POWERS[k]
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        self.style = np.repeat(np.fromiter(styles, np.uint64, len(styles)) * np.uint64(77777), lengths)
        self.last = np.cumsum(lengths) - 2
        self.next = np.append(self.a[1:], np.uint32(0))

    def ended(self, at: np.ndarray) -> np.ndarray:
        return (self.next[at] == _CUE) | (np.isin(self.a[at], _TERMINAL) & (self.next[at] == 32))

    def contexts(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each order, the keys of the contexts at the positions; send() narrows the positions for the next."""
        k = ORDERS[0]
        h = self.short[at]
        for o in ORDERS:
            while k < o:
                h = h + self.sym[np.maximum(at - k, 0)] * _POWERS[k]
                k += 1
            keep = yield o, _mixed(h + self.style[at] + np.uint64(o))
            if keep is not None:
                at, h = at[keep], h[keep]

    def anchors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the second context at the positions, and where there is one (the cue's text is long enough)."""
        size, pos = len(self.a), np.arange(len(self.a))
        start = np.maximum.accumulate(np.where(self.a == _CUE, pos, 0))
        text = np.minimum.accumulate(np.where(np.isin(self.a, _TIME_CODE), size - 1, pos)[::-1])[::-1]
        begin = text[np.minimum(start[at] + 1, size - 1)]
        spaces = np.cumsum(self.a == 32)
        words = (spaces[at] - spaces[begin]).astype(np.uint64)
        head_end = np.minimum(begin + ANCHOR_LENGTH - 1, size - 1)
        h = np.zeros(len(at), np.uint64)
        for k in range(ANCHOR_LENGTH):
            h = h + self.sym[np.maximum(head_end - k, 0)] * _POWERS[k]
        c = self.a[at]
        letter = ((c >= 97) & (c <= 122)) | ((c >= 170) & ~np.isin(c, _MARKS)) | (c == 48)
        kind = np.where(letter, np.uint32(97), c).astype(np.uint64)
        keys = _mixed(h + words * np.uint64(1000003) + kind * np.uint64(998244353) + self.style[at] + np.uint64(31))
        return keys, head_end <= at


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    held, at, size = [], [], 0
    for i, s in enumerate(texts):
        held.append(s)
        at.append(i)
        size += len(s)
        if size >= BLOCK:
            yield at, held
            held, at, size = [], [], 0
    if held:
        yield at, held


_ENDS = "doc_id bigint, variant int, style boolean, short bigint, orders array<int>, keys array<bigint>"
_PART_SHIFT = 40  # the bits of a hash that tell the part of a context


def _end_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text (and per text without its closing ellipsis) the keys of its end contexts; further columns go along."""
    for batch in batches:
        more = batch.schema.names[2:]
        rows_of: list[int] = []
        ids, variants, texts, styles = [], [], [], []
        for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            s = normal(text)
            style = unpunctuated(s)
            forms = [s]
            if s.endswith(("..", "…")):
                forms.append(_DOTS.sub("", s))
            for v, form in enumerate(forms):
                ids.append(doc)
                rows_of.append(row)
                variants.append(v)
                texts.append(form)
                styles.append(style)
        for at, some in _blocks(texts):
            block = _Block(some, [styles[i] for i in at])
            rows: list[list[int]] = [[] for _ in at]
            orders: list[list[int]] = [[] for _ in at]
            for o, keys in block.contexts(block.last):
                for row, order, k in zip(rows, orders, keys.view(np.int64).tolist()):
                    row.append(k)
                    order.append(o)
            keys, there = block.anchors(block.last)
            for row, order, k, ok in zip(rows, orders, keys.view(np.int64).tolist(), there.tolist()):
                if ok:
                    row.append(k)
                    order.append(ANCHOR)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in at], pa.int64()),
                    pa.array([variants[i] for i in at], pa.int32()),
                    pa.array([styles[i] for i in at], pa.bool_()),
                    pa.array((_mixed(block.short[block.last]) >> np.uint64(_PART_SHIFT)).astype(np.int64)),
                    pa.array(orders, pa.list_(pa.int32())),
                    pa.array(rows, pa.list_(pa.int64())),
                    *[batch.column(c).take(pa.array([rows_of[i] for i in at], pa.int64())) for c in more],
                ],
                ["doc_id", "variant", "style", "short", "orders", "keys", *more],
            )


def _counter(shared, bits: int, part: int = 0, parts: int = 1):
    mask = np.uint64(bits - 1)

    def mine(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(_PART_SHIFT)) & np.uint64(parts - 1) == np.uint64(part)

    def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = keys & mask
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def merge(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _, _ in held])
        distinct, where = np.unique(keys, return_inverse=True)
        n, c = (np.bincount(where, np.concatenate([x[i] for x in held]), len(distinct)).astype(np.int64) for i in (1, 2))
        return distinct, n, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint64)
        slots = np.zeros(SLOTS, np.uint64)  # the key that has the slot; others wait in `held`
        n, c = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        held: list[tuple] = []

        def count(keys: np.ndarray, ended: np.ndarray) -> None:
            slot = ((keys >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)
            free = np.flatnonzero(slots[slot] == 0)
            slots[slot[free]] = keys[free]
            own = slots[slot] == keys
            n.__iadd__(np.bincount(slot[own], minlength=SLOTS))
            c.__iadd__(np.bincount(slot[own & ended], minlength=SLOTS))
            if not own.all():
                rest = ~own
                held.append((keys[rest], np.ones(int(rest.sum())), ended[rest].astype(np.float64)))

        for batch in batches:
            texts = [normal(t) for t in batch.column(0).to_pylist()]
            for _, some in _blocks(texts):
                block = _Block(some, [unpunctuated(s) for s in some])
                base = np.flatnonzero((block.a > 32) & (block.a != 160) & (block.next != _END) | (block.a == _TEXT_NEXT))
                ends = base[(block.next[base] == 32) | (block.next[base] == _CUE)]
                if parts > 1:
                    base = base[mine(_mixed(block.short[base]))]
                ended = block.ended(base)
                at, found = base, []
                walk = block.contexts(at)
                step = next(walk, None)
                while step is not None:
                    keep = np.flatnonzero(marked(bitmap, step[1]))
                    at, ended = at[keep], ended[keep]
                    found.append((step[1][keep], ended))
                    try:
                        step = walk.send(keep) if len(keep) else None
                    except StopIteration:
                        step = None
                keys, there = block.anchors(ends)
                keep = np.flatnonzero(there & mine(keys) & marked(bitmap, keys))
                found.append((keys[keep], block.ended(ends[keep])))
                count(np.concatenate([k for k, _ in found]), np.concatenate([e for _, e in found]))
                if sum(len(k) for k, _, _ in held) > 1_500_000:
                    held[:] = [merge(held)]
                    if len(held[0][0]) > 1_000_000:  # bounded memory: pass partial counts on
                        yield _counts(held.pop())
        used = np.flatnonzero(n)
        held.append((slots[used], n[used], c[used]))
        yield _counts(merge(held))

    return run


def _counts(t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t[0].view(np.int64)), pa.array(t[1]), pa.array(t[2])], ["key", "n", "ended"])


def _size(ends: DataFrame) -> tuple[int, int]:
    """(bits of a bitmap, number of parts) for the distinct end contexts of all texts."""
    distinct = ends.select(F.explode("keys").alias("k")).agg(F.approx_count_distinct("k", 0.02)).first()[0]
    parts = 1 << max(0, (distinct * BITS_A_KEY - 1) // MAX_BITS).bit_length()
    return min(MAX_BITS, max(1 << 16, 1 << (4 * BITS_A_KEY * distinct // parts).bit_length())), parts


def _bitmap(ends: DataFrame, bits: int, part: int, parts: int):
    """The end contexts of a part as one bitmap of at most MAX_BITS, whatever the number of texts."""
    bit = F.expr(f"k & {bits - 1}L")
    own = F.when(F.col("o") == ANCHOR, F.shiftrightunsigned("k", _PART_SHIFT)).otherwise(F.col("short"))
    words = (
        ends.select("short", F.explode(F.arrays_zip("orders", "keys")).alias("x"))
        .select("short", F.col("x.orders").alias("o"), F.col("x.keys").alias("k"))
        .filter(own.bitwiseAND(F.lit(parts - 1).cast("bigint")) == part)
        .select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    found = words.toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return ends.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def end_contexts(documents: DataFrame) -> DataFrame:
    """What the first pass writes of each text: its end contexts and the columns of documents after doc_id and text."""
    kinds = "".join(f", {name} {kind}" for name, kind in documents.dtypes[2:])
    return cut_lineage(documents.mapInArrow(_end_contexts, _ENDS + kinds))


def scores(documents: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, variant, style, suffix, anchor, known) per text: log-odds of an end by both contexts.

    documents: (text) with no null or blank text; ends: their end contexts. variant 1 is the text without its closing ellipsis.
    """
    bits, parts = _size(ends)
    counted = None
    for part in range(parts):
        run = _counter(_bitmap(ends, bits, part, parts), bits, part, parts)
        one = documents.select("text").mapInArrow(run, "key bigint, n bigint, ended bigint")
        counted = one if counted is None else counted.unionByName(one)
    model = cut_lineage(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended")))
    asked = ends.select("doc_id", "variant", "style", F.explode(F.arrays_zip("orders", "keys")).alias("x")).select(
        "doc_id", "variant", "style", F.col("x.orders").alias("order"), F.col("x.keys").alias("key")
    )
    known = lookup(asked, model, "key").select("doc_id", "variant", F.struct("order", "n", "ended").alias("x"))
    per_text = known.groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # ten at most
    weight = F.create_map(*[F.lit(x) for o in ORDERS for x in (o, float(WEIGHTS[o]))])
    p = F.aggregate(
        F.filter("xs", lambda x: x["order"] != ANCHOR),
        F.lit(0.05),
        lambda p, x: (x["ended"] + weight[x["order"]] * p) / (x["n"] + weight[x["order"]]),
    )
    p = F.greatest(F.lit(1e-30), F.least(F.lit(1 - 1e-6), p))
    anchor = F.get(F.filter("xs", lambda x: (x["order"] == ANCHOR) & (x["n"] >= 8)), F.lit(0))
    pa_ = (anchor["ended"] + 0.1) / (anchor["n"] + 1)
    by_order_8 = F.get(F.filter("xs", lambda x: x["order"] == 8), F.lit(0))["n"]
    scored = per_text.select(
        "doc_id",
        "variant",
        F.log(p / (1 - p)).alias("suffix"),
        F.log(pa_ / (1 - pa_)).alias("anchor"),
        by_order_8.alias("known"),
    )
    lone = F.log(F.lit(0.05 / 0.95))  # an end context nothing else shares
    return ends.select("doc_id", "variant", "style").join(scored, ["doc_id", "variant"], "left").withColumns({"suffix": F.coalesce("suffix", lone), "known": F.coalesce("known", F.lit(0).cast("bigint"))})


def _measures() -> Column:
    return F.array(
        F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")),
        F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length")),
    )


def length_limits(facts: DataFrame) -> DataFrame:
    """(source, measure, length): lengths, in characters or bytes, that distinct texts of a source have far too often.

    facts: (source, text_hash, n_chars, n_bytes) per text.

    At least 8 texts, half a percent of the source's and five times the mean of the 50 lengths around. So there are at
    most 200 a source and measure.
    """
    lengths = facts.select("source", "text_hash", F.inline(_measures())).distinct()
    n = lengths.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "measure")
    around = by.orderBy("length").rangeBetween(-25, 25)
    near = (F.sum("n").over(around) - F.col("n")) / 50
    picked = n.withColumn("near", near).withColumn("all", F.sum("n").over(by))
    return picked.filter("n >= 8 and n >= 0.005 * all and n >= 5 * near").select("source", "measure", "length")


def language(lang: Column) -> Column:
    """The first two letters, lower case; a missing language is one of its own."""
    return F.coalesce(F.lower(F.substring(lang, 1, 2)), F.lit(""))


def judged(documents: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, source, log_odds, threshold, cut) for every text that is not null or blank.

    documents: doc_id (unique), the text column, lang, source; other columns play no part. Texts whose end nothing else shares
    score by the prior. Re-uploads of one text are judged alike. Empty input: no rows.
    """
    texts = documents.filter(F.col(column).rlike(r"[^\s\p{Z}]")).select(
        "doc_id",
        F.col(column).alias("text"),
        "source",
        language(F.col("lang")).alias("language"),
        F.length(column).alias("n_chars"),
        F.octet_length(column).alias("n_bytes"),
        F.xxhash64(column).alias("text_hash"),
    )
    ends = end_contexts(texts)
    found = scores(texts.select("text"), ends)
    facts = ends.filter("variant = 0").select("doc_id", "source", "language", "n_chars", "n_bytes", "text_hash")
    limits = length_limits(facts.filter("source is not null"))
    at_limit = (
        facts.select("doc_id", "source", F.inline(_measures()))
        .join(limits, ["source", "measure", "length"], "left_semi")
        .select("doc_id", F.lit(True).alias("at_limit"))
        .distinct()
    )
    facts = facts.select("doc_id", "source", "language").join(at_limit, "doc_id", "left")
    trusted = F.col("at_limit").isNull() & (F.col("anchor") > 1.5) & (F.col("suffix") > TRUSTED_FROM)
    each = found.join(facts, "doc_id").withColumn(
        "log_odds", F.when(trusted, F.greatest("anchor", "suffix")).otherwise(F.col("suffix"))
    )
    raw, bare = F.max(F.when(F.col("variant") == 0, F.struct("log_odds", "known"))), F.max(F.when(F.col("variant") == 1, F.col("log_odds")))
    one = each.groupBy("doc_id", "source", "language", "style", "at_limit").agg(raw.alias("raw"), bare.alias("bare"))
    one = one.select(
        "doc_id",
        "source",
        "language",
        "style",
        "at_limit",
        F.when((F.col("raw.known") < KNOWN) & F.col("bare").isNotNull(), F.col("bare")).otherwise(F.col("raw.log_odds")).alias("log_odds"),
    )
    one = cut_lineage(one)
    return (
        one.join(F.broadcast(_thresholds(one)), ["language", "style"], "left")
        .withColumn("threshold", F.when(F.col("at_limit"), LIMIT_THRESHOLD).otherwise(F.col("threshold")))
        .select("doc_id", "source", "language", "style", "log_odds", "threshold", (F.col("log_odds") < F.col("threshold")).alias("cut"))
    )


def _thresholds(one: DataFrame) -> DataFrame:
    """Per language and kind of text: the emptiest half unit of log-odds in [-6, -2], ties nearest to -3.

    The counts of a group are added to PRIOR_TEXTS times the shares among all texts of its kind.
    Languages are two letters, so there are fewer than 70 000 of them however many texts.
    """
    bins = one.select("language", "style", F.floor(F.col("log_odds") * 2).cast("int").alias("b"))
    n = bins.groupBy("language", "style").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("b") == b).cast("int")).alias(f"b{-b}") for b in range(-12, -4)]
    )
    order = sorted(range(-12, -4), key=lambda b: (abs(b + 6.5), b))
    best = F.array_min(F.array(*[F.struct(F.col(f"b{-b}").alias("n"), F.lit(i).alias("i"), F.lit(b / 2 + 0.25).alias("t")) for i, b in enumerate(order)]))
    of_kind = Window.partitionBy("style")  # one row per language
    smooth = n.select("language", "style", *[(F.col(f"b{-b}") + PRIOR_TEXTS * F.sum(f"b{-b}").over(of_kind) / F.sum("n").over(of_kind)).alias(f"b{-b}") for b in range(-12, -4)])
    return smooth.select("language", "style", best["t"].alias("threshold"))


def truncation_report(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share_cut) per source; texts of no source are a source of their own (null)."""
    return (
        judged(documents)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"))
        .withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
    )
