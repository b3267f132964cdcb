"""Most frequent values in bounded memory: count-min sketches with conservative update over a partitioned stream.

1. Each map task adds up its batches in a table of at most FLUSH_AT values and passes partial counts on, so a value
   that holds a third of all rows leaves each task as a few rows.
2. Partial counts are partitioned by a hash of the value: each value's whole stream meets one sketch.
3. Every partition keeps one sketch per field (depth x width counters) with conservative update - a counter is raised
   only to the new estimate of the value - and a heap of the `keep` heaviest candidates.
4. Partitions hold disjoint values, so their heaps merge by union.

Estimates are never below the true count and above it by at most e/width of the partition's weight, except with
probability e^-depth. Width and heap follow from what is asked: for a share s the width keeps that error below s/4, and
fewer than 1 / (s - s/4) values can seem to reach s; for the top k the heap holds more than k values of each partition. A heap
that an estimate leaves comes back with the value's next sighting, as its estimate grows on in the sketch.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLUSH_AT = 200_000
#: Counters of each value: the error holds but for a probability of e^-DEPTH.
DEPTH = 4
_PARTIAL = "field_name string, item string, n bigint"
_HEAP = "field_name string, item string, n bigint, weight bigint"


class ConservativeSketch:
    """Count-min sketch with conservative update; hashes come in as two 64-bit words per value."""

    def __init__(self, width: int, depth: int) -> None:
        if width & (width - 1):
            raise ValueError("width must be a power of two")
        self.width, self.depth = width, depth
        self.cells = np.zeros((depth, width), np.int64)

    def add(self, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Add n of each (distinct) value; returns the estimates after it."""
        at = [((h1 + np.uint64(i) * (h2 | np.uint64(1))) >> np.uint64(20)) & np.uint64(self.width - 1) for i in range(self.depth)]
        estimate = np.min([self.cells[i][a] for i, a in enumerate(at)], axis=0) + n
        for i, a in enumerate(at):
            np.maximum.at(self.cells[i], a, estimate)
        return estimate


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and field, counts of its values, added up until FLUSH_AT distinct values are held."""
    held: dict[str, pa.Table] = {}

    def batch_of(field: str, t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        names = pa.array([field] * t.num_rows, pa.string())
        n = t.column("n_sum").combine_chunks() if t.num_rows else pa.array([], pa.int64())
        item = t.column("item").combine_chunks() if t.num_rows else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([names, item, n], ["field_name", "item", "n"])

    for batch in batches:
        for field in batch.schema.names:
            found = pc.value_counts(batch.column(field).cast(pa.string()))
            t = pa.table({"item": found.field("values"), "n_sum": found.field("counts").cast(pa.int64())})
            if field in held:
                t = pa.concat_tables([held[field], t])
                if t.num_rows >= FLUSH_AT:
                    t = t.rename_columns(["item", "n"]).group_by("item").aggregate([("n", "sum")]).select(["item", "n_sum"])
                    if t.num_rows >= FLUSH_AT:
                        yield batch_of(field, t)
                        t = t.slice(0, 0)
            held[field] = t
    for field, t in held.items():
        if t.num_rows:
            yield batch_of(field, t.rename_columns(["item", "n"]).group_by("item").aggregate([("n", "sum")]).select(["item", "n_sum"]))


def _sketcher(width: int, depth: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, ConservativeSketch] = {}
        heaps: dict[str, dict[str, int]] = {}
        floor: dict[str, int] = {}
        weight: dict[str, int] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["field_name", "item", "h1", "h2"]).aggregate([("n", "sum")])
            for field in pc.unique(t.column("field_name")).to_pylist():
                own = t.filter(pc.equal(t.column("field_name"), field))
                weight[field] = weight.get(field, 0) + pc.sum(own.column("n_sum")).as_py()
                own = own.filter(pc.is_valid(own.column("item")))
                if not own.num_rows:
                    continue
                sketch = sketches.setdefault(field, ConservativeSketch(width, depth))
                h1, h2 = (own.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
                estimate = sketch.add(h1, h2, own.column("n_sum").to_numpy())
                heavy = np.flatnonzero(estimate > floor.get(field, 0))
                heap = heaps.setdefault(field, {})
                heap.update(zip(own.column("item").take(pa.array(heavy)).to_pylist(), estimate[heavy].tolist()))
                if len(heap) > 4 * keep:
                    best = heapq.nlargest(keep, heap.items(), key=lambda x: (x[1], x[0]))
                    heaps[field], floor[field] = dict(best), best[-1][1] - 1
        for field, total in weight.items():
            best = heapq.nlargest(keep, heaps.get(field, {}).items(), key=lambda x: (x[1], x[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * (len(best) + 1), pa.string()),
                    pa.array([None, *[v for v, _ in best]], pa.string()),
                    pa.array([None, *[n for _, n in best]], pa.int64()),
                    pa.array([total] + [0] * len(best), pa.int64()),
                ],
                ["field_name", "item", "n", "weight"],
            )

    return run


def width_for(error: float) -> int:
    """Least power of two of counters whose estimates are above the truth by at most `error` of the rows (but for e^-depth)."""
    if not 0 < error <= 1:
        raise ValueError("the error must be in (0, 1]")
    return 1 << max(4, math.ceil(math.log2(math.e / error)))


def heavy_candidates(df: DataFrame, fields: list[str], keep: int, width: int, depth: int = DEPTH) -> DataFrame:
    """(field_name, item, n, total): up to `keep` candidates per partition and field with estimated counts, values as text.

    total: all rows of the field, nulls included; null is no value. Empty strings are values. Empty input: no rows.
    """
    picked = df.select(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields])
    partial = picked.mapInArrow(_partial_counts, _PARTIAL)
    hashed = partial.select("*", F.xxhash64("field_name", "item").alias("h1"), F.xxhash64(F.lit(7), "item", "field_name").alias("h2"))
    heaps = hashed.repartition("h1").mapInArrow(_sketcher(width, depth, keep), _HEAP)
    whole = Window.partitionBy("field_name")  # bounded: (keep + 1) rows per partition
    return heaps.withColumn("total", F.sum("weight").over(whole)).filter("item is not null").drop("weight")


def top_items(df: DataFrame, fields: list[str], k: int, error: float = 5e-5, keep: int | None = None) -> DataFrame:
    """(field_name, rank, item, n, most_over): the k most frequent values of each field by estimated count, ties by value.

    n is never too low, and too high by at most most_over (`error` of the field's rows) but for a probability of e^-DEPTH.
    """
    keep = 2 * k if keep is None else keep
    if keep < k:
        raise ValueError(f"a heap of {keep} cannot hold the top {k}")
    w = Window.partitionBy("field_name").orderBy(F.desc("n"), "item")
    ranked = heavy_candidates(df, fields, keep, width_for(error)).withColumn("rank", F.row_number().over(w))
    over = F.ceil(F.col("total") * F.lit(error)).cast("bigint").alias("most_over")
    return ranked.filter(F.col("rank") <= k).select("field_name", "rank", "item", "n", over)


def frequent_items(df: DataFrame, fields: list[str], share: float, keep: int | None = None, width: int | None = None) -> DataFrame:
    """(field_name, item, n, total): values on at least `share` of all rows, with exact counts.

    The sketch names the candidates (estimates are never too low, so none is missing); a second pass counts only those.
    They are fewer than 1 / (share - e/width) per field, which bounds what is broadcast. A width or heap too small for the
    share is refused.
    """
    width = width_for(share / 4) if width is None else width
    least = 1 / (share - math.e / width) if share * width > math.e else math.inf
    keep = math.ceil(min(least, 1 << 31)) + 1 if keep is None else keep
    if keep < least:
        raise ValueError(f"a heap of {keep} over {width} counters can lose values of share {share}")
    candidates = heavy_candidates(df, fields, keep, width).filter(F.col("n") >= F.lit(share) * F.col("total"))
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("item")) for f in fields])))
    counted = pairs.join(F.broadcast(candidates.select("field_name", "item", "total")), ["field_name", "item"])
    exact = counted.groupBy("field_name", "item", "total").agg(F.count(F.lit(1)).alias("n"))
    return exact.filter(F.col("n") >= F.lit(share) * F.col("total")).select("field_name", "item", "n", "total")
