"""Distinct counts from fixed bitmaps (linear counting).

Each identifier sets one hashed bit in its group's bitmap of m bits. Bitmaps merge by bitwise union, so partial
results of any slices of the data can be joined later. With z of m bits empty the estimate is -m ln(z/m); at n
identifiers its relative standard error is sqrt(m (e^t - t - 1)) / n, t = n/m. The error of an estimate is below three
of these in 99.7 % of all groups.

Every combination of the group columns is a level with an m of its own, chosen for the rows of its largest group, so that
each level keeps the target error and small groups keep small bitmaps. Map tasks set the bits of all levels for their own
rows. A state is one slice (SLICE bits) of a group's bitmap, written as its bits or, while that is shorter, as the numbers
of its set bits; so no state exceeds a megabyte, small groups cost what they hold, and states stop growing when rows go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one state at most (a power of two below 2^24, as bit numbers take two or three bytes).
SLICE = 1 << 23
#: Rows a map task adds up before it passes states on.
FLUSH_AT = 500_000
#: States of one slice that are held before they are united.
UNITE_AT = 64
#: Identifiers per bit at most: beyond that a bitmap could fill up.
FULLEST = 8

Bits = int | dict[int, int]


def relative_error(n: float, m: int) -> float:
    """Relative standard error of linear counting of n identifiers in m bits."""
    t = n / m
    return math.sqrt(m * (math.expm1(t) - t)) / n if n else 0.0


def bitmap_bits(most: int, target_error: float) -> int:
    """Least power of two of bits (64 at least) that counts up to `most` identifiers within the standard error."""
    m = 64
    while most and (most > FULLEST * m or relative_error(most, m) > target_error):
        m *= 2
    return m


def _levels(groups: list[str], m: Bits) -> dict[int, int]:
    return m if isinstance(m, dict) else dict.fromkeys(range(2 ** len(groups)), m)


def level_bits(df: DataFrame, groups: dict[str, Column], target_error: float) -> dict[int, int]:
    """For each combination of the group columns the bits that its largest group needs (it has no more identifiers than rows)."""
    per_group = df.cube(*[c.alias(g) for g, c in groups.items()]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    most = {r.level: r.n for r in per_group.groupBy("level").agg(F.max("n").alias("n")).collect()}  # one row per combination
    return {mask: bitmap_bits(most.get(mask, 0), target_error) for mask in range(2 ** len(groups))}


def _hash(value: Column) -> Column:
    """60 bits of an MD5, so that partial results agree between engines; null for null."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("bigint")


# --- states: a first byte (1: bits, 2 or 3: bit numbers of so many bytes), then the bits or the numbers ---------------


def _encoded(at: np.ndarray, starts: np.ndarray, size: int) -> list[bytes]:
    """A state for each run of sorted distinct bit numbers; starts has the end of the last run too."""
    width = 2 if size <= 1 << 16 else 3
    raw = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()
    head, out = bytes([width]), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        out.append(_bits(at[a:b], size) if (b - a) * width > size // 8 else head + raw[a * width : b * width])
    return out


def _bits(at: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, np.uint8)
    flags[at] = 1
    return b"\x01" + np.packbits(flags).tobytes()


def _numbers(state: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(state, np.uint8, offset=1).reshape(-1, width).astype(np.int64)
    return raw @ (1 << (8 * np.arange(width)))


def _united(states: list[bytes], size: int) -> np.ndarray:
    """The union of states of one slice as bytes of bits."""
    out = np.zeros(size // 8, np.uint8)
    flags = np.zeros(size, np.uint8)
    for s in states:
        if s[0] == 1:
            out |= np.frombuffer(s, np.uint8, offset=1)
        else:
            flags[_numbers(s, s[0])] = 1
    return out | np.packbits(flags)


def _mapper(groups: list[str], fields: list[str], bits: dict[int, int]):
    k = len(groups)

    def states(t: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [t.column(i).combine_chunks() for i in range(k)]
        codes = []
        for c in columns:
            d = c.dictionary_encode(null_encoding="encode")
            codes.append((d.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(d.dictionary))))
        hashes = [t.column(k + j).combine_chunks() for j in range(len(fields))]
        for mask, m in bits.items():
            own = [not mask >> (k - 1 - i) & 1 for i in range(k)]
            gid = np.zeros(t.num_rows, np.int64)
            for i in range(k):
                if own[i]:
                    gid = np.unique(gid * codes[i][1] + codes[i][0], return_inverse=True)[1]
            first = np.zeros(gid.max(initial=-1) + 1, np.int64)
            first[gid[::-1]] = np.arange(t.num_rows - 1, -1, -1)
            size, shift = min(m, SLICE), m.bit_length() - 1
            for name, h in zip(fields, hashes):
                valid = np.flatnonzero(pc.is_valid(h).to_numpy(zero_copy_only=False))
                at = h.drop_null().to_numpy() & (m - 1)
                pairs = np.unique((gid[valid] << shift) | at)
                run = pairs // size  # group and slice
                starts = np.flatnonzero(np.diff(run, prepend=-1))
                found = _encoded(pairs & (size - 1), np.append(starts, len(pairs)), size)
                group, part = (run[starts] * size) >> shift, run[starts] & (m // size - 1)
                bare = np.setdiff1d(np.arange(len(first)), group)  # groups without any identifier stay, with no bit set
                at_row = first[np.concatenate([group, bare])]
                n = len(at_row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, mask, np.int64)),
                        *[c.take(pa.array(at_row)) if mine else pa.nulls(n, c.type) for c, mine in zip(columns, own)],
                        pa.array([name] * n, pa.string()),
                        pa.array(np.concatenate([part, np.zeros(len(bare), np.int64)]).astype(np.int32)),
                        pa.array(found + [b"\x02"] * len(bare), pa.binary()),
                    ],
                    ["grouping_set", *groups, "field", "slice_no", "bits"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FLUSH_AT:
                yield from states(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from states(pa.Table.from_batches(held))

    return run


def _merger(keys: list[str], bits: dict[int, int], counts: bool):
    """Unite the states of equal keys, which stand together; `counts`: give the number of set bits instead of the bits."""

    def runs(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in keys:
            a = t.column(c).combine_chunks()
            x, y = a.slice(0, len(a) - 1), a.slice(1)
            differ = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def unite(t: pa.Table, starts: np.ndarray, counts: bool = counts) -> pa.RecordBatch:
        ends = np.append(starts[1:], t.num_rows)
        states = t.column("bits").to_pylist()
        sizes = [min(bits[x], SLICE) for x in t.column("grouping_set").take(pa.array(starts)).to_pylist()]
        ones, merged = np.zeros(len(starts), np.int64), [b""] * len(starts)
        for i, (a, b, size) in enumerate(zip(starts.tolist(), ends.tolist(), sizes)):
            some = states[a:b]
            width = some[0][0]
            if b - a == 1:
                ones[i] = int(np.bitwise_count(np.frombuffer(some[0], np.uint8, offset=1)).sum()) if width == 1 else (len(some[0]) - 1) // width
                merged[i] = some[0]
                continue
            if any(s[0] == 1 for s in some) or sum(map(len, some)) > size // 8:
                whole = _united(some, size)
                ones[i] = int(np.bitwise_count(whole).sum())
                if not counts:
                    at = np.flatnonzero(np.unpackbits(whole))
                    merged[i] = _encoded(at, np.array([0, len(at)]), size)[0]
                continue
            joined = b"".join(s[1:] for s in some)
            if width == 2 and counts and len(joined) < 1024:  # small groups, most of all: no arrays
                ones[i] = len({joined[j : j + 2] for j in range(0, len(joined), 2)})
                continue
            at = np.unique(_numbers(b"\x00" + joined, width))
            ones[i] = len(at)
            if not counts:
                merged[i] = _encoded(at, np.array([0, len(at)]), size)[0]
        out = t.select(keys).take(pa.array(starts)).combine_chunks()
        columns = [out.column(c).combine_chunks() for c in keys]
        last = pa.array(ones) if counts else pa.array(merged, pa.binary())
        return pa.RecordBatch.from_arrays([*columns, last], [*keys, "ones" if counts else "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if open_ is None else pa.concat_tables([open_, t])
            if not t.num_rows:
                continue
            starts = runs(t)
            if len(starts) > 1:
                yield unite(t.slice(0, starts[-1]), starts[:-1])
            open_ = t.slice(starts[-1])
            if open_.num_rows >= UNITE_AT:  # a key of many states is held as one
                open_ = pa.Table.from_batches([unite(open_, np.array([0]), False)])
        if open_ is not None:
            yield unite(open_, np.array([0]))

    return run


def _schema(df: DataFrame, groups: list[str], last: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(["grouping_set bigint", *[f"`{g}` {kinds[g]}" for g in groups], "field string", "slice_no int", last])


def bitmaps(df: DataFrame, groups: dict[str, Column], fields: dict[str, Column], m: Bits) -> DataFrame:
    """Partial result: (grouping_set, groups..., field, slice_no, bits), states of every level in m, one or more for a key.

    grouping_set: bit i is set where the i-th group column from the right is no part of the level. m: bits of each level, or
    of all levels alike (powers of two). A null identifier sets no bit but its group stays; null is a group of its own.
    Empty input: no rows.
    """
    picked = df.select(*[c.alias(g) for g, c in groups.items()], *[_hash(c).alias(f"__h{i}") for i, c in enumerate(fields.values())])
    names = list(groups)
    return picked.mapInArrow(_mapper(names, list(fields), _levels(names, m)), _schema(picked, names, "bits binary"))


def _together(partials: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [c for c in partials.columns if c != "bits"]
    return partials.repartition(*keys).sortWithinPartitions(*keys), keys


def merge_bitmaps(*parts: DataFrame, m: Bits) -> DataFrame:
    """Union of partial results made with the same m: one state per key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sorted_, keys = _together(out)
    groups = [c for c in keys if c not in ("grouping_set", "field", "slice_no")]
    return sorted_.mapInArrow(_merger(keys, _levels(groups, m), False), _schema(out, groups, "bits binary"))


def estimates(partials: DataFrame, groups: list[str], fields: list[str], m: Bits) -> DataFrame:
    """Estimated distinct counts of every group of every level.

    Result: grouping_set, the group columns (null where not part of the level), and for each field n_<field> (bigint, -1 if
    the bitmap is full, which cannot be where m fits the rows) and err_<field>, the relative standard error at that count.
    """
    sorted_, keys = _together(partials)
    counted = sorted_.mapInArrow(_merger(keys, _levels(groups, m), True), _schema(partials, groups, "ones bigint"))
    ones = counted.groupBy("grouping_set", *groups).agg(*[F.sum(F.when(F.col("field") == f, F.col("ones")).otherwise(0)).alias(f"__{f}") for f in fields])
    size = F.create_map(*[F.lit(x).cast("bigint") for level in _levels(groups, m).items() for x in level])[F.col("grouping_set")]
    out = ["grouping_set", *[F.col(g) for g in groups]]
    for f in fields:
        zero = size - F.col(f"__{f}")
        n = F.when(zero > 0, F.round(-size * F.log(zero / size)).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
        t = n / size
        err = F.when(n > 0, F.round(F.sqrt(size * (F.exp(t) - t - 1)) / n, 6)).when(n == 0, F.lit(0.0))
        out += [n.alias(f"n_{f}"), err.alias(f"err_{f}")]
    return ones.select(*out)
