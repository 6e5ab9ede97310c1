"""Bloom filters that are built in tasks, merged range by range, and broadcast within a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh

#: Slots of a filter for each row; a row sets two of them, so that about 1 in 70 is hit by chance.
SLOTS = 16
#: Slots of one range of a filter, which one reducer merges; a hash has both its slots in one range.
RANGE = 1 << 22
#: Bytes of a filter that are broadcast at most. What has more ranges is folded onto as many as fit: the filter then hits
#: more rows by chance, so that more of them shuffle, but it misses none.
FILTER_BYTES = 64 << 20


def slots(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 64-bit hashes: the range, and two slots in it."""
    h = h.view(np.uint64)
    r = h * np.uint64(0x9E3779B97F4A7C15)
    r = (r ^ r >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)
    return (r % np.uint64(ranges)).astype(np.int64), (h & np.uint64(RANGE - 1)).astype(np.int64), ((h >> np.uint64(22)) & np.uint64(RANGE - 1)).astype(np.int64)


def pack(off: np.ndarray) -> bytes:
    """Sorted offsets as differences, squeezed."""
    return zlib.compress(np.diff(off.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32), dtype=np.int64)


def slots_set(ranges: int) -> Callable:
    """What a task sets in each range: its slots, and those among them that it sets more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            r, x, y = slots(b.column(0).to_numpy(), ranges)
            parts += [r * RANGE + x, (r * RANGE + y)[x != y]]
        if not parts:
            return
        at, times = np.unique(np.concatenate(parts), return_counts=True)
        group = at // RANGE
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(at) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1], edges[1:]):
            off = at[lo:hi] % RANGE
            yield pa.RecordBatch.from_pydict({"range": [int(group[lo])], "once": [pack(off)], "again": [pack(off[times[lo:hi] > 1])]})

    return run


def merged(least: int, folds: int) -> Callable:
    """Rows (range, once, again) in order of range: the slots of each range that were set `least` times, 1 or 2, for the range it folds onto."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(0, np.uint8)
        done = lambda: pa.RecordBatch.from_pydict({"range": [now % folds], "once": [pack(np.flatnonzero(seen >= least))], "again": [pack(np.zeros(0, np.int64))]})
        for b in batches:
            for r, once, again in zip(*(b.column(i).to_pylist() for i in range(3))):
                if r != now:
                    if now is not None:
                        yield done()
                    now, seen = r, np.zeros(RANGE, np.uint8)
                at = unpack(once)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[unpack(again)] = 2
        if now is not None:
            yield done()

    return run


def build(hashes: DataFrame, rows: int, least: int = 1, filter_bytes: int = FILTER_BYTES):  # noqa: ANN201
    """(broadcast bits, ranges, folds) for a frame of one column of bigints without nulls, some `rows` of them.

    The slots set once (least = 1) or more than once (2) are found range by range in the reducers, at full
    resolution whatever the number of rows; only what is set goes to the driver, folded in reducers onto
    filter_bytes at most.
    """
    spark = hashes.sparkSession
    ranges = max(1, -(-rows * SLOTS // RANGE))
    folds = max(1, min(ranges, filter_bytes * 8 // RANGE))
    kind = "range long, once binary, again binary"
    found = hashes.mapInArrow(slots_set(ranges), kind).repartition(min(ranges, 2000), "range").sortWithinPartitions("range").mapInArrow(merged(least, folds), kind)
    if folds < ranges:
        found = found.repartition(folds, "range").sortWithinPartitions("range").mapInArrow(merged(1, folds), kind)
    bits = np.zeros(folds * (RANGE // 8), np.uint8)
    for r, blob, _ in found.toLocalIterator():
        one = np.zeros(RANGE, np.uint8)
        one[unpack(bytes(blob))] = 1
        bits[r * (RANGE // 8) : (r + 1) * (RANGE // 8)] |= np.packbits(one, bitorder="little")
    return spark.sparkContext.broadcast(bits.tobytes()), ranges, folds


def hits(h: np.ndarray, bits: np.ndarray, ranges: int, folds: int) -> np.ndarray:
    """Are both slots of each hash set?"""
    r, x, y = slots(h, ranges)
    hit = np.ones(len(h), bool)
    for at in (r % folds * RANGE + x, r % folds * RANGE + y):
        hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def tester(flags, ranges: int, folds: int):  # noqa: ANN001, ANN201
    """UDF of hits() over a column of hashes."""

    @F.pandas_udf("boolean")
    def test(h):  # noqa: ANN001, ANN202
        return type(h)(hits(h.to_numpy(), np.frombuffer(flags.value, np.uint8), ranges, folds))

    return test


def without(df: DataFrame, key: str, gone: DataFrame, rows: int, broadcast_rows: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of df whose key is not in `gone`, a computed frame of one column with some `rows` keys.

    Up to broadcast_rows keys are broadcast. Of more a Bloom filter is, within filter_bytes: rows that it rules out
    pass straight through, only the others shuffle to an exact join. A null key is in nothing.
    """
    (name,) = gone.columns
    if rows <= broadcast_rows:
        return df.join(F.broadcast(gone), col(key) == col(name), "left_anti")
    h, flag = fresh(df, "hash", "flag")
    bits = build(gone.select(F.xxhash64(col(name))), rows, 1, filter_bytes)
    marked = df.withColumn(h, F.xxhash64(col(key)))
    marked = marked.withColumn(flag, tester(*bits)(col(h)))
    cols = [col(c) for c in df.columns]
    maybe = marked.where(col(flag)).select(cols).join(gone.hint("merge"), col(key) == col(name), "left_anti")
    return marked.where(~col(flag)).select(cols).unionAll(maybe)
