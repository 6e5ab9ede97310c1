"""Pairs of sets with a high Jaccard similarity, by prefixes, parities and blocks: what joins by sets are built on.

Sets are sorted arrays of 64-bit hashes; equal sets are one node, under a 64-bit hash of the set. What shuffles are prefixes,
packed, then pairs of nodes, then 1 bit or 2 for each element, and at last the sets of the nodes that still have a partner, about once each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a bucket, about; pairs formed at once; elements of a block of sets that are verified together.
KEYS, AT_ONCE, BLOCK = 1 << 20, 1 << 21, 1 << 20
#: Rounds in which nodes take the least label around them. They set where sets are verified, not the result.
ROUNDS = 3
#: Rows of a side that is broadcast at most.
SMALL = 2_000_000
#: Bits of a parity: the power of 2 from the size of the set on, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 15


def grouped(batches: Iterator[pa.RecordBatch], found: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What `found` gives for the rows of each value of the first column, by which they are sorted."""
    now, held = None, []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and now != key[lo]:
                yield from found(pa.Table.from_batches(held))
                held = []
            now = key[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from found(pa.Table.from_batches(held))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each list begins, and the end) of lists."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def prefixes(threshold: float, often, buckets: int) -> Callable:  # noqa: ANN001
    """Rows (h, side, s): rows (bucket, h, n, side, many, g), one for each bucket and batch, of the first elements of each set, so many that two similar sets share one.

    Their order is that of the hash, those of `often` (from the most seen on) last, the most seen at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        at_last, rank = np.sort(last), np.argsort(last)
        for b in batches:
            if not b.num_rows:
                continue
            h, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            s, begin = _flat(b.column(2))
            n = np.diff(begin)
            size = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            row = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(s), np.int64)
            if len(last):
                at = np.minimum(np.searchsorted(at_last, s), len(last) - 1)
                late = np.where(at_last[at] == s, len(last) - rank[at], 0)
            seldom = late == 0
            before = np.r_[0, np.cumsum(seldom)]
            keep = seldom & (before[:-1] - before[begin[:-1]][row] < size[row])
            short = size - (before[begin[1:]] - before[begin[:-1]])  # what is seen often fills it up
            for k in np.flatnonzero(short > 0):
                own = begin[k] + np.flatnonzero(~seldom[begin[k] : begin[k + 1]])
                keep[own[np.argsort(late[own], kind="stable")[: short[k]]]] = True
            g, row = s[keep].view(np.uint64), row[keep]
            bucket = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            g, row, bucket = g[order].astype(np.uint32), row[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(g) else []
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, many = np.unique(row[lo:hi], return_counts=True)
                out.append((int(bucket[lo]), h[own].tobytes(), n[own].astype(np.int32).tobytes(), (side[own] + 1).astype(np.int8).tobytes(), many.astype(np.int32).tobytes(), g[lo:hi].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out))], names=["bucket", "h", "n", "side", "many", "g"])

    return run


def candidates(threshold: float, two: bool) -> Callable:
    """Rows of prefixes() in order of bucket: (a, b), a < b, of nodes that share an element and may be similar by size; two: of which one is on either side."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, n, side, many, g = (np.frombuffer(b"".join(t[k].to_pylist()), d) for k, d in (("h", np.int64), ("n", np.int32), ("side", np.int8), ("many", np.int32), ("g", np.uint32)))
        h, n, side = (np.repeat(x, many) for x in (h, n, side))
        value = (g.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        order = np.lexsort((h, value))
        value, h, n, side = value[order], h[order], n[order], side[order]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (h[1:] != h[:-1])])
        side = np.bitwise_or.reduceat(side, first)
        value, h, n = value[first], h[first], n[first]
        most = np.minimum(np.floor(n / threshold + 1e-9), 2**32 - 1).astype(np.uint64)
        partners = np.searchsorted(value, (value >> np.uint64(32) << np.uint64(32)) | most, "right") - np.arange(len(value)) - 1
        so_far = np.r_[0, np.cumsum(partners)]
        nodes, number = np.unique(h, return_inverse=True)
        lo, held = 0, np.zeros(0, np.int64)
        while lo < len(value):
            hi = max(lo + 1, int(np.searchsorted(so_far, so_far[lo] + AT_ONCE, "right")) - 1)
            i = np.repeat(np.arange(lo, hi), partners[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(so_far[lo:hi] - so_far[lo], partners[lo:hi])
            lo = hi
            if two:
                ok = (side[i] | side[j]) == 3
                i, j = i[ok], j[ok]
            x, y = number[i], number[j]
            held = np.unique(np.r_[held, np.minimum(x, y) * len(nodes) + np.maximum(x, y)])
            if len(held) > AT_ONCE or lo == len(value):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[held // len(nodes)]), pa.array(nodes[held % len(nodes)])], names=["a", "b"])
                held = held[:0]

    return lambda batches: grouped(batches, found)


def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, s): (h, n, p): for each of some residues of the elements whether there is an odd number of them. The bits in which two sets differ are no more than the elements in which they do."""
    for b in batches:
        s, begin = _flat(b.column(1))
        u, out = s.view(np.uint64), []
        for lo, hi in zip(begin[:-1], begin[1:]):
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(hi - lo - 1).bit_length()))
            out.append(np.packbits((np.bincount((u[lo:hi] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(begin).astype(np.int32)), pa.array(out, pa.binary())], names=["h", "n", "p"])


def likely(threshold: float) -> Callable:
    """Rows (a, b, na, nb, pa, pb): (a, b) of the pairs whose parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            most = na + nb - 2 * np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9).astype(np.int64)
            p, q = (b.column(k).to_pylist() for k in (4, 5))
            wide = np.array([(len(x), len(y)) for x, y in zip(p, q)], np.int64).reshape(-1, 2)
            keep = np.zeros(len(na), bool)
            for lx, ly in np.unique(wide, axis=0):
                at, least = np.flatnonzero((wide == (lx, ly)).all(1)), min(lx, ly)
                x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), -1, least), 1) for side in (p, q))  # the wider one is folded
                keep[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[at]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def verify(threshold: float) -> Callable:
    """Rows (key, h, b, s) in order of key, sets (h, s) and pairs (h, b) among them: (a, b, similarity) of the pairs at the threshold."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, pairs = t.filter(t["s"].is_valid()).combine_chunks(), t.filter(t["s"].is_null())
        column = rows["s"].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        s, begin = _flat(column)
        of = {h: s[begin[k] : begin[k + 1]] for k, h in enumerate(rows["h"].to_pylist())}
        left, right = (pairs[k].to_numpy() for k in ("h", "b"))
        value = np.zeros(len(left))
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            x, y = of[a], of[b]
            if len(x) > len(y):
                x, y = y, x
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            value[k] = shared / (len(x) + len(y) - shared)
        ok = value >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(left[ok]), pa.array(right[ok]), pa.array(value[ok])], names=["a", "b", "similarity"])

    return lambda batches: grouped(batches, found)


def node_pairs(sets: DataFrame, often: np.ndarray, threshold: float, two: bool, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of nodes at the threshold, of (c, h, side, n, s); c are distinct bigints, s not empty. two: pairs with one on either side. sets are read several times."""
    sc = sets.sparkSession.sparkContext
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = int(max(8, min(20_000, total * max(0.02, 1 - threshold) // KEYS + 1)))
    packed = sets.select("h", "side", "s").mapInArrow(prefixes(threshold, sc.broadcast(often), buckets), "bucket int, h binary, n binary, side binary, many binary, g binary")
    some = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(candidates(threshold, two), "a long, b long").distinct()
    nodes = sets.groupBy("h").agg(F.min("c").alias("c"))
    parity = store(sets.select("h", "s").mapInArrow(parities, "h long, n int, p binary").dropDuplicates(["h"]))
    a, b = (parity.select(F.col("h").alias(k), F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}")) for k in "ab")
    edges = store(some.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(likely(threshold), "a long, b long"))
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")))
    for _ in range(ROUNDS - 1):
        label = store(both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.least("a", F.min("l")).alias("l")))
    placed = label.select(F.col("a").alias("h"), "l").join(parity.select("h", "n"), "h").join(nodes, "h")
    parts = placed.groupBy("l").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    placed = store(placed.join(parts, "l").select("h", "c", F.xxhash64("l", F.pmod(F.xxhash64("h"), "parts")).alias("block")))
    at = [placed.select(F.col("h").alias(k), F.col("block").alias(f"{k}_block"), F.col("c").alias(f"{k}_c")) for k in "ab"]
    keyed = store(edges.join(at[0], "a").join(at[1], "b").withColumn("key", F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block"))))
    needed = store(keyed.select("key", F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("a_c").alias("c")), F.struct(F.col("b").alias("h"), F.col("b_c").alias("c")))).alias("x")).select("key", "x.h", "x.c").distinct())
    wanted = F.broadcast(needed) if needed.count() <= SMALL else needed
    rows = sets.select("c", "s").join(wanted, "c").select("key", "h", F.lit(None).cast("long").alias("b"), "s")
    rows = rows.unionAll(keyed.select("key", F.col("a").alias("h"), "b", F.lit(None).cast("array<long>").alias("s")))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify(threshold), "a long, b long, similarity double")
