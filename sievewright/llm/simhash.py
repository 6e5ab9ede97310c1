"""SimHash near-deduplication with a Gray-order hierarchical index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._common import SMALL_ROWS, col, components, fresh, small, stored, table

BITS = 128
#: Two documents are near copies at this many differing bits or fewer.
DISTANCE = 20
#: Votes of a distinct word, and of a distinct pair of words that follow each other: the pairs tell orders apart.
WORD, PAIR = 10, 7
#: The first RING bits form a ring of DISTANCE + 1 parts. If two fingerprints differ in DISTANCE bits or fewer, there is a
#: part from which on, round the ring, the first j parts differ in j - 1 bits or fewer, for every j (pigeonring principle).
PARTS = DISTANCE + 1
PART = BITS // PARTS
RING = PART * PARTS
#: Where the index has nodes: after so many bits from the first part on.
LEVELS = (6, 9, 12, 15, 18, 21, 24, 30, 36, 42, 48, 60, 72, 96, RING, BITS)
#: Up to so many fingerprints, a bucket is what agrees in a part; beyond, buckets are split by so many bits more.
SPLITS = ((1 << 21, 0), (1 << 25, 3), (1 << 62, 6))
#: Node pairs that are compared at once, and pairs found that are held.
CHUNK = 1 << 19
#: Words whose hashes a worker remembers.
MEMO = 200_000

_WORD = re.compile(r"\w+")


class _Words:
    """Rows of hash bytes for words, kept between batches up to MEMO words."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = bytearray()

    def numbers(self, words: list[str]) -> np.ndarray:
        at, rows = self.at, self.rows
        for w in [w for w in dict.fromkeys(words) if w not in at]:
            at[w] = len(at)
            rows += blake2b(w.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest()
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def fingerprints(texts: list[str | None], memo: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 unsigned words, n flags: has it any word?). Each distinct word of the lower-cased text and each distinct pair of neighbours votes once on each bit."""
    memo = memo or _Words()
    out, some = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        if text and (words := _WORD.findall(text.lower())):
            if len(memo.at) > MEMO:
                memo.__init__()
            out[k], some[k] = _vote(memo, words), True
    return out, some


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (16 bytes each) have each bit."""
    out = np.zeros(BITS, np.int64)
    for lo in range(0, len(rows), 255):  # bytes are summed eight at once: no sum is above 255
        out += np.unpackbits(rows[lo : lo + 255], axis=1).view(np.uint64).sum(0).view(np.uint8)
    return out


def _vote(memo: _Words, words: list[str]) -> np.ndarray:
    at = memo.numbers(words)
    rows = np.frombuffer(memo.rows, "<u8").reshape(-1, 2)
    own = np.unique(at)
    votes = WORD * (2 * _ones(rows[own].view(np.uint8)) - len(own))
    if len(at) > 1:
        pairs = np.unique(at[:-1] << 32 | at[1:])
        mixed = rows[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + (rows[pairs & 0xFFFFFFFF] ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        votes += PAIR * (2 * _ones(mixed.view(np.uint8)) - len(pairs))
    return np.packbits(votes > 0).view(">u8")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Words()
    for b in batches:
        fps, some = fingerprints(b.column(1).to_pylist(), memo)
        fps, ids = fps.view(np.int64)[some], b.column(0).filter(pa.array(some))
        yield pa.RecordBatch.from_arrays([ids, pa.array(fps[:, 0]), pa.array(fps[:, 1])], names=["id", "hi", "lo"])


def _shift(hi: np.ndarray, lo: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit values shifted to the left by 0 to 127, or to the right by as much below 0."""
    none = np.zeros_like(hi)
    if by < 0:
        n = -by
        if n >= 64:
            lo, hi, n = hi, none, n - 64
        return (hi, lo) if not n else (hi >> np.uint64(n), lo >> np.uint64(n) | hi << np.uint64(64 - n))
    if by >= 64:
        hi, lo, by = lo, none, by - 64
    return (hi, lo) if not by else (hi << np.uint64(by) | lo >> np.uint64(64 - by), lo << np.uint64(by))


def _turn(hi: np.ndarray, lo: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints with the ring turned so that it begins at a part; the bits outside it stay last."""
    rest = np.uint64((1 << BITS - RING) - 1)
    a, b = _shift(hi, lo & ~rest, part * PART)
    c, d = _shift(*_shift(hi, lo, -(BITS - part * PART)), BITS - RING) if part else (np.zeros_like(hi), np.zeros_like(lo))
    return a | c, b & ~rest | d | lo & rest


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of each 128-bit value in Gray order: neighbours in this order differ in one bit."""

    def fold(x: np.ndarray) -> np.ndarray:
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ x >> np.uint64(s)
        return x

    hi, lo = fold(hi), fold(lo)
    return hi, np.where(hi & np.uint64(1), ~lo, lo)


class GrayIndex:
    """Distinct 128-bit fingerprints in Gray order, with nodes for the bit patterns that neighbours share.

    A node at level l stands for a run of fingerprints with the same first LEVELS[l] bits. near_pairs() walks
    pairs of nodes from a level down; a pair, and with it every pair of fingerprints below, is dropped as soon
    as the shared bits differ in more than is allowed so far: one bit less than the parts begun, DISTANCE at last.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray, top: int = PART) -> None:
        """top: the bits after which the walk begins; all fingerprints fall into one or two nodes there."""
        a, b = gray_rank(hi, lo)
        self.order = np.lexsort((b, a))
        self.hi, self.lo = hi[self.order], lo[self.order]
        levels = LEVELS[LEVELS.index(top) :]
        self.limits = [min(DISTANCE, -(-bits // PART) - 1) for bits in levels]
        self.masks = [(np.uint64((1 << 64) - (1 << 64 - min(bits, 64))), np.uint64((1 << 64) - (1 << 128 - max(bits, 64)) if bits > 64 else 0)) for bits in levels]
        self.first, self.child = [], []
        for h, l in self.masks:
            x, y = self.hi & h, self.lo & l
            self.first.append(np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64))
        # child[k]: where the children of each node of level k begin among the nodes of level k + 1
        for k in range(len(levels) - 1):
            self.child.append(np.searchsorted(self.first[k + 1], np.r_[self.first[k], len(hi)]))

    def near_pairs(self, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (of the arrays given) of all pairs within the limits, in pieces; across: only between the two top nodes."""
        tops, last = len(self.first[0]), len(self.masks) - 1
        if across and tops < 2 or not tops:
            return
        work = [(0, *self._kept(0, np.array([0]), np.array([int(across)])))]
        while work:
            level, u, v = work.pop()
            if level == last:
                apart = u != v
                if apart.any():
                    yield self.order[u[apart]], self.order[v[apart]]
                continue
            c = self.child[level]
            size = (c[u + 1] - c[u]) * (c[v + 1] - c[v])
            if size.sum() > CHUNK and len(u) > 1:
                half = min(max(1, int(np.searchsorted(np.cumsum(size), size.sum() // 2))), len(u) - 1)
                work += [(level, u[half:], v[half:]), (level, u[:half], v[:half])]
                continue
            if len(u) == 1 and size[0] > CHUNK:  # one pair of wide nodes: by rows
                for i in range(c[u[0]], c[u[0] + 1]):
                    j = np.arange(c[v[0]], c[v[0] + 1])
                    i, j = self._kept(level + 1, np.full(len(j), i), j)
                    if len(i):
                        work.append((level + 1, i, j))
                continue
            wide = (c[v + 1] - c[v])
            pair = np.repeat(np.arange(len(u)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i = c[u][pair] + k // wide[pair]
            j = c[v][pair] + k % wide[pair]
            i, j = self._kept(level + 1, i, j)
            if len(i):
                work.append((level + 1, i, j))

    def _kept(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = i <= j
        i, j = i[right], j[right]
        at, (h, l) = self.first[level], self.masks[level]
        p, q = at[i], at[j]
        d = np.bitwise_count((self.hi[p] ^ self.hi[q]) & h)
        if l:
            d = d + np.bitwise_count((self.lo[p] ^ self.lo[q]) & l)
        ok = d <= self.limits[level]
        return i[ok], j[ok]


def _forest(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root: the least position that each position is linked with so far; the same with the links u, v."""
    u, v = np.concatenate([u, np.arange(len(root))]), np.concatenate([v, root])
    while True:
        low = np.minimum(root[u], root[v])
        now = root.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _search(extra: int) -> Callable:
    """Rows (key, id, hi, lo) in order of key; keys are those of _keys(). Gives each row's link to the least row it is near to, directly or not."""

    def group(held: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        keys, ids, hi, lo = (np.concatenate(x) for x in zip(*held))
        if len(ids) < 2:
            return None
        key, least = int(keys[0]), int(ids.min())
        part, across = key >> PART + 2 * extra, key >> extra & (1 << extra) - 1 != key & (1 << extra) - 1
        index = GrayIndex(*_turn(hi.view(np.uint64), lo.view(np.uint64), part), PART + extra)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root, links, n = np.arange(len(ids)), [], 0
        for u, v in index.near_pairs(across):
            links.append((place[u], place[v]))
            n += len(u)
            if n > CHUNK:
                root, links, n = _forest(root, *(np.concatenate(x) for x in zip(*links))), [], 0
        if links:
            root = _forest(root, *(np.concatenate(x) for x in zip(*links)))
        linked = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[order][linked]), pa.array(ids[order][root[linked]])], names=["a", "b"]) if len(linked) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            cuts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True]) if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                piece = [c[lo:hi] for c in cols]
                if held and held[0][0][0] != piece[0][0]:
                    if out := group(held):
                        yield out
                    held = []
                held.append(piece)
        if held and (out := group(held)):
            yield out

    return run


def _bits(hi, lo, start: int, n: int):  # noqa: ANN001, ANN202
    """n bits of the ring from `start` on, as a number."""
    start %= RING
    if start + n > RING:
        first = RING - start
        return F.shiftleft(_bits(hi, lo, start, first), n - first).bitwiseOR(_bits(hi, lo, 0, n - first))
    end = start + n
    if end <= 64:
        bits = F.shiftrightunsigned(hi, 64 - end)
    elif start >= 64:
        bits = F.shiftrightunsigned(lo, 128 - end)
    else:
        bits = F.shiftleft(hi, end - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - end))
    return bits.bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _keys(hi, lo, extra: int = 0):  # noqa: ANN001, ANN202
    """A fingerprint's keys: for each part its number, its bits, and twice the `extra` bits after it.

    Within PART + 6 bits two near copies may differ in one bit. So a bucket is split by its extra bits into
    sub-buckets; a key stands for one of them or for two that differ in one bit, the lesser first.
    """
    out = []
    for p in range(PARTS):
        head = F.shiftleft(_bits(hi, lo, p * PART, PART) + F.lit(p << PART), 2 * extra)
        own = _bits(hi, lo, (p + 1) * PART, extra) if extra else F.lit(0).cast("long")
        for other in (own, *(own.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(extra))):
            out.append(head + F.shiftleft(F.least(own, other), extra) + F.greatest(own, other))
    return F.array(*out)


def near_groups(df: DataFrame, text: str = "text", order: str = "doc_id", extra: int | None = None) -> DataFrame:
    """(node, root): documents with a near copy, and the least document of their group; `order` may be of any type that sorts.

    Near copies are documents whose fingerprints differ in DISTANCE bits or fewer; groups are their connected
    components. The search is exact: every fingerprint goes to one task for each of its keys, and in some of
    them it meets each of its near copies. Equal fingerprints are searched as one, under a 64-bit hash. A
    document with several texts has a row for each of its groups. `extra` is set by SPLITS unless given.
    """
    ids = df.where(col(order).isNotNull()).select(col(order).alias("id"), col(text).alias("text"))
    kind = dict(ids.dtypes)["id"]
    fps = stored(ids.mapInArrow(_fingerprint_rows, f"id {kind}, hi long, lo long"), "simhash")
    one = F.xxhash64("hi", "lo")
    reps = stored(fps.groupBy("hi", "lo").agg(F.min("id").alias("least"), F.max("id").alias("most")).withColumn("c", one), "prints")
    if extra is None:
        n = reps.count()
        extra = next(x for most, x in SPLITS if n <= most)
    keyed = reps.select(F.explode(_keys(F.col("hi"), F.col("lo"), extra)).alias("key"), F.col("c").alias("id"), "hi", "lo")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_search(extra), "a long, b long")
    groups = components(stored(found, "edges"))
    least = reps.join(groups, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("g"), "least", "most", F.col("node").isNotNull().alias("linked"))
    roots = least.where("linked").groupBy("g").agg(F.min("least").alias("root"))
    place = least.where("linked or least <> most").join(roots, "g", "left").select("c", F.coalesce("root", "least").alias("root"))
    return fps.select("id", one.alias("c")).join(small(stored(place, "groups")), "c").select(F.col("id").alias("node"), "root").distinct()


def near_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", broadcast_rows: int = SMALL_ROWS, filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """The rows left when of each group of near copies only the document with the least `order` stays.

    Documents without a word (null, empty or only signs) are near nothing and stay, as do rows without `order`.
    Rows that share an `order` are one document: they go together if any of them is a near copy of a lesser one.
    Very long texts count whole. An empty table gives an empty one. Columns may have any names. The ids that go
    are applied as bloom.without() says, so that the texts of rows that stay never shuffle.
    """
    (node,) = fresh(df, "node")
    gone = stored(near_groups(df, text, order).where("node <> root").select(F.col("node").alias(node)).distinct(), "gone")
    return bloom.without(df, order, gone, gone.count(), broadcast_rows, filter_bytes)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of): the documents that go, each with the one of its group that stays."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.where("node <> root").groupBy(F.col("node").alias("doc_id")).agg(F.min("root").alias("duplicate_of"))


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
SQL: dict[str, str] = {}
