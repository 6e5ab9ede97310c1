"""Pairs of near vectors by products of int8 tiles with error bounds: what joins by cosine are built on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a tile, about, and tiles at least (if they have LEAST vectors or more), so that small tables occupy a cluster too.
TILE, TILES, LEAST = 1 << 17, 8, 1024
#: Vectors of a tile in one row, and rows of a tile that are multiplied at once.
PIECE, ROWS = 1 << 14, 512
#: What sums of products in double precision may be off by, generously.
SLACK = 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of what was lost) of unit vectors: x = scale * values + lost."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - scale[:, None] * q) ** 2).sum(1))
    return q, scale, lost


def unit(rows: list, n: int) -> np.ndarray:
    """Vectors of n numbers, at length 1; first by the greatest value, so that squares neither vanish nor overflow."""
    x = np.array(rows, np.float64).reshape(len(rows), n)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


Tile = tuple[np.ndarray, ...]  # int8 values, scale, norm of what was lost, and the vectors as they were if they are wanted


def near_pairs(x: Tile, y: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, certain?) of all pairs that may be at the threshold or above; same: x is y, and each pair comes once.

    With unit vectors s q + e and t r + f, their product is off from s t q.r by at most |e| (1 + |f|) + |f|. A pair
    is certain if it is above the threshold by that much, left out if it is below by that much. The products of
    int8 values are whole numbers below 2^24 (2^53 for long vectors), so exact in floating point, which is how
    numpy multiplies fast.
    """
    (q, s, e), (r, t, f) = x[:3], y[:3]
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for lo in range(0, len(q), ROWS):
        from_ = lo if same else 0
        rr, tt, ff = r[from_:].astype(exact), t[from_:], f[from_:]
        for at in range(0, len(rr), 1 << 15):
            part = slice(at, at + (1 << 15))
            product = q[lo : lo + ROWS].astype(exact) @ rr[part].T
            el, sl = e[lo : lo + ROWS, None], s[lo : lo + ROWS, None]
            # the least bound of the block finds the few rows and columns worth a closer look
            least = (threshold - SLACK - el - (1 + el) * ff[part].max(initial=0)) / (sl * tt[part].max(initial=1e-300))
            i, j = np.nonzero(product >= np.nextafter(np.maximum(least, 0).astype(exact), exact(-np.inf)))
            d = product[i, j].astype(np.float64) * sl[i, 0] * tt[part][j]
            off = el[i, 0] * (1 + ff[part][j]) + ff[part][j] + SLACK
            ok = d >= threshold - off
            i, j, d, off = i[ok] + lo, j[ok] + from_ + at, d[ok], off[ok]
            if same:
                ok = i < j
                i, j, d, off = i[ok], j[ok], d[ok], off[ok]
            if len(i):
                yield i, j, d >= threshold + off


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list]]:
    """(length, places, vectors) by length of the vectors that have a direction."""
    by: dict[int, list[int]] = {}
    rows = column.to_pylist()
    for k, v in enumerate(rows):
        if v and None not in v:
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and np.abs(a).max() > 0:
                by.setdefault(len(v), []).append(k)
    for n, at in by.items():
        yield n, np.array(at), [rows[k] for k in at]


def _assign(pivots, whole: bool) -> Callable:  # noqa: ANN001
    """Rows (c, v): (c, n, cell, angle, q, scale, lost, v): the nearest pivot of the vector's length, the angle to it, and the quantised vector; if `whole`, as it was too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for n, at, rows in by_length(b.column(1)):
                x = unit(rows, n)
                if n in known:
                    d = x @ known[n].T
                    cell = d.argmax(1)
                    angle = np.arccos(np.clip(d[np.arange(len(x)), cell], -1, 1))
                else:  # no pivot of this length: one cell that reaches everywhere
                    cell, angle = np.zeros(len(x), np.int64), np.full(len(x), np.pi)
                q, scale, lost = quantise(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(x), n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(scale), pa.array(lost), pa.array([np.array(v, np.float64).tobytes() if whole else b"" for v in rows], pa.binary())], names=["c", "n", "cell", "angle", "q", "scale", "lost", "v"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, cell, part, c, q, scale, lost, v) in order of tile: a row for each PIECE vectors of a tile, or fewer."""

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        n, cell, part = (t[k][0].as_py() for k in ("n", "cell", "part"))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((n, pa.int32()), (cell, pa.int32()), (part, pa.int32()), (t["c"].to_numpy().tobytes(), pa.binary()), (b"".join(t["q"].to_pylist()), pa.binary()), (t["scale"].to_numpy().tobytes(), pa.binary()), (t["lost"].to_numpy().tobytes(), pa.binary()), (b"".join(t["v"].to_pylist()), pa.binary()))], names=["n", "cell", "part", "c", "q", "scale", "lost", "v"])

    now, held, size = None, [], 0
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True]) if b.num_rows else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for at in range(lo, hi, PIECE):
                own, few = tuple(key[lo]), min(hi - at, PIECE)
                if held and (now != own or size + few > PIECE):
                    yield done(held)
                    held, size = [], 0
                now, size = own, size + few
                held.append(b.slice(at, few))
    if held:
        yield done(held)


def _partners(pivots, tiles, reach: float) -> Callable:  # noqa: ANN001
    """Rows (tile,): rows (pair, n, cell, part, side) for each tile of that number and each later one that it may be near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, all_tiles = pivots.value, tiles.value
        total = len(all_tiles["n"])
        for b in batches:
            for i in b.column(0).to_pylist():
                n, cell, angle = all_tiles["n"][i], all_tiles["cell"][i], all_tiles["angle"][i]
                j = np.arange(i, total)[all_tiles["n"][i:] == n]
                if n in known:
                    apart = np.arccos(np.clip(known[n][all_tiles["cell"][j]] @ known[n][cell], -1, 1))
                    j = j[(j == i) | (apart <= angle + all_tiles["angle"][j] + reach)]
                pair = i * total + j
                both = np.r_[np.full(len(j), i), j[j != i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[pair, pair[j != i]]), *(pa.array(all_tiles[k][both]) for k in ("n", "cell", "part")), pa.array(np.r_[np.zeros(len(j), np.int32), np.ones((j != i).sum(), np.int32)])], names=["pair", "n", "cell", "part", "side"])

    return run


def _pairs_of_tiles(found: Callable) -> Callable:
    """Rows (pair, side, c, q, scale, lost, v) in order of pair: what `found` gives for the numbers, and the tile, of either side; of one tile alone for both."""

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        sides, tiles = t["side"].to_numpy(), []
        for side in (0, 1):
            at = np.flatnonzero(sides == side)
            if len(at):
                ids, scale, lost = (np.frombuffer(b"".join(t[k][int(i)].as_py() for i in at), d) for k, d in (("c", np.int64), ("scale", np.float64), ("lost", np.float64)))
                tiles.append((ids, (np.frombuffer(b"".join(t["q"][int(i)].as_py() for i in at), np.int8).reshape(len(ids), -1), scale, lost, np.frombuffer(b"".join(t["v"][int(i)].as_py() for i in at)).reshape(len(ids), -1))))
        yield from found(*tiles[0], *tiles[-1], len(tiles) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, key in enumerate(b.column(0).to_pylist()):
                if held and now != key:
                    yield from group(held)
                    held = []
                now = key
                held.append(b.slice(k, 1))
        if held:
            yield from group(held)

    return run


def tile_pairs(vectors: DataFrame, count: int, threshold: float, found: Callable, schema: str, store: Callable[[DataFrame, str], DataFrame], whole: bool = False, tile: int | None = None) -> DataFrame:
    """What `found` gives for every pair of tiles of (c, v) that may hold a pair of vectors at the threshold; c are distinct bigints, `count` of them.

    The vectors fall to the nearest of some pivots (drawn by a hash, as many as there are tiles); cells of many vectors
    are split at random into tiles of int8 values. Pairs of tiles whose directions (the pivots', give or take the
    widest angle within) are too far apart for the threshold are left out. Vectors without a direction are in no
    tile. store: computes a frame once, into a folder that all executors share. whole: tiles hold the vectors as they were too. tile: vectors in one at most, TILE if None.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    wanted = max(-(-count // (tile or TILE)), min(TILES, count // LEAST), 1)
    drawn: dict[int, list] = {}
    for b in vectors.where("v is not null").orderBy(F.xxhash64("c"), "c").limit(wanted).select("v").toArrow().to_batches():
        for n, _, some in by_length(b.column(0)):
            drawn.setdefault(n, []).extend(some)
    pivots = sc.broadcast({n: unit(some, n) for n, some in drawn.items()})
    placed = store(vectors.where("v is not null").select("c", "v").mapInArrow(_assign(pivots, whole), "c long, n int, cell int, angle double, q binary, scale double, lost double, v binary"), "placed")
    size = max(1, -(-count // wanted))
    cells = placed.groupBy("n", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    tiled = placed.join(F.broadcast(cells), ["n", "cell"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    known = tiled.groupBy("n", "cell", "part").agg(F.max("angle").alias("angle")).orderBy("n", "cell", "part").toArrow()
    tiles = sc.broadcast({k: known[k].to_numpy() for k in known.column_names})
    number = spark.range(0, known.num_rows, 1, min(max(1, known.num_rows), 2000))
    pairs = number.mapInArrow(_partners(pivots, tiles, float(np.arccos(min(1.0, threshold))) + 1e-6), "pair long, n int, cell int, part int, side int")
    key = ["n", "cell", "part"]
    pieces = store(tiled.select(*key, "c", "q", "scale", "lost", "v").repartition(max(1, min(known.num_rows, 2000)), *key).sortWithinPartitions(*key).mapInArrow(_pieces, "n int, cell int, part int, c binary, q binary, scale binary, lost binary, v binary"), "tiles")
    tasks = max(1, min(known.num_rows * (known.num_rows + 1) // 2, 20_000))
    sent = pieces.join(pairs, key).select("pair", "side", "c", "q", "scale", "lost", "v").repartition(tasks, "pair").sortWithinPartitions("pair")
    return sent.mapInArrow(_pairs_of_tiles(found), schema)
