"""Line deduplication by a segment-partition edit join with banded bit-parallel verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._common import SMALL_ROWS, col, fresh, stored, table

#: (least bytes of the shorter line, edits that two near lines may differ by); shorter lines must be equal.
BANDS = ((100, 3), (40, 2), (20, 1))
LEAST, MOST = min(n for n, _ in BANDS), max(k for _, k in BANDS)
#: Pairs that are verified, or formed, at once.
CHUNK = 1 << 13
#: Entries of a key that one task pairs; a key that more lines share is split into blocks of about as many.
HOT = 1 << 15
#: Numbers of lines that a task remembers.
MEMO = 500_000
#: Bytes of texts that are taken at once.
BYTES = 1 << 18
#: Bits of a line's number that tell which of so many groups of bytes it holds an odd number of times.
SIGNS = 24
_ODD = 0x9E3779B97F4A7C15
#: Groups of bytes: each of the most common letters, the digits, and the rest by their low bits.
_SIGN = np.uint32(1) << np.array([b"etaoinsrhldcumfp".find(bytes([b]).lower()) if bytes([b]).lower() in b"etaoinsrhldcumfp" else 16 if 48 <= b < 58 else 17 + b % 7 for b in range(256)], np.uint32)


def allowed(n: int) -> int:
    """Edits allowed when the shorter of two lines has n bytes."""
    return next((k for least, k in BANDS if n >= least), 0)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of n bytes, as equal as can be, longer ones last."""
    base, more = divmod(n, edits + 1)
    sizes = [base + (k > edits - more) for k in range(edits + 1)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(edits + 1)]


def offsets(edits: int, longer: int, k: int) -> range:
    """Where in a line that is `longer` bytes longer the segment k may stand, relative to its place (multi-match-aware selection)."""
    i = k + 1
    return range(max(-(i - 1), longer - (edits + 1 - i)), min(i - 1, longer + edits + 1 - i) + 1)


class _Powers:
    """Tables for hashes of substrings: sums of (a random number for each byte) x B^place, modulo 2^64, and the inverse powers of B."""

    def __init__(self) -> None:
        self.byte = np.random.default_rng(11).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Lines:
    """The lines of LEAST bytes or more, blank ones left out, of a batch of texts: where they stand, and hashes of any parts of them."""

    def __init__(self, texts: pa.Array, powers: _Powers) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        feeds = np.flatnonzero(self.data == 10)
        # a text ends a line too, and an empty one has one
        ends = np.concatenate([feeds, offsets[1:]])
        order = np.argsort(ends * 2 + np.r_[np.zeros(len(feeds), np.int64), np.ones(len(offsets) - 1, np.int64)], kind="stable")
        ends, closes = ends[order], order >= len(feeds)
        self.doc = np.r_[0, np.cumsum(closes)[:-1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        starts = np.where(np.r_[True, closes[:-1]], offsets[:-1][self.doc] if len(ends) else 0, np.r_[0, ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        first = np.searchsorted(self.doc, np.arange(len(offsets) - 1))
        self.number_in = np.arange(len(ends)) - first[self.doc] if len(ends) else ends
        keep = np.flatnonzero(ends - starts >= LEAST)
        if len(blank := keep[self.data[starts[keep]] == 32]):  # only what begins with a space can be all spaces
            keep = np.setdiff1d(keep, [k for k in blank if not self.data[starts[k] : ends[k]].tobytes().strip(b" ")])
        self.doc, self.number_in, self.start, self.size = self.doc[keep], self.number_in[keep], starts[keep], (ends - starts)[keep]
        powers.reach(len(self.data) + 1)
        self.powers = powers
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        terms = powers.byte[self.data]
        terms *= powers.up[: len(terms)]
        np.cumsum(terms, out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.powers.down[start])

    def numbers(self) -> np.ndarray:
        """63 bits for each line: SIGNS parity bits, then bits of its hash; equal lines have equal numbers."""
        h = self.hashes(self.start, self.size) >> np.uint64(SIGNS + 1)
        if len(self.start):
            flips = np.zeros(len(self.data) + 1, np.uint32)
            np.bitwise_xor.accumulate(_SIGN[self.data], out=flips[1:])
            h |= (flips[self.start + self.size] ^ flips[self.start]).astype(np.uint64) << np.uint64(63 - SIGNS)
        return h.view(np.int64)

    def only(self, at: np.ndarray) -> None:
        for k in ("doc", "number_in", "start", "size"):
            setattr(self, k, getattr(self, k)[at])

    def entries(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, refs): the lines' own segments, and the substrings that may be a segment of an equally long or shorter line.

        A ref is a line's number, doubled, plus one if the key is of an own segment.
        """
        keys, refs = [], []
        for band, (least, edits) in enumerate(BANDS):
            most = BANDS[band - 1][0] - 1 if band else 1 << 62
            for longer in range(edits + 1):
                m = self.size - longer  # length of the line whose segments are looked for
                at = np.flatnonzero((m >= least) & (m <= most))
                m, n, at_start, twice = m[at], self.size[at], self.start[at], number[at] << 1
                base, more = m // (edits + 1), m % (edits + 1)
                for k in range(edits + 1):
                    start = base * k + np.maximum(0, more - (edits + 1 - k))
                    size = base + (more > edits - k)
                    salt = _mixed((m * (MOST + 1) + k).astype(np.uint64))
                    for off in offsets(edits, longer, k):
                        place = start + off
                        ok = (place >= 0) & (place + size <= n)
                        keys.append(self.hashes((at_start + place)[ok], size[ok]) ^ salt[ok])
                        refs.append(twice[ok] | int(longer == 0 and off == 0))
        return np.concatenate(keys).view(np.int64), np.concatenate(refs)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BYTES bytes, so that what is computed of them stays in a core's cache; a longer text is a run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).tolist()
    lo = done = 0
    for k, end in enumerate(ends):
        if end - done >= BYTES or k == len(ends) - 1:
            yield lo, k + 1
            lo, done = k + 1, end


class _Distinct:
    """The lines of texts, each once for a task as far as MEMO numbers are remembered, so that copies do not swell what shuffles."""

    def __init__(self) -> None:
        self.powers, self.seen = _Powers(), set()

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = Lines(texts, self.powers)
        number, at = np.unique(lines.numbers(), return_index=True)
        new = np.array([x not in self.seen for x in number.tolist()], bool)
        if len(self.seen) > MEMO:
            self.seen = set()
        self.seen.update(number.tolist())
        lines.only(at[new])
        return lines.entries(number[new])


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ref): the entries of keys that 16 lines or more of a batch share."""
    lines = _Distinct()
    for b in batches:
        parts = [lines.entries(b.column(0)[lo:hi]) for lo, hi in _chunks(b.column(0))]
        if parts:
            key, ref = (np.concatenate(x) for x in zip(*parts))
            often, times = np.unique(key, return_counts=True)
            often = often[times >= 16]
            at = np.flatnonzero(_among(key, often))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ref[at])], names=["key", "ref"])


def _entries(hot) -> Callable:  # noqa: ANN001
    """(key, ref) of all lines. hot: broadcast (sorted keys, blocks of each): an entry of a hot key goes to every pair of blocks that its own is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, (hot_keys, blocks) = _Distinct(), hot.value
        for column, lo, hi in ((b.column(0), *x) for b in batches for x in _chunks(b.column(0))):
            key, ref = lines.entries(column[lo:hi])
            if len(hot_keys):
                place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                warm = np.flatnonzero(hot_keys[place] == key)
                of = blocks[place[warm]]
                own = (_mixed(ref[warm].view(np.uint64) >> np.uint64(1)) % of.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(warm)), of)
                other = np.arange(len(again)) - np.repeat(np.cumsum(of) - of, of)
                pair = np.minimum(own[again], other) * 1_000_003 + np.maximum(own[again], other) + 1
                split = _mixed(key[warm][again].view(np.uint64) + pair.astype(np.uint64) * np.uint64(_ODD)).view(np.int64)
                cold = np.ones(len(key), bool)
                cold[warm] = False
                key, ref = np.concatenate([key[cold], split]), np.concatenate([ref[cold], ref[warm][again]])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ref)], names=["key", "ref"])

    return run


def _wanted(kind: str, test: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Rows (doc_id, text): (w, doc_id, line_no, line) of the lines whose numbers pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for ids, texts, lo, hi in ((*b.columns, *x) for b in batches for x in _chunks(b.column(1))):
            lines = Lines(texts[lo:hi], powers)
            number = lines.numbers()
            lines.only(at := np.flatnonzero(test(number)))
            data = lines.data.tobytes()
            cut = [data[i : i + n] for i, n in zip(lines.start.tolist(), lines.size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(number[at]), ids.take(pa.array(lines.doc + lo)), pa.array(lines.number_in.astype(np.int32)), pa.array(cut, pa.binary())], names=["w", "doc_id", "line_no", "line"])

    return run


def banded(a: list[bytes], b: list[bytes], most: np.ndarray) -> np.ndarray:
    """The edit distance of each pair, or most + 1 if it is greater; the lengths of a pair differ by most at the utmost.

    Bit-parallel over a band of 2 most + 1 diagonals (Hyyro, 2003), for all pairs at once: word i of a pair holds
    the vertical differences of column i, its top bit the lowest row of the band.
    """
    swap = [(y, x) if len(x) < len(y) else (x, y) for x, y in zip(a, b)]
    order = sorted(range(len(swap)), key=lambda k: -len(swap[k][1]))
    out = np.zeros(len(swap), np.int64)
    one, u = np.uint64(1), np.uint64
    for lo in range(0, len(order), CHUNK):
        own = order[lo : lo + CHUNK]
        k = most[own].astype(np.int64)
        n1, n2 = (np.array([len(swap[p][s]) for p in own], np.int64) for s in (0, 1))
        pad = int(k.max(initial=0))
        wide = int(n1.max(initial=0)) + 2 * pad + 1
        # long lines cost memory for each pair: the texts are laid out in a row, not in a square
        s1 = np.frombuffer(b"".join(b"\0" * pad + swap[p][0] + b"\0" * (pad + 1) for p in own), np.uint8)
        at1 = np.cumsum(n1 + 2 * pad + 1) - (n1 + 2 * pad + 1) + pad
        s2 = np.frombuffer(b"".join(swap[p][1] for p in own), np.uint8)
        at2 = np.cumsum(n2) - n2
        vp = u(0xFFFFFFFFFFFFFFFF) << (63 - k).astype(u)
        vn = np.zeros(len(own), u)
        dist, low = k.copy(), np.full(len(own), 62, np.int64)
        live = len(own)
        for i in range(int(n2.max(initial=0))):
            while live and n2[live - 1] <= i:  # sorted by length: the ended ones are last
                live -= 1
            c = s2[at2[:live] + i]
            x = np.zeros(live, u)
            for off in range(-pad, pad + 1):
                place = i + off
                hit = (s1[np.minimum(at1[:live] + place, len(s1) - 1)] == c) & (place >= 0) & (place < n1[:live]) & (abs(off) <= k[:live])
                x |= hit.astype(u) << (63 - k[:live] + off).clip(0, 63).astype(u)
            p, q = vp[:live], vn[:live]
            d0 = (((x & p) + p) ^ p) | x | q
            hp = q | ~(d0 | p)
            hn = d0 & p
            inside = i < n1[:live] - k[:live]
            dist[:live] += np.where(inside, (d0 >> u(63)) ^ one, (hp >> low[:live].astype(u) & one) - (hn >> low[:live].astype(u) & one)).astype(np.int64)
            low[:live] -= ~inside
            vp[:live] = hn | ~((d0 >> one) | hp)
            vn[:live] = (d0 >> one) & hp
        out[own] = np.where(dist <= k, dist, k + 1)
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ref) in order of key; ref is a line's number, doubled, plus one if the key is of its own segments.

    Gives each pair of different lines of a key of which one has it as a segment and whose signs allow MOST edits.
    """

    def group(refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        refs = np.unique(refs)
        refs = refs.view(np.uint64)
        own, every = (refs[refs & np.uint64(1) == 1] >> np.uint64(1)).view(np.int64), np.unique(refs >> np.uint64(1)).view(np.int64)
        signs, mine = every >> 63 - SIGNS, np.isin(every, own, assume_unique=True)
        for lo in range(0, len(own), step := max(1, CHUNK * 16 // max(1, len(every)))):
            some = own[lo : lo + step]
            # an edit makes at most two of the parities others
            i, j = np.nonzero(np.bitwise_count((some >> 63 - SIGNS)[:, None] ^ signs[None]) <= 2 * MOST)
            a, b = some[i], every[j]
            keep = (a != b) & (~mine[j] | (a < b))
            if keep.any():
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ref = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held and key[0] != held_key:
            yield from group(np.concatenate(held))
            held = []
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        starts = cuts[:-1]
        # a run matters if it has two lines or more, and a segment among them; the first and last may go on elsewhere
        line = ref.view(np.uint64) >> np.uint64(1)
        runs = (np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)) & (np.bitwise_or.reduceat(ref, starts) & 1 == 1)
        for g in np.flatnonzero(runs) if not held else np.r_[0, np.flatnonzero(runs[1:]) + 1]:
            lo, hi = cuts[g], cuts[g + 1]
            if g == 0 and held:
                held.append(ref[lo:hi])
                if sum(map(len, held)) > 1 << 20:  # copies of a line in many tasks
                    held = [np.unique(np.concatenate(held))]
                if hi < len(key):
                    yield from group(np.concatenate(held))
                    held = []
            elif hi < len(key):
                yield from group(ref[lo:hi])
        if not held:
            held_key, held = key[-1], [ref[cuts[-2] :]]
    if held:
        yield from group(np.concatenate(held))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a_..., b_...) with both lines as the last columns: those within the edits allowed, with the distance for them."""
    for batch in batches:
        n = batch.num_columns
        x, y = (batch.column(k).cast(pa.large_binary()).to_pylist() for k in (n - 2, n - 1))
        most = np.array([allowed(min(len(p), len(q))) for p, q in zip(x, y)], np.int64)
        fits = np.array([abs(len(p) - len(q)) for p, q in zip(x, y)], np.int64) <= most
        at = np.flatnonzero(fits & (most > 0))
        d = banded([x[k] for k in at], [y[k] for k in at], most[at])
        ok = d <= most[at]
        rows = batch.take(pa.array(at[ok]))
        yield pa.RecordBatch.from_arrays([*rows.columns[: n - 2], pa.array(d[ok])], names=[*batch.schema.names[: n - 2], "distance"])


def lines_of(df: DataFrame, text: str, order: str) -> DataFrame:
    """(doc_id, line_no, line, n, h, h2): the lines that are not blank, as bytes, with two hashes."""
    split = df.select(col(order).alias("doc_id"), F.posexplode(F.split(col(text), "\n")).alias("line_no", "text"))
    split = split.where((F.trim("text") != "") & F.col("doc_id").isNotNull())
    return split.select("doc_id", "line_no", F.encode("text", "UTF-8").alias("line")).select(
        "doc_id", "line_no", "line", F.octet_length("line").alias("n"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def line_duplicates(df: DataFrame, text: str = "text", order: str = "doc_id", broadcast_rows: int = SMALL_ROWS, filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """(doc_id, line_no, of_doc_id, of_line_no, distance): lines that repeat an earlier one, with the first that they repeat.

    Lines end at line feeds and count from 0; blank ones (empty or spaces) are left out. A line repeats another
    if they are equal, or their edit distance over bytes is within BANDS. `of` is the first place, by doc_id and
    line_no, of the equal lines or of any line near them. Null texts have no lines, nor have rows without
    doc_id, which may be of any type that sorts. Rows that share a doc_id are one document: a line of theirs with
    equal number and text is one line. An empty table gives an empty one; other columns are not read.

    The join is complete: of two near lines the longer holds one of the edits + 1 segments of the shorter at one
    of the places that offsets() gives. Only hashes of segments and numbers of lines shuffle; a segment that many
    lines share is paired by many tasks (HOT), and pairs whose signs are too far apart are never formed. The lines
    themselves are fetched for candidates alone: their numbers are broadcast, above broadcast_rows a Bloom filter of
    them within filter_bytes is, and the lines that it passes shuffle to an exact join.
    """
    spark = df.sparkSession
    lines = lines_of(df, text, order)
    first = lines.select("h", "h2", "doc_id", "line_no").groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("pos"), F.max(F.struct("doc_id", "line_no")).alias("end"))
    # candidates: pairs of lines by number
    rows = df.where(col(order).isNotNull() & col(text).isNotNull()).select(col(order).alias("doc_id"), col(text).cast("binary").alias("text"))
    heavy = rows.select("text").mapInArrow(_heavy, "key long, ref long").groupBy("key").agg(F.approx_count_distinct("ref", 0.1).alias("n")).where(F.col("n") > HOT // 2).orderBy("key").toArrow()
    keys, n = (heavy[k].to_numpy().astype(np.int64) for k in ("key", "n"))
    hot = spark.sparkContext.broadcast((keys, -(-n * 2 // HOT) + 1))
    entries = rows.select("text").mapInArrow(_entries(hot), "key long, ref long")
    found = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a long, b long").distinct()
    found = stored(found, "line-pairs")
    # their texts
    wanted = stored(found.select(F.col("a").alias("w")).unionAll(found.select(F.col("b").alias("w"))).distinct(), "line-numbers")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"w long, doc_id {kind}, line_no int, line binary"
    if (many := wanted.count()) <= broadcast_rows:
        known = spark.sparkContext.broadcast(np.sort(wanted.toArrow()["w"].to_numpy()))
        texts = rows.mapInArrow(_wanted(schema, lambda x: _among(x, known.value)), schema)
    else:
        bits, ranges, folds = bloom.build(wanted, many, 1, filter_bytes)
        texts = rows.mapInArrow(_wanted(schema, lambda x: bloom.hits(x, np.frombuffer(bits.value, np.uint8), ranges, folds)), schema).join(wanted.hint("merge"), "w", "left_semi")
    texts = texts.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    texts = stored(texts.groupBy("w", "h", "h2").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("x")).select("w", "h", "h2", "x.*"), "lines")
    sides = [texts.select(*[F.col(c).alias(f"{s}_{c}") for c in ("w", "h", "h2", "doc_id", "line_no", "line")]) for s in "ab"]
    pairs = found.join(sides[0], F.col("a") == F.col("a_w")).join(sides[1], F.col("b") == F.col("b_w"))
    kept = {"h": "long", "h2": "long", "doc_id": kind, "line_no": "int"}
    pairs = pairs.select(*[f"{s}_{c}" for s in "ab" for c in kept], "a_line", "b_line")
    near = stored(pairs.mapInArrow(_verify, ", ".join(f"{s}_{c} {k}" for s in "ab" for c, k in kept.items()) + ", distance long"), "near-lines")
    both = near.select(F.col("a_h").alias("h"), F.col("a_h2").alias("h2"), F.struct(F.col("b_doc_id").alias("doc_id"), F.col("b_line_no").alias("line_no"), "distance").alias("m")).unionAll(
        near.select(F.col("b_h").alias("h"), F.col("b_h2").alias("h2"), F.struct(F.col("a_doc_id").alias("doc_id"), F.col("a_line_no").alias("line_no"), "distance").alias("m"))
    )
    nearest = both.groupBy("h", "h2").agg(F.min("m").alias("m"))
    # places: only of lines that occur more than once or are near another
    of = first.join(nearest, ["h", "h2"], "left").where("end > pos or m is not null")
    at = lines.select("h", "h2", "doc_id", "line_no").distinct().join(of.select("h", "h2", "pos", "m"), ["h", "h2"])
    here = F.struct("doc_id", "line_no")
    that = F.struct(F.col("m.doc_id").alias("doc_id"), F.col("m.line_no").alias("line_no"))
    to_near = F.col("m").isNotNull() & (that < F.col("pos"))
    at = at.select("doc_id", "line_no", F.when(to_near, that).otherwise(F.col("pos")).alias("of"), F.when(to_near, F.col("m.distance")).otherwise(F.lit(0)).alias("distance"))
    return at.where(F.col("of") < here).select("doc_id", "line_no", F.col("of.doc_id").alias("of_doc_id"), F.col("of.line_no").alias("of_line_no"), "distance")


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Is each of x in the sorted array?"""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def drop_lines(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The frame without the lines that repeat an earlier one; rows and columns stay, a text may become empty. Columns may have any names."""
    node, gone = fresh(df, "node", "gone")
    out = line_duplicates(df, text, order).groupBy(F.col("doc_id").alias(node)).agg(F.collect_set("line_no").alias(gone))
    out = df.join(out, col(order) == col(node), "left")
    left = F.array_join(F.filter(F.split(col(text), "\n"), lambda x, i: ~F.array_contains(col(gone), i)), "\n")
    new = F.when(col(gone).isNull(), col(text)).otherwise(left)
    return out.select(*[new.alias(c) if c == text else col(c) for c in df.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS line_no, unnest(a) AS line FROM s),
        o AS (SELECT DISTINCT *, strlen(line) AS n FROM l WHERE trim(line) <> ''),
        d AS (SELECT line, n, min((doc_id, line_no)) AS pos FROM o GROUP BY ALL),
        p AS (
            SELECT x.line AS a, y.line AS b, x.pos AS a_pos, y.pos AS b_pos, levenshtein(x.line, y.line) AS distance,
                CASE {' '.join(f'WHEN x.n >= {n} THEN {k}' for n, k in BANDS)} ELSE 0 END AS allowed
            FROM d x JOIN d y ON y.n BETWEEN x.n AND x.n + {max(k for _, k in BANDS)} AND x.line <> y.line
                AND (y.n > x.n OR x.line < y.line) AND x.n >= {min(n for n, _ in BANDS)}),
        q AS (SELECT * FROM p WHERE distance <= allowed),
        m AS (
            SELECT line, min((pos, distance)) AS m FROM (
                SELECT a AS line, b_pos AS pos, distance FROM q UNION ALL SELECT b, a_pos, distance FROM q) GROUP BY line),
        r AS (
            SELECT o.doc_id, o.line_no, CASE WHEN m.m IS NOT NULL AND m.m[1] < d.pos THEN m.m[1] ELSE d.pos END AS "of",
                CASE WHEN m.m IS NOT NULL AND m.m[1] < d.pos THEN m.m[2] ELSE 0 END AS distance
            FROM o JOIN d USING (line) LEFT JOIN m USING (line))
        SELECT doc_id, line_no::INTEGER AS line_no, "of"[1] AS of_doc_id, "of"[2]::INTEGER AS of_line_no, distance::BIGINT AS distance
        FROM r WHERE "of" < (doc_id, line_no)""",
}
