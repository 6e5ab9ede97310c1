"""Language identification with a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import col, fresh, table

#: Bytes in a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
#: The network is fitted on at most so many labelled documents of each language (the least by a hash of doc_id).
SAMPLE_ROWS = 250
#: The class of what is no language: it is trained on made-up noise.
NONE = "und"
#: A text is rejected as noise at a higher probability of noise than this.
NOISE = 0.8
STEPS, BATCH, RATE = 500, 192, 0.01
#: Windows scored at once.
CHUNK = 512


class Network:
    """Filters over one-hot bytes (so that a filter is a sum of table rows), ReLU, max over places, softmax."""

    def __init__(self, classes: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def _maps(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for w, t in zip(WIDTHS, self.tables):
            places = x.shape[1] - w + 1
            y = t[0].take(x[:, :places], axis=0)
            for j in range(1, w):
                y += t[j].take(x[:, j : j + places], axis=0)
            yield y

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: windows of byte values, n x WINDOW, short ones filled up with 0."""
        pooled = np.concatenate([y.max(1) for y in self._maps(x)], 1)
        return _softmax(np.maximum(pooled, 0) @ self.out + self.bias)

    def fit(self, draw, steps: int = STEPS) -> Network:  # noqa: ANN001
        """draw() -> (windows, class numbers). Adam on the cross-entropy."""
        params = [*self.tables, self.out, self.bias]
        m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
        for step in range(1, steps + 1):
            x, y = draw()
            maps = list(self._maps(x))
            at = [z.argmax(1) for z in maps]
            pooled = np.concatenate([np.take_along_axis(z, a[:, None], 1)[:, 0] for z, a in zip(maps, at)], 1)
            on = np.maximum(pooled, 0)
            d = _softmax(on @ self.out + self.bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ self.out.T) * (pooled > 0)
            grads = []
            rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
            for k, w in enumerate(WIDTHS):
                g = np.zeros((w, 256, FILTERS), np.float32)
                for j in range(w):
                    np.add.at(g[j], (x[rows, at[k] + j], np.broadcast_to(filters, at[k].shape)), back[:, k * FILTERS : (k + 1) * FILTERS])
                grads.append(g)
            grads += [on.T @ d, d.sum(0)]
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _noise(rng: np.random.Generator, n: int) -> np.ndarray:
    """Windows that are no language: random bytes, signs and digits, hexadecimal, one character over and over, random letters."""
    kinds = [bytes(range(1, 256)), b"0123456789 .,;:-+*/=()[]{}<>#$%&!?@_|~^", b"0123456789abcdef", None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    x = np.zeros((n, WINDOW), np.uint8)
    for k in range(n):
        letters = kinds[k % len(kinds)] or bytes([rng.integers(1, 256)])
        x[k] = np.frombuffer(letters, np.uint8)[rng.integers(0, len(letters), WINDOW)]
    return x


def train(rows: list[tuple[str, str]], seed: int = 7, steps: int = STEPS) -> Network:
    """rows: (language, text). Languages without a text are unknown to the network; with none at all it knows only noise."""
    texts: dict[str, list[np.ndarray]] = {}
    for lang, text in rows:
        if lang and text:
            texts.setdefault(lang, []).append(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    classes = [*sorted(texts), NONE]
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    # a window is drawn in proportion to the length of its text
    joined = {c: (np.concatenate(t), np.cumsum([len(x) for x in t])) for c, t in texts.items()}

    def draw() -> tuple[np.ndarray, np.ndarray]:
        y = rng.integers(0, len(classes), BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        noise = np.flatnonzero(y == len(classes) - 1)
        x[noise] = _noise(rng, len(noise))
        for k in np.flatnonzero(y < len(classes) - 1):
            data, ends = joined[classes[y[k]]]
            at = int(rng.integers(0, len(data)))
            end = min(int(ends[np.searchsorted(ends, at, "right")]), at + WINDOW)
            x[k, : end - at] = data[at:end]
        # half the windows are cut short, as the ends of texts are
        short = np.flatnonzero(rng.random(BATCH) < 0.5)
        lengths = np.exp(rng.uniform(np.log(6), np.log(WINDOW), len(short))).astype(int)
        x[short] = np.where(np.arange(WINDOW) < lengths[:, None], x[short], 0)
        return x, y

    return net.fit(draw, steps)


def classify(net: Network, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """(language, its probability, rejected?) of each text, from all its windows, each weighing as many bytes as it has.

    Rejected are null and empty texts and those that are noise rather than any known language.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    counts = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    have = np.minimum((offsets[:-1] + lengths)[doc] - start, WINDOW)
    sums = np.zeros((len(lengths), len(net.classes)))
    place = np.arange(WINDOW)
    for lo in range(0, len(doc), CHUNK):
        s, n, d = start[lo : lo + CHUNK], have[lo : lo + CHUNK], doc[lo : lo + CHUNK]
        at = s[:, None] + place
        x = np.where(place < n[:, None], data[np.minimum(at, len(data) - 1)], 0)
        p = net.probabilities(x) * n[:, None]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        sums[d[first]] += np.add.reduceat(p, first, axis=0)
    p = sums / np.maximum(lengths, 1)[:, None]
    known = p[:, :-1]
    some = (lengths > 0) & (known.shape[1] > 0)
    best = known.argmax(1) if known.shape[1] else np.zeros(len(p), int)
    rejected = ~some | (p[:, -1] > NOISE)
    top = np.where(rejected, np.where(some, p[:, -1], 0.0), known[np.arange(len(p)), best] if known.shape[1] else 0.0)
    names = [None if not n else NONE if r else net.classes[b] for n, r, b in zip(lengths, rejected, best)]
    return names, top, rejected


def trained(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on at most sample_rows labelled documents of each language, the least by a hash.

    Languages are counted first; a cutoff of the hash then leaves some four times the rows wanted of each, so
    that what is ranked does not grow with the table.
    """
    labelled = df.where(col(lang).isNotNull() & (F.length(col(text)) > 0))
    counts = {r[0]: r[1] for r in labelled.groupBy(col(lang)).count().collect()}
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (4 * sample_rows + 100) / n))])
    labelled = labelled.select(col(lang).alias("lang"), col(text).alias("text"), F.xxhash64(col(order), col(text)).alias("h"))
    drawn = labelled.where(F.pmod("h", F.lit(1 << 53)) < share[F.col("lang")] * float(1 << 53))
    some = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 53)), "text"))).where(F.col("rank") <= sample_rows)
    return train(sorted((r.lang, r.text) for r in some.select("lang", "text").collect()))


def identify(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", out: str = "identified", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The frame with one more column `out`: struct(language, confidence, rejected).

    Every byte of every text is scored, in windows of WINDOW bytes. A null or empty text has no language (null),
    confidence 0 and is rejected; noise has the language "und". Without a labelled row all texts are rejected.
    Equal texts get equal results. Columns may have any names but `out`.
    """
    net = df.sparkSession.sparkContext.broadcast(trained(df, text, lang, order, sample_rows))

    @F.arrow_udf("struct<language: string, confidence: double, rejected: boolean>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            names, top, rejected = classify(net.value, b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(top), pa.array(rejected)], ["language", "confidence", "rejected"])

    return df.withColumn(out, scored(col(text)))


def known_language(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The rows whose text is neither null, empty nor taken for noise, and in a language of `keep` if given; columns as they were.

    A text in a language without labels has no class of its own: it stays, under the name of a known language,
    unless the network takes it for the made-up noise.
    """
    (out,) = fresh(df, "identified")
    found = identify(df, text, lang, order, out, sample_rows).where(~F.col(out + ".rejected"))
    return (found if keep is None else found.where(F.col(out + ".language").isin(keep))).drop(out)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", "identified.language", "identified.confidence", "identified.rejected")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
