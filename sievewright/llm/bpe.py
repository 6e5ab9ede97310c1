"""Byte-level BPE: a minimal perfect hash for pre-tokens in the vocabulary, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, table

#: The vocabulary: a line for each token, its bytes in base 64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into pre-tokens; every character belongs to one.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a task remembers, and bytes in them, about.
MEMO, LETTERS = 200_000, 8 << 20
#: Characters that are encoded at once.
CHUNK = 1 << 22


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens in order of rank, which is their id."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [t for _, t in pairs]


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n places (hash and displace).

    Keys fall into buckets; each bucket, the largest first, gets the first displacement that sends all its keys
    to free places; buckets of one key take what is left. find() must still compare the key at the place.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        h = _hash(keys)
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys have the same hash, or are equal")
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.place = np.full(self.n, -1, np.int64)  # place -> key
        free = np.ones(self.n, bool)
        order = np.argsort(b, kind="stable")
        starts = np.searchsorted(b[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        single = []
        for k in np.argsort(-sizes, kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if len(own) < 2:
                single += [(k, own[0])] if len(own) else []
                continue
            at = 0
            while True:
                d = np.arange(at, at + 256)
                spots = self._spots(h[own], d[:, None])
                ok = free[spots].all(1)
                if len(own) > 1 and ok.any():
                    s = np.sort(spots, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    hit = int(ok.argmax())
                    self.shift[k], self.place[spots[hit]] = at + hit, own
                    free[spots[hit]] = False
                    break
                at += 256
                if at > 1 << 22:
                    raise ValueError("no displacement found")
        for (k, key), spot in zip(single, np.flatnonzero(free)):
            self.shift[k], self.place[spot] = -1 - spot, key

    def _spots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The place of a hash under a displacement."""
        z = (h ^ d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (z >> np.uint64(32)).astype(np.int64) % self.n

    def find(self, words: list[bytes]) -> np.ndarray:
        """For each word the number of the only key that it can be."""
        h = _hash(words)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.place[np.where(d < 0, -1 - d, self._spots(h, np.maximum(d, 0)))]


def _hash(words: list[bytes]) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w) for w in words), np.uint64, len(words))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of all neighbours the pair that is the token of least rank joins first, leftmost if equal.

    The heap holds rank, place and end of each pair that is a token, as one number; a pair of which a part has
    been joined since is passed over when it comes up.
    """
    n = len(word)
    get = ranks.get
    w = n.bit_length() + 1
    low = (1 << w) - 1
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is joined to another
    before = list(range(-1, n - 1))
    heap = [(r << w | i) << w | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, stop = x >> w & low, x & low
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                push(heap, (r << w | i) << w | end[stop])
        j = before[i]
        if j >= 0 and (r := get(word[j:stop])) is not None:
            push(heap, (r << w | j) << w | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Encodes and decodes lists of texts; a copy of it is broadcast to the tasks (a few MB, whatever the table)."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.tokens = read_vocabulary(path)
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        self.hash = PerfectHash(self.tokens)
        if missing := 256 - sum(len(t) == 1 for t in self.tokens):
            raise ValueError(f"{missing} bytes have no token of their own")
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "pattern", "letters", "flat", "at", "size")}

    def _ready(self) -> None:
        if not hasattr(self, "pattern"):
            self.pattern = regex.compile(PATTERN)
            self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.letters = 0
        self.flat = np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Ids of pre-tokens that are not remembered: tier one by the hash, tier two by the heap."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        found, flat, size = self.hash.find(raw).tolist(), [], []
        for w, k in zip(raw, found):
            if self.tokens[k] == w:
                flat.append(k)
                size.append(1)
            else:
                ids = merge(w, self.ranks)
                flat += ids
                size.append(len(ids))
        self.letters += sum(map(len, raw))
        base = len(self.memo)
        for k, w in enumerate(words):
            self.memo[w] = base + k
        size = np.array(size, np.int64)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin; one more for the end)."""
        self._ready()
        if len(self.memo) > MEMO or self.letters > LETTERS:
            self._forget()
        words, counts = [], []
        for t in texts:
            own = self.pattern.findall(t)
            counts.append(len(own))
            words += own
        new = [w for w in set(words) if w not in self.memo]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, np.cumsum(counts)]
        return ids, np.r_[0, ends][cuts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a row of ids."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(tok: Tokenizer, texts: pa.Array) -> pa.StructArray:
    """struct(ids, n_tokens, exact) of each text; all null for null. exact: do the decoded ids give the text's bytes again?"""
    raw = texts.cast(pa.large_binary())
    values, valid = raw.to_pylist(), np.array(raw.is_valid().to_numpy(zero_copy_only=False))
    ids, sizes, exact = [], np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    lo = 0
    while lo < len(values):
        hi, total = lo, 0
        while hi < len(values) and (hi == lo or total + len(values[hi] or b"") <= CHUNK):
            total += len(values[hi] or b"")
            hi += 1
        own = [v or b"" for v in values[lo:hi]]
        some, at = tok.encode([v.decode("utf-8", "surrogateescape") for v in own])
        ids.append(some)
        sizes[lo:hi] = np.diff(at)
        back, places = tok.decode(some), np.r_[0, np.cumsum(tok.lengths[some])][at].tolist()
        back = back.tobytes()
        exact[lo:hi] = [back[a:b] == v for a, b, v in zip(places, places[1:], own)]
        lo = hi
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~valid, False])
    lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
    return pa.StructArray.from_arrays([lists, pa.array(sizes, mask=~valid), pa.array(exact, mask=~valid)], ["ids", "n_tokens", "exact"])


def encode_column(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The frame with one more column `out`: struct(ids array<int>, n_tokens, exact); a column of that name is replaced.

    Every text is encoded whole and decoded again; exact tells whether its bytes came back. The ids of a null
    text are null, those of an empty one an empty array; bytes that are no UTF-8 are encoded as they are.
    Equal texts get equal ids. The vocabulary's size is fixed by its file, and with it what is broadcast.
    """
    tok = df.sparkSession.sparkContext.broadcast(Tokenizer(vocabulary))

    @F.arrow_udf("struct<ids: array<int>, n_tokens: long, exact: boolean>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield encoded(tok.value, b)

    return df.withColumn(out, tokens(col(text)))


def decode_column(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The frame with the text of the ids as column `out`, in place of one of that name: null for null, empty for no ids. Unknown ids are an error."""
    tok = df.sparkSession.sparkContext.broadcast(Tokenizer(vocabulary))

    @F.arrow_udf("binary")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else tok.value.decode(np.array(x, np.int64)).tobytes() for x in b.to_pylist()], pa.binary())

    return df.withColumn(out, text_of(col(ids)).cast("string"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "tokens.ids", "tokens.n_tokens", "tokens.exact")


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
SQL: dict[str, str] = {}
