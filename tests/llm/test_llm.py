"""The operators against brute force, on hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import bloom, bpe, embedding_dedup, exact_dedup, langid, line_dedup, lm_score, mixing, pii, simhash, warc
from sievewright.llm import _common, registry
from sievewright.llm._common import components, fresh
from sievewright.operators import tiles

#: Columns whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, flag boolean, rank int, node long, root long, epoch int, `copies` int, identified string, tokens string"
EXTRA = (1, True, 2, 3, 4, 5, 6, "x", "y")
LONG = " ".join("the " + "".join(random.Random(k).choices(string.ascii_lowercase, k=6)) for k in range(20_000))
HARD = [
    (1, "the cat and the dog went to the house on the hill", "en", "a"), (2, "the cat and the dog went to the house on the hill", "en", "a"),
    (3, "", "en", "a"), (4, "", "de", "b"), (5, None, "en", None), (6, None, None, "b"), (7, LONG, "en", "b"), (8, LONG + " end", "en", "b"),
    (None, "der Hund und die Katze", "de", None), (None, "der Hund und die Katze", "de", None), (9, "der Hund und die Katze", "de", "b"), (9, "der Hund und die Katze", "de", "b"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in HARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, spark, duck, small, same_rows):
    same_rows(registry.QUERIES[name](spark, small), duck.execute(registry.SQL[name]).fetchdf())


def test_fresh_names(empty):
    assert fresh(empty, "hash", "Node", "new") == ["hash_", "Node_", "new"]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    root = {k: k for e in edges for k in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact deduplication


def test_exact_hard(hard, empty):
    out = exact_dedup.exact_dedup(hard)
    assert out.columns == hard.columns
    assert Counter((r.doc_id, (r.text or "")[-9:]) for r in out.collect()) == Counter([(1, " the hill"), (3, ""), (5, ""), (6, ""), (7, LONG[-9:]), (8, LONG[-5:] + " end"), (9, "die Katze")])
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 1 << 19])
def test_exact_folds(spark, limit, monkeypatch):
    """A filter of several ranges, all broadcast or folded onto one; the result is the same."""
    monkeypatch.setattr(bloom, "SLOTS", 1 << 14)
    df = spark.createDataFrame([(k, f"text {k % 700}") for k in range(1000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df, filter_bytes=limit).collect()) == list(range(700))
    _, ranges, folds = bloom.build(df.select(F.xxhash64("text")), 1000, 2, limit)
    assert ranges > 1 and folds == (1 if limit == 1 << 19 else ranges)


@pytest.mark.parametrize("most", [1000, 0])
def test_without(spark, hard, most):
    """By a broadcast and by a filter: the same rows stay, with null keys, clashing names and keys of text."""
    gone = spark.createDataFrame([(1,), (9,), (77,)], "gone long")
    assert Counter(r.doc_id for r in bloom.without(hard, "doc_id", gone, 3, most).collect()) == Counter(r[0] for r in HARD if r[0] not in (1, 9))
    names = spark.createDataFrame([("x",), (None,), ("y",)], "name string")
    assert {r.name for r in bloom.without(names, "name", spark.createDataFrame([("x",)], "gone string"), 1, most).collect()} == {None, "y"}


def test_bloom_misses_nothing(spark):
    df = spark.range(5000).select((F.col("id") % 4000).alias("k")).select(F.xxhash64("k").alias("h"), "k")
    marked = exact_dedup.possibly_repeated(df, "h", "f")
    flagged = {r.k for r in marked.where("f").collect()}
    assert set(range(1000)) <= flagged
    assert len(flagged) < 1000 + 0.1 * 3000


# SimHash


def test_gray_rank_is_a_walk():
    lo = np.arange(64, dtype=np.uint64)
    _, rank = simhash.gray_rank(np.zeros(64, np.uint64), lo)
    order = np.argsort(rank)
    assert (np.bitwise_count(lo[order][1:] ^ lo[order][:-1]) == 1).all()


def test_gray_index_finds_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (60, 2)).astype(np.uint64) * 2
    rows = [base]
    for d in (1, 5, 12, 19, 20, 21, 22):
        x = base.copy()
        for r in range(len(x)):
            for b in rng.choice(128, d, replace=False):
                x[r, b // 64] ^= np.uint64(1 << int(b % 64))
        rows.append(x)
    x = np.unique(np.concatenate(rows), axis=0)
    near = sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(int) for k in range(2)) <= simhash.DISTANCE
    df = spark.createDataFrame([(k, int(h), int(l)) for k, (h, l) in enumerate(x.view(np.int64))], "id long, hi long, lo long")
    for _ in range(7):
        near = near @ near
    for extra in (0, 3, 6):
        keyed = df.select(F.explode(simhash._keys(F.col("hi"), F.col("lo"), extra)).alias("key"), "id", "hi", "lo")
        found = keyed.repartition(5, "key").sortWithinPartitions("key").mapInArrow(simhash._search(extra), "a long, b long").collect()
        links = np.eye(len(x), dtype=bool)
        for r in found:
            links[r.a, r.b] = links[r.b, r.a] = True
        for _ in range(7):
            links = links @ links
        assert (links == near).all(), extra


def test_order_of_words_counts():
    apart = lambda a, b: int(np.bitwise_count(np.bitwise_xor(*simhash.fingerprints([a, b])[0])).sum())
    assert apart("a b c d e", "e d c b a") > simhash.DISTANCE
    assert apart("the price of gold rose today in london", "the price of gold fell today in london") > simhash.DISTANCE
    assert apart("The price, of gold", "the price of  gold") == 0


def test_near_copies_with_ids_of_text(spark):
    t = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([("b", t), ("a", t + " more"), ("c", "something else"), ("d", t)], "doc_id string, text string")
    assert sorted(map(tuple, simhash.near_groups(df).collect())) == [("a", "a"), ("b", "a"), ("d", "a")]
    for most in (100, 0):
        assert sorted(r.doc_id for r in simhash.near_dedup(df, broadcast_rows=most).collect()) == ["a", "c"]


def test_near_copies_are_caught(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    r, made = random.Random(3), []
    for k, t in rows:
        w = t.split(" ")
        if len(w) > 60:
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "changed"
            made.append((10_000 + k, " ".join(w)))
    both = spark.createDataFrame(rows + made, "doc_id long, text string")
    root = {x.node: x.root for x in simhash.near_groups(both).collect()}
    caught = sum(root.get(k, k) == root.get(k - 10_000, k - 10_000) for k, _ in made)
    assert caught >= 0.95 * len(made)
    # against all pairs of fingerprints
    fps, some = simhash.fingerprints([t for _, t in rows + made])
    d = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(2))
    ids = [k for k, _ in rows + made]
    near = {tuple(sorted((ids[i], ids[j]))) for i, j in zip(*np.nonzero(d <= simhash.DISTANCE)) if i < j and some[i] and some[j]}
    assert all(root[a] == root[b] for a, b in near) and set(root) == {k for p in near for k in p}


def test_near_hard(hard, empty):
    out = simhash.near_dedup(hard)
    assert out.columns == hard.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, 5, 6, 7, None, None, 9, 9])
    assert simhash.near_dedup(empty).count() == 0


# mixing


def test_mix_budgets(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 30))), r.choice("aab") if k % 5 else None) for k in range(400)] + [(3, "x y", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"a": 1.0, "b": 3.0}, total=9000).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    taken, copies = Counter(), Counter()
    for x in out:
        taken[x.source] += x.tokens_taken
        copies[(x.source, x.epoch)] += x.n_tokens
    assert taken == {"a": 2250, "b": 6750}
    for s in "ab":
        whole = taken[s] // size[s]
        assert all(copies[(s, e)] == size[s] for e in range(whole))
        assert sum(x.tokens_taken < x.n_tokens for x in out if x.source == s) <= 1


def test_mix_hard(hard, empty, spark):
    out = mixing.mix(hard)
    assert out.agg(F.sum("tokens_taken")).first()[0] <= sum(len((r[1] or "").split()) for r in HARD)
    rows = mixing.mix_rows(hard)
    assert rows.columns == hard.columns
    whole = mixing.mix(hard).groupBy("doc_id", "source").count().collect()
    got = {(r.doc_id, r.source): r["count"] for r in rows.groupBy("doc_id", "source").count().collect()}
    assert set(got) == {(r.doc_id, r.source) for r in whole}
    assert mixing.mix(empty).count() == mixing.mix_rows(empty).count() == 0
    assert mixing.mix(hard, {}).count() == 0
    long = F.length("text").cast("long")
    by_length = mixing.mix_rows(hard, tokens=F.coalesce(long, F.lit(0)))
    want = mixing.mix(hard, tokens=F.coalesce(long, F.lit(0))).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in by_length.collect()} == {r.doc_id for r in want}


# tokens


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer()


def test_perfect_hash_is_minimal(tok):
    h = tok.hash
    assert sorted(h.place) == list(range(len(tok.tokens)))
    assert [tok.tokens[k] for k in h.find(tok.tokens)] == tok.tokens
    assert all(tok.tokens[k] != b"no such token here" for k in h.find([b"no such token here"]))


def test_bpe_is_that_of_a_public_library(tok, spark, small):
    import tiktoken

    other = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ["", "  \n\t x", "don't 日本語 ½² 12 é́ 👩‍👩‍👧", "x" * 5000, "\x00", LONG]
    got = bpe.encoded(tok, pa.array(texts))
    assert got.field("ids").to_pylist() == [other.encode_ordinary(t) for t in texts]
    assert all(got.field("exact").to_pylist())


def test_merge_against_a_plain_loop(tok):
    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranks = [(tok.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 1 << 30:
                return [tok.ranks[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choices("abeinstté ", k=r.randrange(1, 30))).encode()
        assert bpe.merge(word, tok.ranks) == plain(word)


def test_bpe_hard(hard, empty):
    assert bpe.encode_column(hard).columns == hard.columns and bpe.encode_column(hard).where("doc_id = 3").first().tokens.n_tokens == 0
    rows = bpe.encode_column(hard, out="coded").select("doc_id", "text", "coded.*").collect()
    assert len(rows) == len(HARD)
    assert all((r.ids is None) == (r.text is None) and (r.exact or r.text is None) for r in rows)
    assert {r.n_tokens for r in rows if r.text == ""} == {0}
    back = bpe.decode_column(bpe.encode_column(hard, out="coded").select("doc_id", F.col("text").alias("was"), "coded.ids"))
    assert back.where("not text <=> was").count() == 0
    assert bpe.encode_column(empty, out="coded").count() == 0


# personal data


def test_pii_kinds():
    a = pii.automaton()
    cases = {
        "mail a.b+c@x.example.com. now": [("email", "a.b+c@x.example.com")], "not@this or @that": [], "DE89 3704 0044 0532 0130 00 ok": [("iban", "DE89 3704 0044 0532 0130 00")],
        "+49 30 1234 5678, or +1 (743) 555-3824 227.5.221.1": [("phone", "+49 30 1234 5678"), ("phone", "+1 (743) 555-3824"), ("ip", "227.5.221.1")],
        "ssn 123-45-6789 or 000-45-6789": [("ssn", "123-45-6789")], "4111111111111111 4111111111111112": [("card", "4111111111111111")],
        "see https://x.example.com/a?b=c). www.foo.org": [("url", "https://x.example.com/a?b=c"), ("url", "www.foo.org")], "foo://x.example.com": [],
        "account no. 12345678": [("account", "12345678")], "token = \"0123456789abcdef0123\"": [("secret", "0123456789abcdef0123")], "token ring": [],
        "version 3.0, 256.1.1.1, 1.2.3.4.5": [], "İ@x.com": [("email", "İ@x.com")],
    }
    for t, want in cases.items():
        assert [(k, t[lo:hi]) for lo, hi, k in pii.find(t, a)] == want, t


def test_anchors_miss_nothing(spark, small):
    """Against every parser at every place."""
    a = pii.automaton()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text) < 5000]
    r = random.Random(4)
    texts += ["".join(r.choices("a1 @.+-()4:/", k=80)) for _ in range(300)]
    for t in texts:
        low, found = pii._lower(t), []
        for word, parsers in pii.ANCHORS.items():
            for at in range(len(t)):
                if low.startswith(word, at) and not (word.isdigit() and at and t[at - 1].isdigit() and t[at - 1].isascii()):
                    found += [f for _, p in parsers if (f := p(t, at)) is not None]
        assert pii.find(t, a) == pii.settle(found)


def test_pii_against_independent_patterns(spark, small):
    """Places that patterns of their own find in the documents, and in made-up sentences, are found."""
    import re

    a = pii.automaton()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    r = random.Random(6)
    word = lambda n: "".join(r.choices(string.ascii_lowercase, k=n))
    digits = lambda n: "".join(r.choices(string.digits, k=n))
    for _ in range(300):
        card = digits(15)
        check = next(c for c in string.digits if sum((int(d) * 2 - 9 * (int(d) > 4)) if k % 2 else int(d) for k, d in enumerate(reversed(card + c))) % 10 == 0)
        texts.append(f"so {word(5)}.{word(3)}@{word(6)}.{word(4)}.com, {card}{check} and 10.{r.randrange(256)}.{r.randrange(256)}.7 or https://{word(5)}.org/{word(4)}?q={digits(3)} {word(4)} +49 {digits(3)} {digits(7)}")
    patterns = {
        "email": re.compile(r"(?<![\w.+%-])[a-z0-9]+(?:\.[a-z0-9]+)*@(?:[a-z0-9]+\.)+[a-z]{2,}(?![\w.-]*\w)"), "ip": re.compile(r"(?<![\d.\w-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)(?!\w)"),
        "url": re.compile(r"(?<!\w)https?://[a-z0-9.-]+/[a-z0-9]+\?q=\d+(?= )"), "phone": re.compile(r"(?<![\w+])\+49 \d{3} \d{7}(?!\w)"), "card": re.compile(r"(?<=, )\d{16}(?= and)"),
    }
    seen = Counter()
    for t in texts:
        got = {(kind, t[lo:hi]) for lo, hi, kind in pii.find(t, a)}
        for kind, p in patterns.items():
            for m in p.finditer(t):
                assert (kind, m.group()) in got, (kind, m.group(), got)
                seen[kind] += 1
    assert all(seen[k] >= 250 for k in patterns), seen


def test_pii_hard(hard, empty, spark):
    assert pii.entities(hard).count() == pii.entities(empty).count() == 0
    df = spark.createDataFrame([(1, "x@y.example.com"), (1, "x@y.example.com"), (None, "x@y.example.com"), (2, None)], "doc_id long, text string")
    assert pii.entities(df).count() == 3
    assert {r.text for r in pii.redact(df).collect()} == {"[EMAIL]", None}


# language


def test_language_held_out(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.trained(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("text", "lang").toPandas()
    names, _, rejected = langid.classify(net, pa.array(held.text))
    assert np.mean([a == b for a, b in zip(names, held.lang)]) > 0.98
    assert rejected.mean() < 0.005
    noise = langid._noise(np.random.default_rng(1), 50)
    assert langid.classify(net, pa.array([bytes(x).decode("latin-1") for x in noise]))[2].mean() > 0.9
    # every window counts: a text of two languages is of that which is longer, wherever it stands
    en, de = (held[held.lang == k].text.str.cat(sep=" ") for k in ("en", "de"))
    assert langid.classify(net, pa.array([de[:3000] + en[:9000], en[:3000] + de[:9000]]))[0] == ["en", "de"]


def plain_probabilities(net, data):
    """One window by plain loops over one-hot bytes: filters, ReLU of the greatest, softmax."""
    x = list(data[: langid.WINDOW]) + [0] * (langid.WINDOW - len(data))
    pooled = []
    for w, t in zip(langid.WIDTHS, net.tables):
        for f in range(langid.FILTERS):
            pooled.append(max(0.0, max(sum(float(t[j, x[i + j], f]) for j in range(w)) for i in range(langid.WINDOW - w + 1))))
    z = [sum(p * float(net.out[k, c]) for k, p in enumerate(pooled)) + float(net.bias[c]) for c in range(len(net.classes))]
    e = [np.exp(v - max(z)) for v in z]
    return np.array(e) / sum(e)


def test_network_against_plain_loops():
    net = langid.Network(["a", "b", langid.NONE], seed=3)
    net.bias[:] = [0.1, -0.2, 0.3]
    r = random.Random(1)
    texts = ["".join(r.choices("abc é", k=n)) for n in (1, 2, 60, 128, 129, 300)] + ["", None]
    names, top, rejected = langid.classify(net, pa.array(texts))
    for t, name, p, bad in zip(texts, names, top, rejected):
        raw = (t or "").encode()
        if not raw:
            assert (name, p, bad) == (None, 0.0, True)
            continue
        pieces = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        want = sum(plain_probabilities(net, x) * len(x) for x in pieces) / len(raw)
        assert bad == (want[-1] > langid.NOISE)
        assert p == pytest.approx(want[-1] if bad else want[:2].max(), rel=1e-4)
        assert name == (langid.NONE if bad else "ab"[int(want[:2].argmax())])


def test_network_gradient_by_differences(monkeypatch):
    """A step of the optimiser from zero moments goes by the sign of the gradient, which differences of the loss give too."""
    rng = np.random.default_rng(5)
    net = langid.Network(["a", "b"], seed=4)
    x, y = rng.integers(97, 101, (6, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 6)
    loss = lambda n: -np.log(n.probabilities(x)[np.arange(6), y]).mean()
    before = [p.astype(np.float64) for p in (*net.tables, net.out, net.bias)]
    stepped = langid.Network(["a", "b"], seed=4).fit(lambda: (x, y), steps=1)
    checked = 0
    for k, (p, q) in enumerate(zip(before, (*stepped.tables, stepped.out, stepped.bias))):
        moved = (q - p).ravel()
        for i in rng.permutation(np.flatnonzero(np.abs(moved) > 1e-4))[:12]:
            sides = []
            for d in (1e-3, -1e-3):
                n = langid.Network(["a", "b"], seed=4)
                ps = [*n.tables, n.out, n.bias]
                for own, was in zip(ps, before):
                    own[...] = was
                ps[k].reshape(-1)[i] += d
                sides.append(loss(n))
            slope = (sides[0] - sides[1]) / 2e-3
            if abs(slope) > 1e-4:
                assert np.sign(moved[i]) == -np.sign(slope), (k, i)
                checked += 1
    assert checked > 30


def test_network_gradient_learns():
    rows = [("a", "abab" * 50), ("b", "xyxy" * 50)]
    net = langid.train(rows, steps=60)
    assert langid.classify(net, pa.array(["abababab" * 9, "xyxyxyxy" * 9]))[0] == ["a", "b"]


def test_language_hard(hard, empty):
    out = langid.known_language(hard)
    assert out.columns == hard.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 7, 8, None, None, 9, 9])
    assert langid.known_language(empty).count() == 0
    assert Counter(r.doc_id for r in langid.known_language(hard, keep=["de"]).collect()) == Counter([None, None, 9, 9])
    unlabelled = hard.withColumn("lang", F.lit(None).cast("string"))
    assert langid.known_language(unlabelled).count() == 0


@pytest.mark.parametrize("text, want", [
    ("call (017) 555-7713 now", [("phone", "(017) 555-7713")]), ("at 555-123-4567.", [("phone", "555-123-4567")]), ("Tel. 030 1234567", [("phone", "030 1234567")]),
    ("phone number is 555 1234", [("phone", "555 1234")]), ("Telefon: (030) 1234 5678", [("phone", "(030) 1234 5678")]), ("my account number is 12345678", [("account", "12345678")]),
    ("Konto Nummer ist 12345678", [("account", "12345678")]), ("+1 (743) 555-3824", [("phone", "+1 (743) 555-3824")]), ("hotel 1234567, phone 12, (2023) 100-2000, (see 12) 5551234", []),
    ("tel 10.20.30.40", [("ip", "10.20.30.40")]), ("1-555-123-4567-9", []), ("phone: +49 30 1234 5678", [("phone", "+49 30 1234 5678")]), ("account nothing 123456", []), ("+49 627 3258851", [("phone", "+49 627 3258851")]), ("+17435553824", [("phone", "+17435553824")]), ("+1 743555", []), ("a +5 or +12 345", []),
])
def test_pii_national_phones_and_linked_accounts(text, want):
    assert [(kind, text[lo:hi]) for lo, hi, kind in pii.find(text, pii.automaton())] == want



# language-model scores


def test_lm_gradient():
    m = lm_score.Model(np.ones(lm_score.SIZE))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    w, t, _ = lm_score.windows([np.arange(40) % 7, np.arange(5)])
    _, g = m.gradient(w, t)
    n = (t >= 0).sum()
    for key, x in m.p.items():
        i = int(np.abs(g[key]).argmax())
        flat, old = x.reshape(-1), x.reshape(-1)[i]
        flat[i] = old + 1e-5
        up = m.score(w, t).sum()
        flat[i] = old - 1e-5
        down = m.score(w, t).sum()
        flat[i] = old
        assert g[key].reshape(-1)[i] == pytest.approx(-(up - down) / 2e-5 / n, rel=1e-4), key


def test_lm_scores_each_token_once_by_plain_attention():
    rng = np.random.default_rng(0)
    m = lm_score.Model(rng.integers(1, 100, lm_score.SIZE))
    doc = rng.integers(0, lm_score.SIZE, 70)
    w, t, _ = lm_score.windows([doc])
    assert (t[t >= 0] == doc).all()
    p, line, want = m.p, [lm_score.BEGIN, *doc[:-1]], 0.0
    for i, goal in enumerate(doc):
        first = max(0, i // lm_score.STEP * lm_score.STEP - lm_score.BEFORE)
        seen = np.arange(first, i + 1)
        s = np.array([p["q"][line[i]] @ p["k"][line[j]] * lm_score.WIDTH**-0.5 + p["far"][i - j] for j in seen])
        a = np.exp(s - s.max())
        z = np.maximum((a / a.sum()) @ p["v"][[line[j] for j in seen]] @ p["o"] + p["x"][line[i]] + p["h"], 0)
        c, k = m.clas[goal], m.member[goal]
        for y, at in ((z @ p["c"] + p["cb"], c), (z @ p["m"][c] + p["mb"][c], k)):
            want += y[at] - np.log(np.exp(y).sum())
    assert lm_score.score(m, [doc])[0] == pytest.approx(want, rel=1e-5)


def test_lm_prefers_what_it_knows(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    noise = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=3000))
    out = lm_score.lm_scores(docs.unionAll(spark.createDataFrame([(-1, noise)], docs.schema))).toPandas().set_index("doc_id")
    assert out.perplexity[-1] > 1.5 * out.perplexity.drop(-1).median()


def test_lm_trains_on_every_window(spark):
    docs = [(k, np.full(n, k, "<u2").tobytes()) for k, n in enumerate([1, 5, 24, 25, 100, 700, 0] * 5)] + [(None, np.full(3, 50, "<u2").tobytes())]
    tokens = spark.createDataFrame(docs, "doc_id long, ids binary")
    rounds, trainers = 3, 4
    got = lm_score.parts(tokens, rounds, trainers)
    assert Counter(bytes(r.ids) for r in got.collect()) == Counter(x for _, x in docs if x)
    model, seen = lm_score.Model(np.ones(lm_score.SIZE)), 0
    for k in range(rounds):
        own = got.where(f"round = {k}").repartition(trainers, "trainer").sortWithinPartitions("trainer", "z").select("trainer", "ids")
        made = own.mapInArrow(lm_score._trainer(spark.sparkContext.broadcast(model), 0.001), "trainer long, n long, params binary")
        seen += sum(r.n for r in made.collect())
    assert seen == sum(-(-len(x) // 2 // lm_score.STEP) for _, x in docs)


def test_lm_sees_hundreds_of_subwords_back():
    r = np.random.default_rng(3)
    m, doc = lm_score.Model(np.ones(lm_score.SIZE)), r.integers(0, lm_score.SIZE, 1000)
    at = lambda d: m.score(*lm_score.windows([d])[:2]).ravel()
    for place in (300, 511, 512, 767, 900):
        other = doc.copy()
        other[place - 200] = (other[place - 200] + 1) % lm_score.SIZE
        assert at(doc)[place] != at(other)[place]


def test_lm_steps_grow_with_the_corpus():
    steps = [lm_score.plan(n)[0] for n in (0, 10**6, 10**8, 10**10)]
    assert steps == sorted(set(steps))
    assert all(a * b * lm_score.TRAINER >= n for n in (0, 1, 10**6, 10**9) for a, b in [lm_score.plan(n)])


def test_lm_forms_what_the_texts_need():
    """Not the places without targets, nor positions that are fills."""
    m = lm_score.Model(np.ones(lm_score.SIZE))
    w, t, _ = lm_score.windows([np.arange(5), np.arange(lm_score.STEP + 3)])
    _, (_, kept) = m._attend(w, t >= 0, keep=True)
    assert [s.shape for _, _, _, s, *_ in kept] == [(5, 5), (lm_score.STEP, lm_score.STEP), (3, lm_score.BEFORE + 3)]


def test_lm_forms_a_product_for_each_different_subword():
    """However often a window has it."""
    m = lm_score.Model(np.ones(lm_score.SIZE))
    w, t, _ = lm_score.windows([np.full(lm_score.STEP + 44, 7), np.arange(90) % 3])
    _, (_, kept) = m._attend(w, t >= 0, keep=True)
    assert [s.shape for _, _, _, s, *_ in kept] == [(lm_score.STEP, 2), (44, 2), (90, 4)]


def test_lm_sums_of_rows_and_by_distance():
    r = np.random.default_rng(6)
    at, rows = np.minimum(r.integers(0, 40, 900) ** 2 // 30, 30), r.normal(size=(501, 300))
    own, at = lm_score._distinct(at, 40)
    rows[-1], which = 0, r.integers(0, 500, 900)
    want = np.zeros((len(own), 300))
    np.add.at(want, at, rows[which])
    assert np.allclose(lm_score._sums(rows, which, at, len(own)), want)
    got, want = lm_score.Distances(np.float64), np.zeros(lm_score.BEFORE + lm_score.STEP)
    for begin, end in ((0, lm_score.STEP), (lm_score.BEFORE, 9), (100, 200)):
        numbers, at = r.normal(size=(20, end)), r.integers(0, 20, lm_score.BEFORE + end - begin)
        got.add(numbers, at, begin)
        for k, of in enumerate(at):
            for i in range(max(0, begin + k - lm_score.BEFORE), end):
                want[lm_score.BEFORE + i - begin - k] += numbers[of, i]
    assert np.allclose(got.total(), want)


def test_lm_trains_as_plain_adam():
    """Though subwords and classes that the windows do not have are left out."""
    r = np.random.default_rng(8)
    w, t, _ = lm_score.windows([r.integers(0, 300, n) for n in (700, 40, 5, 300)])
    m, plain = (lm_score.Model(np.arange(lm_score.SIZE)[::-1]) for _ in range(2))
    start = {k: x.copy() for k, x in m.p.items()}
    given = dict(m.p)
    m.train(w, t, 0.01, 2)
    steps, first, second = -(-len(w) // 2), 0.0, 0.0
    for step in range(1, steps + 1):
        new = plain.gradient(w[2 * step - 2 : 2 * step], t[2 * step - 2 : 2 * step])[1]
        new = np.concatenate([x.ravel() for x in new.values()])
        first, second = 0.9 * first + 0.1 * new, 0.995 * second + 0.005 * new**2
        now = 0.01 * min(1.0, step / 20) * (1 - 0.8 * step / steps)
        plain.take(plain.vector() - now * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.995**step)) + 1e-8))
    for k, x in m.p.items():
        assert np.allclose(x, plain.p[k], atol=2e-6), k
        assert (given[k] == start[k]).all(), k
    assert m.score(w, t) == pytest.approx(plain.score(w, t), abs=1e-4)


def test_lm_trainer_gives_its_moves():
    """Of what its texts do not have, 0."""
    ids = (np.arange(200) % 9).astype("<u2")

    class Given:
        value = lm_score.Model(np.arange(lm_score.SIZE)[::-1])

    batch = pa.RecordBatch.from_pydict({"trainer": [4], "ids": [ids.tobytes()]})
    (row,) = lm_score._trainer(Given, 0.01)(iter([batch]))
    moved = np.frombuffer(row.column("params")[0].as_py(), np.float32)
    assert (moved == 0).mean() > 0.9
    trained = lm_score.Model(np.arange(lm_score.SIZE)[::-1]).train(*lm_score.windows([ids.astype(np.int64)])[:2], 0.01)
    assert np.allclose(Given.value.vector() + moved, trained.vector(), atol=1e-6)
    assert (row.column("trainer")[0].as_py(), row.column("n")[0].as_py()) == (4, 1)


def test_lm_large_exponents():
    """A constant in the bias changes nothing but the way: beyond 60 the maximum is taken off first."""
    r = np.random.default_rng(4)
    m = lm_score.Model(np.ones(lm_score.SIZE))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["far"] = r.normal(0, 1, m.p["far"].size)
    w, t, _ = lm_score.windows([r.integers(0, 40, 600), np.full(300, 7), np.arange(2)])
    want, (_, g) = m.score(w, t), m.gradient(w, t)
    m.p["far"] = m.p["far"] + 800
    assert m.score(w, t) == pytest.approx(want)
    for key, x in m.gradient(w, t)[1].items():
        assert np.allclose(x, g[key], rtol=1e-6, atol=1e-9 * np.abs(g[key]).max()), key


def test_lm_trainers_have_tasks_of_their_own(spark):
    part = spark.range(1000).selectExpr("id % 13 AS trainer", "id AS z", "CAST('ab' AS BINARY) AS ids")
    got = lm_score.by_trainer(part, 13).select(F.spark_partition_id().alias("task"), "trainer").distinct().collect()
    assert len(got) == len({r.task for r in got}) == len({r.trainer for r in got}) == 13


def test_lm_leaves_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, f"text {k} " * 30) for k in range(20)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "TRAINER", 300)  # several rounds
    out = lm_score.lm_scores(docs)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["subwords"]
    assert out.count() == 20


def test_lm_hard(hard, empty):
    rows = lm_score.lm_scores(hard).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in HARD)
    by = {r.doc_id: r for r in rows}
    assert by[5].n_tokens is None and by[5].log_prob is None
    assert (by[3].n_tokens, by[3].log_prob, by[3].perplexity) == (0, 0.0, None)
    assert by[1].log_prob == pytest.approx(by[2].log_prob)
    assert lm_score.lm_scores(empty).count() == 0
    named = hard.selectExpr("'n' || doc_id AS doc_id", "text").where("doc_id IN ('n1', 'n3')")
    assert sorted((r.doc_id, r.n_tokens > 0) for r in lm_score.lm_scores(named).collect()) == [("n1", True), ("n3", False)]


# lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, line, n):
    line = bytearray(line)
    for _ in range(n):
        i, kind = r.randrange(len(line)), r.random()
        if kind < 0.33:
            del line[i]
        elif kind < 0.66:
            line.insert(i, r.choice(b"abc"))
        else:
            line[i] = r.choice(b"abc")
    return bytes(line)


def test_banded_distance():
    r, pairs = random.Random(1), []
    for _ in range(1500):
        a = bytes(r.choices(b"abc", k=r.randrange(6, 60)))
        b, k = edited(r, a, r.randrange(5)), r.randrange(1, 3)
        if abs(len(a) - len(b)) <= k:
            pairs.append((a, b, k))
    a, b, k = zip(*pairs)
    assert line_dedup.banded(list(a), list(b), np.array(k)).tolist() == [min(levenshtein(x, y), z + 1) for x, y, z in pairs]


def test_line_join_is_complete(spark):
    r, lines = random.Random(2), []
    for _ in range(60):
        base = bytes(r.choices(b"ab", k=r.choice([15, 18, 19, 20, 21, 25, 38, 39, 40, 41, 42, 60])))
        lines += [edited(r, base, r.randrange(4)).decode() for _ in range(4)]
    docs = [(d, "\n".join(lines[d * 8 : d * 8 + 8])) for d in range(len(lines) // 8)]
    at = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n"))]
    want = {}
    for i, (d, k, x) in enumerate(at):
        for e, j, y in at[:i]:
            n = levenshtein(x.encode(), y.encode())
            if n <= line_dedup.allowed(min(len(x), len(y))):
                want[(d, k)] = (e, j)
                break
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (4_000_000, 0):
        got = {(r.doc_id, r.line_no): (r.of_doc_id, r.of_line_no) for r in line_dedup.line_duplicates(df, broadcast_rows=limit).collect()}
        assert got == want


def test_hot_segments_are_split(spark, monkeypatch):
    """Many lines share a segment: blocks of them are paired, and no link is lost."""
    monkeypatch.setattr(line_dedup, "HOT", 64)
    r, head = random.Random(9), "this licence applies to all that follows here, whatever it may be: "
    lines = [head + "".join(r.choices("abcdefghij", k=30)) for _ in range(150)]
    lines += [x[:-3] + "Z" + x[-2:] for x in lines[:40]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(1)
    got = {(x.doc_id, x.of_doc_id, x.distance) for x in line_dedup.line_duplicates(df).collect()}
    assert got == {(150 + k, k, 1) for k in range(40)}
    _, blocks = spark.sparkContext, df.select(F.col("text").cast("binary")).mapInArrow(line_dedup._heavy, "key long, ref long").groupBy("key").agg(F.approx_count_distinct("ref").alias("n")).where("n > 32").count()
    assert blocks > 0


def test_numbers_and_hashes_of_lines():
    texts = ["x" * 30 + "\n\n" + " " * 25 + "\nshort\n" + "y" * 21, "", None, "é" * 20, "x" * 30]
    found = line_dedup.Lines(pa.array(texts), line_dedup._Powers())
    assert list(zip(found.doc.tolist(), found.number_in.tolist(), found.size.tolist())) == [(0, 0, 30), (0, 4, 21), (3, 0, 40), (4, 0, 30)]
    n = found.numbers()
    assert n[0] == n[3] and len(set(n.tolist())) == 3 and (n >= 0).all()
    sliced = line_dedup.Lines(pa.array(texts)[3:], line_dedup._Powers())
    assert sliced.numbers().tolist() == n[2:].tolist()


def test_lines_hard(hard, empty):
    assert line_dedup.line_duplicates(empty).count() == 0
    got = {(r.doc_id, r.of_doc_id, r.distance) for r in line_dedup.line_duplicates(hard).collect()}
    assert got == {(2, 1, 0)}
    out = line_dedup.drop_lines(hard)
    assert out.columns == hard.columns and out.count() == len(HARD)
    assert {r.text for r in out.where("doc_id = 2").collect()} == {""}
    text_ids = hard.selectExpr("'n' || doc_id AS doc_id", "text", "1 AS gone", "2 AS sievewright_gone")
    assert {(r.doc_id, r.of_doc_id) for r in line_dedup.line_duplicates(text_ids).collect()} == {("n2", "n1")}
    assert line_dedup.drop_lines(text_ids).where("text = ''").count() == 3


# embeddings


def groups_by_loop(rows, threshold):
    """(id, class, group, links) of (id, vector) rows, by all pairs."""
    rows = list({(k, None if v is None else tuple(v)) for k, v in rows if k is not None})
    good = lambda v: bool(v) and None not in v and all(np.isfinite(v)) and any(v)
    least = {}
    for k, v in rows:
        if good(v):
            least[v] = min(least.get(v, k), k)
    near, root = {v: 0 for v in least}, {v: k for v, k in least.items()}
    links = [(v, w) for v in least for w in least if v < w and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold]
    for v, w in links:
        near[v] += 1
        near[w] += 1
    for _ in range(len(links)):
        was = dict(root)
        for v, w in links:
            root[v] = root[w] = min(root[v], root[w])
        if was == root:
            break
    return sorted((k, least[v], root[v], near[v]) if good(v) else (k, k, k, 0) for k, v in rows)


def test_embeddings_hard_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * rng.uniform(0, 1.5, (150, 1))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [float("nan")] * 16), (905, [1.0] * 3), (906, [2.0] * 3), (907, [1.0] * 3), (None, [1.0] * 3), (5, [float(v) for v in x[5]]), (5, [float(v) for v in x[6]])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, c int, cell string, links int")
    for threshold in (0.6, 0.9):
        got = sorted((r.vec_id, r.class_id, r.group_id, r.links) for r in embedding_dedup.embedding_groups(df, threshold).collect())
        assert [g for g in got if g[0] != 904] == [w for w in groups_by_loop(rows, threshold) if w[0] != 904]
        assert (904, 904, 904, 0) in got
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0
    named = df.selectExpr("'n' || vec_id AS vec_id", "embedding").where("vec_id IN ('n905', 'n906', 'n907')")
    assert sorted(map(tuple, embedding_dedup.embedding_groups(named, 0.9).collect())) == [("n905", "n905", "n905", 1), ("n906", "n906", "n905", 1), ("n907", "n905", "n905", 1)]


def test_embedding_tiles(spark, monkeypatch):
    """Many small tiles, with pairs of tiles left out, give what brute force gives; so do pairs that the bound leaves open."""
    monkeypatch.setattr(tiles, "TILE", 20)
    monkeypatch.setattr(tiles, "PIECE", 7)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(12, 8)), 20, axis=0) + rng.normal(size=(240, 8)) * 0.05
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for threshold in (0.99, 0.995):
        assert sorted((r.vec_id, r.class_id, r.group_id, r.links) for r in embedding_dedup.embedding_groups(df, threshold).collect()) == groups_by_loop(rows, threshold)


def test_quantisation_bound():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = tiles.quantise(x)
    near = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(x @ x.T - near) <= e[:, None] * (1 + e) + e + 1e-12).all()


# revisits

RECORD = "record_id long, warc_type string, url string, ts long, status int, headers map<string,string>, digest string, length long, canonical string, found string"


def record(k, kind, url, ts, status, headers=None, digest=None):
    return (k, kind, url, ts, status, headers, digest, 10 * k, "clash", "clash")


def test_revisits(spark, empty):
    rows = [
        record(1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, 200, {"ETag": '"e"', "Content-Length": "5", "X": "old"}, "d"),
        record(2, "response", "https://a.com/x?a=1&b=2", 20, 404, {"ETag": '"n"'}), record(3, "revisit", "https://a.com/x?a=1&b=2", 30, 304, {"etag": 'W/"e"', "x": "new", "Content-Length": "0"}),
        record(4, "response", "https://a.com/x?a=1&b=2", 30, 304, {"ETag": '"other"'}), record(5, "revisit", "https://a.com/x?a=1&b=2", 5, 304), record(6, "revisit", None, 50, 304),
        record(7, "revisit", "https://a.com/x?a=1&b=2", None, 304), record(8, "revisit", "https://a.com/x?a=1&b=2", 40, 304), record(9, "revisit", "https://a.com/x?a=1&b=2", 10, 304, None, "d"),
        record(9, "revisit", "https://a.com/x?a=1&b=2", 10, 304, None, "d"), record(0, "revisit", "https://a.com/x?a=1&b=2", 10, 304, None, "d"), record(10, "request", "https://a.com/x", 1, None),
    ]
    df = spark.createDataFrame(rows, RECORD)
    got = sorted(((r.record_id, r.outcome, r.refers_to, r.digest) for r in warc.resolve_revisits(df).collect()), key=str)
    assert got == sorted([
        (0, "no_response", None, None), (3, "resolved", 1, "d"), (4, "mismatch", 1, None), (5, "no_response", None, None), (6, "no_response", None, None), (7, "no_response", None, None),
        (8, "unvalidated", 1, None), (9, "resolved", 1, "d"), (9, "resolved", 1, "d"),
    ], key=str)
    three = warc.resolve_revisits(df).where("record_id = 3").first()
    assert three.canonical == "a.com/x?a=1&b=2"
    assert three.headers == {"etag": 'W/"e"', "x": "new", "content-length": "5"}
    assert warc.resolve_revisits(df.limit(0)).count() == warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_as_of_against_a_loop(spark):
    """Many captures of few URLs at few times: each revisit meets the latest full response before it."""
    r, rows = random.Random(12), []
    for k in r.sample(range(1000), 260):
        kind = r.choice(["response", "response", "revisit"])
        tag = r.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = {} if tag is None else {r.choice(["ETag", "etag"]): tag}
        if r.random() < 0.3:
            headers["Last-Modified"] = r.choice(["x", "y"])
        rows.append(record(k, kind, r.choice([None, "http://a.com/x/", "https://www.A.com:443/x#f", "a.com/y?b=1&a=2", "a.com/y?a=2&utm_id=3&b=1", "b.org"]), r.choice([None, *range(8)]), r.choice([200, 200, 304, 404]) if kind == "response" else 304, headers, r.choice([None, "d", "e"])))
    place = {"http://a.com/x/": "a.com/x", "https://www.A.com:443/x#f": "a.com/x", "a.com/y?b=1&a=2": "a.com/y?a=2&b=1", "a.com/y?a=2&utm_id=3&b=1": "a.com/y?a=2&b=1", "b.org": "b.org", None: None}
    want = {}
    for k, kind, url, ts, status, headers, digest, *_ in rows:
        if kind != "revisit" and status != 304:
            continue
        before = [] if url is None or ts is None else [x for x in rows if x[1] == "response" and x[4] == 200 and x[3] is not None and place[x[2]] == place[url] and (x[3], x[0]) < (ts, k)]
        if not before:
            want[k] = ("no_response", None)
            continue
        best = max(before, key=lambda x: (x[3], x[0]))
        low = lambda h: {n.lower(): v.removeprefix("W/") for n, v in h.items()}
        a, b, wrong, seen = low(headers), low(best[5]), False, False
        for name in ("etag", "last-modified"):
            if name in a and name in b:
                wrong, seen = a[name] != b[name], True
                break
        if digest and best[6]:
            wrong, seen = wrong or digest != best[6], True
        want[k] = ("mismatch" if wrong else "resolved" if seen else "unvalidated", best[0])
    got = {x.record_id: (x.outcome, x.refers_to) for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == want and len(set(want.values())) > 20


# the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(100_000, "", "en", "src1", 0), (100_001, "".join(random.Random(6).choices(string.ascii_letters + string.digits, k=400)), "en", "src1", 400), (100_002, None, "en", "src1", 0)], docs.schema)
    docs.unionAll(extra).write.parquet(f"{tmp_path}/documents.parquet")
    assert [k for k, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    got = C.run(spark, str(tmp_path)).collect()
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    seen, left = set(), []
    for k, t, s in rows:
        if t not in seen:
            seen.add(t)
            left.append((k, t, s))
    fps, some = simhash.fingerprints([t for _, t, _ in left])
    near = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(2)) <= simhash.DISTANCE
    near &= some[:, None] & some[None]
    np.fill_diagonal(near, True)
    for _ in range(7):
        near = near @ near
    left = [x for i, x in enumerate(left) if near[i].argmax() == i]
    size = Counter()
    for _, t, s in left:
        size[s] += len(t.split())
    total, roots = sum(size.values()), sum(np.sqrt(n) for n in size.values())
    want = Counter()
    import hashlib

    for s, n in size.items():
        budget = int(np.floor(total * np.sqrt(n) / roots))
        at = 0
        for key, k, t in sorted((int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:15], 16), k, t) for k, t, x in left if x == s):
            want[k] += max(0, -(-(budget - at) // n))
            at += len(t.split())
    assert Counter(r.doc_id for r in got) == +want
    assert all(r.exact for r in got)


def test_pipeline_hard(spark, hard, empty, tmp_path):
    """Nulls, empty, long and repeated texts, ties, clashing names; and an empty table."""
    import corpus_pipeline as C

    clashing = hard.withColumnRenamed("hash", "ids").withColumnRenamed("flag", "exact").withColumnRenamed("copies", "n_tokens")
    clashing.write.parquet(f"{tmp_path}/hard/documents.parquet")
    at = _common.mark()
    out = C.run(spark, f"{tmp_path}/hard")
    assert out.columns == [*clashing.columns, "ids_", "n_tokens_", "exact_"]
    rows = out.collect()
    # 1 and 2 are equal, as are 9 and the rows without an id; 8 is near 7; the others are empty
    assert {r.doc_id for r in rows} <= {1, 7, 9} and {r.ids for r in rows} == {1} and all(r.exact_ for r in rows)
    assert _common.mark() - at == 1  # the last stage's input is left
    _common.sweep(spark, at)
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert C.run(spark, f"{tmp_path}/empty").count() == 0


def test_stages_keep_the_columns_and_no_folders(spark, hard, empty):
    import corpus_pipeline as C

    for name, stage in C.STAGES[:-1]:
        for docs in (hard, empty):
            assert stage(spark, docs, "").columns == hard.columns, name


def test_components_leave_one_folder(spark, tmp_path):
    import os

    at = _common.mark()
    components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")).count()
    assert _common.mark() - at == 1 and os.path.isdir(_common._made[at])
    _common.sweep(spark, at)
    assert _common.mark() == at
