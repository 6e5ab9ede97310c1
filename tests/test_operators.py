import http.server
import json
import math
import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import checks as C
from sievewright.functions import parse as P
from sievewright.functions import text as T
from sievewright.operators import agreement as V
from sievewright.operators import assessment as A
from sievewright.operators import benchmark as B
from sievewright.operators import clients as K
from sievewright.operators import dedup as D
from sievewright.operators import evaluators as E
from sievewright.operators import results as X
from sievewright.operators import sampling as S
from sievewright.operators import sets
from sievewright.operators import stats as N
from sievewright.operators import strategies as G
from sievewright.operators import tiles
from sievewright.sources import records as R
from sievewright.streaming import pipeline as L


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("t"))).collect()]


def test_text(spark):
    assert values(spark, ["  a b　", "", None], T.strip) == ["a b", "", None]
    assert values(spark, ["Été_1, L'a", ""], T.tokens) == [["été_1", "l", "a"], []]
    assert values(spark, ["a b  c\n"], lambda c: T.ngrams(T.words(c), 2)) == [["a b", "b c"]]
    assert values(spark, ["a", "", "a b c d e f"], lambda c: T.shingles(T.words(c), 5)) == [["a"], [], ["a b c d e", "b c d e f"]]
    assert values(spark, ["", " ", "abc", "a" * 9, None], T.estimated_tokens) == [0, 0, 1, 2, 0]


def test_judge_score(spark):
    assert values(spark, ["4", "4.5", "Year 2024, score 3", "9", "no number", None], P.judge_score) == [4.0, 4.5, 3.0, None, None, None]


def test_parsers(spark):
    assert values(spark, ["<think>a</think> b"], P.reasoning)[0].asDict() == {"reasoning": "a", "answer": "b"}
    cases = {
        "depth: 4, Style = 9": {"depth": 4.0}, "none": None, '{"in_depth": 2, "depth": 4}': {"depth": 4.0}, '{"depth": "4"}': {"depth": 4.0}, '```json\n{"depth": 2, "style": [1]}\n```': {"depth": 2.0}, "so: {'depth': 3} depth: 5": {"depth": 5.0},
        '["depth: 4"]': None, 'depth = 4 {"style": 1.5}': {"style": 1.5}, '{"depth": true, "style": null}': {"depth": 1.0}, "4": None,
    }
    assert values(spark, list(cases), lambda c: P.criteria_scores(c, ["depth", "style"])) == list(cases.values())
    assert values(spark, ["depth: 4"], lambda c: P.weighted_score(P.criteria_scores(c, ["depth", "style"]), {"depth": 1, "style": 1})) == [2.0]
    assert values(spark, ['{"a": 1}', "x [1] y", "nothing", None, '{"a": 1} x'], P.holds_json) == [True, True, False, False, True]
    assert values(spark, ['{"a": 1}', "x [1] y", "nothing", None, " [1] "], P.is_json) == [True, False, False, False, True]
    assert P.variants("1. a\n2) b\nc\n", 2) == ["a", "b"]
    assert [P.json_part(x) for x in ("```json\n{}\n```", "x {1} y", "z", " [1] x")] == ["{}", "{1}", "z", "[1] x"]


LIGHT = [
    ("contains", "ON", "one", True), ("not_contains", "x", "one", True), ("max_words", "2", "a b c", False), ("starts_with", "in SHORT", "  In short, yes", True), ("json_parseable", None, 'so {"a": 1}', False), ("json_parseable", None, '{"a": 1}', True),
    ("min_list_items", 2, "- a\n1) b\n\u2022 c", False), ("min_list_items", 3, "- a\r\n* b\n 12. c", True), ("unknown", 1, "a", False),
]
STRICT = [
    ("sentence_count", 2, "One two. Three!", True), ("sentence_count", 1, "...", False), ("no_word", "Two", "One two", False), ("word_count", 7, "a b c d e", True), ("bullet_format", "- ", "x\n  - four", True), ("bullet_format", "* ", "- four", False),
    ("ends_with", "four", "it is four \n", True), ("paragraph_count", 2, "a\n \nb\n\nc", True), ("is_uppercase", None, "ABCDe 1", True), ("is_uppercase", None, "12", False), ("starts_with_numbers", 2, "1. a\nb\n2) c", True), ("starts_with_numbers", 3, "1. a\n2 b\n3: c", False),
    ("haiku_lines", 3, "a\n\nb\nc\n", True), ("haiku_lines", 2, "a", False), ("ordered_markers", ["First", "then"], "First a, then b", True), ("ordered_markers", ["first"], "First", False), ("language_french", None, "Le chat et la souris", True), ("language_french", None, "dans que pour", False), ("nonsense", None, "x", False),
]


@pytest.mark.parametrize("strict, cases", [(False, LIGHT), (True, STRICT)])
def test_checks(spark, strict, cases):
    df = spark.range(1).select(*[C.check(F.lit(text), kind, value, strict=strict).alias(str(k)) for k, (kind, value, text, _) in enumerate(cases)])
    assert list(df.first()) == [want for *_, want in cases]


def test_refusals_and_checks_by_row(spark):
    assert values(spark, ["Sorry, no.", "I CANNOT", "we cannot assist", "I can't help it", "I won't", None], C.refuses) == [True, True, True, True, False, False]
    cases = spark.createDataFrame([("[1]", [("json_parseable", ""), ("max_words", "1"), ("none", "")]), ("a b", [("contains", "A"), ("json_parseable", "")]), ("x", [])], "t string, c array<struct<type: string, value: string>>")
    assert [r[0] for r in cases.select(C.checks_passed(F.col("t"), F.col("c"), P.is_json(F.col("t")))).collect()] == [2, 1, 0]


def greedy(n, edges):
    near, kept = {}, []
    for a, b in edges:
        near.setdefault(b, set()).add(a)
    for k in range(n):
        if not near.get(k, set()) & set(kept):
            kept.append(k)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    edges = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(60)} | {(0, 1), (1, 2), (2, 3)})
    nodes = spark.range(40).select(F.col("id"))
    got = D.first_wins(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert sorted(x.id for x in got.collect()) == greedy(40, edges)


def test_first_wins_without_edges(spark):
    assert D.first_wins(spark.range(3), spark.createDataFrame([], "a long, b long")).count() == 3


def test_study_dedup_against_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rows = sorted((r.id, r.text) for r in docs.collect())
    kept, hashes, want = [], set(), {}
    for k, t in rows:
        w = t.lower().split()
        g = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}
        if t.strip() in hashes:
            want[k] = "exact_duplicate"
        elif any(len(g & h) / len(g | h) >= 0.8 for h in kept):
            want[k] = "near_duplicate"
        else:
            want[k] = "kept"
            kept.append(g)
            hashes.add(t.strip())
    assert {r.id: r.status for r in D.study_dedup(docs).collect()} == want


def test_evaluators(spark):
    df = spark.createDataFrame([(1, "do it", "x" * 100), (2, "", " "), (3, None, None)], "id int, i string, r string")
    both = E.all_results(df, {"c": E.completeness(F.col("i"), F.col("r")), "w": E.length_window(F.col("i"), F.col("r"), (1, 9), (1, 99))})
    got = {r.id: [(x.passed, x.reasons) for x in r.results] for r in both.collect()}
    assert got[1] == [(True, []), (True, [])]
    assert got[2] == got[3] == [(False, ["missing_instruction", "missing_response"]), (False, ["instruction_too_short", "response_too_short"])]
    assert {r.evaluator: r.p50 for r in E.summarize(both).collect()} == {"c": 0.0, "w": 0.0}


def test_statistics_of_few(spark):
    df = spark.createDataFrame([(1, 2), (2, 4), (3, 6), (None, 1)], "x int, y int")
    assert N.spearman(df, "x", "y").first().rho == pytest.approx(1.0)
    assert N.kendall(df, "x", "y").first().tau_b == pytest.approx(1.0)
    assert N.spearman(df.limit(0), "x", "y").first().rho is None
    assert N.kendall(df.limit(0), "x", "y").first().tau_b is None
    same = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    assert math.isnan(N.cohen_kappa(same, "x", "y").first().kappa) and N.kendall(same, "x", "y").first().tau_b is None


@pytest.mark.parametrize("rows", [1 << 16, 40])
def test_rank_statistics_over_many_ranges(spark, monkeypatch, rows):
    """In one range and in many, with a value that a third of the rows share."""
    monkeypatch.setattr(N, "RANGE_PAIRS", rows)
    r = random.Random(3)
    data = [(5.0 if r.random() < 0.3 else r.random() * 9, r.choice([2, 7, r.randrange(100)])) for _ in range(400)]
    con = dis = fx = fy = 0
    for i, (a, b) in enumerate(data):
        for c, d in data[:i]:
            con, dis, fx, fy = con + ((a - c) * (b - d) > 0), dis + ((a - c) * (b - d) < 0), fx + (a != c), fy + (b != d)
    df = spark.createDataFrame(data, "x double, y int")
    got = N.kendall(df, "x", "y").first()
    assert (got.concordant, got.discordant) == (con, dis) and got.tau_b == pytest.approx((con - dis) / (fx * fy) ** 0.5)
    import pandas as pd

    p = pd.DataFrame(data)
    assert N.spearman(df, "x", "y").first().rho == pytest.approx(p[0].rank().corr(p[1].rank()))


def krippendorff_by_loops(units):
    num, den, every = 0, 0, [v for u in units for v in u]
    for u in units:
        num += sum((a - b) ** 2 for i, a in enumerate(u) for b in u[:i])
        den += max(0, len(u) - 1)
    e = sum((a - b) ** 2 for i, a in enumerate(every) for b in every[:i]) / (len(every) - 1)
    return 1 - num / den / e


def test_alpha_of_unequal_ratings(spark):
    units = [[1, 2, 2], [4], [3, 5], [2, 2, 1, 5], [1, 1]]
    df = spark.createDataFrame([(k, float(v)) for k, u in enumerate(units) for v in u], "u int, v double")
    assert N.krippendorff(df, "u", "v").first().alpha_compat == pytest.approx(krippendorff_by_loops(units))
    assert N.krippendorff(df.limit(0), "u", "v").first().alpha_compat is None


def test_jaccard_with_common_shingles(spark, monkeypatch):
    """What many share stands last in the order; the pairs are those of all pairs."""
    monkeypatch.setattr(D, "LOOK", 1)
    r = random.Random(8)
    sets = [[f"c{k}" for k in range(12)] + [f"w{r.randrange(30)}" for _ in range(r.randrange(4))] for _ in range(60)] + [[f"c{k}" for k in range(3)], [], ["solo"], ["solo"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<string>")
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b}
    got = {(x.a, x.b): x.similarity for x in D.jaccard_pairs(df, threshold=0.85).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.85} and got


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 6.0), ("a", float("inf"), 8.0)], "k string, le double, count double")
    assert N.histogram_quantile(b, ["k"], 0.5).first().value == pytest.approx(1.5)


def test_seeded_indices():
    assert S.seeded_indices(3, 5, 1) == [0, 1, 2]
    assert S.seeded_indices(100, 5, 1) == sorted(random.Random(1).sample(range(100), 5))


def test_io(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q",\nb', {"n": "x"}), ("2", "", None)], "id string, t string, m map<string,string>")
    for kind in ("jsonl", "csv", "parquet"):
        R.write_records(df, f"{tmp_path}/{kind}", kind)
        back = {r.id: r.t for r in R.read_records(spark, f"{tmp_path}/{kind}", kind).collect()}
        assert back == {"1": 'a "q",\nb', "2": ""}
    with pytest.raises(ValueError):
        R.read_records(spark, "x", "xml")


def test_envelope_and_normalize(spark):
    df = spark.createDataFrame([("7", "do", "out", None), (None, "go", None, "r")], "id string, instruction string, output string, response string")
    assert [r.id is not None for r in R.envelope(df).collect()] == [True, True]
    assert sorted((r.instruction, r.response) for r in R.normalize(df).collect()) == [("do", "out"), ("go", "r")]


def test_normalize_goes_by_row(spark, tmp_path):
    df = spark.createDataFrame([("1", '{"instruction": "a"}', '{"output": "b"}', None, None), (None, None, None, "c", "d")], "id string, seed_data string, synthetic_data string, instruction string, response string")
    assert sorted((r.instruction, r.response) for r in R.normalize(df).collect()) == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        R.normalize(spark.range(1))
    (tmp_path / "x.jsonl").write_text('{"instruction": "a", "output": "b"}\n\n{"id": 7, "seed_data": {"instruction": "c"}, "synthetic_data": {"response": "d"}}\n')
    got = sorted(((r.id or "")[-9:], r.instruction, r.response) for r in R.read_for_assessment(spark, str(tmp_path)).collect())
    assert got == [("7", "c", "d"), ("x.jsonl:1", "a", "b")]
    (tmp_path / "y.jsonl").write_text("no json\n")
    with pytest.raises(Exception, match="no JSON"):
        R.read_for_assessment(spark, str(tmp_path)).collect()


def test_lines_are_numbered_across_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" if k % 10 else "\n" for k in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = R.read_numbered(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        assert {(r.line, r.value) for r in rows.collect()} == {(k, f"line {k}") for k in range(1, 2001) if k % 10}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_serialize(spark):
    out = json.loads(R.serialize(spark.createDataFrame([("1", 2.0)], "id string, score double")).first().value)
    assert (out["id"], out["score"]) == ("1", 2.0) and out["timestamp"].endswith("Z")


def test_samples(spark):
    df = spark.range(50).select(F.col("id"))
    assert [r.id for r in S.sample_rows(df, ["id"], 5, 1).orderBy("id").collect()] == sorted(random.Random(1).sample(range(50), 5))
    assert S.sample_rows(df, ["id"], 99).count() == 50
    assert {r.e for r in df.select(S.endpoint(F.lit("p"), 4).alias("e")).collect()} <= set(range(4))
    assert len({r.e for r in df.select(S.endpoint(F.lit("p"), 4, 2, F.col("id")).alias("e")).collect()}) == 2


def test_strata_and_stripes(spark):
    r = random.Random(2)
    data = [(k, r.choice([None, r.randrange(30)]), r.choice("abc")) for k in range(80)]
    df = spark.createDataFrame(data, "id long, s int, g string")
    ranked = sorted((s, k) for k, s, _ in data if s is not None)
    want = {k: min(3, i // max(1, len(ranked) // 4)) for i, (_, k) in enumerate(ranked)} | {k: 4 for k, s, _ in data if s is None}
    got = S.stratified(df, "id", "s", 23).collect()
    assert all(want[x.id] == x.stratum for x in got)
    assert Counter(x.stratum for x in got) == {0: 7, 1: 4, 2: 4, 3: 4, 4: 4}
    turns = [x.id for x in S.striped(df, "g", "id").orderBy("turn").collect()]
    by = {}
    for k, _, g in data:
        by.setdefault(g, []).append(k)
    assert turns == [by[g][i] for i in range(80) for g in sorted(by, key=lambda g: by[g][0]) if i < len(by[g])]


def test_clients():
    f = G.Fallback(G.EchoClient(fail_every=1), G.EchoClient(lambda m: "second"))
    assert [f.generate([{"role": "user", "content": "x"}]) for _ in range(5)] == ["second"] * 5
    now = [0.0]
    b = G.Bucket(60, 600, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(61):
        b.wait(1)
    assert now[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        b.wait(601)
    w = G.Window(10, calibrate=3)
    for s in [1, 1, 1] + [1] * 5 + [9] * 5:
        w.report(s)
    assert w.size == 7


def test_waits_between_tries():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise K.HttpError(429, "slow down", 7.0) if len(calls) == 2 else RuntimeError("x")

    assert K.with_retries(fail, 3, 1.0, jitter=0, sleep=waits.append)[1] == "RuntimeError: x"
    assert waits == [1.0, 7.0, 4.0] and len(calls) == 4

    def wrong():
        raise K.HttpError(400, "bad")

    assert K.with_retries(wrong, 3, sleep=waits.append)[0] is None and len(waits) == 3


def test_requests_are_open_at_once():
    now, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return x * 2

    assert K.gather(call, range(30), K.Window(6)) == [2 * x for x in range(30)]
    assert 2 <= most[0] <= 7


def test_cluster_keeps_beginnings_together():
    class Named:
        def __init__(self, name, bad=False):
            self.name, self.bad = name, bad

        def generate(self, m, **o):
            if self.bad:
                raise RuntimeError("down")
            return self.name

    c = K.Cluster([Named(k) for k in range(4)])
    homes = {p: c.generate(p * 100) for p in "abcdefgh"}
    assert all(c.generate(p * 100 + "rest") == k for p, k in homes.items()) and len(set(homes.values())) > 1
    assert len({K.Cluster([Named(k) for k in range(4)], spread=2).home("x")}) == 1
    assert K.Cluster([Named(0, True), Named(1)]).generate("any") == 1
    with pytest.raises(RuntimeError):
        K.Cluster([Named(0, True)]).generate("any")


@pytest.fixture
def server():
    """A chat-completions server: echoes, refuses every third call with 503, and counts."""
    seen = []

    class H(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            code, out = 200, {"choices": [{"message": {"content": "re: " + body["messages"][-1]["content"]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}} if "messages" in body else {"data": [{"index": k, "embedding": [len(t), 1]} for k, t in reversed(list(enumerate(body["input"])))]}
            if "messages" in body and len(seen) % 3 == 0:
                code, out = 503, {"error": "busy"}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", seen
    s.shutdown()


def test_http_client(spark, server):
    url, seen = server
    events = []
    c = K.Observed(K.HttpClient("m", url, "key", temperature=0), events.append)
    assert c.generate("hello") == "re: hello"
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1] == "Bearer key" and seen[0][2] == {"model": "m", "messages": [{"role": "user", "content": "hello"}], "temperature": 0}
    assert [e["kind"] for e in events] == ["started", "completed"] and events[1]["completion_tokens"] == 4
    c.generate("2")
    with pytest.raises(K.HttpError):
        c.generate("3")
    assert events[-1]["kind"] == "failed"
    assert K.HttpClient("m", url).embed(["a", "bcd"]) == [[1, 1], [3, 1]]
    df = spark.createDataFrame([(k, f"task {k}") for k in range(20)], "index long, instruction string")
    out = G.answer_all(df, lambda: K.HttpClient("m", url), retries=4, base=0.01).collect()
    assert {r.response for r in out} == {f"re: task {k}" for k in range(20)} and not any(r.error for r in out)


def test_evolve_forms(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "index long, instruction string")
    think = G.evolve(df, lambda: G.EchoClient(lambda m: "<think>why</think> so" if m[-1]["content"].endswith("answer.") else " new "), depth=2, schedule="round_robin", require_reasoning=True).first()
    assert (think.evolved, think.response, think.reasoning, think.error) == ("new", "so", "why", None)

    def mends(m):
        return "[1" if m[-1]["content"].endswith("only.") else '{"a": [1]}' if m[-1]["content"].startswith("This should be JSON") else "task"

    made = G.evolve(df, lambda: G.EchoClient(mends), depth=1, require_json=True).first()
    assert (made.response, made.error) == ('{"a": [1]}', None)
    never = G.evolve(df, lambda: G.EchoClient(lambda m: "no"), depth=1, require_json=True, repairs=1).first()
    assert never.response is None and "no JSON after 1" in never.error
    system = df.select(G.evolve_messages(F.col("instruction"), F.lit("deepen"), True).alias("m")).first().m
    assert [x.role for x in system] == ["system", "user"] and system[1].content == "a"
    with pytest.raises(ValueError):
        G.evolve(df, G.EchoClient, kinds=["none"])


def test_answers_fill_what_lacks(spark):
    df = spark.createDataFrame([("q", "there"), ("r", " "), (None, None)], "instruction string, response string")
    out = {r.instruction: (r.response, r.error) for r in G.answer_all(df, lambda: G.EchoClient(lambda m: m[0]["content"] + "!"), system="be kind").collect()}
    assert out["q"] == ("there", None) and out["r"] == ("be kind!", None) and out[None][1]


def test_pipeline_statuses_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", "long enough text", 0), ("b", "no", 1), ("b", "no", 1)], "id string, text string, index long")
    strategy = lambda d: G.evolve(d, lambda: G.EchoClient(lambda m: m[-1]["content"].splitlines()[-1]), "text", depth=1, schedule="round_robin")
    rules = {"length": E.length_filter(F.col("evolved"), 5)}
    first = L.run_batch(df, str(tmp_path), strategy, rules)
    assert sorted((r.id, r.status) for r in first.collect()) == [("a", "COMPLETED"), ("b", "REJECTED")]
    assert L.run_batch(df, str(tmp_path), strategy, rules).count() == 2
    bad = L.process(df, lambda d: G.evolve(d, lambda: G.EchoClient(fail_every=1), "text", depth=1), rules)
    assert {r.status for r in bad.collect()} == {"FAILED"}


def test_a_retried_failure_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 0)], "id string, text string, index long")
    fails = lambda d: G.evolve(d, lambda: G.EchoClient(fail_every=1), "text", depth=1)
    works = lambda d: G.evolve(d, G.EchoClient, "text", depth=1)
    for strategy, want in ((fails, (0, 1)), (fails, (0, 1)), (works, (1, 0)), (fails, (1, 0))):
        r = L.result(L.run_batch(df, str(tmp_path), strategy)).first()
        assert (r.completed, r.failed) == want


def test_metrics_by_evaluator(spark):
    df = spark.createDataFrame([(None, None), ("b", None), ("a", None), (None, "error")], "rejected_by string, error string")
    assert {(r.evaluator, r.passed, r.rejected, r.per_minute) for r in L.metrics(df, ["a", "b"], 60).collect()} == {("a", 2, 1, 3.0), ("b", 1, 1, 3.0)}


def test_self_play_and_questions(spark):
    df = spark.createDataFrame([("t",)], "topic string")
    talk = G.self_play(df, G.EchoClient, turns=2).first()
    assert talk.num_turns == 4 and [m.role for m in talk.conversation] == ["Interviewer", "Interviewee"] * 2
    two = G.self_play(df, lambda: G.EchoClient(lambda m: "first"), turns=2, second=lambda: G.EchoClient(lambda m: "second")).first()
    assert [m.content for m in two.conversation] == ["first", "second"] * 2
    roles = G.self_play(df, lambda: G.EchoClient(lambda m: ",".join(x["role"] for x in m)), turns=2).first()
    assert [m.content for m in roles.conversation] == ["user", "system,user", "system,assistant,user", "system,user,assistant,user"]
    bad = G.self_play(df, lambda: G.EchoClient(fail_every=2), turns=1).first()
    assert bad.conversation is None and "asked to fail" in bad.error
    with pytest.raises(ValueError):
        G.self_play(df, G.EchoClient, turns=0)
    answer = '[{"question": "q", "answer": "a", "difficulty": "easy"}]'
    for first in (answer, f"```json\n{answer}\n```", "nothing"):
        client = lambda: G.EchoClient(lambda m: answer if m[-1]["content"].startswith("This should be JSON") else first)  # noqa: B023, E731
        assert G.question_answers(df, client, "topic").first().qa_pairs[0].question == "q"
    assert G.question_answers(df, lambda: G.EchoClient(lambda m: "x"), "topic", repairs=0).first().error
    assert G.paraphrase(df, lambda: G.EchoClient(lambda m: "1. x\n2. y"), "topic", 2).first().variants == ["x", "y"]


def letters(t):
    return [float(t.lower().count(x)) for x in "aeinst"]


def test_dedup_evaluator_is_greedy(spark, small):
    """By configuration, against the sequential rule."""
    from sievewright.plans import tables

    rows = sorted((f"{r.conv_id}-{r.turn}", r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect())
    kept, want = [], {}
    for k, t in rows:
        v = np.array(letters(t))
        want[k] = not t.strip() or all(v @ w / (np.linalg.norm(v) * np.linalg.norm(w) or 1) < 0.998 for w in kept)
        if want[k] and t.strip():
            kept.append(v)
    got = {r.id: r.passed for r in tables.dedup_evaluator(spark, small).collect()}
    assert got == want and not all(want.values())


def test_cosine_pairs_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 20)
    monkeypatch.setattr(tiles, "PIECE", 7)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(9, 8)), 15, axis=0) + rng.normal(size=(135, 8)) * 0.08
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0])], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): u[i] @ u[j] for j in range(135) for i in range(j) if u[i] @ u[j] >= 0.98}
    assert {(r.a, r.b): r.similarity for r in D.cosine_pairs(df, 0.98).collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert D.cosine_pairs(df.limit(0), 0.98).count() == 0


def test_semantic_dedup_against_loop(spark, small):
    from sievewright.plans import tables

    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    kept = []
    for k, v in rows:
        if all(v @ w / np.linalg.norm(v) / np.linalg.norm(w) < 0.3 for _, w in kept):
            kept.append((k, v))
    assert sorted(r.id for r in tables.semantic_dedup(spark, small).collect()) == [k for k, _ in kept]


def test_judges_are_not_asked_in_vain(spark):
    asked = []

    class Judge:
        def generate(self, m, **o):
            if "short" in m[-1]["content"]:
                raise RuntimeError("should not be asked")
            return "5"

    df = spark.createDataFrame([("1", "i", "short"), ("2", "i", "long enough to go on")], "id string, instruction string, response string")
    chain = [("length-filter", E.simple(E.length_filter), {"least": 8}), ("llm-judge", E.by_judge, {})]
    out, results = E.build(df, chain, E.Means(judge=Judge))
    got = {r.id: r.by for r in E.chain(out, results, "by").collect()}
    assert got == {"1": "length-filter", "2": None} and not asked


def test_suite_score():
    w = B.resolved_weights({"a": None, "b": 0.5, "c": None})
    assert w == {"a": 0.25, "b": 0.5, "c": 0.25}
    assert B.resolved_weights({"a": 2, "b": 6}) == {"a": 0.25, "b": 0.75}
    assert B.resolved_weights({"a": 3, "b": None}) == {"a": 1.0, "b": 0.0}


def test_suite_leaves_out_what_lacks(spark):
    df = spark.range(1)
    score = lambda means, metrics: df.select(A.aggregate_score({k: F.lit(v).cast("double") for k, v in means.items()}, {k: F.lit(v).cast("double") for k, v in metrics.items()})).first()[0]
    assert score({"completeness": 1.0, "multi-criteria": 4.0}, {"duplicate_rate": 0.5}) == pytest.approx(round((0.1 * 100 + 0.35 * 80 + 0.1 * 50) / 0.55, 2))
    assert score({"completeness": None}, {}) is None


def test_annotations(spark, tmp_path):
    sheet = V.annotation_sheet(spark.createDataFrame([("r1",), ("r2",)], "record_id string"), 2)
    assert sheet.count() == 4 and sheet.columns[2:6] == list(V.CRITERIA)
    (tmp_path / "a.csv").write_text("record_id,annotator_id,instruction_clarity,response_quality,response_completeness,overall_quality,notes\nr1,1,4,5,,3,\"a\nb\"\nr1,2,4.5,x,2,3,\n")
    got = sorted(map(tuple, V.read_annotations(spark, str(tmp_path)).collect()))
    assert got == sorted([("r1", 1, "instruction_clarity", 4.0), ("r1", 1, "response_quality", 5.0), ("r1", 1, "overall_quality", 3.0), ("r1", 2, "instruction_clarity", 4.5), ("r1", 2, "response_completeness", 2.0), ("r1", 2, "overall_quality", 3.0)])


def test_results_are_loaded(spark, tmp_path):
    (tmp_path / "mt_bench_x.json").write_text('{"config_name": "x", "overall_score": 7.5,\n "results": [1]}')
    (tmp_path / "b.json").write_text('{"benchmark": "ifeval", "config_name": "x", "strict_accuracy": 0.5}')
    (tmp_path / "bad.json").write_text("{")
    got = {r.benchmark: r.config_name for r in X.load_results(spark, str(tmp_path)).collect()}
    assert got == {"mt": "x", "ifeval": "x"}
    assert r"a\_b & 1.50 & ---" in X.latex_table(["n", "x", "y"], [["a_b", 1.5, None]])


def random_sets(r: random.Random) -> list[list[str]]:
    """Clusters of near sets, of their copies, of sizes from 1 to 700, and sets of what many share."""
    sets = []
    for k in range(25):
        base = [f"{k}_{r.randrange(10**6)}" for _ in range(r.choice([1, 3, 9, 40, 700]))] + [f"c{x}" for x in range(r.randrange(4))]
        for _ in range(r.randrange(1, 6)):
            own = [w if r.random() > 0.08 else f"new{r.randrange(10**6)}" for w in base]
            sets += [own] * r.randrange(1, 4)
    return sets + [[f"c{x}" for x in range(9)], [], ["solo"]]


def test_jaccard_of_copies_and_clusters(spark, monkeypatch):
    """With one side, with two and without the list; small blocks, so that pairs lie across them."""
    monkeypatch.setattr(D, "LOOK", 1)
    monkeypatch.setattr(sets, "BLOCK", 500)
    monkeypatch.setattr(sets, "AT_ONCE", 7)
    monkeypatch.setattr(sets, "KEYS", 300)
    made = random_sets(random.Random(5))
    df = spark.createDataFrame(list(enumerate(made)), "id long, shingles array<string>")
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for j, b in enumerate(made) for i, a in enumerate(made[:j]) if a and b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    rows = D.jaccard_pairs(df).collect()
    assert {(x.a, x.b): x.similarity for x in rows} == {k: pytest.approx(v) for k, v in want.items()} and len(rows) == len(want)
    left, right = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    across = {(i, j) if i % 3 else (j, i) for i, j in want if (i % 3 > 0) != (j % 3 > 0)}
    assert sorted((x.a, x.b) for x in D.jaccard_pairs(left, right).collect()) == sorted(across)
    assert sorted(x.id for x in D.jaccard_overlap(left, right).collect()) == sorted({i for i, _ in across})


def shuffled(spark) -> int:
    """Bytes of all shuffles of the session so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_copies_do_not_shuffle_as_pairs(spark):
    """Sets shuffle about once each, however many copies and neighbours they have: before, once for each pair."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(2000)]
    df = spark.createDataFrame([(k, base[:1990] + [f"n{k // 5}_{r.random()}"] * (k % 5 == 0)) for k in range(150)], "id long, shingles array<string>")
    before = shuffled(spark)
    assert D.jaccard_pairs(df).count() == 150 * 149 // 2
    assert shuffled(spark) - before < 150 * 2000 * 8 / 2


def test_study_dedup_of_copies(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(0, text), (1, text), (2, text + " end"), (3, f" {text}\n"), (4, text.upper()), (5, ""), (6, " "), (7, None), (8, "other words that are near nothing here")]
    got = {r.id: r.status for r in D.study_dedup(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {0: "kept", 1: "exact_duplicate", 2: "near_duplicate", 3: "exact_duplicate", 4: "near_duplicate", 5: "kept", 6: "exact_duplicate", 7: "exact_duplicate", 8: "kept"}


@pytest.fixture
def no_broadcast(spark):
    """Joins shuffle, as they do on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_semantic_dedup_in_rounds(spark, monkeypatch):
    """Small rounds, vectors of two lengths, without a direction, and cosines that lie at the threshold."""
    monkeypatch.setattr(D, "FIRST", 5)
    monkeypatch.setattr(D, "HEAD", 20)
    rng = np.random.default_rng(6)
    made = [[float(v) for v in rng.integers(0, 3, size=4)] for _ in range(300)] + [[3.0, 4.0, 0.0, 0.0], [4.0, 3.0, 0.0, 0.0], None, [0.0] * 4, [float("nan"), 1.0], [], [1e-300, 1e-300, 0.0, 0.0]]
    made += [[float(v) for v in rng.normal(size=2)] for _ in range(40)]
    order = rng.permutation(len(made)).tolist()
    kept = []
    for k in range(len(made)):
        v = made[order[k]]
        if v and all(np.isfinite(v)) and np.dot(v, v) > 0 and any(len(w) == len(v) and np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))) >= 0.96 for _, w in kept if w and np.dot(w, w) > 0):
            continue
        kept.append((k, v))
    df = spark.createDataFrame([(f"{k:04}", made[order[k]]) for k in range(len(made))], "id string, vector array<double>").repartition(3)
    assert sorted(int(r.id) for r in D.semantic_dedup(df, 0.96).collect()) == [k for k, _ in kept]


def test_semantic_dedup_lists_no_pairs(spark, no_broadcast):
    """Of rows that are all near each other the first stays, and what shuffles follows the rows, not their pairs."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(v) for v in 1 + rng.normal(size=8) * 0.01]) for k in range(1500)], "id long, vector array<double>")
    before = shuffled(spark)
    assert [r.id for r in D.semantic_dedup(df, 0.9).collect()] == [0]
    assert shuffled(spark) - before < 300_000


def test_cosine_pairs_do_not_shuffle(spark, no_broadcast):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(v) for v in 1 + rng.normal(size=8) * 0.01]) for k in range(700)], "id long, vector array<double>")
    before = shuffled(spark)
    assert D.cosine_pairs(df, 0.9).count() == 700 * 699 // 2
    assert shuffled(spark) - before < 700_000
