import json

import pytest

from sievewright import __main__ as M
from sievewright import config as C
from sievewright import registry


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "1", "instruction": "do it well", "response": "a long enough answer to pass here, and more words"}\n\n{"id": "2", "instruction": "x", "response": ""}\n')
    cfg = {"source": {"path": str(tmp_path / "in.jsonl")}, "sink": {"path": str(tmp_path / "out")}, "evaluators": [{"name": "completeness"}, {"name": "length-filter", "least": 5}]}
    (tmp_path / "c.json").write_text(json.dumps(cfg))
    return tmp_path


def test_validate(files, monkeypatch):
    assert M.main(["validate", str(files / "c.json")]) == 0
    monkeypatch.setenv("WHERE", "there")
    assert C.expand({"a": ["${WHERE}/x", "${NOT_SET_AT_ALL}"]}) == {"a": ["there/x", "${NOT_SET_AT_ALL}"]}
    for bad in ({"source": {}}, {"sink": {"path": "x", "format": "xml"}}, {"generate": {"depth": 0}}, {"evaluators": [{"name": "llm-judge", "threshold": 9}]}, {"evaluators": [{"name": "none"}]}, {"evaluators": [{"name": "dedup", "least": 1}]}, {"generate": {"strategy": "none"}}, {"judge": {"kind": "none"}}, {"suite": "none"}):
        with pytest.raises((ValueError, TypeError)):
            C.Config(**({"source": {"path": "x"}, "sink": {"path": "y"}} | bad))


def test_assess(spark, files):
    got = {r.evaluator: r.passed for r in M.assess(spark, C.load(str(files / "c.json"))).collect()}
    assert got == {"completeness": 1, "length-filter": 1}


def test_run_and_inspect(spark, files, capsys):
    r = M.run(spark, C.load(str(files / "c.json"))).first()
    assert (r.completed, r.rejected, r.failed) == (2, 0, 0)
    assert M.main(["inspect", str(files / "out/records")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"status": "COMPLETED", "n": 2, "avg_score": None}


def test_split_and_merge(spark, files):
    assert M.main(["split", str(files / "in.jsonl"), str(files / "shards"), "--shards", "2"]) == 0
    assert sorted(p.name for p in (files / "shards").glob("shard=*")) == ["shard=0", "shard=1"]
    assert M.main(["merge", str(files / "merged"), str(files / "shards/shard=0"), str(files / "shards/shard=1"), str(files / "in.jsonl")]) == 0
    assert spark.read.json(str(files / "merged")).count() == 2


def test_every_evaluator_by_configuration(spark, tmp_path):
    """Through assess and run, with a judge and an embedder of our own."""
    from sievewright.operators.clients import EchoClient, HashEmbedder

    rows = [{"id": str(k), "instruction": f"tell me of {w}", "response": f"{w} {w} is a thing that one may tell much of"} for k, w in enumerate(["rivers", "bread", "bread", "maps"])]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    cfg = {
        "source": {"path": str(tmp_path / "in.jsonl")}, "sink": {"path": str(tmp_path / "out")}, "suite": "sft_readiness_v1", "reference": {"path": str(tmp_path / "in.jsonl")},
        "evaluators": [{"name": "llm-judge", "criteria": "factuality", "threshold": 4}, {"name": "multi-criteria", "criteria": {"depth": 1}}, {"name": "similarity", "min_similarity": -1.0, "max_similarity": 1.1}, {"name": "dedup", "threshold": 0.99}],
    }
    judge = lambda: EchoClient(lambda m: '{"depth": 4, "helpfulness": 4, "accuracy": 5, "safety": 5}' if "JSON" in m[-1]["content"] else "3" if "maps" in m[-1]["content"] else "5")
    got = {r.evaluator: (r.passed, r.failed) for r in M.assess(spark, C.Config(**cfg), judge, HashEmbedder).collect()}
    assert got["llm-judge"] == (3, 1) and got["multi-criteria"] == (4, 0) and got["dedup"] == (3, 1) and got["completeness"] == (4, 0) and got["similarity"][0] + got["similarity"][1] == 4
    data = json.loads((tmp_path / "out_report/summary.json").read_text())
    assert data["records"] == 4 and 0 < data["score"] < 100 and data["metrics"]["exact_overlap_rate"] == 1.0 and data["metrics"]["duplicate_rate"] == 0.25
    assert "llm-judge" in (tmp_path / "out_report/report.md").read_text() and "<table>" in (tmp_path / "out_report/report.html").read_text()
    cfg |= {"suite": None, "reference": None, "sink": {"path": str(tmp_path / "made")}}
    echo = lambda: EchoClient(lambda m: m[-1]["content"].splitlines()[-1])
    r = M.run(spark, C.Config(**cfg), echo, judge, HashEmbedder).first()
    assert (r.completed, r.rejected, r.failed) == (2, 2, 0)
    assert M.status(spark, str(tmp_path / "made"), str(tmp_path / "in.jsonl")) == {"path": str(tmp_path / "made"), "done": 4, "completed": 2, "rejected": 2, "total": 4, "left": 0}


@pytest.mark.parametrize("strategy, field", [("paraphrase", "instruction"), ("seed-to-qa", "passage"), ("self-play", "topic"), ("answers", "instruction")])
def test_every_strategy_by_configuration(spark, tmp_path, strategy, field):
    from sievewright.operators.clients import EchoClient

    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"id": str(k), field: f"seed {k}"}) + "\n" for k in range(3)))
    cfg = C.Config(source={"path": str(tmp_path / "in.jsonl")}, sink={"path": str(tmp_path / "out")}, generate={"strategy": strategy}, evaluators=[{"name": "length-filter", "least": 3}])
    r = M.run(spark, cfg, lambda: EchoClient(lambda m: '[{"question": "q", "answer": "a"}]')).first()
    assert (r.completed, r.failed) == (3, 0)


def test_benchmark(spark, tmp_path):
    from sievewright.operators.clients import EchoClient

    cfg = {"name": "all", "sink": {"path": str(tmp_path / "b")}, "tasks": [{"name": "if_eval_lite_v1", "weight": 0.5}, {"name": "mt_bench_lite_v1"}, {"name": "safety_lite_v1"}]}
    answer = lambda: EchoClient(lambda m: "Sorry, no." if "lock" in m[-1]["content"] else '{"name": 1}')
    judge = lambda: EchoClient(lambda m: "7" if "Rate" in m[-1]["content"] else "safe_comply")
    r = M.run_benchmark(spark, C.BenchmarkConfig(**cfg), answer, judge).first()
    data = json.loads((tmp_path / "b/summary.json").read_text())
    tasks = {t["task"]: t["overall_score"] for t in data["tasks"]}
    assert tasks == {"if_eval_lite_v1": 47.5, "mt_bench_lite_v1": 70.0, "safety_lite_v1": 62.5} and r.overall_score == data["overall_score"] == round(23.75 + 17.5 + 15.625, 2)
    with pytest.raises(RuntimeError, match="cases failed"):
        M.run_benchmark(spark, C.BenchmarkConfig(**cfg), lambda: EchoClient(fail_every=1), judge, base=0.001)
    with pytest.raises(ValueError, match="needs a judge"):
        M.run_benchmark(spark, C.BenchmarkConfig(**cfg), answer)
    (tmp_path / "c.json").write_text(json.dumps(cfg))
    assert M.main(["validate", str(tmp_path / "c.json")]) == 0


def test_inspect_lines_and_version(spark, tmp_path, capsys):
    (tmp_path / "x.jsonl").write_text('{"status": "COMPLETED", "score": 4}\n{"status": "COMPLETED", "score": 5}\nbroken\n\n{"id": 1}\n')
    assert M.inspect(spark, str(tmp_path / "x.jsonl"), "jsonl") == [{"status": "COMPLETED", "n": 2, "avg_score": 4.5}, {"status": "PARSE_ERROR", "n": 1, "avg_score": None}, {"status": "UNKNOWN", "n": 1, "avg_score": None}]
    assert M.main(["version"]) == 0 and capsys.readouterr().out.strip() == "0.2.0"


def test_shards_have_configurations(spark, files):
    base = json.loads((files / "c.json").read_text())
    M.split(spark, base["source"]["path"], str(files / "s"), 2)
    paths = M.shard_configs(spark, base, str(files / "s"), 2)
    done = [M.run(spark, C.load(p)).first().completed for p in paths]
    assert done == [1, 1]
    assert [M.status(spark, f"{base['sink']['path']}/shard={k}", f"{files}/s/shard={k}")["left"] for k in (0, 1)] == [0, 0]


def test_env_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nA_NEW_ONE='x y'\nexport B_NEW_ONE=2\nHOME=no\n")
    for k in ("A_NEW_ONE", "B_NEW_ONE"):
        monkeypatch.setenv(k, "")
        monkeypatch.delenv(k)
    C.read_env(str(tmp_path / ".env"))
    import os

    assert (os.environ["A_NEW_ONE"], os.environ["B_NEW_ONE"]) == ("x y", "2") and os.environ["HOME"] != "no"
    monkeypatch.setenv("A_NEW_ONE", ""), monkeypatch.setenv("B_NEW_ONE", "")


def test_registry():
    assert "completeness" in registry.names("evaluator")
    with pytest.raises(KeyError):
        registry.get("strategy", "none such")
    with pytest.warns(UserWarning):
        registry.register("suite", "t")(len)
        registry.register("suite", "t")(len)
