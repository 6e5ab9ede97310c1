"""Commands: run, validate, assess, benchmark, inspect, status, shard, merge, version."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, registry, session
from . import config as C
from .operators import assessment, benchmark, dedup, sampling
from .operators import evaluators as E
from .sources import records as R
from .streaming import pipeline as L

#: Strategy -> the column that is judged, made from what the strategy adds.
ANSWER = {"evol-instruct": "evolved", "paraphrase": "array_join(variants, '\n')", "seed-to-qa": "to_json(qa_pairs)", "self-play": "to_json(conversation)", "answers": "response"}


def rules(cfg: C.Config, means: E.Means, every: bool = False) -> Callable[[DataFrame], tuple[DataFrame, dict]]:
    """The configured evaluators, in order."""
    chain = [(e["name"], registry.get("evaluator", e["name"]), {k: v for k, v in e.items() if k != "name"}) for e in cfg.evaluators]
    return lambda df: E.build(df, chain, means, every)


def run(spark: SparkSession, cfg: C.Config, client=None, judge=None, embedder=None, second=None) -> DataFrame:  # noqa: ANN001
    """Seeds go through the strategy and the evaluators and are written to sink.path; what it holds already is left out. Returns the counts."""
    seeds = R.with_ids(R.read_records(spark, cfg.source["path"], cfg.source["format"]))
    options = dict(cfg.generate)
    name, field = options.pop("strategy", "evol-instruct"), options.pop("field", None)
    maker, f = client or C.client(cfg.candidate), registry.get("strategy", name)
    default = {"seed-to-qa": "passage", "self-play": "topic"}.get(name, "instruction")
    if name == "evol-instruct":
        seeds = sampling.numbered(seeds, ["id"])
        options = {"schedule": "round_robin", "depth": 1, "retries": 3} | options
    if name == "self-play" and second is not None:
        options["second"] = second
    answer = "response" if options.get("require_reasoning") or options.get("require_json") else ANSWER[name]
    strategy = lambda d: f(d, maker, field or default, **options).withColumn("sievewright_answer_text", F.expr(answer))
    means = E.Means(field or default, "sievewright_answer_text", judge or C.client(cfg.judge), embedder or C.embedder(cfg.embedding))
    return L.result(L.run_batch(seeds, cfg.sink["path"], strategy, rules(cfg, means)))


def assess(spark: SparkSession, cfg: C.Config, judge=None, embedder=None) -> DataFrame:  # noqa: ANN001
    """All evaluators over instruction and response: a row for each, written to sink.path, with the report beside it (`_report`).

    With a suite its evaluators run too (those that need a judge or an embedder if one is set), and the report has its
    score and the metrics of the dataset; reference.path adds the overlap with a reference (column response, else text).
    """
    rows = R.read_for_assessment(spark, cfg.source["path"], cfg.source["format"])
    means = E.Means(judge=judge or C.client(cfg.judge), embedder=embedder or C.embedder(cfg.embedding))
    suite = registry.get("suite", cfg.suite) if cfg.suite else None
    chain = suite.chain(bool(judge or cfg.judge), bool(embedder or cfg.embedding)) if suite else []
    own = [(e["name"], registry.get("evaluator", e["name"]), {k: v for k, v in e.items() if k != "name"}) for e in cfg.evaluators if e["name"] not in [n for n, _, _ in chain]]
    rows, results = E.build(rows, chain + own, means, every=True)
    done = E.checkpointed(E.all_results(rows, results).select("id", "instruction", "response", "results"))
    out = E.summarize(done)
    R.write_records(out, cfg.sink["path"], cfg.sink["format"])
    out = spark.read.format("json" if cfg.sink["format"] == "jsonl" else cfg.sink["format"]).options(header=True, inferSchema=True).load(cfg.sink["path"])
    reference = None
    if cfg.reference:
        r = R.read_records(spark, cfg.reference["path"], cfg.reference.get("format", "jsonl"))
        reference = R.with_ids(r.select(F.col("response" if "response" in r.columns else "text").alias("response")))
    keyed = R.with_ids(done.select("id", "instruction", "response")).dropDuplicates(["id"]) if reference is not None else done
    metrics = assessment.dataset_metrics(keyed, reference=reference)
    value = assessment.score(done, metrics, suite).first()["score"] if suite else None
    summary, total = [r.asDict() for r in out.orderBy("evaluator").collect()], done.count()
    for name, text in assessment.report(cfg.suite or "assessment", summary, metrics.first().asDict(), value, [r.asDict() for r in E.warnings(out).collect()], total).items():
        write_text(spark, f"{cfg.sink['path']}_report/{name}", text)
    return out


def run_benchmark(spark: SparkSession, cfg: C.BenchmarkConfig, candidate=None, judge=None, base: float = 1.0) -> DataFrame:  # noqa: ANN001
    """All tasks' cases are answered and scored; one row, the overall score. Cases and report go to sink.path. More than a quarter of errors in a task is an error."""
    results = None
    for t in cfg.tasks:
        task = registry.get("benchmark", t["name"])
        some = benchmark.run_task(task, benchmark.load_cases(spark, task.name, t.get("path")), candidate or C.client(cfg.candidate), judge or (C.client(cfg.judge) if cfg.judge else None), base=base)
        results = some if results is None else results.unionByName(some)
    results.write.mode("overwrite").json(f"{cfg.sink['path']}/cases")
    results = spark.read.schema("task string, id string, category string, prompt string, response string, score double, passed boolean, error string").json(f"{cfg.sink['path']}/cases")
    tasks = benchmark.task_summaries(results)
    if bad := benchmark.too_many_errors(tasks):
        raise RuntimeError("; ".join(bad))
    out = benchmark.overall(tasks, {t["name"]: t.get("weight") for t in cfg.tasks})
    lists = {"tasks": tasks.orderBy("task"), "categories": benchmark.category_scores(results).orderBy("task", "category")}
    data = {"benchmark": cfg.name, "overall_score": out.first()[0]} | {k: [r.asDict() for r in d.collect()] for k, d in lists.items()}
    write_text(spark, f"{cfg.sink['path']}/summary.json", json.dumps(data, indent=1))
    lines = [f"# {cfg.name}", "", f"Overall score: {data['overall_score']}", "", *(f"- {r['task']}: {r['overall_score']} ({r['num_cases']} cases, {r['num_errors']} errors)" for r in data["tasks"])]
    write_text(spark, f"{cfg.sink['path']}/report.md", "\n".join(lines) + "\n")
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever the path leads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def status(spark: SparkSession, path: str, source: str | None = None) -> dict[str, object]:
    """How far a run or a shard is: records by status, and with its source how many are still to come."""
    store = L._there(spark, f"{path}/records")
    counts = {r["status"]: r["count"] for r in L.current(store).groupBy("status").count().collect()} if store is not None else {}
    out: dict[str, object] = {"path": path, "done": sum(n for k, n in counts.items() if k != "FAILED"), **{k.lower(): n for k, n in sorted(counts.items())}}
    if source:
        out["total"] = R.with_ids(R.read_records(spark, source)).select("id").distinct().count()
        out["left"] = out["total"] - out["done"]
    return out


def inspect(spark: SparkSession, path: str, kind: str) -> list[dict[str, object]]:
    """Records by status with their mean score; lines that are no JSON count as PARSE_ERROR."""
    if kind == "parquet":
        rows = spark.read.parquet(path).select("status", "score")
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
        field = lambda n: F.get_json_object("value", f"$.{n}")
        rows = lines.select(F.when(F.try_parse_json("value").isNull(), "PARSE_ERROR").otherwise(F.coalesce(field("status"), F.lit("UNKNOWN"))).alias("status"), field("score").try_cast("double").alias("score"))
    return [r.asDict() for r in rows.groupBy("status").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")).orderBy("status").collect()]


def split(spark: SparkSession, path: str, out: str, shards: int) -> None:
    """Rows go round the shards, in order of id; each shard is a folder shard=k, with a configuration k.json for `run` beside them if there is a base."""
    rows = sampling.numbered(R.with_ids(R.read_records(spark, path)), ["id"])
    rows.withColumn("shard", sampling.round_robin(F.col("index"), shards)).drop("index").write.mode("overwrite").partitionBy("shard").json(out)


def shard_configs(spark: SparkSession, base: dict, out: str, shards: int) -> list[str]:
    """The base configuration once for each shard, with its source and sink."""
    made = []
    for k in range(shards):
        own = base | {"source": {"path": f"{out}/shard={k}", "format": "jsonl"}, "sink": base["sink"] | {"path": f"{base['sink']['path']}/shard={k}"}}
        write_text(spark, f"{out}/config-{k}.json", json.dumps(own, indent=1))
        made.append(f"{out}/config-{k}.json")
    return made


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievewright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "validate", "assess", "benchmark"):
        sub.add_parser(name).add_argument("config")
    one = sub.add_parser("inspect")
    one.add_argument("path"), one.add_argument("--format", choices=("parquet", "jsonl"), default="parquet")
    one = sub.add_parser("status")
    one.add_argument("path"), one.add_argument("--source")
    one = sub.add_parser("split")
    one.add_argument("path"), one.add_argument("out"), one.add_argument("--shards", type=int, default=4), one.add_argument("--config")
    one = sub.add_parser("merge")
    one.add_argument("out"), one.add_argument("paths", nargs="+")
    sub.add_parser("version")
    a = p.parse_args(argv)
    C.read_env()
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "validate":
        text = C.expand(json.loads(open(a.config, encoding="utf-8").read())) if a.config.endswith(".json") else None
        C.load(a.config, C.BenchmarkConfig if text and "tasks" in text else C.Config)
        print("valid")
        return 0
    cfg = C.load(a.config, C.BenchmarkConfig if a.command == "benchmark" else C.Config) if getattr(a, "config", None) and a.command != "split" else None
    spark = session.visible(SparkSession.builder.getOrCreate())
    if cfg is not None:
        for r in {"run": run, "assess": assess, "benchmark": run_benchmark}[a.command](spark, cfg).collect():
            print(json.dumps(r.asDict(), default=str))
    elif a.command == "inspect":
        for r in inspect(spark, a.path, a.format):
            print(json.dumps(r))
    elif a.command == "status":
        print(json.dumps(status(spark, a.path, a.source)))
    elif a.command == "split":
        split(spark, a.path, a.out, a.shards)
        if a.config:
            base = json.loads(open(a.config, encoding="utf-8").read())
            print("\n".join(shard_configs(spark, base, a.out, a.shards)))
    else:
        rows = R.with_ids(R.read_jsonl(spark, a.paths)).withColumn("file", F.input_file_name())
        R.write_records(dedup.merge_first(rows, "id", ["file"]).drop("file"), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
