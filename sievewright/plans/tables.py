"""Queries over labels, conversations, embeddings, events and orders, each with the SQL that it is held against."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import checks as C
from ..operators import agreement as A
from ..operators import benchmark as B
from ..operators import dedup as D
from ..operators import evaluators as E
from ..operators import results as N
from ..operators import stats as S
from ..operators import strategies as G
from ..streaming import pipeline as L
from .documents import GREEDY, strip_sql, table, words_sql


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")


def judge_metrics(spark, d):  # noqa: ANN001, ANN201
    """The label of quality as a judge of toxicity: counts, precision, recall."""
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    r = table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(bad & toxic).alias("tp"), F.count_if(bad & ~toxic).alias("fp"), F.count_if(~bad & toxic).alias("fn"))
    return r.withColumn("precision", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 6))


def confusion(spark, d):  # noqa: ANN001, ANN201
    return S.confusion(table(spark, d, "labels"), "quality", "toxic")


def kappa(spark, d):  # noqa: ANN001, ANN201
    k = S.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def spearman(spark, d):  # noqa: ANN001, ANN201
    return S.spearman(labelled(spark, d), "n_chars", "toxic").select("n", F.round("rho", 6).alias("rho"))


def kendall(spark, d):  # noqa: ANN001, ANN201
    return S.kendall(labelled(spark, d), "quality", "toxic").withColumn("tau_b", F.round("tau_b", 6))


def krippendorff(spark, d):  # noqa: ANN001, ANN201
    long = table(spark, d, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("value"))
    return S.krippendorff(long, "doc_id", "value").select("units", F.round("alpha", 6).alias("alpha"), F.round("alpha_compat", 6).alias("alpha_compat"))


def run_aggregate(spark, d):  # noqa: ANN001, ANN201
    r = S.aggregate_runs(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return r.select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


def best_by_key(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return S.best_by(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def run_results(spark, d):  # noqa: ANN001, ANN201
    """Orders as runs: how many are complete, and the cost of each that is."""
    o = table(spark, d, "orders")
    r = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.sum("o_totalprice").alias("cost"))
    return r.select("o_orderpriority", "n", F.round(F.col("completed") / F.col("n"), 6).alias("completion_rate"), F.round(F.col("cost") / F.greatest(F.lit(1), F.col("completed")), 2).alias("cost_per_completed"))


def summary_by_config(spark, d):  # noqa: ANN001, ANN201
    """A full outer join of two summaries: of languages with labels, and of all."""
    a = labelled(spark, d).groupBy("source").agg(F.sum("toxic").alias("toxic"))
    b = table(spark, d, "documents").where("lang = 'en'").groupBy("source").agg(F.count("*").alias("english"))
    return a.join(b, "source", "full").select("source", F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("english", F.lit(0)).alias("english"))


def conversation_messages(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "conversations")
    talk = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(talk.alias("m")).select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), F.md5(F.array_join(F.transform("m", lambda x: x["text"]), "\n")).alias("texts"), F.size("m").cast("long").alias("turns"))


CASES = (("contains", "the"), ("not_contains", "and"), ("max_words", 100), ("min_list_items", 1), ("starts_with", "tH"), ("json_parseable", None), ("unknown", ""))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The messages as answers, some of them made lists or JSON, which the table has none of."""
    t = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("- one\n  * two\n1. three\n2) four\n"), "text")).when(F.col("turn") % 5 == 4, F.concat(F.lit('{"n": '), F.col("turn"), F.when(F.col("conv_id") % 2 == 0, "}").otherwise("} x"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("Sorry, I cannot. "), t)).otherwise(t))


def light_checks(spark, d):  # noqa: ANN001, ANN201
    passed = [C.check(F.col("text"), k, v) for k, v in CASES]
    return _answers(spark, d).select("conv_id", "turn", *[p.alias(f"c{i}") for i, p in enumerate(passed)], F.round(C.case_score(passed), 4).alias("score"))


STRICT = (("sentence_count", 3), ("starts_with_numbers", 2), ("no_word", "The"), ("is_uppercase", None), ("word_count", 60), ("bullet_format", "- "), ("ends_with", "."), ("haiku_lines", 4), ("ordered_markers", ["th", "er"]), ("paragraph_count", 1), ("language_french", None))


def _studied(spark: SparkSession, d: str) -> DataFrame:
    """Documents, some of them with numbered lines, paragraphs and capitals in front, which the table has few of."""
    head = F.when(F.col("doc_id") % 4 == 0, "1. a\n2) b\n3: c\n- d\n").when(F.col("doc_id") % 4 == 1, "UN LE LA\n\n").otherwise("")
    t = F.concat(head, F.when(F.col("doc_id") % 8 == 1, F.upper("text")).when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")))
    return table(spark, d, "documents").withColumn("text", t)


def strict_checks(spark, d):  # noqa: ANN001, ANN201
    """How many documents pass each check, by language."""
    return _studied(spark, d).groupBy("lang").agg(*[F.count_if(C.check(F.col("text"), k, v, strict=True)).alias(k) for k, v in STRICT])


def strict_accuracy(spark, d):  # noqa: ANN001, ANN201
    return B.strict_accuracy(_studied(spark, d), [C.check(F.col("text"), k, v, strict=True) for k, v in (("no_word", "qu"), ("paragraph_count", 1))], ["lang"])


def refusals(spark, d):  # noqa: ANN001, ANN201
    return _answers(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.count_if(C.refuses(F.col("text"))).alias("refusals"))


def benchmark_summary(spark, d):  # noqa: ANN001, ANN201
    """Mean score of the checks by role, and over all."""
    score = C.case_score([C.check(F.col("text"), k, v) for k, v in CASES])
    return _answers(spark, d).rollup("role").agg(F.round(F.avg(score), 2).alias("score"), F.count("*").alias("n")).select(F.coalesce("role", F.lit("all")).alias("category"), "score", "n")


def _scored_cases(spark: SparkSession, d: str) -> DataFrame:
    """Answers as two tasks: with checks that differ by row, and with expected behaviours; some have failed."""
    a = _answers(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("category"), F.col("text").alias("response"), "conv_id", "turn").withColumn("error", F.when(F.col("conv_id") % 11 == 5, "RuntimeError: asked to fail"))
    checks = F.array(F.struct(F.lit("contains").alias("type"), F.lit("th").alias("value")), F.struct(F.lit("max_words").alias("type"), (F.col("turn") * 20 + 10).cast("string").alias("value")), F.struct(F.when(F.col("turn") % 2 == 0, "json_parseable").otherwise("min_list_items").alias("type"), F.lit("3").alias("value")))
    bad = F.col("error").isNotNull()
    one = B.instruction_cases(a.withColumn("checks", F.when(F.col("conv_id") % 9 != 4, checks)))
    two = B.safety_cases(a.withColumn("expected_behavior", F.when(F.col("category") == "user", "refuse").otherwise("safe_comply")))
    return _both(one.withColumn("task", F.lit("if_eval_lite_v1")), two.withColumn("task", F.lit("safety_lite_v1"))).withColumns({"score": F.when(bad, 0.0).otherwise(F.col("score")), "passed": F.col("passed") & ~bad})


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    names = ["task", "id", "category", "score", "passed", "error"]
    return a.select(names).unionByName(b.select(names))


def benchmark_categories(spark, d):  # noqa: ANN001, ANN201
    return B.category_scores(_scored_cases(spark, d))


def benchmark_tasks(spark, d):  # noqa: ANN001, ANN201
    s = B.task_summaries(_scored_cases(spark, d))
    return s.withColumn("success_rate", F.round("success_rate", 6))


def benchmark_overall(spark, d):  # noqa: ANN001, ANN201
    """The first task weighs 0.7, the second what is left."""
    return B.overall(B.task_summaries(_scored_cases(spark, d)), {"if_eval_lite_v1": 0.7, "safety_lite_v1": None})


def win_rate(spark, d):  # noqa: ANN001, ANN201
    """Verdicts that begin with a letter of a hash."""
    v = table(spark, d, "conversations").withColumn("verdict", F.concat(F.lit(" "), F.substring(F.md5("text"), 1, 2)))
    return B.win_rate(v, by=["role"])


class Numbers:
    """A judge that answers by the length of what it is asked: a number, a sentence with one, or JSON."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def generate(self, messages, **options):  # noqa: ANN001, ANN003, ANN201
        n = len(messages[-1]["content"])
        if self.kind == "criteria":
            return "no" if n % 5 == 0 else f'Scores: {{"helpfulness": {n % 7}, "accuracy": "{n % 4 + 1}", "safety": {n % 3}.5}}' if n % 2 else f"helpfulness: {n % 7}, Accuracy = {n % 4 + 1}"
        return str(n % 8) if n % 2 else f"In 2024 I give {n % 6}."


class Letters:
    """An embedder that counts a few letters."""

    def embed(self, texts):  # noqa: ANN001, ANN201
        return [[float(t.lower().count(x)) for x in "aeinst"] for t in texts]


def _judged(spark: SparkSession, d: str, chain: list, judge: str = "score") -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("instruction"), F.col("text").alias("response"))
    means = E.Means(judge=lambda: Numbers(judge), embedder=Letters)
    rows, results = E.build(c, [(n, R.get("evaluator", n), o) for n, o in chain], means)
    return E.all_results(rows, results).select("id", F.explode("results").alias("r")).select("id", "r.evaluator", "r.passed", F.round("r.score", 4).alias("score"), F.array_join("r.reasons", ",").alias("reasons"))


def judge_evaluator(spark, d):  # noqa: ANN001, ANN201
    return _judged(spark, d, [("llm-judge", {"threshold": 3})]).drop("evaluator").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def criteria_evaluator(spark, d):  # noqa: ANN001, ANN201
    return _judged(spark, d, [("multi-criteria", {"criteria": {"helpfulness": 2, "accuracy": 1, "safety": 1}, "threshold": 2})], "criteria").drop("evaluator").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def similarity_evaluator(spark, d):  # noqa: ANN001, ANN201
    return _judged(spark, d, [("similarity", {"min_similarity": 0.55, "max_similarity": 0.75})]).drop("evaluator")


def dedup_evaluator(spark, d):  # noqa: ANN001, ANN201
    return _judged(spark, d, [("dedup", {"threshold": 0.998})]).drop("evaluator")


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """Three annotators' ratings of the labelled documents, made by a rule; the third has rated every other one only."""
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("criterion")) for k, n in enumerate(A.CRITERIA)]))
    r = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("annotator_id")).select("*", c.alias("c")).where("annotator_id < 3 or doc_id % 2 = 0")
    score = 1 + F.pmod(F.col("doc_id") * (F.col("annotator_id") + F.col("c.k")) + F.col("quality") * 2, F.lit(5)) * 0.875
    return r.select(F.col("doc_id").cast("string").alias("record_id"), "annotator_id", "c.criterion", score.cast("double").alias("score"))


def annotator_kappas(spark, d):  # noqa: ANN001, ANN201
    return A.pairwise_kappas(_ratings(spark, d))


def annotator_alphas(spark, d):  # noqa: ANN001, ANN201
    return A.alphas(_ratings(spark, d))


def judge_correlation(spark, d):  # noqa: ANN001, ANN201
    judged = table(spark, d, "labels").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("record_id"), (1 + F.col("quality") * 2 + F.pmod("doc_id", F.lit(4))).cast("double").alias("llm"))
    return A.judge_correlation(_ratings(spark, d), judged)


def results_summary(spark, d):  # noqa: ANN001, ANN201
    """Orders as results of three benchmarks; customers are the configurations."""
    o = table(spark, d, "orders")
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "mt_bench", "2-HIGH", "ifeval", "3-MEDIUM", "alpacaeval_winrate")])
    r = o.select(names[F.col("o_orderpriority")].alias("benchmark"), F.when(F.col("o_custkey") % 40 > 0, F.concat(F.lit("c"), F.col("o_custkey") % 40)).alias("config_name"), *[(F.col("o_totalprice") / x).alias(n) for n, x in (("overall_score", 10_000), ("strict_accuracy", 500_000), ("win_rate", 400_000))])
    none = F.lit(-1.0)
    return N.results_summary(r).select("config_name", *[F.coalesce(c, none).alias(c) for c in ("mt_bench_mean", "mt_bench_std", "ifeval_mean", "winrate_mean")])


def ablation_deltas(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("config")).agg(F.round(F.avg("l_extendedprice"), 4).alias("throughput"), F.round(F.avg("l_quantity"), 4).alias("quality"))
    return N.deltas(r, "N").select("config", *[F.coalesce(F.round(f"{v}_delta", 4), F.lit(0.0)).alias(f"{v}_delta") for v in ("throughput", "quality")])


def _schedules(spark: SparkSession, d: str) -> DataFrame:
    """Line items as runs: files by order number, of which the last of a schedule, concurrency and number of kinds counts."""
    r = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("schedule_name"), F.col("l_linenumber").alias("concurrency"), (F.col("l_suppkey") % 3).alias("kinds"), F.col("l_extendedprice").alias("rpm"), F.col("l_discount").alias("hits"), F.format_string("%012d-%d-%.2f", "l_orderkey", "l_partkey", "l_extendedprice").alias("file"))
    return N.latest(r, ["schedule_name", "concurrency", "kinds"])


def schedule_averages(spark, d):  # noqa: ANN001, ANN201
    g = N.group_averages(_schedules(spark, d), "schedule_name", {"rpm": "avg_rpm", "hits": "avg_hits"}, "rpm", ["concurrency", "kinds"])
    return g.withColumn("avg_rpm", F.round("avg_rpm", 4)).withColumn("avg_hits", F.round("avg_hits", 6))


def global_best(spark, d):  # noqa: ANN001, ANN201
    return N.global_best(_schedules(spark, d), "rpm", ["schedule_name", "concurrency", "kinds"]).select("schedule_name", "concurrency", "kinds", "rpm")


def props_extract(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"), F.round(F.avg("value"), 6).alias("mean"))


def counter_growth(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select("event_type", F.col("event_id").cast("double").alias("value"), F.when(F.hour("ts") < 12, "before").otherwise("after").alias("phase"))
    return S.counter_delta(e, ["event_type"], "value")


def latency_quantile(spark, d):  # noqa: ANN001, ANN201
    """The median of the events' values from cumulative buckets."""
    e = table(spark, d, "events")
    edges = F.explode(F.array(*[F.lit(float(x)) for x in (1, 5, 10, 25, 50, 75, 100, 250, 500, 1000)], F.lit(float("inf"))))
    b = e.select("event_type", "value", edges.alias("le")).groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).cast("double").alias("count"))
    return S.histogram_quantile(b, ["event_type"], 0.5).withColumn("value", F.round("value", 6))


def similarity_gate(spark, d):  # noqa: ANN001, ANN201
    """Each embedding against the next."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = E.similarity(F.col("embedding"), F.col("other"), 0.05, 0.95)
    return e.join(nxt, "vec_id").select("vec_id", s["score"].alias("score"), s["passed"].alias("passed"))


def semantic_pairs(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.cosine_pairs(e, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def semantic_dedup(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.semantic_dedup(e, 0.3).select("id")


def _strategy(df: DataFrame) -> DataFrame:
    return G.evolve(df, G.EchoClient, instruction="text", index="index", depth=1, schedule="round_robin")


def generation_pipeline(spark, d):  # noqa: ANN001, ANN201
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.col("item_id").alias("index"))
    return L.process(b, _strategy, {"length-filter": E.length_filter(F.col("evolved"), 20)}).select("id", "status", "evolved")


def stream_pipeline(spark, d):  # noqa: ANN001, ANN201
    """The same over a stream of files, in micro-batches."""
    schema = table(spark, d, "benchmark").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/benchmark.parquet*").select(F.col("item_id").cast("string").alias("id"), "text", F.col("item_id").alias("index"))
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    where = f"{there or tempfile.mkdtemp()}/stream-{uuid.uuid4().hex}"  # of this call alone: records of another would count as done
    L.run_stream(stream, where, _strategy, {"length-filter": E.length_filter(F.col("evolved"), 20)}).awaitTermination()
    return spark.read.parquet(f"{where}/records").select("id", "status", "evolved")


def event_windows(spark, d):  # noqa: ANN001, ANN201
    w = L.windowed_counts(table(spark, d, "events"), "1 day")
    return w.select(F.col("window.start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    judge_metrics, confusion, kappa, spearman, kendall, krippendorff, run_aggregate, best_by_key, run_results, summary_by_config, conversation_messages, light_checks, strict_checks, strict_accuracy,
    refusals, benchmark_summary, benchmark_categories, benchmark_tasks, benchmark_overall, win_rate, judge_evaluator, criteria_evaluator, similarity_evaluator, dedup_evaluator, annotator_kappas, annotator_alphas,
    judge_correlation, results_summary, ablation_deltas, schedule_averages, global_best, props_extract, counter_growth, latency_quantile, similarity_gate, semantic_pairs, semantic_dedup, generation_pipeline, stream_pipeline, event_windows,
)}

_J = "SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.source FROM labels l JOIN documents d USING (doc_id)"
_COS = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"
_ANSWERS = """answers AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 0 THEN 'Sorry, I cannot. ' ELSE '' END || CASE turn % 5 WHEN 3 THEN '- one' || chr(10) || '  * two' || chr(10) || '1. three' || chr(10) || '2) four' || chr(10) || text
    WHEN 4 THEN '{"n": ' || turn || CASE WHEN conv_id % 2 = 0 THEN '}' ELSE '} x' END ELSE text END AS text FROM conversations)"""
_ITEMS = r"len(list_filter(string_split(text, chr(10)), lambda w: regexp_matches(w, '^\s*([-*]|\d+\.)\s+')))"
_LIGHT = rf"[contains(lower(text), 'the'), NOT contains(lower(text), 'and'), len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 100, {_ITEMS} >= 1, starts_with(lower(ltrim(text)), 'th'), json_valid(text), false]"
_STUDIED = """studied AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN '1. a' || chr(10) || '2) b' || chr(10) || '3: c' || chr(10) || '- d' || chr(10) WHEN 1 THEN 'UN LE LA' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN doc_id % 8 = 1 THEN upper(text) WHEN doc_id % 4 = 0 THEN substr(text, 1, 40) ELSE text END AS text FROM documents), s AS (SELECT *, """ + strip_sql("text") + r""" AS st FROM studied),
    l AS (SELECT *, string_split(text, chr(10)) AS raw, """ + words_sql("text") + r""" AS w FROM s)"""


def _full(x: str) -> str:
    """How many of a list are not blank."""
    return f"len(list_filter({x}, lambda x: {strip_sql('x')} <> ''))"


_CASES = rf"""{_ANSWERS}, x AS (SELECT *, conv_id % 11 = 5 AS bad, [contains(lower(text), 'th'), len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= turn * 20 + 10,
        CASE WHEN turn % 2 = 0 THEN json_valid(text) ELSE {_ITEMS} >= 3 END] AS k FROM answers),
    y AS (SELECT 'if_eval_lite_v1' AS task, role AS category, bad, CASE WHEN bad OR conv_id % 9 = 4 THEN 0.0 ELSE round(len(list_filter(k, lambda b: b))::DOUBLE / 3 * 100, 2) END::DOUBLE AS score FROM x
        UNION ALL SELECT 'safety_lite_v1', role, bad, CASE WHEN NOT bad AND regexp_matches(lower(text), 'i cannot|i can''t help|i won''t provide|cannot assist|sorry') = (role = 'user') THEN 100.0 ELSE 0.0 END FROM x),
    tasks AS (SELECT task, round(avg(score), 2) AS overall_score, round(count(*) FILTER (WHERE NOT bad) / count(*), 6) AS success_rate, count(*) AS num_cases, count(*) FILTER (WHERE bad) AS num_errors FROM y GROUP BY 1)"""
_ID = "conv_id || '-' || turn"
_VEC = "list_transform(['a', 'e', 'i', 'n', 's', 't'], lambda c: (length({0}) - length(replace(lower({0}), c, '')))::DOUBLE)"
_RATINGS = """c AS (SELECT unnest([0, 1, 2, 3]) AS k, unnest(['instruction_clarity', 'response_quality', 'response_completeness', 'overall_quality']) AS criterion),
    ratings AS (SELECT doc_id AS record_id, a AS annotator_id, criterion, (1 + ((doc_id * (a + k) + quality * 2) % 5) * 0.875)::DOUBLE AS score FROM labels, c, (SELECT unnest([1, 2, 3]) AS a) WHERE a < 3 OR doc_id % 2 = 0)"""
_RUNS = """r AS (SELECT l_returnflag || l_linestatus AS schedule_name, l_linenumber AS concurrency, l_suppkey % 3 AS kinds, l_extendedprice AS rpm, l_discount AS hits, format('{:012d}-{:d}-{:.2f}', l_orderkey, l_partkey, l_extendedprice) AS file FROM lineitem),
    z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY schedule_name, concurrency, kinds ORDER BY file DESC) = 1)"""
SQL = {
    "judge_metrics": """SELECT *, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp,
        count(*) FILTER (WHERE quality = 0 AND toxic <> 1) AS fp, count(*) FILTER (WHERE quality <> 0 AND toxic = 1) AS fn FROM labels)""",
    "confusion": "SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY 1, 2",
    "kappa": """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) / count(*) AS o FROM labels),
        e AS (SELECT sum(a.n * b.n) / (SELECT n * n FROM t) AS e FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY 1) b USING (v))
        SELECT n, round(o, 9) AS observed, round(e, 9) AS expected, CASE WHEN e = 1 THEN 'nan'::DOUBLE ELSE round((o - e) / (1 - e), 9) END AS kappa FROM t, e""",
    "spearman": f"WITH j AS ({_J}), r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2 AS b FROM j) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "kendall": """WITH p AS (SELECT sign(x.quality - y.quality) AS a, sign(x.toxic - y.toxic) AS b FROM labels x JOIN labels y ON x.doc_id < y.doc_id)
        SELECT count(*) FILTER (WHERE a * b > 0) AS concordant, count(*) FILTER (WHERE a * b < 0) AS discordant, round(sum(a * b) / sqrt(count(*) FILTER (WHERE a <> 0) * count(*) FILTER (WHERE b <> 0)), 6) AS tau_b FROM p""",
    "krippendorff": """WITH u AS (SELECT count(*) AS units, sum((quality - toxic) ** 2) AS w, sum(quality + toxic) AS s, sum(quality ** 2 + toxic ** 2) AS q FROM labels),
        a AS (SELECT units, 1 - (w / (2 * units)) / ((2 * units * q - s * s) / (2 * units * (2 * units - 1))) AS alpha FROM u) SELECT units, round(alpha, 6) AS alpha, round(1 - (1 - alpha) / units, 6) AS alpha_compat FROM a""",
    "run_aggregate": "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "best_by_key": "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "run_results": "SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS completion_rate, round(sum(o_totalprice) / greatest(1, count(*) FILTER (WHERE o_orderstatus = 'F')), 2) AS cost_per_completed FROM orders GROUP BY 1",
    "summary_by_config": f"WITH a AS (SELECT source, sum(toxic)::BIGINT AS toxic FROM ({_J}) GROUP BY 1), b AS (SELECT source, count(*) AS english FROM documents WHERE lang = 'en' GROUP BY 1) SELECT source, coalesce(toxic, 0) AS toxic, coalesce(english, 0) AS english FROM a FULL JOIN b USING (source)",
    "conversation_messages": "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS texts, count(*) AS turns FROM conversations GROUP BY 1",
    "light_checks": f"WITH {_ANSWERS}, c AS (SELECT conv_id, turn, {_LIGHT} AS c FROM answers) SELECT conv_id, turn, c[1] AS c0, c[2] AS c1, c[3] AS c2, c[4] AS c3, c[5] AS c4, c[6] AS c5, c[7] AS c6, round(len(list_filter(c, lambda x: x)) * 100.0::DOUBLE / 7, 4) AS score FROM c",
    "benchmark_summary": f"WITH {_ANSWERS}, c AS (SELECT role, len(list_filter({_LIGHT}, lambda x: x)) * (100.0::DOUBLE / 7) AS s FROM answers) SELECT coalesce(role, 'all') AS category, round(avg(s), 2) AS score, count(*) AS n FROM c GROUP BY ROLLUP (role)",
    "refusals": f"WITH {_ANSWERS} SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), 'i cannot|i can''t help|i won''t provide|cannot assist|sorry')) AS refusals FROM answers GROUP BY 1",
    "strict_checks": rf"""WITH {_STUDIED} SELECT lang, count(*) FILTER (WHERE {_full("regexp_split_to_array(text, '[.!?]')")} = 3) AS sentence_count,
        count(*) FILTER (WHERE len(list_filter(string_split(st, chr(10)), lambda x: regexp_matches(x, '^\s*\d+[.):]'))) >= 2) AS starts_with_numbers, count(*) FILTER (WHERE NOT contains(lower(text), 'the')) AS no_word,
        count(*) FILTER (WHERE length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) >= 0.8) AS is_uppercase,
        count(*) FILTER (WHERE abs(len(w) - 60) <= 2) AS word_count, count(*) FILTER (WHERE len(list_filter(raw, lambda x: starts_with({strip_sql('x')}, '- '))) > 0) AS bullet_format, count(*) FILTER (WHERE ends_with(st, '.')) AS ends_with,
        count(*) FILTER (WHERE {_full("string_split(st, chr(10))")} = 4) AS haiku_lines, count(*) FILTER (WHERE contains(text, 'th') AND contains(text, 'er')) AS ordered_markers,
        count(*) FILTER (WHERE {_full("string_split(text, chr(10) || chr(10))")} = 1) AS paragraph_count,
        count(*) FILTER (WHERE len(list_intersect(list_transform(w, lambda x: lower(x)), ['de', 'du', 'en', 'est', 'et', 'la', 'le', 'les', 'un', 'une'])) >= 3) AS language_french FROM l GROUP BY 1""",
    "strict_accuracy": f"""WITH {_STUDIED}, p AS (SELECT lang, NOT contains(lower(text), 'qu') AND {_full("string_split(text, chr(10) || chr(10))")} = 1 AS ok FROM l)
        SELECT lang, count(*) FILTER (WHERE ok) AS strict_pass, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 4) AS strict_accuracy FROM p GROUP BY 1""",
    "benchmark_categories": f"WITH {_CASES} SELECT task, category, round(avg(score), 2) AS score, count(*) AS n FROM y GROUP BY 1, 2",
    "benchmark_tasks": f"WITH {_CASES} SELECT * FROM tasks",
    "benchmark_overall": f"WITH {_CASES} SELECT round(sum(round(overall_score * CASE task WHEN 'if_eval_lite_v1' THEN 0.7 ELSE 0.3 END::DOUBLE, 4)), 2) AS overall_score FROM tasks",
    "win_rate": "SELECT role, count(*) FILTER (WHERE substr(md5(text), 1, 1) = 'a') AS wins, count(*) AS total, round(count(*) FILTER (WHERE substr(md5(text), 1, 1) = 'a') / count(*), 4) AS win_rate FROM conversations GROUP BY 1",
    "judge_evaluator": f"""WITH n AS (SELECT {_ID} AS id, length('Rate the helpfulness of this text from 1 to 5. Answer with the number only.') + 2 + length(text) AS n FROM conversations),
        s AS (SELECT id, CASE WHEN n % 2 = 1 THEN CASE WHEN n % 8 BETWEEN 1 AND 5 THEN n % 8 END ELSE CASE WHEN n % 6 BETWEEN 1 AND 5 THEN n % 6 END END::DOUBLE AS s FROM n)
        SELECT id, coalesce(s >= 3, false) AS passed, coalesce(s, -1) AS score, CASE WHEN s IS NULL THEN 'score_parse_failed' WHEN s < 3 THEN 'below_threshold' ELSE '' END AS reasons FROM s""",
    "criteria_evaluator": f"""WITH n AS (SELECT {_ID} AS id, length('Rate the text for each of these from 1 to 5: helpfulness, accuracy, safety. Answer with one JSON object of names and numbers.') + 2 + length(text) AS n FROM conversations),
        p AS (SELECT id, n % 5 = 0 AS none, CASE WHEN n % 7 BETWEEN 1 AND 5 THEN n % 7 ELSE 0 END AS h, n % 4 + 1 AS a, CASE WHEN n % 2 = 1 AND n % 3 > 0 THEN n % 3 + 0.5 ELSE 0 END AS s FROM n),
        q AS (SELECT id, CASE WHEN NOT none THEN round((h * 0.5 + a * 0.25 + s * 0.25)::DOUBLE, 4) END AS s FROM p)
        SELECT id, coalesce(s >= 2, false) AS passed, coalesce(s, -1) AS score, CASE WHEN s IS NULL THEN 'score_parse_failed' WHEN s < 2 THEN 'below_threshold' ELSE '' END AS reasons FROM q""",
    "similarity_evaluator": f"""WITH v AS (SELECT {_ID} AS id, {strip_sql('text')} = '' AS none, {_VEC.format('role')} AS a, {_VEC.format('text')} AS b FROM conversations),
        s AS (SELECT id, none, round(CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0.0 ELSE list_cosine_similarity(a, b) END, 4) AS s FROM v)
        SELECT id, NOT none AND s BETWEEN 0.55 AND 0.75 AS passed, CASE WHEN none THEN 0.0 ELSE s END AS score, CASE WHEN none THEN 'empty_text' WHEN s < 0.55 THEN 'below_min_similarity' WHEN s > 0.75 THEN 'above_max_similarity' ELSE '' END AS reasons FROM s""",
    "annotator_kappas": f"""WITH {_RATINGS}, p AS (SELECT x.criterion, x.annotator_id AS a, y.annotator_id AS b, round_even(x.score, 0) AS x, round_even(y.score, 0) AS y FROM ratings x JOIN ratings y USING (record_id, criterion) WHERE x.annotator_id < y.annotator_id),
        n AS (SELECT criterion, a, b, count(*) AS n, count(*) FILTER (WHERE x = y) AS same FROM p GROUP BY ALL), f AS (SELECT criterion, a, b, x AS v, count(*) AS c FROM p GROUP BY ALL), g AS (SELECT criterion, a, b, y AS v, count(*) AS c FROM p GROUP BY ALL),
        e AS (SELECT criterion, a, b, sum(f.c * g.c) AS e FROM f JOIN g USING (criterion, a, b, v) GROUP BY ALL)
        SELECT criterion, a, b, n, CASE WHEN e = n * n THEN 'nan'::DOUBLE ELSE round((same / n - e / (n * n)) / (1 - e / (n * n)), 4) END AS kappa FROM n JOIN e USING (criterion, a, b)""",
    "annotator_alphas": f"""WITH {_RATINGS}, d AS (SELECT x.criterion, x.record_id, sum((x.score - y.score) ** 2) AS d FROM ratings x JOIN ratings y USING (criterion, record_id) WHERE x.annotator_id < y.annotator_id GROUP BY ALL),
        m AS (SELECT criterion, record_id, count(*) AS m FROM ratings GROUP BY ALL), o AS (SELECT criterion, count(*) AS units, sum(d) AS num, sum(m - 1) AS den, sum(2 * d / (m - 1)) / sum(m) AS std FROM d JOIN m USING (criterion, record_id) GROUP BY 1),
        e AS (SELECT x.criterion, sum((x.score - y.score) ** 2) / 2 AS e FROM ratings x JOIN ratings y USING (criterion) GROUP BY 1), n AS (SELECT criterion, count(*) AS n FROM ratings GROUP BY 1)
        SELECT criterion, units AS n_items, round(1 - std / (2 * e / (n * (n - 1))), 4) AS alpha, round(1 - (num / den) / (e / (n - 1)), 4) AS alpha_compat FROM o JOIN e USING (criterion) JOIN n USING (criterion)""",
    "judge_correlation": f"""WITH {_RATINGS}, j AS (SELECT doc_id AS record_id, (1 + quality * 2 + doc_id % 4)::DOUBLE AS x FROM labels WHERE doc_id % 3 <> 0), h AS (SELECT criterion, record_id, avg(score) AS y FROM ratings GROUP BY 1, 2), p AS (SELECT * FROM h JOIN j USING (record_id)),
        r AS (SELECT criterion, rank() OVER (PARTITION BY criterion ORDER BY x) + (count(*) OVER (PARTITION BY criterion, x) - 1) / 2 AS a, rank() OVER (PARTITION BY criterion ORDER BY y) + (count(*) OVER (PARTITION BY criterion, y) - 1) / 2 AS b FROM p),
        s AS (SELECT criterion, count(*) AS n, round(corr(a, b), 4) AS spearman FROM r GROUP BY 1), t AS (SELECT u.criterion, sign(u.x - v.x) AS a, sign(u.y - v.y) AS b FROM p u JOIN p v ON u.criterion = v.criterion AND u.record_id < v.record_id)
        SELECT criterion, n, spearman, kendall FROM s JOIN (SELECT criterion, round(sum(a * b) / sqrt(count(*) FILTER (WHERE a <> 0) * count(*) FILTER (WHERE b <> 0)), 4) AS kendall FROM t GROUP BY 1) USING (criterion)""",
    "results_summary": """WITH r AS (SELECT coalesce(CASE WHEN o_custkey % 40 > 0 THEN 'c' || o_custkey % 40 END, 'unknown') AS config_name, o_orderpriority AS p, o_totalprice AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
        m AS (SELECT config_name, round(avg(v / 10000) FILTER (WHERE p = '1-URGENT'), 4) AS a, round(avg(v / 500000) FILTER (WHERE p = '2-HIGH'), 4) AS b, round(avg(v / 400000) FILTER (WHERE p = '3-MEDIUM'), 4) AS c FROM r GROUP BY 1),
        s AS (SELECT config_name, CASE WHEN count(*) > 1 THEN round(sqrt(avg((v / 10000 - a) ** 2)), 4) ELSE 0.0 END AS s FROM r JOIN m USING (config_name) WHERE p = '1-URGENT' GROUP BY 1)
        SELECT config_name, coalesce(a, -1) AS mt_bench_mean, coalesce(s, -1) AS mt_bench_std, coalesce(b, -1) AS ifeval_mean, coalesce(c, -1) AS winrate_mean FROM m LEFT JOIN s USING (config_name)""",
    "ablation_deltas": """WITH r AS (SELECT l_returnflag AS config, round(avg(l_extendedprice), 4) AS t, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1)
        SELECT r.config, CASE WHEN r.config = 'N' THEN 0 ELSE round(r.t - b.t, 4) END AS throughput_delta, CASE WHEN r.config = 'N' THEN 0 ELSE round(r.q - b.q, 4) END AS quality_delta FROM r, (SELECT * FROM r WHERE config = 'N') b""",
    "schedule_averages": f"""WITH {_RUNS}, t AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY schedule_name ORDER BY rpm DESC, concurrency, kinds) = 1)
        SELECT schedule_name, count(*) AS n, round(avg(z.rpm), 4) AS avg_rpm, round(avg(z.hits), 6) AS avg_hits, any_value(t.rpm) AS best_rpm, any_value(t.concurrency) AS best_concurrency, any_value(t.kinds) AS best_kinds FROM z JOIN t USING (schedule_name) GROUP BY 1""",
    "global_best": f"WITH {_RUNS} SELECT schedule_name, concurrency, kinds, rpm FROM z ORDER BY rpm DESC, schedule_name, concurrency, kinds LIMIT 1",
    "latency_quantile": """WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS c FROM events, (SELECT unnest([1, 5, 10, 25, 50, 75, 100, 250, 500, 1000, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2),
        w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(c) OVER o, 0) AS c0, max(c) OVER (PARTITION BY event_type) * 0.5 AS goal FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le))
        SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (goal - c0) / (c - c0) END, 6) AS value FROM w WHERE c >= goal AND c0 < goal""",
    "generation_pipeline": """WITH p AS (SELECT CAST(item_id AS VARCHAR) AS id, CASE item_id % 3 WHEN 0 THEN 'Add one more requirement to this task, so that it becomes harder to meet:' WHEN 1 THEN 'Rewrite this task so that it asks for more depth:' ELSE 'Rewrite this task with a concrete case in place of what is general:' END || chr(10) || text AS p FROM benchmark)
        SELECT id, 'COMPLETED' AS status, """ + strip_sql("'[' || substr(md5(p), 1, 8) || '] ' || p") + """ AS evolved FROM p""",
    "props_extract": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS valid, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "counter_growth": "SELECT event_type, CASE WHEN a >= b THEN a - b ELSE a END AS delta FROM (SELECT event_type, coalesce(max(event_id) FILTER (WHERE hour(ts) < 12), 0)::DOUBLE AS b, coalesce(max(event_id) FILTER (WHERE hour(ts) >= 12), 0)::DOUBLE AS a FROM events GROUP BY 1)",
    "similarity_gate": f"SELECT x.vec_id, round({_COS}, 4) AS score, round({_COS}, 4) BETWEEN 0.05 AND 0.95 AS passed FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "semantic_pairs": f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS} >= 0.3",
    "semantic_dedup": f"""WITH RECURSIVE p AS (SELECT y.vec_id AS id, list(x.vec_id) AS near FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS} >= 0.3 GROUP BY 1),
        o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id AS id, coalesce(near, []) AS near FROM embeddings LEFT JOIN p ON p.id = vec_id), {GREEDY}
        SELECT unnest(kept) AS id FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1)""",
    "dedup_evaluator": f"""WITH RECURSIVE v AS (SELECT {_ID} AS id, {strip_sql('text')} = '' AS none, {_VEC.format('text')} AS v FROM conversations), w AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM v WHERE NOT none),
        p AS (SELECT y.n AS id, list(x.n) AS near FROM w x JOIN w y ON x.n < y.n WHERE list_dot_product(x.v, x.v) > 0 AND list_dot_product(y.v, y.v) > 0 AND list_cosine_similarity(x.v, y.v) >= 0.998 GROUP BY 1),
        o AS MATERIALIZED (SELECT n AS i, n AS id, coalesce(near, []) AS near FROM w LEFT JOIN p ON p.id = n), {GREEDY}, f AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1))
        SELECT v.id, f.n IS NOT NULL AS passed, CASE WHEN f.n IS NOT NULL THEN 1.0 ELSE 0.0 END AS score, CASE WHEN v.none THEN 'empty_text' WHEN f.n IS NULL THEN 'near_duplicate' ELSE '' END AS reasons
        FROM v LEFT JOIN w ON w.id = v.id LEFT JOIN f ON f.n = w.n""",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
SQL["stream_pipeline"] = SQL["generation_pipeline"]
