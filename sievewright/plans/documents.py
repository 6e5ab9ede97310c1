"""Queries over documents, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import assessment as A
from ..operators import dedup as D
from ..operators import evaluators as E
from ..operators import results as N
from ..operators import sampling as S
from ..operators import strategies as G
from ..operators import sweep as W
from ..operators.sets import SMALL
from ..operators.stats import best_by

PATTERNS = ["CC BY", r"token = ", r"\d{16}"]
#: The same in SQL: white space as Unicode has it, word characters, the words between white space.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def est_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, length({x}) // 4) END"


#: Of rows o (i from 1 on, id, near: the ids before it that it is near to) the ids that stay, in order, as the last list of k.
GREEDY = "k AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(k.kept, o.near) THEN k.kept ELSE list_append(k.kept, o.id) END FROM k JOIN o ON o.i = k.i + 1)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: what they are is the instruction, their text the response."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("instruction"), F.col("text").alias("response"), "lang", "source", "n_chars")


def _evaluators() -> dict:
    i, r = F.col("instruction"), F.col("response")
    return {"completeness": E.completeness(i, r), "length-filter": E.length_filter(r, 50, 10_000), "length-window": E.length_window(i, r, (2, 512), (10, 2048)), "regex-filter": E.regex_filter(r, PATTERNS)}


RESULTS_SQL = f"""
    r AS (SELECT doc_id AS id, concat_ws(' ', source, lang) AS i, text AS t FROM documents),
    s AS (SELECT *, {strip_sql('i')} AS si, {strip_sql('t')} AS st FROM r),
    m AS (SELECT *, {est_sql('si')} AS ni, {est_sql('st')} AS nt FROM s),
    e AS (
        SELECT id, 'completeness' AS evaluator, list_filter([CASE WHEN si = '' THEN 'missing_instruction' END, CASE WHEN st = '' THEN 'missing_response' END], lambda x: x IS NOT NULL) AS reasons FROM m
        UNION ALL SELECT id, 'length-filter', list_filter([CASE WHEN length(t) < 50 THEN 'too_short' END, CASE WHEN length(t) > 10000 THEN 'too_long' END], lambda x: x IS NOT NULL) FROM m
        UNION ALL SELECT id, 'length-window', list_filter([CASE WHEN ni < 2 THEN 'instruction_too_short' END, CASE WHEN ni > 512 THEN 'instruction_too_long' END,
            CASE WHEN nt < 10 THEN 'response_too_short' END, CASE WHEN nt > 2048 THEN 'response_too_long' END], lambda x: x IS NOT NULL) FROM m
        UNION ALL SELECT id, 'regex-filter', CASE WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in PATTERNS)} THEN ['regex_blacklist_hit'] ELSE [] END FROM m)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    return E.all_results(records(spark, d), _evaluators())


def evaluator_summary(spark, d):  # noqa: ANN001, ANN201
    return E.summarize(_results(spark, d))


def evaluator_reasons(spark, d):  # noqa: ANN001, ANN201
    return E.reason_counts(_results(spark, d))


def evaluator_warnings(spark, d):  # noqa: ANN001, ANN201
    return E.warnings(E.summarize(_results(spark, d)))


def record_scores(spark, d):  # noqa: ANN001, ANN201
    return _results(spark, d).withColumn("s", E.record_summary(F.col("results"))).select("id", "s.aggregate_score", "s.passed_all")


def quality_gate(spark, d):  # noqa: ANN001, ANN201
    return E.chain(records(spark, d), _evaluators()).groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def length_filter(spark, d):  # noqa: ANN001, ANN201
    r = records(spark, d)
    return r.where(E.length_filter(F.col("response"), 50, 10_000)["passed"]).select("id")


def length_window(spark, d):  # noqa: ANN001, ANN201
    w = E.length_window(F.col("instruction"), F.col("response"), (2, 512), (10, 2048))
    return records(spark, d).select("id", w["passed"].alias("passed"), F.array_join(w["reasons"], ",").alias("reasons"))


def completeness(spark, d):  # noqa: ANN001, ANN201
    return records(spark, d).where(E.completeness(F.col("instruction"), F.col("response"))["passed"]).select("id")


def regex_blacklist(spark, d):  # noqa: ANN001, ANN201
    hits = E.blacklisted(F.col("response"), PATTERNS)
    return records(spark, d).select("id", F.array_join(hits, " | ").alias("hits")).where("hits <> ''")


def json_filter(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    return e.groupBy(P.holds_json(F.col("props")).alias("holds_json")).agg(F.count("*").alias("n"))


def duplicate_rate(spark, d):  # noqa: ANN001, ANN201
    return D.duplicate_counts(table(spark, d, "documents"), F.col("text"))


def _distinct_n(n):  # noqa: ANN001, ANN202
    return lambda spark, d: D.distinct_n(table(spark, d, "documents"), F.col("text"), n)


def token_stats(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "documents")
    return r.groupBy("lang").agg(F.avg(T.estimated_tokens(F.col("text"))).alias("avg_tokens"), F.avg(F.size(T.tokens(F.col("text")))).alias("avg_words"), F.sum(T.prompt_tokens(F.col("text"))).alias("prompt_tokens"), F.max(F.size(T.words(F.col("text")))).cast("long").alias("most_words"))


def _labelled(spark: SparkSession, d: str, docs: DataFrame, key: str, how: str) -> DataFrame:
    """The documents with a label or, by left_anti, without one. Up to SMALL ids are broadcast, so that texts do not shuffle."""
    ids = table(spark, d, "labels").select(F.col("doc_id").alias(key))
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key, how)


def _reference(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents without a label, and those with one, which stand for a reference corpus."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _labelled(spark, d, docs, "doc_id", "left_anti"), _labelled(spark, d, docs, "doc_id", "left_semi")


def exact_overlap(spark, d):  # noqa: ANN001, ANN201
    docs, reference = _reference(spark, d)
    return D.exact_overlap(docs, reference).select("doc_id")


def fuzzy_overlap(spark, d):  # noqa: ANN001, ANN201
    """Documents that share 8 in 10 of their word 5-grams with a reference document."""
    docs, reference = (x.select(F.col("doc_id").alias("id"), T.shingles(T.tokens(F.col("text")), 5).alias("shingles")) for x in _reference(spark, d))
    return D.jaccard_pairs(docs, reference, 0.8).select(F.col("a").alias("doc_id"), F.col("b").alias("reference_id"), F.round("similarity", 6).alias("similarity"))


def jaccard_pairs(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.shingles(T.words(F.lower("text")), 5).alias("shingles"))
    return D.jaccard_pairs(docs).select("a", "b", F.round("similarity", 6).alias("similarity"))


def study_dedup(spark, d):  # noqa: ANN001, ANN201
    return D.study_dedup(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def judge_scores(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.coalesce(P.judge_score(F.col("text")), F.lit(-1.0)).alias("score"), P.ten_point_score(F.col("text")).alias("ten"), P.first_rating(F.col("text")).alias("rating"))


def reasoning_split(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "conversations")
    made = F.concat(F.lit("<think>"), F.col("role"), F.lit(" thinks</think> "), F.col("text"), F.lit("<think>again</think>"))
    return c.select("conv_id", "turn", P.reasoning(made).alias("r")).select("conv_id", "turn", "r.reasoning", F.md5("r.answer").alias("answer"))


def evolve_prompts(spark, d):  # noqa: ANN001, ANN201
    b = table(spark, d, "benchmark")
    out = b
    for k in ("round_robin", "batch"):
        out = out.withColumn(k, G.next_mutation(F.col("item_id"), list(G.MUTATIONS), k, 10))
    return out.select("item_id", "round_robin", "batch", G.evolve_prompt(F.col("text"), F.col("round_robin")).alias("prompt"))


def chat_format(spark, d):  # noqa: ANN001, ANN201
    return records(spark, d).select("id", F.md5(G.chat_text(F.col("instruction"), F.col("response"))).alias("chatml"), F.md5(G.chat_text(F.col("instruction"), F.col("response"), "llama3")).alias("llama3"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Five dimensions of each document: flags, a judge's score made from the label, a similarity from its length."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    first = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("keeper"))
    r = docs.withColumn("h", F.md5("text")).join(first, "h").join(labels, "doc_id", "left")
    n = F.size(T.words(F.col("text")))
    r = r.select(
        "doc_id", "source", (~T.blank(F.col("text"))).cast("double").alias("completeness"), n.between(10, 2048).cast("double").alias("length"),
        (F.lit(3.0) + F.col("quality") - F.col("toxic")).alias("llm"), F.round(F.pmod("n_chars", F.lit(100)) / 100, 2).alias("similarity"), (F.col("keeper") == F.col("doc_id")).cast("double").alias("dedup"),
    )
    return r.withColumn("readiness", W.readiness({k: F.col(k) for k in W.DIMENSIONS}))


SCORED_SQL = f"""
    k AS MATERIALIZED (SELECT md5(text) AS h, min(doc_id) AS keeper FROM documents GROUP BY 1),
    x AS (
        SELECT d.doc_id, d.source, CASE WHEN {strip_sql('d.text')} <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS completeness,
            CASE WHEN len({words_sql('d.text')}) BETWEEN 10 AND 2048 THEN 1.0 ELSE 0.0 END::DOUBLE AS length,
            (3.0 + l.quality - l.toxic)::DOUBLE AS llm, round((n_chars % 100)::DOUBLE / 100, 2) AS similarity,
            CASE WHEN k.keeper = d.doc_id THEN 1.0 ELSE 0.0 END::DOUBLE AS dedup
        FROM documents d JOIN k ON md5(d.text) = k.h LEFT JOIN labels l ON l.doc_id = d.doc_id),
    scored AS MATERIALIZED (
        SELECT *, round((completeness * 0.1::DOUBLE + length * 0.1::DOUBLE + coalesce((llm - 1) / 4, 0) * 0.5::DOUBLE + similarity * 0.15::DOUBLE + dedup * 0.15::DOUBLE)
            / (0.1::DOUBLE + 0.1::DOUBLE + CASE WHEN llm IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE) * 100, 2) AS readiness FROM x)"""


def sft_readiness(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("readiness"), 4).alias("readiness"), F.round(F.avg("llm"), 4).alias("llm"))


def config_sweep(spark, d):  # noqa: ANN001, ANN201
    return W.retention(scored(spark, d))


def config_subsets(spark, d):  # noqa: ANN001, ANN201
    return W.subsets(scored(spark, d)).groupBy("config", "source").agg(F.count("*").alias("n"))


def contributions(spark, d):  # noqa: ANN001, ANN201
    return W.contributions(W.retention(scored(spark, d))).withColumn("contribution", F.round("contribution", 4))


def interactions(spark, d):  # noqa: ANN001, ANN201
    return W.interactions(W.retention(scored(spark, d))).withColumn("interaction", F.round("interaction", 4) + F.lit(0.0))


#: The catalogue, written out: what each configuration keeps; exp6_random_50pct keeps half of all, by a hash.
CATALOGUE = """
    exp1_all_off: true
    exp1_full: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp1_no_completeness: length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp1_no_length: completeness >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp1_no_llm_score: completeness >= 1 AND length >= 1 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp1_no_similarity: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND dedup >= 1
    exp1_no_dedup: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95
    exp2_completeness_length: completeness >= 1 AND length >= 1
    exp2_completeness_llm_score: completeness >= 1 AND llm >= 3.5
    exp2_completeness_similarity: completeness >= 1 AND similarity BETWEEN 0.3 AND 0.95
    exp2_completeness_dedup: completeness >= 1 AND dedup >= 1
    exp2_length_llm_score: length >= 1 AND llm >= 3.5
    exp2_length_similarity: length >= 1 AND similarity BETWEEN 0.3 AND 0.95
    exp2_length_dedup: length >= 1 AND dedup >= 1
    exp2_llm_score_similarity: llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95
    exp2_llm_score_dedup: llm >= 3.5 AND dedup >= 1
    exp2_similarity_dedup: similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp2_only_completeness: completeness >= 1
    exp2_only_length: length >= 1
    exp2_only_llm_score: llm >= 3.5
    exp2_only_similarity: similarity BETWEEN 0.3 AND 0.95
    exp2_only_dedup: dedup >= 1
    exp3_sim_10_80: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.1 AND 0.8 AND dedup >= 1
    exp3_sim_10_85: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.1 AND 0.85 AND dedup >= 1
    exp3_sim_10_90: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.1 AND 0.9 AND dedup >= 1
    exp3_sim_10_95: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.1 AND 0.95 AND dedup >= 1
    exp3_sim_20_80: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.2 AND 0.8 AND dedup >= 1
    exp3_sim_20_85: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.2 AND 0.85 AND dedup >= 1
    exp3_sim_20_90: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.2 AND 0.9 AND dedup >= 1
    exp3_sim_20_95: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.2 AND 0.95 AND dedup >= 1
    exp3_sim_30_80: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.8 AND dedup >= 1
    exp3_sim_30_85: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.85 AND dedup >= 1
    exp3_sim_30_90: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.9 AND dedup >= 1
    exp3_sim_30_95: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1
    exp3_sim_40_80: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.4 AND 0.8 AND dedup >= 1
    exp3_sim_40_85: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.4 AND 0.85 AND dedup >= 1
    exp3_sim_40_90: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.4 AND 0.9 AND dedup >= 1
    exp3_sim_40_95: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.4 AND 0.95 AND dedup >= 1
    exp3_sim_no_lower: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.0 AND 0.95 AND dedup >= 1
    exp3_sim_no_upper: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 1.0 AND dedup >= 1
    exp4_threshold_20: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 20
    exp4_threshold_30: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 30
    exp4_threshold_40: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 40
    exp4_threshold_50: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 50
    exp4_threshold_60: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 60
    exp4_threshold_70: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 70
    exp4_threshold_80: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 80
    exp4_threshold_90: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.95 AND dedup >= 1 AND readiness >= 90
    exp6_alpagasus: llm >= 4.0
    exp6_length_only: length >= 1
    exp6_ifd_style: completeness >= 1 AND length >= 1 AND dedup >= 1
    exp6_best: completeness >= 1 AND length >= 1 AND llm >= 3.5 AND similarity BETWEEN 0.3 AND 0.9 AND dedup >= 1 AND readiness >= 50
"""
_KEPT = dict(x.strip().split(": ", 1) for x in CATALOGUE.strip().splitlines())
KEPT_SQL = (
    f"SELECT config, kept, total, round(kept::DOUBLE / total, 4) AS retention_rate FROM (SELECT unnest({[*_KEPT, 'exp6_random_50pct']}) AS config, unnest(k) AS kept, total FROM ("
    + "SELECT [" + ", ".join(f"count(*) FILTER (WHERE {p})" for p in _KEPT.values()) + ", count(*) // 2] AS k, count(*) AS total FROM scored))"
)


def split_round_robin(spark, d):  # noqa: ANN001, ANN201
    docs = S.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return docs.select("doc_id", "index", S.round_robin(F.col("index"), 4).alias("shard"))


def merge_dedup(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return D.merge_first(docs.withColumn("key", F.col("n_chars")), "key", ["lang", "doc_id"]).select("key", "doc_id", "lang")


def resume_anti_join(spark, d):  # noqa: ANN001, ANN201
    return D.resume(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def stratified_sample(spark, d):  # noqa: ANN001, ANN201
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    r = docs.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("score"))
    return S.stratified(r, "doc_id", "score", 52).select("doc_id", "stratum")


def hash_sample(spark, d):  # noqa: ANN001, ANN201
    return S.hash_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100)


def prefix_plan(spark, d):  # noqa: ANN001, ANN201
    """Requests with a common prefix take turns by group."""
    docs = table(spark, d, "documents").select("doc_id", T.prefix_key(F.col("text")).alias("prefix"), "source")
    return S.striped(docs, "source", "doc_id").select("doc_id", F.md5("prefix").alias("prefix"), F.col("turn").cast("long").alias("turn"))


def longest_by_source(spark, d):  # noqa: ANN001, ANN201
    return best_by(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")])


def overlap_rates(spark, d):  # noqa: ANN001, ANN201
    docs, reference = (x.select(F.col("doc_id").alias("id"), "text") for x in _reference(spark, d))
    return A.overlap_rates(docs, reference).select(F.round("exact_overlap_rate", 9).alias("exact_overlap_rate"), F.round("fuzzy_overlap_rate", 9).alias("fuzzy_overlap_rate"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, reference = (_labelled(spark, d, records(spark, d), "id", how) for how in ("left_anti", "left_semi"))
    return A.dataset_metrics(docs, reference=reference.select("id", "response"))


def dataset_metrics(spark, d):  # noqa: ANN001, ANN201
    """Of the documents without a label; those with one are the reference."""
    m = _metrics(spark, d)
    return m.select([F.round(c, 9).alias(c) for c in m.columns])


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    rows, results = E.build(_labelled(spark, d, records(spark, d), "id", "left_anti"), A.SFT_READINESS.chain(), E.Means(), every=True)
    return E.all_results(rows, results)


def assessment_score(spark, d):  # noqa: ANN001, ANN201
    return A.score(_assessed(spark, d), _metrics(spark, d))


def quality_summary(spark, d):  # noqa: ANN001, ANN201
    return A.quality_summary(_assessed(spark, d))


def retention_join(spark, d):  # noqa: ANN001, ANN201
    """The catalogue with the retention of the runs that there are, 1 for the others."""
    kept = W.retention(scored(spark, d)).where("config LIKE 'exp4%'")
    names = spark.createDataFrame([(c.name,) for c in W.configs()], "config string")
    return N.with_retention(names, kept)


QUERIES = {
    "overlap_rates": overlap_rates, "dataset_metrics": dataset_metrics, "assessment_score": assessment_score, "quality_summary": quality_summary, "retention_join": retention_join,
    "evaluator_summary": evaluator_summary, "evaluator_reasons": evaluator_reasons, "evaluator_warnings": evaluator_warnings, "record_scores": record_scores,
    "quality_gate": quality_gate, "length_filter": length_filter, "length_window": length_window, "completeness": completeness, "regex_blacklist": regex_blacklist,
    "json_filter": json_filter, "duplicate_rate": duplicate_rate, "distinct_1": _distinct_n(1), "distinct_2": _distinct_n(2), "token_stats": token_stats,
    "exact_overlap": exact_overlap, "fuzzy_overlap": fuzzy_overlap, "jaccard_pairs": jaccard_pairs, "study_dedup": study_dedup, "judge_scores": judge_scores,
    "reasoning_split": reasoning_split, "evolve_prompts": evolve_prompts, "chat_format": chat_format, "sft_readiness": sft_readiness, "config_sweep": config_sweep,
    "config_subsets": config_subsets, "contributions": contributions, "interactions": interactions, "split_round_robin": split_round_robin, "merge_dedup": merge_dedup,
    "resume_anti_join": resume_anti_join, "stratified_sample": stratified_sample, "hash_sample": hash_sample, "prefix_plan": prefix_plan, "longest_by_source": longest_by_source,
}

_SHINGLES = "SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS g FROM {}"
_SUMMARY = "SELECT evaluator, count(*) AS total, count(*) FILTER (WHERE len(reasons) = 0) AS passed, count(*) FILTER (WHERE len(reasons) > 0) AS failed, avg(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0.0 END) AS avg_score, quantile_disc(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 0.5) AS p50, quantile_disc(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 0.95) AS p95 FROM e GROUP BY 1"
_NUM = r"regexp_extract_all({}, '\d+(?:\.\d+)?')"

_REF = f"""a AS MATERIALIZED (SELECT doc_id AS id, text, concat_ws(' ', source, lang) AS instruction, {tokens_sql('text')} AS w, doc_id IN (SELECT doc_id FROM labels) AS ref FROM documents),
    d AS (SELECT id, w FROM a WHERE NOT ref), b AS (SELECT id, w FROM a WHERE ref), total AS (SELECT count(*) AS n FROM d),
    dg AS ({_SHINGLES.format('d')}), bg AS ({_SHINGLES.format('b')}), dn AS (SELECT id, count(*) AS n FROM dg GROUP BY 1), bn AS (SELECT id, count(*) AS n FROM bg GROUP BY 1),
    ex AS (SELECT id FROM d WHERE len(w) > 0 AND array_to_string(w, ' ') IN (SELECT array_to_string(w, ' ') FROM b)),
    fz AS (SELECT x AS id FROM (SELECT dg.id AS x, bg.id AS y, count(*) AS c FROM dg JOIN bg USING (g) GROUP BY 1, 2) JOIN dn ON dn.id = x JOIN bn ON bn.id = y WHERE c / (dn.n + bn.n - c) >= 0.8),
    rates AS (SELECT (SELECT count(*) FROM ex) / n AS exact_overlap_rate, (SELECT count(DISTINCT id) FROM (SELECT id FROM ex UNION ALL SELECT id FROM fz)) / n AS fuzzy_overlap_rate FROM total),
    t AS (SELECT array_to_string(w, ' ') AS t FROM d), g AS (SELECT t, count(*) AS n FROM t GROUP BY 1), one AS (SELECT unnest(w) AS g FROM d),
    two AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM d), st AS (SELECT {strip_sql('instruction')} AS si, {strip_sql('text')} AS st FROM a WHERE NOT ref),
    metrics AS (SELECT (SELECT sum(n - 1) FILTER (WHERE t <> '') / sum(n) FROM g) AS duplicate_rate, (SELECT count(DISTINCT g) / count(*) FROM one) AS distinct_1, (SELECT count(DISTINCT g) / count(*) FROM two) AS distinct_2,
        (SELECT avg({est_sql('si')}) FROM st) AS avg_instruction_tokens, (SELECT avg({est_sql('st')}) FROM st) AS avg_response_tokens, exact_overlap_rate, fuzzy_overlap_rate FROM rates),
    parts AS (SELECT (si <> '' AND st <> '')::INTEGER AS c, ({est_sql('si')} BETWEEN 3 AND 512 AND {est_sql('st')} BETWEEN 10 AND 2048)::INTEGER AS l,
        (NOT regexp_matches(lower(st), 'as an ai|i cannot|i''m sorry|cannot assist with'))::INTEGER AS r FROM st)"""
SQL = {
    "overlap_rates": f"WITH {_REF} SELECT round(exact_overlap_rate, 9) AS exact_overlap_rate, round(fuzzy_overlap_rate, 9) AS fuzzy_overlap_rate FROM rates",
    "dataset_metrics": f"WITH {_REF} SELECT " + ", ".join(f"round({c}, 9) AS {c}" for c in ("duplicate_rate", "distinct_1", "distinct_2", "avg_instruction_tokens", "avg_response_tokens", "exact_overlap_rate", "fuzzy_overlap_rate")) + " FROM metrics",
    "assessment_score": f"""WITH {_REF} SELECT round((0.1 * avg(c) * 100 + 0.1 * avg(l) * 100 + 0.1 * avg(r) * 100 + 0.1 * (1 - any_value(duplicate_rate)) * 100 + 0.05 * any_value(distinct_2) * 100 + 0.05 * (1 - any_value(exact_overlap_rate)) * 100
        + 0.05 * (1 - any_value(fuzzy_overlap_rate)) * 100)::DOUBLE / 0.55::DOUBLE, 2) AS score FROM parts, metrics""",
    "quality_summary": f"WITH {_REF} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, count(*) AS scored, sum({c})::BIGINT AS passed, round(sum({c}) / count(*), 4) AS pass_rate, round(avg({c}), 4) AS avg_score FROM parts" for n, c in (("completeness", "c"), ("length-window", "l"), ("regex-filter", "r"))),
    "retention_join": f"WITH {SCORED_SQL}, z AS ({KEPT_SQL}) SELECT config, CASE WHEN config LIKE 'exp4%' THEN retention_rate ELSE 1.0 END AS retention_rate FROM z",
    "evaluator_summary": f"WITH {RESULTS_SQL} {_SUMMARY}",
    "evaluator_reasons": f"WITH {RESULTS_SQL} SELECT evaluator, reason, count(*) AS n FROM (SELECT evaluator, unnest(reasons) AS reason FROM e) GROUP BY 1, 2",
    "evaluator_warnings": f"WITH {RESULTS_SQL}, z AS ({_SUMMARY}) SELECT evaluator, 1 - pass_rate AS failure_rate FROM z WHERE 1 - pass_rate > 0.25",
    "record_scores": f"WITH {RESULTS_SQL} SELECT id, round(avg(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0.0 END), 4) AS aggregate_score, bool_and(len(reasons) = 0) AS passed_all FROM e GROUP BY 1",
    "quality_gate": f"""WITH {RESULTS_SQL}, f AS (SELECT id, coalesce(min_by(evaluator, list_position(['completeness', 'length-filter', 'length-window', 'regex-filter'], evaluator)) FILTER (WHERE len(reasons) > 0), 'kept') AS outcome FROM e GROUP BY 1)
        SELECT outcome, count(*) AS n FROM f GROUP BY 1""",
    "length_filter": "SELECT doc_id AS id FROM documents WHERE length(text) BETWEEN 50 AND 10000",
    "length_window": f"WITH {RESULTS_SQL} SELECT id, len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS reasons FROM e WHERE evaluator = 'length-window'",
    "completeness": f"WITH {RESULTS_SQL} SELECT id FROM e WHERE evaluator = 'completeness' AND len(reasons) = 0",
    "regex_blacklist": "SELECT * FROM (SELECT doc_id AS id, concat_ws(' | ', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{p}' END" for p in PATTERNS) + ") AS hits FROM documents) WHERE hits <> ''",
    "json_filter": "SELECT json_valid(props) AS holds_json, count(*) AS n FROM events GROUP BY 1",
    "duplicate_rate": f"""WITH t AS (SELECT array_to_string({tokens_sql('text')}, ' ') AS t FROM documents), g AS (SELECT t, count(*) AS n FROM t GROUP BY 1)
        SELECT sum(n)::BIGINT AS rows, coalesce(sum(n - 1) FILTER (WHERE t <> ''), 0)::BIGINT AS duplicates, coalesce(sum(n - 1) FILTER (WHERE t <> ''), 0) / greatest(sum(n), 1) AS duplicate_rate FROM g""",
    "distinct_1": f"WITH g AS (SELECT unnest({tokens_sql('text')}) AS g FROM documents) SELECT count(DISTINCT g) AS distinct_ngrams, count(*) AS ngrams, count(DISTINCT g) / count(*) AS ratio FROM g",
    "distinct_2": f"WITH t AS (SELECT {tokens_sql('text')} AS w FROM documents), g AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM t) SELECT count(DISTINCT g) AS distinct_ngrams, count(*) AS ngrams, count(DISTINCT g) / count(*) AS ratio FROM g",
    "token_stats": f"""WITH s AS (SELECT lang, text, {strip_sql('text')} AS st FROM documents)
        SELECT lang, avg({est_sql('st')}) AS avg_tokens, avg(len({tokens_sql('text')})) AS avg_words, sum(greatest(1, length(text) // 5))::BIGINT AS prompt_tokens, max(len({words_sql('text')})) AS most_words FROM s GROUP BY 1""",
    "exact_overlap": f"""WITH t AS (SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS t, doc_id IN (SELECT doc_id FROM labels) AS ref FROM documents)
        SELECT doc_id FROM t WHERE NOT ref AND t <> '' AND t IN (SELECT t FROM t WHERE ref)""",
    "fuzzy_overlap": f"""WITH a AS (SELECT doc_id AS id, {tokens_sql('text')} AS w, doc_id IN (SELECT doc_id FROM labels) AS ref FROM documents),
        d AS (SELECT id, w FROM a WHERE NOT ref), b AS (SELECT id, w FROM a WHERE ref),
        dg AS ({_SHINGLES.format('d')}), bg AS ({_SHINGLES.format('b')}), dn AS (SELECT id, count(*) AS n FROM dg GROUP BY 1), bn AS (SELECT id, count(*) AS n FROM bg GROUP BY 1),
        c AS (SELECT dg.id AS doc_id, bg.id AS reference_id, count(*) AS c FROM dg JOIN bg USING (g) GROUP BY 1, 2)
        SELECT doc_id, reference_id, round(c / (dn.n + bn.n - c), 6) AS similarity FROM c JOIN dn ON dn.id = doc_id JOIN bn ON bn.id = reference_id WHERE c / (dn.n + bn.n - c) >= 0.8""",
    "jaccard_pairs": f"""WITH d AS (SELECT doc_id AS id, {words_sql('lower(text)')} AS w FROM documents), g AS ({_SHINGLES.format('d')}), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT a, b, round(c / (p.n + q.n - c), 6) AS similarity FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.8""",
    "study_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {words_sql('lower(text)')} AS w FROM documents), u AS (SELECT id, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w FROM d), g AS ({_SHINGLES.format('u')}), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2), t AS MATERIALIZED (SELECT doc_id AS id, {strip_sql('text')} AS t FROM documents),
        e AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.8 UNION SELECT x.id, y.id FROM t x JOIN t y ON x.t = y.t AND x.id < y.id),
        l AS (SELECT b AS id, list(a) AS near FROM e GROUP BY 1), o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t.id) AS i, t.id, coalesce(near, []) AS near FROM t LEFT JOIN l USING (id)), {GREEDY},
        f AS MATERIALIZED (SELECT unnest(kept) AS id FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1))
        SELECT id, CASE WHEN id IN (SELECT id FROM f) THEN 'kept' WHEN t IN (SELECT t FROM t JOIN f USING (id)) THEN 'exact_duplicate' ELSE 'near_duplicate' END AS status FROM t""",
    "judge_scores": rf"""WITH s AS (SELECT doc_id, text, {strip_sql('text')} AS st FROM documents),
        x AS (SELECT *, list_filter(list_transform({_NUM.format('st')}, lambda v: v::DOUBLE), lambda v: v BETWEEN 1 AND 5) AS i, regexp_extract_all(text, '\b\d+(?:\.\d+)?\b') AS k FROM s)
        SELECT doc_id, coalesce(CASE WHEN regexp_full_match(st, '\d+(\.\d+)?') THEN CASE WHEN st::DOUBLE BETWEEN 1 AND 5 THEN st::DOUBLE END ELSE i[-1] END, -1) AS score,
            CASE WHEN len(k) > 0 THEN least(10.0, k[-1]::DOUBLE) * 10 ELSE 0 END AS ten, coalesce(nullif(regexp_extract(text, '\b(10|[1-9])\b', 1), '')::DOUBLE, 5.0) AS rating FROM x""",
    "reasoning_split": f"SELECT conv_id, turn, role || ' thinks' AS reasoning, md5({strip_sql('text')}) AS answer FROM conversations",
    "evolve_prompts": "WITH m AS (SELECT item_id, text, ['constraints', 'deepen', 'concretize'] AS k FROM benchmark) SELECT item_id, k[item_id % 3 + 1] AS round_robin, k[(item_id // 10) % 3 + 1] AS batch, CASE item_id % 3 WHEN 0 THEN 'Add one more requirement to this task, so that it becomes harder to meet:' WHEN 1 THEN 'Rewrite this task so that it asks for more depth:' ELSE 'Rewrite this task with a concrete case in place of what is general:' END || chr(10) || text AS prompt FROM m",
    "chat_format": """SELECT doc_id AS id, md5('<|im_start|>user' || chr(10) || source || ' ' || lang || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>') AS chatml,
        md5('<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || source || ' ' || lang || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>') AS llama3 FROM documents""",
    "sft_readiness": f"WITH {SCORED_SQL} SELECT source, count(*) AS n, round(avg(readiness), 4) AS readiness, round(avg(llm), 4) AS llm FROM scored GROUP BY 1",
    "config_sweep": f"WITH {SCORED_SQL} {KEPT_SQL}",
    "config_subsets": f"WITH {SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS config, source, count(*) AS n FROM scored WHERE {p} GROUP BY source" for n, p in _KEPT.items())
        + " UNION ALL SELECT 'exp6_random_50pct', source, count(*) FROM (SELECT source FROM scored ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT count(*) // 2 FROM scored)) GROUP BY source",
    "contributions": f"WITH {SCORED_SQL}, z AS MATERIALIZED ({KEPT_SQL}) SELECT substr(config, 9) AS dimension, round((SELECT retention_rate FROM z WHERE config = 'exp1_full') - retention_rate, 4) AS contribution FROM z WHERE config LIKE 'exp1_no_%'",
    "interactions": f"""WITH {SCORED_SQL}, z AS MATERIALIZED ({KEPT_SQL}), d AS (SELECT unnest(['completeness', 'length', 'llm_score', 'similarity', 'dedup']) AS d, unnest([1, 2, 3, 4, 5]) AS k)
        SELECT x.d AS a, y.d AS b, round(p.retention_rate - (sx.retention_rate + sy.retention_rate - o.retention_rate), 4) + 0.0 AS interaction
        FROM d x JOIN d y ON x.k < y.k JOIN z p ON p.config = 'exp2_' || x.d || '_' || y.d JOIN z sx ON sx.config = 'exp2_only_' || x.d JOIN z sy ON sy.config = 'exp2_only_' || y.d JOIN z o ON o.config = 'exp1_all_off'""",
    "split_round_robin": 'SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS "index", ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INTEGER AS shard FROM documents',
    "merge_dedup": "SELECT n_chars AS key, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY lang, doc_id) = 1",
    "resume_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "stratified_sample": """WITH r AS (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN n_chars END AS score FROM documents d LEFT JOIN labels l USING (doc_id)),
        s AS (SELECT doc_id, (CASE WHEN score IS NULL THEN 4 ELSE least(3, (row_number() OVER (ORDER BY score NULLS LAST, doc_id) - 1) // greatest(1, count(score) OVER () // 4)) END)::INTEGER AS stratum FROM r)
        SELECT doc_id, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) <= CASE stratum WHEN 0 THEN 12 ELSE 10 END""",
    "hash_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "prefix_plan": """WITH x AS (SELECT doc_id, md5(substr(text, 1, 96)) AS prefix, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS own, min(doc_id) OVER (PARTITION BY source) AS f FROM documents)
        SELECT doc_id, prefix, row_number() OVER (ORDER BY own, f) - 1 AS turn FROM x""",
    "longest_by_source": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
}
