"""Evaluators: each a struct column (passed, score, reasons) of a record; chains and roll-ups of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parse import criteria_scores, holds_json, judge_score, weighted_score
from ..functions.vectors import cosine
from ._shared import checkpointed
from .clients import Client, EchoClient, HashEmbedder
from .dedup import semantic_dedup
from .sampling import numbered
from .strategies import ask, embed, message


def result(reasons: dict[str, Column], score: Column | None = None) -> Column:
    """struct(passed, score, reasons): passed if no reason holds; the score is 1 or 0 unless given."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons.items()]), lambda x: x.isNotNull())
    passed = F.size(found) == 0
    return F.struct(passed.alias("passed"), (passed if score is None else score).cast("double").alias("score"), found.alias("reasons"))


def completeness(instruction: Column, response: Column) -> Column:
    return result({"missing_instruction": T.blank(instruction), "missing_response": T.blank(response)})


def length_filter(content: Column, least: int = 0, most: int | None = None) -> Column:
    n = F.length(F.coalesce(content, F.lit("")))
    return result({"too_short": n < least, "too_long": n > most if most is not None else F.lit(False)})


def length_window(instruction: Column, response: Column, instruction_tokens: tuple[int, int] = (3, 512), response_tokens: tuple[int, int] = (10, 2048)) -> Column:
    a, b = T.estimated_tokens(instruction), T.estimated_tokens(response)
    return result({
        "instruction_too_short": a < instruction_tokens[0], "instruction_too_long": a > instruction_tokens[1],
        "response_too_short": b < response_tokens[0], "response_too_long": b > response_tokens[1],
    })


def blacklisted(content: Column, patterns: list[str]) -> Column:
    """The patterns that the text matches."""
    return F.filter(F.array(*[F.when(F.coalesce(content, F.lit("")).rlike(p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())


def regex_filter(content: Column, patterns: list[str] = (), require_json: bool = False) -> Column:
    reasons = {"regex_blacklist_hit": F.size(blacklisted(content, list(patterns))) > 0} if patterns else {}
    if require_json:
        reasons["json_invalid"] = ~holds_json(content)
    return result(reasons or {"regex_blacklist_hit": F.lit(False)})


def similarity(a: Column, b: Column, least: float = 0.3, most: float = 0.95) -> Column:
    """a, b: embeddings; null for an empty text."""
    s = F.round(cosine(a, b), 4)
    return result({"empty_text": a.isNull() | b.isNull(), "below_min_similarity": s < least, "above_max_similarity": s > most}, F.coalesce(s, F.lit(0.0)))


def judged(score: Column, threshold: float = 4.0) -> Column:
    """score: as read from the judge's answer, null if it could not be read."""
    return result({"score_parse_failed": score.isNull(), "below_threshold": score < threshold}, score)


def criteria(scores: Column, weights: dict[str, float], threshold: float = 3.5) -> Column:
    """scores: map of name -> score from 1 to 5, null if none could be read."""
    s = F.when(scores.isNotNull(), weighted_score(scores, weights))
    return judged(s, threshold)


#: What a judge is asked to rate; any other text is asked as it is.
JUDGE = {k: f"Rate the {what} of this text from 1 to 5. Answer with the number only." for k, what in {"helpfulness": "helpfulness", "factuality": "factual accuracy", "logical_reasoning": "logic and coherence"}.items()}


@dataclass
class Means:
    """What evaluators by configuration may need: the judge, the embedder, the columns, and how the judge is asked."""

    instruction: str = "instruction"
    response: str = "response"
    judge: Callable[[], Client] = EchoClient
    embedder: Callable[[], object] = HashEmbedder
    retries: int = 0
    key: str = "id"


#: An evaluator by configuration: of a frame, the name of its own column, the means, which rows need it, and its options, the frame
#: with what it needs and the result.
Built = tuple[DataFrame, Column]


def by_judge(df: DataFrame, out: str, means: Means, only: Column, criteria: str = "helpfulness", threshold: float = 4.0) -> Built:
    text = F.concat(F.lit(JUDGE.get(criteria, criteria) + "\n\n"), F.coalesce(F.col(means.response), F.lit("")))
    df = ask(df.withColumn(out, F.when(only, F.array(message("user", text)))), out, means.judge, out, f"{out}_error", means.retries)
    return df, judged(judge_score(F.col(out)), float(threshold))


def by_criteria(df: DataFrame, out: str, means: Means, only: Column, criteria: dict[str, float] | None = None, threshold: float = 3.5) -> Built:
    if criteria is not None and not criteria:
        raise ValueError("multi-criteria needs a criterion")
    weights = {k: float(w) for k, w in (criteria or {"helpfulness": 1, "accuracy": 1, "safety": 1}).items()}
    text = F.concat(F.lit("Rate the text for each of these from 1 to 5: " + ", ".join(weights) + ". Answer with one JSON object of names and numbers.\n\n"), F.coalesce(F.col(means.response), F.lit("")))
    df = ask(df.withColumn(out, F.when(only, F.array(message("user", text)))), out, means.judge, out, f"{out}_error", means.retries)
    df = df.withColumn(out, criteria_scores(F.col(out), list(weights)))
    return df, globals()["criteria"](F.col(out), weights, float(threshold))


def by_similarity(df: DataFrame, out: str, means: Means, only: Column, min_similarity: float = 0.3, max_similarity: float = 0.95) -> Built:
    for side in ("instruction", "response"):
        df = embed(df.withColumn(f"{out}_{side}", F.when(only, F.col(getattr(means, side)))), f"{out}_{side}", means.embedder, f"{out}_{side}")
    return df, similarity(F.col(f"{out}_instruction"), F.col(f"{out}_response"), float(min_similarity), float(max_similarity))


def by_dedup(df: DataFrame, out: str, means: Means, only: Column, threshold: float = 0.95, field: str | None = None) -> Built:
    """In order of id: what is too similar to an accepted record is rejected. The frame is written first, for judges must not be asked twice."""
    df = checkpointed(embed(df.withColumn(out, F.when(only, F.col(field or means.response))), out, means.embedder, out))
    number = F.xxhash64(means.key)
    ranked = numbered(df.where(F.col(out).isNotNull()).select(means.key, number.alias("h")), [means.key, "h"], "at")
    kept = semantic_dedup(ranked.join(df.select(means.key, F.col(out).alias("vector")), means.key).select(F.col("at").alias("id"), "vector"), float(threshold))
    kept = ranked.join(kept.select(F.col("id").alias("at")), "at", "left_semi").select(means.key, F.lit(True).alias(f"{out}_kept"))
    df = df.join(kept.dropDuplicates([means.key]), means.key, "left")
    return df, result({"empty_text": F.col(out).isNull(), "near_duplicate": F.col(out).isNotNull() & F.col(f"{out}_kept").isNull()})


def simple(f: Callable[..., Column], both: bool = False) -> Callable[..., Built]:
    """An evaluator of columns alone, of the response or of instruction and response."""
    return lambda df, out, means, only, **options: (df, f(F.col(means.instruction), F.col(means.response), **options) if both else f(F.col(means.response), **options))


def build(df: DataFrame, chain: list[tuple[str, Callable[..., Built], dict]], means: Means, every: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """The frame and the results, by name, of evaluators in order. Unless `every` is set, a record that one rejects is not sent to the judges after it."""
    out: dict[str, Column] = {}
    only = F.lit(True)
    for k, (name, f, options) in enumerate(chain):
        df, column = f(df, f"sievewright_{k}", means, only, **options)
        df = df.withColumn(f"sievewright_result_{k}", column)
        own = F.col(f"sievewright_result_{k}")
        out[name if name not in out else f"{name}-{k}"] = own
        if not every:
            only = only & own["passed"]
    return df, out


def all_results(df: DataFrame, evaluators: dict[str, Column], out: str = "results") -> DataFrame:
    """Every evaluator's result, in an array."""
    return df.withColumn(out, F.array(*[F.struct(F.lit(k).alias("evaluator"), c["passed"].alias("passed"), c["score"].alias("score"), c["reasons"].alias("reasons")) for k, c in evaluators.items()]))


def chain(df: DataFrame, evaluators: dict[str, Column], out: str = "rejected_by") -> DataFrame:
    """The first evaluator that the record fails, null if none; later ones are not evaluated then."""
    return df.withColumn(out, F.coalesce(*[F.when(~c["passed"], F.lit(k)) for k, c in evaluators.items()]))


def record_summary(results: Column) -> Column:
    """struct(aggregate_score, passed_all) of an array of results: the mean of the scores there are."""
    scores = F.filter(F.transform(results, lambda r: r["score"]), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.round(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores), 4))
    return F.struct(mean.alias("aggregate_score"), F.forall(results, lambda r: r["passed"]).alias("passed_all"))


def summarize(df: DataFrame, results: str = "results") -> DataFrame:
    """A row for each evaluator: counts, pass rate, mean and nearest-rank percentiles of the scores."""
    r = df.select(F.explode(results).alias("r")).select("r.*")
    return r.groupBy("evaluator").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        (F.count_if("passed") / F.count("*")).alias("pass_rate"), F.avg("score").alias("avg_score"),
        F.expr("percentile_disc(0.5) within group (order by score)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by score)").alias("p95"),
    )


def reason_counts(df: DataFrame, results: str = "results") -> DataFrame:
    r = df.select(F.explode(results).alias("r")).select("r.evaluator", F.explode("r.reasons").alias("reason"))
    return r.groupBy("evaluator", "reason").agg(F.count("*").alias("n"))


def warnings(summary: DataFrame, most: float = 0.25) -> DataFrame:
    """Evaluators that more than this share fail."""
    return summary.where(1 - F.col("pass_rate") > most).select("evaluator", (1 - F.col("pass_rate")).alias("failure_rate"))
