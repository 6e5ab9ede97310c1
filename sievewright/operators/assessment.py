"""Suites that assess a dataset as a whole: metrics of it, a score from 0 to 100, a report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup as D
from . import evaluators as E

#: What an answer says that is no answer.
REFUSALS = ["(?iu)as an ai", "(?iu)i cannot", "(?iu)i'm sorry", "(?iu)cannot assist with"]


@dataclass(frozen=True)
class Suite:
    """Evaluators with the weights of their mean scores, metrics of the dataset with theirs, and the share of failures that is warned of."""

    name: str
    weights: dict[str, float]
    metric_weights: dict[str, float]
    scale: dict[str, float] = field(default_factory=dict)
    sample: int = 1000
    seed: int = 42

    def chain(self, judge: bool = False, embedder: bool = False) -> list[tuple[str, object, dict]]:
        """The evaluators, as build() takes them; those that need a judge or an embedder only with one."""
        out = [("completeness", E.simple(E.completeness, True), {}), ("length-window", E.simple(E.length_window, True), {}), ("regex-filter", E.simple(E.regex_filter), {"patterns": REFUSALS})]
        out += [("multi-criteria", E.by_criteria, {"criteria": {"helpfulness": 0.5, "accuracy": 0.3, "safety": 0.2}, "threshold": 3.5})] * judge
        return out + [("similarity", E.by_similarity, {"min_similarity": 0.2, "max_similarity": 0.92})] * embedder


SFT_READINESS = Suite(
    "sft_readiness_v1",
    {"completeness": 0.10, "length-window": 0.10, "regex-filter": 0.10, "multi-criteria": 0.35, "similarity": 0.10},
    {"duplicate_rate": 0.10, "distinct_2": 0.05, "exact_overlap_rate": 0.05, "fuzzy_overlap_rate": 0.05},
    {"multi-criteria": 5.0},
)
#: Metrics of which less is better.
RATES = ("duplicate_rate", "exact_overlap_rate", "fuzzy_overlap_rate")


def overlap_rates(df: DataFrame, reference: DataFrame, text: str = "text", key: str = "id", threshold: float = 0.8) -> DataFrame:
    """One row: the share of rows whose normalised text is a reference's, and the share that is so or near one by word 5-grams. Keys are distinct."""
    side = lambda d: d.select(key, T.shingles(T.tokens(F.col(text)), 5).alias("shingles")).withColumnRenamed(key, "id")
    exact = D.exact_overlap(df, reference, text).select(F.col(key).alias("id"))
    near = D.jaccard_overlap(side(df), side(reference), threshold)
    hits = exact.withColumn("exact", F.lit(1)).unionByName(near.withColumn("exact", F.lit(0))).groupBy("id").agg(F.max("exact").alias("exact"))
    found = hits.agg(F.coalesce(F.sum("exact"), F.lit(0)).alias("e"), F.count("*").alias("f"))
    total = df.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    return total.join(found, F.lit(True)).select((F.col("e") / F.col("n")).alias("exact_overlap_rate"), (F.col("f") / F.col("n")).alias("fuzzy_overlap_rate"))


def dataset_metrics(df: DataFrame, instruction: str = "instruction", response: str = "response", reference: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One row: duplicate_rate, distinct_1, distinct_2, mean estimated tokens of both sides; with a reference (key, response) the overlap rates too."""
    text = F.coalesce(F.col(response), F.lit(""))
    means = df.agg(*[F.coalesce(F.avg(T.estimated_tokens(F.col(c))), F.lit(0.0)).alias(f"avg_{n}_tokens") for c, n in ((instruction, "instruction"), (response, "response"))])
    parts = [D.duplicate_counts(df, text).select("duplicate_rate"), *(D.distinct_n(df, text, n).select(F.col("ratio").alias(f"distinct_{n}")) for n in (1, 2)), means]
    if reference is not None:
        parts.append(overlap_rates(df, reference, response, key))
    out = parts[0]
    for p in parts[1:]:  # of one row each
        out = out.join(p, F.lit(True))
    return out


def aggregate_score(means: dict[str, Column], metrics: dict[str, Column], suite: Suite = SFT_READINESS) -> Column:
    """0 to 100, two places: the weighted mean of the evaluators' mean scores and of the metrics that there are (not null); null if there is none."""
    parts = [(w, c / suite.scale.get(k, 1.0)) for k, w in suite.weights.items() if (c := means.get(k)) is not None]
    parts += [(w, 1 - c if k in RATES else c) for k, w in suite.metric_weights.items() if (c := metrics.get(k)) is not None]
    have = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    total = sum((F.coalesce(c * 100 * w, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return F.when(have > 0, F.round(total / have, 2))


def score(results: DataFrame, metrics: DataFrame, suite: Suite = SFT_READINESS, column: str = "results") -> DataFrame:
    """One row: the suite's score of assessed rows (as all_results() gives them) and metrics of one row."""
    r = results.select(F.explode(column).alias("r")).select("r.*")
    means = r.agg(*[F.avg(F.when(F.col("evaluator") == k, F.col("score"))).alias(k) for k in suite.weights])
    both = means.join(metrics, F.lit(True))
    return both.select(aggregate_score({k: F.col(f"`{k}`") for k in suite.weights}, {k: F.col(k) for k in suite.metric_weights if k in metrics.columns}, suite).alias("score"))


def quality_summary(results: DataFrame, column: str = "results") -> DataFrame:
    """A row for each evaluator (dimension): how many were scored and passed, the pass rate and the mean of the scores there are."""
    r = results.select(F.explode(column).alias("r")).select("r.*")
    return r.groupBy(F.col("evaluator").alias("dimension")).agg(F.count("*").alias("scored"), F.count_if("passed").alias("passed"), F.round(F.count_if("passed") / F.count("*"), 4).alias("pass_rate"), F.round(F.avg("score"), 4).alias("avg_score"))


def report(name: str, summary: list[dict], metrics: dict, value: float | None, warned: list[dict], total: int) -> dict[str, str]:
    """File name -> text: the assessment as JSON, as Markdown and as HTML."""
    data = {"name": name, "records": total, "score": value, "metrics": metrics, "evaluators": summary, "warnings": warned}
    cells = ("evaluator", "total", "passed", "pass_rate", "avg_score")
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    md = [f"# {name}", "", f"Records: {total}. Score: {show(value)}", "", "| " + " | ".join(cells) + " |", "|" + "---|" * len(cells)]
    md += ["| " + " | ".join(show(r.get(c)) for c in cells) + " |" for r in summary]
    md += ["", *(f"- {k}: {show(v)}" for k, v in metrics.items()), *(f"- Warning: {w['evaluator']} fails {w['failure_rate']:.1%}" for w in warned)]
    rows = "".join("<tr>" + "".join(f"<td>{show(r.get(c))}</td>" for c in cells) + "</tr>" for r in summary)
    html = f"<!doctype html><title>{name}</title><h1>{name}</h1><p>Score {show(value)} over {total} records</p><table><tr>{''.join(f'<th>{c}</th>' for c in cells)}</tr>{rows}</table><ul>{''.join(f'<li>{k}: {show(v)}</li>' for k, v in metrics.items())}</ul>"
    return {"summary.json": json.dumps(data, indent=1, default=str), "report.md": "\n".join(md) + "\n", "report.html": html}
