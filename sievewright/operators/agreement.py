"""Agreement of raters with each other, and of a judge with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats

CRITERIA = ("instruction_clarity", "response_quality", "response_completeness", "overall_quality")
ANNOTATIONS = "record_id string, annotator_id int, " + ", ".join(f"{c} double" for c in CRITERIA) + ", notes string"


def annotation_sheet(samples: DataFrame, annotators: int, key: str = "record_id") -> DataFrame:
    """A row to fill in for each sample and annotator (1, 2, ...), with the columns of ANNOTATIONS."""
    empty = [F.lit(None).cast("double").alias(c) for c in CRITERIA]
    return samples.select(F.col(key).cast("string").alias("record_id"), F.explode(F.sequence(F.lit(1), F.lit(annotators))).alias("annotator_id"), *empty, F.lit("").alias("notes"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Filled sheets (CSV): (record_id, annotator_id, criterion, score); empty cells and cells that are no number are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    cells = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).try_cast("double").alias("score")) for c in CRITERIA if c in raw.columns])
    return raw.select("record_id", F.col("annotator_id").cast("int"), F.explode(cells).alias("x")).select("record_id", "annotator_id", "x.*").where("score is not null")


def pairs(ratings: DataFrame) -> DataFrame:
    """(criterion, a, b, x, y): the ratings of each two annotators of one record, a < b; a record has few annotators."""
    other = ratings.select("record_id", "criterion", F.col("annotator_id").alias("b"), F.col("score").alias("y"))
    return ratings.select("record_id", "criterion", F.col("annotator_id").alias("a"), F.col("score").alias("x")).join(other, ["record_id", "criterion"]).where("a < b")


def pairwise_kappas(ratings: DataFrame) -> DataFrame:
    """(criterion, a, b, n, kappa): Cohen's kappa of each two annotators, of scores rounded to whole numbers (halves to even); NaN if chance agrees always."""
    c = pairs(ratings).groupBy("criterion", "a", "b", F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y")).agg(F.count("*").alias("n"))
    key = ["criterion", "a", "b"]
    total = c.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = c.groupBy(*key, F.col("x").alias("v")).agg(F.sum("n").alias("p")), c.groupBy(*key, F.col("y").alias("v")).agg(F.sum("n").alias("q"))
    chance = rows.join(cols, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("p") * F.col("q")).alias("chance"))
    t = total.join(chance, key, "left")
    observed, expected = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return t.select(*key, "n", F.when(expected == 1, F.lit(float("nan"))).otherwise(F.round((observed - expected) / (1 - expected), 4)).alias("kappa"))


def alphas(ratings: DataFrame) -> DataFrame:
    """(criterion, n_items, alpha, alpha_compat): Krippendorff's, as stats.krippendorff() says, for each criterion."""
    parts = [stats.krippendorff(ratings.where(F.col("criterion") == c), "record_id", "score").select(F.lit(c).alias("criterion"), F.col("units").alias("n_items"), F.round("alpha", 4).alias("alpha"), F.round("alpha_compat", 4).alias("alpha_compat")) for c in CRITERIA]
    return reduce(DataFrame.unionAll, parts)


def judge_correlation(ratings: DataFrame, judged: DataFrame) -> DataFrame:
    """(criterion, n, spearman, kendall) of a judge's scores (record_id, llm) and the mean of the people's; null below two records or without variance."""
    human = ratings.groupBy("record_id", "criterion").agg(F.avg("score").alias("human")).join(judged.select("record_id", "llm"), "record_id")
    out = []
    for c in CRITERIA:
        own = human.where(F.col("criterion") == c)
        s, k = stats.spearman(own, "llm", "human"), stats.kendall(own, "llm", "human")
        out.append(s.join(k, F.lit(True)).select(F.lit(c).alias("criterion"), F.coalesce("n", F.lit(0)).alias("n"), F.round("rho", 4).alias("spearman"), F.round("tau_b", 4).alias("kendall")))
    return reduce(DataFrame.unionAll, out)
