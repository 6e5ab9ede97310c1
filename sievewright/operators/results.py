"""Results of evaluations and experiments: loading, summaries by configuration, deltas, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import best_by

#: Benchmark -> the field that its result is in, and the columns of its mean and spread in a summary.
SCORES = {"mt_bench": ("overall_score", "mt_bench_mean", "mt_bench_std"), "ifeval": ("strict_accuracy", "ifeval_mean", None), "alpacaeval_winrate": ("win_rate", "winrate_mean", None)}
RESULT = "benchmark string, config_name string, run_id int, overall_score double, strict_accuracy double, win_rate double"


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The result files (one JSON object each) of a folder; what is no JSON is skipped, a missing benchmark is the file name up to the first underscore."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.from_json("value", RESULT + ", bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r")).where("r is not null and r.bad is null")
    return raw.select("file", "r.*").drop("bad").withColumn("benchmark", F.coalesce("benchmark", F.regexp_extract("file", r"^([^_.]*)", 1)))


def results_summary(results: DataFrame) -> DataFrame:
    """(config_name, mt_bench_mean, mt_bench_std, ifeval_mean, winrate_mean), four places: one row for each configuration of any benchmark.

    The spread is that of the population around the rounded mean, 0 for one run. A missing name is "unknown".
    """
    r = results.withColumn("config_name", F.coalesce("config_name", F.lit("unknown"))).where(F.col("benchmark").isin(*SCORES))
    mean = {b: F.round(F.avg(F.when(F.col("benchmark") == b, F.col(f))), 4) for b, (f, _, _) in SCORES.items()}
    one = r.groupBy("config_name").agg(*[mean[b].alias(m) for b, (_, m, _) in SCORES.items()])
    field = SCORES["mt_bench"][0]
    spread = r.where(F.col("benchmark") == "mt_bench").join(one.select("config_name", F.col("mt_bench_mean").alias("m")), "config_name").groupBy("config_name").agg(
        F.when(F.count(field) > 1, F.round(F.sqrt(F.avg((F.col(field) - F.col("m")) * (F.col(field) - F.col("m")))), 4)).otherwise(0.0).alias("mt_bench_std")
    )
    return one.join(spread, "config_name", "left").select("config_name", "mt_bench_mean", "mt_bench_std", "ifeval_mean", "winrate_mean")


def with_retention(catalogue: DataFrame, retention: DataFrame) -> DataFrame:
    """The catalogue with each configuration's retention rate, 1.0 where none is known."""
    return catalogue.join(retention.select("config", F.col("retention_rate").alias("sievewright_rate")), "config", "left").withColumn("retention_rate", F.coalesce("sievewright_rate", F.lit(1.0))).drop("sievewright_rate")


def deltas(rows: DataFrame, baseline: str = "full", values: tuple[str, ...] = ("throughput", "quality"), key: str = "config") -> DataFrame:
    """The rows with each value less the baseline's, as {value}_delta; null for the baseline itself and without one."""
    base = rows.where(F.col(key) == baseline).agg(*[F.first(F.coalesce(F.col(v), F.lit(0.0))).alias(f"sievewright_{v}") for v in values])
    out = rows.join(base, F.lit(True), "left")
    return out.withColumns({f"{v}_delta": F.when(F.col(key) != baseline, F.coalesce(F.col(v), F.lit(0.0)) - F.col(f"sievewright_{v}")) for v in values}).drop(*[f"sievewright_{v}" for v in values])


def latest(rows: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """Of rows with equal keys the one of the last file by name."""
    return best_by(rows, keys, [F.col(file).desc()])


def group_averages(rows: DataFrame, group: str, values: dict[str, str], best: str, order: list[str]) -> DataFrame:
    """(group, n, means by their new names, best value, and `order` of the best row: of equal ones the least by these)."""
    w = Window.partitionBy(group).orderBy(F.col(best).desc(), *order)
    top = rows.withColumn("sievewright_rank", F.row_number().over(w)).where("sievewright_rank = 1").select(group, F.col(best).alias(f"best_{best}"), *[F.col(c).alias(f"best_{c}") for c in order])
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(v).alias(name) for v, name in values.items()]).join(top, group)


def global_best(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row, the one of the greatest value; of equal ones the least by order."""
    return rows.orderBy(F.col(value).desc_nulls_last(), *order).limit(1)


def latex_table(header: list[str], rows: list[list[object]], caption: str = "", label: str = "") -> str:
    """A table for LaTeX; numbers have two places, nulls are dashes."""
    cell = lambda x: "---" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%")
    body = "\n".join("  " + " & ".join(map(cell, r)) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{' c' * (len(header) - 1)}}}", r"\toprule", " & ".join(header) + r" \\", r"\midrule", body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"
