"""The generation pipeline, over a table or over a stream of files; both give the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.dedup import merge_first
from ..operators.evaluators import record_summary
from ..sources.records import with_ids

Strategy = Callable[[DataFrame], DataFrame]
#: Evaluators by name, or what adds to a frame what they need and gives them (as evaluators.build() does).
Rules = dict[str, Column] | Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]] | None


def process(df: DataFrame, strategy: Strategy, evaluators: Rules = None, every: bool = False) -> DataFrame:
    """strategy adds columns and `error`. Adds status, rejected_by, score: FAILED with an error, REJECTED by an evaluator, else COMPLETED.

    Evaluators run in order, up to the first that rejects; all of them if `every` is set.
    """
    out = strategy(with_ids(df))
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    if callable(evaluators):
        out, evaluators = evaluators(out)
    evaluators = evaluators or {}
    failed = [F.when(~c["passed"], F.lit(k)) for k, c in evaluators.items()]
    first = F.when(F.col("error").isNull(), F.coalesce(*failed) if failed else F.lit(None).cast("string"))
    out = out.withColumn("rejected_by", first)
    results = F.array(*[F.struct(c["passed"].alias("passed"), c["score"].alias("score")) for c in evaluators.values()]) if evaluators else None
    score = record_summary(results)["aggregate_score"] if evaluators and every else F.lit(None).cast("double")
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("rejected_by").isNotNull(), "REJECTED").otherwise("COMPLETED")
    out = out.withColumn("score", score).withColumn("status", status)
    return out.drop(*[c for c in out.columns if c.startswith("sievewright_")])


def split_by_status(df: DataFrame) -> dict[str, DataFrame]:
    return {k: df.where(F.col("status") == k) for k in ("COMPLETED", "REJECTED", "FAILED")}


def _there(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def current(store: DataFrame) -> DataFrame:
    """The records that count of all written: of an id one, a finished one before a failed one, the last run's before others."""
    w = Window.partitionBy("id").orderBy((F.col("status") == "FAILED").cast("int"), F.col("run").desc())
    return store.withColumn("sievewright_rank", F.row_number().over(w)).where("sievewright_rank = 1").drop("sievewright_rank", "run")


def run_batch(df: DataFrame, path: str, strategy: Strategy, evaluators: Rules = None) -> DataFrame:
    """Resumable: rows whose id path/records holds already, and not as FAILED, are left out. Returns all records that count so far.

    Of equal ids the least row by its columns is taken. A FAILED record is tried again by the next run, and counts no
    more when that succeeds.
    """
    spark, store = df.sparkSession, f"{path}/records"
    df = with_ids(df)
    df = merge_first(df, "id", [c for c, kind in df.dtypes if c != "id" and not kind.startswith("map")] or ["id"])
    have = _there(spark, store)
    if have is not None:
        df = df.join(have.where("status <> 'FAILED'").select("id").distinct(), "id", "left_anti")
    process(df, strategy, evaluators).withColumn("run", F.lit(time.time_ns())).write.mode("append").partitionBy("status").parquet(store)
    return current(spark.read.parquet(store))


def run_stream(stream: DataFrame, path: str, strategy: Strategy, evaluators: Rules = None, rows: int | None = None, seconds: float | None = None, on_batch: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Each micro-batch goes to path/records in a folder of its own number, so that a batch that is run again replaces itself.

    FAILED records are the dead letters, REJECTED ones are kept too; both are partitions of the same table. Within a
    batch the least row by its columns of equal ids is taken; ids that a folder path/ids has, which holds nothing else,
    are left out. seconds: how long a batch gathers; without it what there is is taken at once, and the query ends.
    rows: micro-batches of more are written in files of so many rows. on_batch: called after each write, with its number and rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = with_ids(batch)
        new = merge_first(new, "id", [c for c, kind in new.dtypes if c != "id" and not kind.startswith("map")] or ["id"])
        done = _there(spark, f"{path}/ids")
        if done is not None:
            new = new.join(done.where(F.col("batch") != number).select("id"), "id", "left_anti")
        out = process(new, strategy, evaluators).write.mode("overwrite").partitionBy("status")
        (out.option("maxRecordsPerFile", rows) if rows else out).parquet(f"{path}/records/batch={number}")
        made = spark.read.parquet(f"{path}/records/batch={number}") if _there(spark, f"{path}/records/batch={number}") is not None else None
        if made is not None:
            made.where("status <> 'FAILED'").select("id").write.mode("overwrite").parquet(f"{path}/ids/batch={number}")
            if on_batch:
                on_batch(number, made)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def metrics(df: DataFrame, evaluators: list[str] = (), seconds: float | None = None) -> DataFrame:
    """(evaluator, passed, rejected): how many records each evaluator let through and stopped; with seconds the rate of records a minute too."""
    names = F.explode(F.array(*[F.lit(e) for e in evaluators])).alias("evaluator")
    place = F.array_position(F.array(*[F.lit(e) for e in evaluators]), F.col("rejected_by"))
    own = F.array_position(F.array(*[F.lit(e) for e in evaluators]), F.col("evaluator"))
    judged = df.where("error is null").select(names, "rejected_by").withColumn("p", F.coalesce(place, F.lit(1 << 30))).withColumn("o", own)
    out = judged.groupBy("evaluator").agg(F.count_if(F.col("p") > F.col("o")).alias("passed"), F.count_if(F.col("p") == F.col("o")).alias("rejected"), F.count("*").alias("n"))
    return out.drop("n") if seconds is None else out.withColumn("per_minute", F.col("n") * 60 / F.lit(float(seconds))).drop("n")


def result(df: DataFrame) -> DataFrame:
    """One row: records by status and the mean score."""
    return df.agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "REJECTED").alias("rejected"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.avg("score").alias("avg_score"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream (or table) of events by time window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
