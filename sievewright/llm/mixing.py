"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import col, fresh, small, stored, table

SEED = "mix-1"
#: Rows in one range of keys, about; a range is sorted by one task.
RANGE_ROWS = 1 << 16
KEY_BITS = 60


def word_tokens(text: Column) -> Column:
    """Tokens of a text: its runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(id_col: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def _light(df: DataFrame, source: str, order: str, tokens: Column, seed: str) -> DataFrame:
    """What mixing needs of a row; the text stays behind."""
    return df.select(col(source).cast("string").alias("source"), col(order).alias("doc_id"), tokens.alias("n"), _key(col(order), seed).alias("key"))


def _placed(light: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """light with start (tokens before it in its source), size (tokens of the source) and budget.

    The keys are uniform, so ranges of equal width hold about as many rows: a row's range follows from its key
    alone, with no sampling job, and a source with more rows than one range can hold is spread over many tasks.
    """
    ranges = max(1, -(-light.count() // RANGE_ROWS))
    rows = light.withColumn("range", F.expr(f"key div {-(-(1 << KEY_BITS) // ranges)}"))
    sums = rows.groupBy("source", "range").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sums.groupBy("source").agg(F.sum("s").alias("size"))
    if weights is None:
        weight = F.sqrt("size")
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else None
        weight = F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("w", F.when(F.col("size") > 0, weight).otherwise(0.0))
    whole = sizes.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_n"))
    wanted = F.col("all_n") if total is None else F.lit(int(total))
    sizes = sizes.crossJoin(whole).select(F.col("source").alias("source_"), "size", F.when(F.col("all_w") > 0, F.floor(wanted * F.col("w") / F.col("all_w"))).otherwise(0).cast("long").alias("budget"))
    sums = sums.select(F.col("source").alias("source_"), F.col("range").alias("range_"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    sums = sums.join(sizes.withColumnRenamed("source_", "source__"), F.col("source_").eqNullSafe(F.col("source__")))
    own = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("range") == F.col("range_")))
    return joined.select("source", "doc_id", "n", "key", "size", "budget", (F.col("offset") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("start"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, text: str = "text", source: str = "source", order: str = "doc_id", seed: str = SEED, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, tokens_taken): the rows that make up the mixture.

    Each source gets the floor of total x its weight / all weights as budget, in tokens; by default the weights
    are the roots of the sources' sizes and the total is that of the table. In a source the rows stand in order
    of a hash of `order`; they are taken until the budget is full, over and over in epochs 0, 1, ... where the
    source is smaller than its budget. The row that crosses the budget is taken in part: tokens_taken sums to
    the budget exactly.

    A null source is a source of its own (in `weights` it cannot be named and gets 0 there). Null or empty texts
    count 0 tokens; they come along while the budget is not yet full. A source without any token gives no
    rows. Rows equal in all this are interchangeable; each counts. An empty table gives an empty one.
    """
    light = stored(_light(df, source, order, word_tokens(col(text)) if tokens is None else tokens, seed), "mix")
    placed = _placed(light, weights, total).where("start < budget")
    epochs = placed.withColumn("epoch", F.explode(F.expr("sequence(0L, (budget - start - 1) div size)")))
    left = F.col("budget") - F.col("epoch") * F.col("size") - F.col("start")
    return epochs.select("doc_id", "source", "epoch", F.col("n").alias("n_tokens"), F.least("n", left).alias("tokens_taken"))


def mix_rows(df: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, text: str = "text", source: str = "source", order: str = "doc_id", seed: str = SEED, tokens: Column | None = None) -> DataFrame:
    """The rows of the mixture with the columns they came with, one copy for each epoch that takes them.

    As mix(), but the row that crosses a budget comes whole, and rows that tie with it (equal `order` and size)
    come with it. The cut of each source is one key, so that only keys and sizes shuffle; the texts are read
    again and each row's copies follow from its own key. `tokens` counts a row's tokens, words unless given; for
    languages without spaces give another count. A row for each source goes to the driver's broadcast; sources
    beyond SMALL_ROWS are joined by a shuffle.
    """
    n = word_tokens(col(text)) if tokens is None else tokens.cast("long")
    light = stored(_light(df, source, order, n, seed), "mix")
    placed = _placed(light, weights, total).where("size > 0 and budget > 0")
    s, size_, copies, whole, last, epoch = fresh(df, "source_", "size_", "copies", "whole", "last", "epoch")
    cuts = placed.groupBy("source").agg(
        F.expr("max(budget div size)").alias(whole),
        F.max(F.when(F.expr("start < budget % size"), F.struct("key", "doc_id", "n"))).alias(last),
    ).withColumnRenamed("source", s)
    own = F.struct(_key(col(order), seed).alias("key"), col(order).alias("doc_id"), n.alias("n"))
    out = df.join(small(stored(cuts, "cuts")), col(source).cast("string").eqNullSafe(col(s)))
    out = out.withColumn(copies, col(whole) + F.when(col(last).isNotNull() & (own <= col(last)), 1).otherwise(0)).where(col(copies) > 0)
    return out.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), col(copies)))).select([col(c) for c in df.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_mixing": op6_mixing}
SQL = {
    "op6_mixing": f"""
        WITH t AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n,
                ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key
            FROM documents),
        p AS (
            SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, n
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t),
        s AS (SELECT source, sum(n)::BIGINT AS size FROM t GROUP BY source),
        b AS (
            SELECT source, size,
                floor((SELECT sum(size) FROM s)::DOUBLE * sqrt(size) / (SELECT sum(sqrt(size)) FROM s))::BIGINT AS budget
            FROM s WHERE size > 0),
        e AS (
            SELECT p.doc_id, p.source, p.n, p.start, b.size, b.budget,
                unnest(range(0, (b.budget - p.start - 1) // b.size + 1)) AS epoch
            FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source WHERE p.start < b.budget)
        SELECT doc_id, source, epoch::BIGINT AS epoch, n::BIGINT AS n_tokens,
            least(n, budget - epoch * size - start)::BIGINT AS tokens_taken
        FROM e""",
}
