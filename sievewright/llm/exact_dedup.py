"""Exact deduplication: two Bloom passes find possibly repeated texts; only their rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from ._common import col, fresh, table


def possibly_repeated(df: DataFrame, hash_col: str, flag_col: str, rows: int | None = None, filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """The frame with flag_col: false where the hash (a bigint without nulls) certainly occurs once.

    First pass: every task sends the slots that its hashes set, two to three bytes each, to the reducer of their
    range, which keeps the slots set more than once. Second pass: these are broadcast, folded onto filter_bytes
    at most, and each row tests its own. What is folded are the slots of repeated hashes alone, so the filter
    fills with the repeats, not with the rows; the fuller it is the more rows it flags by chance. There is one
    plan for all sizes, and no pass over the rows besides these two.
    """
    rows = df.count() if rows is None else rows
    return df.withColumn(flag_col, bloom.tester(*bloom.build(df.select(hash_col), rows, 2, filter_bytes))(col(hash_col)))


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", filter_bytes: int = bloom.FILTER_BYTES) -> DataFrame:
    """The rows left when of each text only the row with the least `order` stays; columns as they were.

    Texts are equal byte for byte, whatever their length; the hash only finds candidates. A null text equals
    nothing: such rows stay. An empty text is a text like others. A null `order` comes after all numbers; among
    rows of equal text and order the least by the other columns stays (maps left out), so that one of wholly
    equal rows stays. An empty table gives an empty one. Columns may have any names.
    """
    h, flag, rank = fresh(df, "hash", "flag", "rank")
    hashed = df.where(col(text).isNotNull()).withColumn(h, F.xxhash64(col(text)))
    marked = possibly_repeated(hashed, h, flag, df.count(), filter_bytes)
    rest = [col(c).asc_nulls_last() for c, kind in df.dtypes if c not in (text, order) and not any(x in kind for x in ("map<", "variant", "interval"))]
    one = Window.partitionBy(h, col(text)).orderBy(col(order).asc_nulls_last(), *rest)
    first = marked.where(col(flag)).withColumn(rank, F.row_number().over(one)).where(col(rank) == 1)
    cols = [col(c) for c in df.columns]
    return marked.where(~col(flag)).select(cols).unionAll(first.select(cols)).unionAll(df.where(col(text).isNull()))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM documents
        QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang, source, n_chars) = 1""",
}
