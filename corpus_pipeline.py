"""The corpus pipeline: language ID, exact and near deduplication, mixing, tokens.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with the columns of
documents; the last adds the tokens. Every stage's output is written and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm._common import fresh, mark, place, sweep
from sievewright.llm.bpe import encode_column
from sievewright.llm.exact_dedup import exact_dedup
from sievewright.llm.langid import known_language
from sievewright.llm.mixing import mix_rows
from sievewright.llm.simhash import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know stay; empty texts and noise go."""
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least doc_id stays."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the roots of their sizes, out of as many tokens as there are; a source that is short repeats."""
    return mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their text, the number of ids, and whether they decode to the text's bytes.

    The new columns are called ids, n_tokens and exact, with underscores after them where documents has such a column.
    """
    out, *names = fresh(docs, "tokens", "ids", "n_tokens", "exact")
    return encode_column(docs, out=out).withColumns({new: F.col(f"{out}.{name}") for new, name in zip(names, ("ids", "n_tokens", "exact"))}).drop(out)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]
#: No SQL: the network, the fingerprints and the merges cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents. What a stage has written and its successor has read is removed.

    An empty table gives an empty one. Null and empty texts go in the first stage; of equal texts, and of near
    copies, the least doc_id stays, a null one only if there is no other; rows equal in all are one. Documents may come
    several times, where a source is short of its budget. Texts count whole, whatever their length; further
    columns of documents come along.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = place(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, before, mark() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
