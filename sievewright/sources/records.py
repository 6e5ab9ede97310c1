"""Readers and writers of records: JSON lines, CSV, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A record on its way through the pipeline.
ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("seed_data", T.StringType()), T.StructField("synthetic_data", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
STATUSES = ("PENDING", "GENERATED", "EVALUATING", "REJECTED", "COMPLETED", "FAILED")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object on each line; blank lines are skipped, a malformed one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; all columns are strings, quoted line feeds and doubled quotes are understood, empty stays empty."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"jsonl": read_jsonl, "csv": read_csv, "parquet": read_parquet}


def read_records(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}: one of {sorted(READERS)}")
    return READERS[kind](spark, path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if k.startswith(("struct", "array", "map")) else F.col(c) for c, k in df.dtypes])


def write_records(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "overwrite", flatten: bool = False) -> None:
    """Nested values become JSON text in CSV always, in Parquet if asked; an empty frame keeps its schema."""
    if kind == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        flattened(df).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")
    elif kind == "parquet":
        (flattened(df) if flatten else df).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}: one of {sorted(READERS)}")


def with_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids as strings; rows without one get the hash of their content, so that a resumed run knows them."""
    content = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key])), 256)
    own = F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")
    return df.withColumn(key, F.coalesce(own, content))


def envelope(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows as records: the whole row is the seed."""
    ided = with_ids(df, key)
    none = F.lit(None)
    return ided.select(F.col(key).alias("id"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("seed_data"), none.cast("string").alias("synthetic_data"), none.cast("double").alias("score"), F.lit("PENDING").alias("status"), F.create_map().cast("map<string,string>").alias("metadata"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files, numbered from 1 within each file; blank ones count but are left out.

    A file may be read by many tasks: lines are counted by block, and a block's first number follows from those before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = blocks.select("path", "block", "first", before.alias("before"))
    out = raw.join(F.broadcast(numbers), ["path", "block"])
    return out.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value").where(F.trim("value") != "")


def read_for_assessment(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """(id, instruction, response) of JSON lines (by path and line number where there is no id) or of a table, normalised row by row."""
    if kind != "jsonl":
        return normalize(read_records(spark, path, kind))
    rows = read_numbered(spark, path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    read = rows.select("path", "line", F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("no JSON: "), "path", F.lit(":"), "line"))).alias("bad"), *[field(n).alias(n) for n in ("id", "instruction", "response", "output", "seed_data", "synthetic_data")])
    return normalize(read.where("bad is null").drop("bad"), number="line", path_column="path")


def normalize(df: DataFrame, path: str = "", number: str | None = None, path_column: str | None = None) -> DataFrame:
    """(id, instruction, response), each row by its own form: a record if it has seed_data, else flat.

    The response falls back to `output`, the id to path:line. A frame with the columns of neither form is an error.
    """
    have = dict(df.dtypes)

    def part(parent: str, name: str):  # noqa: ANN202
        kind = have.get(parent, "")
        if kind == "string":
            return F.get_json_object(parent, f"$.{name}")
        return F.col(f"{parent}.{name}").cast("string") if f"{name}:" in kind else F.lit(None).cast("string")

    flat = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    if "seed_data" not in have and not ("instruction" in have and ("response" in have or "output" in have)):
        raise ValueError("neither records nor rows with an instruction and a response or output")
    nested = F.col("seed_data").isNotNull() if "seed_data" in have else F.lit(False)
    instruction = F.when(nested, part("seed_data", "instruction")).otherwise(flat("instruction"))
    response = F.when(nested, F.coalesce(part("synthetic_data", "response"), part("synthetic_data", "output"))).otherwise(F.coalesce(flat("response"), flat("output")))
    where = F.col(path_column) if path_column else F.lit(path)
    line = F.concat(where, F.lit(":"), F.col(number).cast("string")) if number else F.lit(None).cast("string")
    return df.select(F.coalesce(flat("id"), line).alias("id"), instruction.alias("instruction"), response.alias("response"))


def serialize(df: DataFrame) -> DataFrame:
    """One column of compact JSON with the time of writing, as UTC text."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select(F.to_json(F.struct(*df.columns, stamp.alias("timestamp"))).alias("value"))
