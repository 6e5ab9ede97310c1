"""What the operators share: reading tables, the shared folder, names that do not clash, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may go without it."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if there:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(there)
        return there
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    sc.setCheckpointDir(there := tempfile.mkdtemp(prefix="sievewright-"))
    return there


#: Folders that this process has written and not removed yet.
_made: list[str] = []


def place(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; sweep() removes it."""
    _made.append(path := f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: smaller than a checkpoint, and it cuts the lineage."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where in the list of folders written those to come will begin."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Removes the folders written since mark() gave `since` (up to `until`). Frames that still read them can't be computed afterwards."""
    for path in _made[since:until]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _made[since:until]


#: Rows of a few numbers that are broadcast at most.
SMALL_ROWS = 2_000_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The frame, computed already, with a broadcast hint if it has few rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node of the node's component. edges: pairs of bigints without nulls.

    Alternating large-star and small-star passes (Kiveris et al., 2014); each ends in the shared folder, so that
    the lineage stays short and a lost executor costs one pass, and the one before is removed. Loops and repeated
    edges do no harm; an empty table gives an empty one. The passes end when neither changes the edges.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least, "u")
        if small:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        else:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def seen(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # every edge points from the larger to the smaller node
    at = mark()
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star")
    now, last = seen(e), None
    while now != last and now[0]:
        e = stored(star(star(e, small=False), small=True), "star")
        now, last = seen(e), now
        sweep(spark, at, at + 1)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
