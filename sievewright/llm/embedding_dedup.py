"""Near-duplicate embeddings: int8 tile products with error bounds; only pairs possibly above the threshold are computed in full."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import near_pairs, tile_pairs, unit
from ._common import col, components, stored, table

THRESHOLD = 0.5


def _links(threshold: float) -> Callable:
    """(a, b, links, certain) of two tiles: the possible pairs of a and b, or counts of certain links of a.

    Certain links are summed up within the task: links of each vector, and for each linked vector one link (a, b) to
    one that it is linked with, so that a group of thousands of near copies costs as many rows, not their square.
    """

    def found(a_ids, x, b_ids, y, same):  # noqa: ANN001, ANN202
        base, ids = len(a_ids), a_ids if same else np.concatenate([a_ids, b_ids])
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, sure in near_pairs(x, y, threshold, same):
            j = j if same else j + base
            u, v = i[sure], j[sure]
            np.add.at(count, u, 1)
            np.add.at(count, v, 1)
            root = _linked(root, u, v)
            u, v = ids[i[~sure]], ids[j[~sure]]
            if len(u):
                yield _rows(u, v, np.zeros(len(u), np.int64), False)
        some = np.flatnonzero(count)
        if len(some):
            yield _rows(ids[some], ids[root[some]], count[some], True)

    return found


def _rows(a: np.ndarray, b: np.ndarray, links: np.ndarray, certain: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links), pa.array([certain] * len(a), pa.bool_())], names=["a", "b", "links", "certain"])


def _linked(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root: some place that each place is linked with; the same with the links u, v."""
    while len(u):
        low = np.minimum(root[u], root[v])
        was = root.copy()
        np.minimum.at(root, was[u], low)
        np.minimum.at(root, was[v], low)
        root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    while (root[root] != root).any():
        root = root[root]
    return root


def _products(threshold: float) -> Callable:
    """Rows (a, b, v of a, v of b): those whose product in double precision is at the threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = np.zeros(len(x), bool)
            lengths = np.array([len(v) for v in x])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                ok[at] = np.einsum("ij,ij->i", unit([x[k] for k in at], n), unit([y[k] for k in at], n)) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def embedding_groups(df: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", order: str = "vec_id") -> DataFrame:
    """(vec_id, class_id, group_id, links): a row for each id and each vector that it has.

    class_id: the least id with an equal vector. links: how many other vectors (equal ones count once) have a cosine
    of threshold (above 0) or more with this one. group_id: the least id that is linked with this one, directly or
    over others; its own class's if there is none. No link is lost: what a vector is near to is counted over all.

    Vectors that are null or empty, hold a null or no finite number, or are zero are near nothing; so are vectors of
    different lengths. Equal rows are one row, rows without an id are left out. Ids may be of any type that sorts.
    An empty table gives an empty one. Other columns are not read.

    Equal vectors are one, under a 64-bit hash. The distinct ones are multiplied as int8 tiles (tile_pairs()); pairs that
    the error bound leaves open are joined back to the full vectors.
    """
    rows = df.where(col(order).isNotNull()).select(col(order).alias("id"), col(vector).alias("v"))
    members = stored(rows.select("id", F.xxhash64("v").alias("c"), F.when(F.size("v") > 0, F.col("v")).alias("v")).groupBy("id", "c").agg(F.first("v").alias("v")), "members")
    classes = stored(members.groupBy("c").agg(F.min("id").alias("least"), F.first("v", ignorenulls=True).alias("v")), "classes")
    found = stored(tile_pairs(classes.select("c", "v"), classes.count(), threshold, _links(threshold), "a long, b long, links long, certain boolean", stored), "links")
    open_ = found.where("not certain").select("a", "b")
    full = lambda s: classes.select(F.col("c").alias(s), F.col("v").alias(f"{s}v"))
    checked = stored(open_.join(full("a"), "a").join(full("b"), "b").select("a", "b", "av", "bv").mapInArrow(_products(threshold), "a long, b long"), "checked")
    sure = found.where("certain")
    one = F.lit(1).cast("long")
    links = sure.select(F.col("a").alias("c"), "links").unionAll(checked.select("a", one)).unionAll(checked.select("b", one)).groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(stored(sure.select("a", "b").unionAll(checked), "edges"))
    placed = classes.select("c", "least").join(groups, F.col("c") == F.col("node"), "left").join(links, "c", "left").select("c", "least", F.coalesce("root", "c").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = stored(placed, "places")
    roots = placed.groupBy("g").agg(F.min("least").alias("group_id"))
    known_rows = members.where("v is not null").select("id", "c").join(placed.join(roots, "g"), "c").select("id", F.col("least").alias("class_id"), "group_id", "links")
    alone = members.where("v is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    return known_rows.unionAll(alone).withColumnRenamed("id", "vec_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_near_dedup": op4_embedding_near_dedup}
SQL = {
    "op4_embedding_near_dedup": f"""
        WITH RECURSIVE e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
        d AS (SELECT v, min(vec_id) AS c FROM e GROUP BY v),
        p AS (SELECT x.c AS a, y.c AS b FROM d x JOIN d y ON x.c <> y.c WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
        r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        g AS (SELECT a, min(b) AS b FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
        SELECT e.vec_id, d.c AS class_id, least(d.c, coalesce(g.b, d.c)) AS group_id, coalesce(n.links, 0) AS links
        FROM e JOIN d USING (v) LEFT JOIN g ON g.a = d.c LEFT JOIN n ON n.a = d.c""",
}
