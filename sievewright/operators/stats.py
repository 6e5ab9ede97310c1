"""Statistics of scores and raters, computed from counts of value pairs wherever that is smaller than the rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpointed
from .sampling import running_sum

#: Distinct value pairs in a range of values, about, and ranges of each value at most.
RANGE_PAIRS, RANGES = 1 << 16, 1000


def aggregate_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population standard deviation (0 for one run) and number by configuration."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def confusion(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, observed, expected, kappa), unweighted; kappa is NaN if chance agrees always."""
    c = confusion(df, x, y)
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = c.groupBy("x").agg(F.sum("n").alias("a")), c.groupBy("y").agg(F.sum("n").alias("b"))
    chance = rows.join(cols, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("chance"))
    r = total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("expected"))
    return r.withColumn("kappa", F.when(F.col("expected") == 1, F.lit(float("nan"))).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def _mid_ranks(c: DataFrame, v: str, one: bool) -> DataFrame:
    """(v, r): the mean rank of each value, from the counts of values; one: they fit a range, which one task sorts."""
    m = c.groupBy(F.col(v).alias("v")).agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = m.withColumn("before", before) if one else running_sum(m, ["v"], "m")
    return placed.select("v", (F.col("before") + (F.col("m") + 1) / 2).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): the correlation of mean ranks; null below two rows or without variance. No task sorts more than a range of values."""
    c = checkpointed(confusion(df, x, y))
    one = c.count() <= RANGE_PAIRS
    rx, ry = _mid_ranks(c, "x", one).toDF("x", "rx"), _mid_ranks(c, "y", one).toDF("y", "ry")
    r = c.join(rx, "x").join(ry, "y")
    s = r.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * e).alias(k) for k, e in {"sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") * F.col("rx"), "syy": F.col("ry") * F.col("ry"), "sxy": F.col("rx") * F.col("ry")}.items()])
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("n", F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).alias("rho"))


def _orders(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """(concordant, discordant) pairs of weighted points: halves by x, each half's points counted against the other's by y."""
    con = dis = 0
    work = [np.argsort(x, kind="stable")]
    while work:
        at = work.pop()
        cut = len(at) // 2
        if len(at) < 2 or x[at[0]] == x[at[-1]]:
            continue
        # the cut goes between different values
        lo, hi = np.searchsorted(x[at], x[at[cut]], "left"), np.searchsorted(x[at], x[at[cut]], "right")
        cut = lo if lo > 0 else hi
        left, right = at[:cut], at[cut:]
        order = left[np.argsort(y[left], kind="stable")]
        sums = np.r_[0, np.cumsum(n[order])]
        con += int((n[right] * sums[np.searchsorted(y[order], y[right], "left")]).sum())
        dis += int((n[right] * (sums[-1] - sums[np.searchsorted(y[order], y[right], "right")])).sum())
        work += [left, right]
    return con, dis


def _counted(of: str, by: str):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        con, dis = _orders(pdf[of].to_numpy(), pdf[by].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"con": [con], "dis": [dis]})

    return run


def _ranged(c: DataFrame, v: str, ranges: int, out: str) -> DataFrame:
    """Numbers of ranges of a value in order: odd ones hold a single value each, even ones the values between."""
    cuts = sorted(set(c.approxQuantile(v, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    edges = F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<double>")
    below, same = F.size(F.filter(edges, lambda e: e < F.col(v))), F.array_contains(edges, F.col(v))
    return c.withColumn(out, (below * 2 + same.cast("int")).cast("long"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (concordant, discordant, tau_b), from distinct value pairs and their counts; tau_b is null without variance.

    Both values fall into ranges of about RANGE_PAIRS pairs. Pairs of points in one range of x are counted there,
    of the others those in one range of y there, by the range of x; what differs in both follows from the counts of
    the cells, RANGES squared at most. No task sees more than a range: a value that many points share is a range of
    its own, within which nothing is to be counted. NaN values are left out.
    """
    c = confusion(df, x, y).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n").where("not isnan(x) and not isnan(y)")
    c = checkpointed(c)
    ranges = max(1, min(RANGES, -(-c.count() // RANGE_PAIRS)))
    if ranges > 1:
        c = checkpointed(_ranged(_ranged(c, "x", ranges, "xr"), "y", ranges, "yr"))
    found = [c.groupBy().applyInPandas(_counted("x", "y"), "con long, dis long")] if ranges == 1 else [
        c.where("xr % 2 = 0").groupBy("xr").applyInPandas(_counted("x", "y"), "con long, dis long"), c.where("yr % 2 = 0").groupBy("yr").applyInPandas(_counted("xr", "y"), "con long, dis long"),
        c.groupBy("xr", "yr").agg(F.sum("n").alias("n")).groupBy().applyInPandas(_counted("xr", "yr"), "con long, dis long"),
    ]
    total = reduce(DataFrame.unionAll, found).agg(F.coalesce(F.sum("con"), F.lit(0)).alias("con"), F.coalesce(F.sum("dis"), F.lit(0)).alias("dis"))
    free = lambda v: c.groupBy(v).agg(F.sum("n").alias("m")).agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias(f"free_{v}"))
    both = total.join(free("x"), F.lit(True)).join(free("y"), F.lit(True))
    return both.select(F.col("con").alias("concordant"), F.col("dis").alias("discordant"), F.when((F.col("free_x") > 0) & (F.col("free_y") > 0), (F.col("con") - F.col("dis")) / F.sqrt(F.col("free_x") * F.col("free_y"))).alias("tau_b"))


def krippendorff(df: DataFrame, unit: str, value: str) -> DataFrame:
    """One row (units, alpha, alpha_compat) over (unit, value) ratings, with squared distances; units counts those with two ratings or more.

    alpha is the standard one, without units rated once. alpha_compat is that of an earlier tool: the observed squares are
    divided by the sum of ratings less one over such units, the expected ones are those of all ratings, of units rated
    once too, divided by the number of ratings less one. Both are 1 if all ratings are equal; null below two ratings
    of a unit.
    """
    v = F.col(value).cast("double")
    u = df.where(F.col(value).isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    two = F.col("m") > 1
    within = F.col("m") * F.col("q") - F.col("s") * F.col("s")
    sums = {k: F.sum(F.when(two, F.col(c))) for k, c in {"n": "m", "s2": "s", "q2": "q"}.items()}
    t = u.agg(F.count_if(two).alias("units"), *[f.alias(k) for k, f in sums.items()], F.sum(F.when(two, within / (F.col("m") - 1))).alias("within"), F.sum(F.when(two, within)).alias("o_num"), F.sum(F.when(two, F.col("m") - 1)).alias("o_den"), F.sum("m").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    expected = (F.col("n") * F.col("q2") - F.col("s2") * F.col("s2")) / (F.col("n") * (F.col("n") - 1))
    alpha = F.when(F.col("units") > 0, F.when(expected > 0, 1 - F.col("within") / F.col("n") / expected).otherwise(1.0))
    e = (F.col("all_n") * F.col("all_q") - F.col("all_s") * F.col("all_s")) / (F.col("all_n") - 1)
    compat = F.when(F.col("o_den") > 0, F.when(e > 0, 1 - F.col("o_num") / F.col("o_den") / e).otherwise(1.0))
    return t.select("units", alpha.alias("alpha"), compat.alias("alpha_compat"))


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("sievewright_rank", F.row_number().over(w)).where("sievewright_rank = 1").drop("sievewright_rank")


def counter_delta(df: DataFrame, keys: list[str], value: str, phase: str = "phase") -> DataFrame:
    """Growth of cumulative counters from phase before to after; a counter that fell counts from 0."""
    s = df.groupBy(*keys).agg(F.max(F.when(F.col(phase) == "before", F.col(value))).alias("b"), F.max(F.when(F.col(phase) == "after", F.col(value))).alias("a"))
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return s.select(*keys, F.when(a >= b, a - b).otherwise(a).alias("delta"))


def histogram_quantile(df: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, value) of cumulative buckets (le, count): linear within the bucket that holds the quantile."""
    w = Window.partitionBy(*keys).orderBy("le")
    lower, under = F.coalesce(F.lag("le").over(w), F.lit(0.0)), F.coalesce(F.lag("count").over(w), F.lit(0.0))
    total = F.max("count").over(Window.partitionBy(*keys))
    r = df.select(*keys, "le", "count", lower.alias("lo"), under.alias("c0"), (total * q).alias("goal")).where("count >= goal and c0 < goal")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("goal") - F.col("c0")) / (F.col("count") - F.col("c0"))
    return r.select(*keys, F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside).alias("value"))
