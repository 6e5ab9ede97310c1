"""Readiness scores and the sweep of filter configurations over one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import numbered

DIMENSIONS = ("completeness", "length", "llm", "similarity", "dedup")
WEIGHTS = {"completeness": 0.10, "length": 0.10, "llm": 0.50, "similarity": 0.15, "dedup": 0.15}


def readiness(scores: dict[str, Column]) -> Column:
    """0 to 100: the weighted mean of the scores there are (the judge's 1 to 5 as 0 to 1); 0 if there is none."""
    parts = {k: (c - 1) / 4 if k == "llm" else c for k, c in scores.items()}
    have = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    return F.when(have > 0, F.round(total / have * 100, 2)).otherwise(0.0)


@dataclass(frozen=True)
class Config:
    name: str
    on: frozenset = field(default_factory=lambda: frozenset(DIMENSIONS))
    llm: float = 3.5
    similarity: tuple[float, float] = (0.3, 0.95)
    readiness: float | None = None
    share: float | None = None


def _called(d: str) -> str:
    return "llm_score" if d == "llm" else d


def configs() -> list[Config]:
    """53: none, all and all but one; pairs and single dimensions; limits of similarity and thresholds of readiness with all dimensions on; five others."""
    every, none = frozenset(DIMENSIONS), frozenset()
    out = [Config("exp1_all_off", none), Config("exp1_full"), *(Config(f"exp1_no_{_called(d)}", every - {d}) for d in DIMENSIONS)]
    out += [Config(f"exp2_{_called(a)}_{_called(b)}", frozenset({a, b})) for a, b in combinations(DIMENSIONS, 2)] + [Config(f"exp2_only_{_called(d)}", frozenset({d})) for d in DIMENSIONS]
    out += [Config(f"exp3_sim_{lo}_{hi}", similarity=(lo / 100, hi / 100)) for lo in (10, 20, 30, 40) for hi in (80, 85, 90, 95)]
    out += [Config("exp3_sim_no_lower", similarity=(0.0, 0.95)), Config("exp3_sim_no_upper", similarity=(0.3, 1.0))]
    out += [Config(f"exp4_threshold_{t}", readiness=float(t)) for t in range(20, 91, 10)]
    out += [Config("exp6_alpagasus", frozenset({"llm"}), llm=4.0), Config("exp6_random_50pct", none, share=0.5), Config("exp6_length_only", frozenset({"length"})), Config("exp6_ifd_style", frozenset({"completeness", "length", "dedup"})), Config("exp6_best", similarity=(0.3, 0.9), readiness=50.0)]
    return out


def _each(df: DataFrame, cfgs: list[Config]) -> tuple[DataFrame, Column]:
    """The frame with every row once for each configuration, as struct `sievewright_c`, and whether the configuration keeps it."""
    use = {d: f"use_{d}" for d in DIMENSIONS}
    kind = "name string, " + ", ".join(f"{u} boolean" for u in use.values()) + ", least_llm double, low double, high double, ready double, share double"
    rows = [(c.name, *[d in c.on for d in DIMENSIONS], c.llm, *c.similarity, -1.0 if c.readiness is None else c.readiness, 1.0 if c.share is None else c.share) for c in cfgs]
    table = df.sparkSession.createDataFrame(rows, kind)
    out, c = df.join(F.broadcast(table.select(F.struct("*").alias("sievewright_c"))), F.lit(True)), F.col("sievewright_c")  # as many rows as there are configurations
    ok = {"llm": F.col("llm") >= c["least_llm"], "similarity": F.col("similarity").between(c["low"], c["high"])}
    keeps = F.coalesce("readiness", F.lit(0.0)) >= c["ready"]
    for d in DIMENSIONS:
        keeps &= ~c[use[d]] | F.coalesce(ok.get(d, F.col(d) >= 1), F.lit(False))
    return out, keeps


def retention(df: DataFrame, cfgs: list[Config] | None = None) -> DataFrame:
    """(config, kept, total, retention_rate) of all configurations in one aggregation; a share keeps so many rows, rounded down."""
    cfgs = cfgs or configs()
    rows, keeps = _each(df, cfgs)
    c = F.col("sievewright_c")
    found = rows.groupBy(c["name"].alias("config"), c["share"].alias("share")).agg(F.count_if(keeps).alias("k"), F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(c.name,) for c in cfgs], "config string")  # an empty frame has them too
    out = names.join(F.broadcast(found), "config", "left").select("config", F.coalesce(F.floor(F.col("k") * F.col("share")), F.lit(0)).cast("long").alias("kept"), F.coalesce("n", F.lit(0)).alias("total"))
    return out.withColumn("retention_rate", F.round(F.when(F.col("total") > 0, F.col("kept") / F.col("total")).otherwise(0.0), 4))


def subsets(df: DataFrame, cfgs: list[Config] | None = None, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Each row once for every configuration that keeps it, with its name; for a write partitioned by config.

    A share takes the rows with the least hashes of seed and key, which is distinct.
    """
    cfgs = cfgs or configs()
    rows, keeps = _each(df, [c for c in cfgs if c.share is None])
    out = rows.where(keeps).withColumn("config", F.col("sievewright_c.name")).drop("sievewright_c")
    for c in cfgs:
        if c.share is not None:
            own, keeps = _each(df, [c])
            some = own.where(keeps).drop("sievewright_c")
            n = int(some.count() * c.share)
            order = some.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("sievewright_h"))
            drawn = numbered(order, ["sievewright_h", key], "sievewright_place").where(F.col("sievewright_place") < n).select(key)
            out = out.unionByName(some.join(drawn, key, "left_semi").withColumn("config", F.lit(c.name)))
    return out


def contributions(kept: DataFrame, value: str = "retention_rate") -> DataFrame:
    """(dimension, contribution): the full configuration's value less that without the dimension."""
    full = kept.where("config = 'exp1_full'").select(F.col(value).alias("f"))
    out = kept.where(F.col("config").isin([f"exp1_no_{_called(d)}" for d in DIMENSIONS])).join(full, F.lit(True))
    return out.select(F.expr("substring(config, 9)").alias("dimension"), (F.col("f") - F.col(value)).alias("contribution"))


def interactions(kept: DataFrame, value: str = "retention_rate") -> DataFrame:
    """(a, b, interaction): a pair's value less the two alone, plus that without filters."""
    names = [_called(d) for d in DIMENSIONS]
    wide = kept.groupBy().pivot("config", [f"exp2_{a}_{b}" for a, b in combinations(names, 2)] + [f"exp2_only_{d}" for d in names] + ["exp1_all_off"]).agg(F.first(value))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"exp2_{a}_{b}") - (F.col(f"exp2_only_{a}") + F.col(f"exp2_only_{b}") - F.col("exp1_all_off"))).alias("interaction")) for a, b in combinations(names, 2)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
