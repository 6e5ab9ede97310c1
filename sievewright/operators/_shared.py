"""Cutting a lineage at files that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        there = sc.getConf().get("spark.checkpoint.dir")
        if not there and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="sievewright-"))
    return df.checkpoint()
