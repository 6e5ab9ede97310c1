import pytest
from pyspark.sql import functions as F

from sievewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(name, spark, duck, small, same_rows):
    same_rows(registry.QUERIES[name](spark, small), duck.execute(registry.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_runs(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_streams_on_two_tables_keep_apart(spark, tmp_path, monkeypatch):
    """As on a cluster: every call has spark.checkpoint.dir in common."""
    sc = spark.sparkContext
    monkeypatch.setattr(sc, "master", "spark://there")
    conf = sc.getConf().set("spark.checkpoint.dir", str(tmp_path / "shared"))
    monkeypatch.setattr(sc, "getConf", lambda: conf)
    rows = spark.createDataFrame([(k, f"text {k} of the first table") for k in range(6)], "item_id long, text string")
    rows.write.parquet(f"{tmp_path}/one/benchmark.parquet")
    rows.where("item_id > 1").withColumn("text", F.concat(F.lit("now the second: "), "text")).write.parquet(f"{tmp_path}/two/benchmark.parquet")
    for d in ("one", "two", "two"):
        got, want = (sorted(map(tuple, registry.QUERIES[q](spark, f"{tmp_path}/{d}").collect())) for q in ("stream_pipeline", "generation_pipeline"))
        assert got == want, d


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
