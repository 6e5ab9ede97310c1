import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from sievewright.session import local_session

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=2, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return c


def _plain(x):
    import numpy as np
    import pandas as pd

    if isinstance(x, (list, tuple, np.ndarray)):
        return [_plain(y) for y in x]
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return x if isinstance(x, str) else round(float(x), 9) + 0.0 if hasattr(x, "__float__") else str(x)


@pytest.fixture(scope="session")
def same_rows():
    def compare(df, table):
        a, b = df.toPandas(), table
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = lambda z: sorted(repr([_plain(v) for v in r]) for r in z[cols].itertuples(index=False))
        assert rows(a) == rows(b)

    return compare
