"""Each registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cadenza.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (f[sorted(f.columns)].convert_dtypes() for f in (ours, theirs))
    assert len(ours) == len(theirs)
    order = [c for c in ours if not pd.api.types.is_float_dtype(ours[c])] + [c for c in ours if pd.api.types.is_float_dtype(ours[c])]
    ours, theirs = (f.sort_values(order, ignore_index=True) for f in (ours, theirs))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=1e-9)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
