"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from clausemill.plans import contracts as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, float):
            return "" if math.isnan(x) else f"{x:.9g}"
        return "" if x is None or x is pd.NaT else str(x.tolist() if hasattr(x, "tolist") else x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, row)) for row in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, small, duck, name):
    """Those without SQL are in test_brute_force.py."""
    got, want = registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_all_queries_are_tested():
    from pathlib import Path

    plain = (Path(__file__).parent / "test_brute_force.py").read_text()
    assert all(name in registry.ORACLES or f'"{name}"' in plain for name in registry.QUERIES)
