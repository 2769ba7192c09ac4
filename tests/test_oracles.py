"""Every query of the spatial engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans import operator_queries, shape_queries, trip_queries, workflow_queries

QUERIES = trip_queries.QUERIES | operator_queries.QUERIES | shape_queries.QUERIES | workflow_queries.QUERIES
ORACLES = trip_queries.ORACLES | operator_queries.ORACLES | shape_queries.ORACLES | workflow_queries.ORACLES


def plain(value):
    if isinstance(value, str):
        return value
    if value is None or pd.isna(value):
        return None
    return float(value) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)


def rows(frame):
    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = oracle.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    elif name != "workflow_accessibility_redevelopment":  # no parcel is served on the smallest tables
        assert len(got)
