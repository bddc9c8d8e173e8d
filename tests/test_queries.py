"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from orewright import registry
from orewright.fixtures import TABLES
from orewright.operators import spatial
from orewright.plans.shared import materialize

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_id_validity_over_a_million(spark, tmp_path):
    """the dotted numbers of orders from 654322 on lost a million."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 654300 + i AS o_orderkey, CAST((12345678 + 654300 + i) % 23 AS BIGINT) AS o_custkey FROM range(100) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df, found = QUERIES["t21_id_validity"](spark, str(tmp_path)), con.execute(ORACLES["t21_id_validity"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def broadcasts_dealt_rows(df):
    """Whether a plan sends rows that an explode has multiplied through the driver; Spark takes them for as few as there were before it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for i, line in enumerate(lines):
        at = line.find("BroadcastExchange")
        for below in lines[i + 1 :] if at >= 0 else []:
            if len(below) - len(below.lstrip(" :+-*(0123456789)")) <= at:
                break
            if "Generate explode" in below:
                return True
    return False


#: Queries of F5, F8 and F9.
DEALT = ["a07_zonal_polygons", "a08_footprint_heights", "j20_hash_near_pairs"]


@pytest.mark.parametrize("name", DEALT)
def test_dealt_rows_stay_off_the_driver(spark, name):
    assert not broadcasts_dealt_rows(QUERIES[name](spark, DIR))


def test_peaks_stay_off_the_driver(spark, monkeypatch):
    """each round joins nine rows a peak."""
    plans = []
    monkeypatch.setattr(spatial, "materialize", lambda df, name: plans.append(broadcasts_dealt_rows(df)) or materialize(df, name))
    assert QUERIES["w05_suppress_peaks"](spark, DIR).count() and len(plans) > 2 and not any(plans)
