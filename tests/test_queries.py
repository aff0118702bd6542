"""Every registered query runs; those with SQL give the rows DuckDB gives."""

import math

import duckdb
import pytest

from tapewatch.catalog import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = load_all()
SLOW_WITHOUT_SQL = {"kmeans_selection", "model_comparison", "learning_curve", "feature_elimination", "combined_vs_per_pattern",
                    "tree_models", "boosting_stages", "pattern_detector", "weak_supervision"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if hasattr(v, "quantize") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_against_sql(spark, data, duck, name):
    df = REGISTRY[name].build(spark, data)
    rel = duck.sql(REGISTRY[name].sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql and n not in SLOW_WITHOUT_SQL])
def test_runs(spark, data, name):
    df = REGISTRY[name].build(spark, data)
    assert df.columns and df.limit(1).count() >= 0


def test_inventory_is_covered():
    """Every inventory id of the blueprint appears in some query."""
    covered = {i for q in REGISTRY.values() for i in q.covers.split()}
    wanted = {f"S{i}" for i in range(1, 22) if i != 5} | {f"P{i}" for i in range(1, 25) if i != 23} | {f"J{i}" for i in range(1, 22)}
    wanted |= {f"A{i}" for i in range(1, 41)} | {f"W{i}" for i in range(1, 34)} | {f"T-{i}" for i in range(1, 10)} | {f"U{i}" for i in range(1, 7)}
    wanted |= {f"F{i}" for i in range(1, 29)} | {f"R{i}" for i in range(1, 12) if i != 8} | {f"M{i}" for i in range(1, 38)} | {f"E{i}" for i in range(1, 9)}
    assert sorted(wanted - covered) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
