"""Every query with SQL against DuckDB, and the others for rows and stable columns."""

from __future__ import annotations

import glob
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quantrail.operators import resampling
from quantrail.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v if v is None else str(v)
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=lambda r: [(v is None, v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() & SQL.keys()))
def test_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = ordered(df.collect(), df.columns)
    known = duck.execute(SQL[name])
    columns = [c[0] for c in known.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == ordered(known.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_reads_a_table(sf_dir):
    """None runs on made-up rows alone: with its tables gone, each fails."""
    import inspect

    for name, f in QUERIES.items():
        code = inspect.getsource(f)
        assert "sf_dir" in code.split("->", 1)[-1], name


def resampled(x, replicates):
    n, at = len(x), lambda d: ((int(hashlib.md5(f"1|boot|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52)
    return {k: sum(x[int(at(d) * n)] for d in range(k * n, (k + 1) * n)) / n for k in range(replicates)}


def test_bootstrap_numbers_ranges_of_rows(spark):
    """Rows in several ranges, out of order and with nulls."""
    df = spark.range(999, -1, -1).selectExpr("id AS k", "CASE WHEN id % 7 > 0 THEN cos(id) END AS v").repartition(5)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        places = resampling.numbered(df.filter("v IS NOT NULL"), "k")
    finally:
        spark.conf.unset(setting)
    rows = sorted(places.collect(), key=lambda r: r.k)
    assert [r.i for r in rows] == list(range(len(rows)))
    got = {r.replicate: r.estimate for r in resampling.bootstrap(df, "v", "k", F.avg("x"), 3).collect()}
    assert got == pytest.approx(resampled([r.v for r in rows], 3))


def test_bootstrap_over_stretches(spark, monkeypatch):
    """Places in several stretches, near and far apart; draws are not shuffled one by one."""
    df = spark.range(70_000).selectExpr("id AS k", "cos(id) AS v")
    out = resampling.bootstrap(df, "v", "k", F.avg("x"), 4)
    want = resampled([r.v for r in df.orderBy("k").collect()], 4)
    assert {r.replicate: r.estimate for r in out.collect()} == pytest.approx(want)
    monkeypatch.setattr(resampling, "PACK", 100)
    assert {r.replicate: r.estimate for r in resampling.bootstrap(df, "v", "k", F.avg("x"), 4).collect()} == pytest.approx(want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]


def test_series_of_every_order(spark, duck, sf_dir):
    """Months after 2000 are in the series, and their totals are those of the table."""
    total, late = duck.execute("SELECT sum(o_totalprice), count(*) FILTER (o_orderdate >= '2001-01-01') FROM orders").fetchone()
    rows = QUERIES["moving_average"](spark, sf_dir).collect()
    assert late > 0 and max(r.t for r in rows) > 72
    assert sum(r.y for r in rows) == pytest.approx(total / 1e6, rel=1e-6)


def test_draws_and_rates_of_every_row(spark, duck, sf_dir):
    """A draw for each event, one in each stratum; the loan's internal rate, over inputs that all differ."""
    rows = QUERIES["uniforms_lhs"](spark, sf_dir).collect()
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert len({r.event_id for r in rows}) == len(rows) == n
    assert all(sorted(int(r[c] * n) for r in rows) == list(range(n)) for c in "ab")
    loans = QUERIES["model_loan"](spark, sf_dir).collect()
    assert all(r.irr is not None and (r.irr > 0.15) == (r.npv > 0) for r in loans if abs(r.irr - 0.15) > 0.031) and len({r.irr for r in loans}) > len(loans) * 0.9
