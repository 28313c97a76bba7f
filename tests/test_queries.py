"""Every registered query of the operators runs on the smallest tables; those with SQL agree with it."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from compare_sql import canonical
from stormglass.plans import queries
from stormglass.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = canonical([tuple(r) for r in got.collect()], got.columns)
    want = db.execute(ORACLES[name]).fetchall()
    assert rows == canonical(want, [d[0] for d in db.description])


#: Columns and least rows of the queries that SQL can't express.
SHAPES = {
    "calibration_slope_intercept": (["model", "slope", "intercept"], 2),
    "fit_predict_logistic": (["entity", "date", "p", "fallback"], 100),
    "conditional_pca": (["sample", "component", "status"], 4),
    "rolling_pca_absorption": (["ts", "n_rows", "n_columns", "absorption", "flagged_rows", "flagged_absorption"], 0),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SHAPES))
def test_query_without_sql_runs(spark, name):
    got, (columns, least) = QUERIES[name](spark, SF), SHAPES[name]
    assert got.columns[: len(columns)] == columns and got.count() >= least


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_screen_takes_every_ticker(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def screen(panel, groups, targets):
        seen.update(features=groups["logit_all"], columns=panel.columns)
        raise Stop

    monkeypatch.setattr(queries.models, "predictive_screen", screen)
    with pytest.raises(Stop):
        QUERIES["predictive_screen"](spark, SF)
    tickers = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    assert tickers | {"view_spread"} <= set(seen["features"]) and tickers <= set(seen["columns"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_too_few_complete_rows_give_null(spark, monkeypatch):
    names = sorted(r[0] for r in spark.read.parquet(f"{SF}/nation.parquet").select("n_name").collect())[:7]
    # 254 dates, of which about 100 in the window are complete, while each column is 90 % present
    rows = [(i, n, float((i * (k + 3)) % 11 + i % 5)) for i in range(254) for k, n in enumerate(names) if i >= 150 or i % 7 != k]
    monkeypatch.setattr(queries.panel, "root_panel", lambda *_: spark.createDataFrame(rows, "date int, ticker string, value double"))
    got = QUERIES["panel_pca_absorption"](spark, SF).collect()
    assert [(r["n_rows"], r["n_columns"], r["absorption"]) for r in got] == [(102, 7, None)]
    few = [(n, i, float((i * f) % 7), float(i % 5), True, False, False, False) for i in range(22) for n, f in (("view", 3), ("error", 5))]
    monkeypatch.setattr(queries, "_aligned", lambda *_: spark.createDataFrame(few, "ticker string, ts int, ret double, ref_ret double, threshold_ready boolean, large_abs boolean, large_down boolean, large_up boolean"))
    assert {r["status"] for r in QUERIES["conditional_pca"](spark, SF).collect()} == {"insufficient_complete_rows"}


def test_names_are_registered():
    assert len(QUERIES) > 80 and set(ORACLES) <= set(QUERIES)
