"""Hand-made cases of the operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.functions import columns as col_fns
from stormglass.operators import backtest, impulse, labels, lift, metrics, models, panel, pca, pit, quantiles, splits
from stormglass.operators import windows as win
from stormglass.sources import io

D = dt.datetime


def series(spark, values, column="price"):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], f"key string, t int, {column} double")


def values(df, column, order="t"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_as_of_join_takes_the_latest_available(spark):
    forecasts = spark.createDataFrame([("a", D(2020, 1, 3)), ("a", D(2020, 1, 6)), ("b", D(2020, 1, 6))], "k string, forecast_timestamp timestamp")
    records = spark.createDataFrame([("a", D(2020, 1, 2), 1.0), ("a", D(2020, 1, 5), None), ("a", None, 9.0)], "k string, earliest_valid_prediction_timestamp timestamp, value double")
    got = pit.as_of_join(forecasts, records, ["k"]).orderBy("k", "forecast_timestamp").collect()
    assert [r["value"] for r in got] == [1.0, None, None]
    assert got[1]["earliest_valid_prediction_timestamp"] == D(2020, 1, 5)  # a null value is not skipped
    with pytest.raises(ValueError):
        pit.as_of_join(forecasts, records, ["k"], direction="forward")


def test_as_of_join_suffix_equal_time_and_empty(spark):
    forecasts = spark.createDataFrame([("a", D(2020, 1, 3), 5.0)], "k string, forecast_timestamp timestamp, value double")
    records = spark.createDataFrame([("a", D(2020, 1, 3), 1.0)], "k string, earliest_valid_prediction_timestamp timestamp, value double")
    row = pit.as_of_join(forecasts, records, ["k"]).first()
    assert (row["value"], row["value_pit"]) == (5.0, 1.0)
    assert pit.as_of_join(forecasts, records.limit(0), ["k"]).first()["value_pit"] is None


def test_matrix_and_future_availability(spark):
    store = spark.createDataFrame([("a", "vix", 20.0, D(2020, 1, 2)), ("a", "vix", 99.0, D(2020, 1, 10))], "k string, feature_name string, value double, earliest_valid_prediction_timestamp timestamp")
    forecasts = spark.createDataFrame([("a", D(2020, 1, 5)), ("a", D(2020, 1, 5))], "k string, forecast_timestamp timestamp")
    rows = pit.pit_feature_matrix(forecasts, store, ["vix", "absent"], ["k"]).collect()
    assert len(rows) == 1 and rows[0]["vix"] == 20.0 and rows[0]["absent"] is None
    bad = spark.createDataFrame([(D(2020, 1, 3), D(2020, 1, 4))], "forecast_timestamp timestamp, vix__available_at timestamp")
    assert pit.future_availability(bad).first()["violations"] == 1
    with pytest.raises(ValueError):
        pit.future_availability(bad, strict=True)


def test_forward_label_and_phases(spark):
    df = series(spark, [100.0, 98.0, 88.0, 90.0, 91.0])
    got = df.withColumn("label", labels.drawdown_label(F.col("price"), ["key"], "t", 2, 0.10))
    assert values(got, "label") == [1.0, 1.0, 0.0, None, None]
    marks = series(spark, [0.0, 1.0, 1.0, 0.0, None, 1.0], "label")
    phased = labels.phased(marks, "label", ["key"], "t", phase="phase")
    assert values(phased, "phase") == ["calm", "onset", "continuation", "recovery", "insufficient_forward_window", "onset"]
    assert values(labels.run_ids(marks, "label", ["key"], "t"), "event_id") == [None, 1, 1, None, None, 2]
    assert values(labels.time_to_onset(marks, "label", ["key"], "t"), "time_to_next_event") == [1, 0, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        win.forward_drawdown(F.col("price"), ["key"], "t", 0)


def test_splits_keep_their_predicates(spark):
    df = splits.indexed(spark.range(90).select(F.lit("a").alias("key"), F.col("id").alias("t")), ["key"], "t")
    assert splits.chronological(df, 0.6).where("role = 'train'").count() == 54
    with pytest.raises(ValueError):
        splits.chronological(df, 1.0)
    with pytest.raises(Exception, match="not enough rows"):
        splits.chronological(df, 0.01).collect()
    rows = splits.purged_folds(df, ["key"], 3, 5, 2).collect()
    for fold in range(3):
        test = sorted(r["row_idx"] for r in rows if r["fold"] == fold and r["role"] == "test")
        train = [r["row_idx"] for r in rows if r["fold"] == fold and r["role"] == "train"]
        assert len(test) == 30 and train
        assert all(i + 5 < test[0] or i > test[-1] + 2 for i in train)


def test_row_index_is_global(spark):
    df = spark.range(200).select((199 - F.col("id")).alias("v")).repartition(5)
    assert {(r["v"], r["row_idx"]) for r in win.row_index(df, ["v"]).collect()} == {(k, k) for k in range(200)}


def test_halo_windows_equal_plain_windows(spark):
    df = spark.range(100).select(F.lit("a").alias("key"), F.col("id").alias("i"), (F.col("id") * 7 % 13).cast("double").alias("x"))
    plain = df.withColumn("m", F.avg("x").over(win.trailing(["key"], "i", 9)))
    for chunk in (4, 10, 1000):
        spread = win.with_halo(df, "i", chunk, 8, ["key"]).withColumn("m", F.avg("x").over(win.trailing(["key", "chunk"], "i", 9)))
        assert sorted((r["i"], r["m"]) for r in spread.where("not is_halo").collect()) == sorted((r["i"], r["m"]) for r in plain.collect())


def test_constant_series_and_missing_values(spark):
    df = series(spark, [2.0] * 10)
    assert values(df.withColumn("z", win.rolling_zscore(F.col("price"), ["key"], "t", 8)), "z") == [None] * 10
    assert df.agg(col_fns.guarded_corr(F.col("price"), F.col("t").cast("double")).alias("c")).first()["c"] is None
    odd = series(spark, [-1.0, 0.0, None, 2.0, 4.0])
    assert values(odd.withColumn("r", win.log_return(F.col("price"), ["key"], "t")), "r") == [None, None, None, None, pytest.approx(math.log(2))]
    assert df.limit(0).withColumn("m", win.rolling_momentum(F.col("price"), ["key"], "t", 4)).count() == 0


def test_ticker_labels(spark):
    rows = spark.createDataFrame([("ES1 Index",), ("TY1 Commodity",), ("DXY  Currency",), ("HYG US Equity",), (None,)], "x string")
    assert [r[0] for r in rows.select(col_fns.canonical_ticker(F.col("x"))).collect()] == ["ES1", "TY1", "DXY", "HYG", None]
    assert col_fns.clean_name("USGG10YR Index") == "USGG10YR"


def test_constant_tenor(spark):
    chain = spark.createDataFrame([("ES", "2024-01-02", 20.0, 0.1, None), ("ES", "2024-01-02", 32.0, 0.2, -0.03), ("TY", "2024-01-02", 31.0, 0.3, None), ("TY", None, 31.0, 0.9, None)], "ticker string, date string, dte double, atm double, rr25 double")
    got = {r["feature"]: r["value"] for r in panel.constant_tenor(chain, [], (30,), 15).collect()}
    assert got == {"ES_atm_30d": 0.2, "ES_rr25_30d": -0.03, "TY_atm_30d": 0.3, "TY_rr25_30d": None}


def test_leakage_audit(spark):
    df = spark.range(20).select(F.current_timestamp().alias("forecast_timestamp"), (F.col("id") % 7).cast("int").alias("clean_feature"), (F.col("id") >= 10).cast("int").alias("leaked_future_stress_flag"), (F.col("id") >= 10).cast("int").alias("target"))
    found = {(r["check"], r["column"]) for r in pit.leakage_audit(df, "target").collect()}
    assert found == {("feature_name", "leaked_future_stress_flag"), ("target_correlation", "leaked_future_stress_flag")}


def test_metrics_with_ties_and_one_class(spark):
    rows = [("m", 1.0, 0.9), ("m", 0.0, 0.9), ("m", 1.0, 0.4), ("m", 0.0, 0.1), ("one", 1.0, 0.5), ("m", None, 0.3)]
    got = {r["model"]: r for r in metrics.probability_metrics(spark.createDataFrame(rows, "model string, y double, p double")).collect()}
    assert got["m"]["n"] == 4 and got["m"]["roc_auc"] == pytest.approx(0.625) and got["m"]["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["one"]["roc_auc"] is None and got["one"]["average_precision"] is None


def test_calibration_line_solves_its_equations(spark):
    rows = [("m", float(k % 3 == 0), 0.1 + 0.08 * (k % 10)) for k in range(60)]
    fit = metrics.calibration_line(spark.createDataFrame(rows, "model string, y double, p double")).first()
    g0 = g1 = 0.0
    for _, y, p in rows:
        x = math.log(p / (1 - p))
        m = 1 / (1 + math.exp(-(fit["intercept"] + fit["slope"] * x)))
        g0, g1 = g0 + y - m, g1 + (y - m) * x
    assert abs(g0) < 1e-6 and abs(g1) < 1e-6


def test_logistic_fallback_and_fit(spark):
    df = spark.createDataFrame([(float(k), None if k % 5 == 0 else float(k % 4), float(k > 20)) for k in range(40)], "a double, b double, y double")
    scored = models.fit_predict_logistic(df, df, ["a", "b"], "y").orderBy("a").collect()
    assert scored[0]["p"] < 0.1 < 0.9 < scored[-1]["p"] and not scored[0]["fallback"]
    assert models.fit_predict_logistic(df.where("y = 1"), df, ["a"], "y").first()["fallback"]


@pytest.mark.parametrize("c,balanced", [(1.0, True), (0.5, False)])
def test_logistic_minimises_its_objective(spark, c, balanced):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2)) * [1, 30] + [0, 7]
    y = (x[:, 0] + rng.normal(size=80) > 0.6).astype(float)
    df = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y, strict=True)], "a double, b double, y double")
    model = models.fit_logistic(df, ["a", "b"], "y", c, balanced)
    z = np.column_stack([np.ones(80), (x - x.mean(0)) / x.std(0)])
    w = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum()))) if balanced else np.ones(80)
    theta = np.array([model.intercept, model.weights["a"], model.weights["b"]])
    gradient = z.T @ (w * (1 / (1 + np.exp(-z @ theta)) - y)) + np.array([0, theta[1] / c, theta[2] / c])
    assert np.abs(gradient).max() < 1e-6
    panel_ = df.withColumn("role", F.when(F.rand(1) < 0.7, "train").otherwise("test"))
    scores, told = models.predictive_screen(panel_, {"one": ["a", "b"]}, ["y"], 20, 5)
    assert {r["model"] for r in scores.select("model").distinct().collect()} == {"y/base_rate", "y/one"}
    assert [r["rank"] for r in told.orderBy("rank").collect()] == [1, 2]
    guard, nothing = models.predictive_screen(panel_, {"one": ["a", "b"]}, ["y"], 1000, 5)
    assert guard.first()["p"] is None and nothing.count() == 0


def test_overlay_is_shifted(spark):
    df = spark.createDataFrame([("a", k, 0.01, k == 1) for k in range(4)], "key string, t int, ret double, risk boolean")
    got = backtest.overlay(df, ["key"], "t", "ret", "risk", 0.5)
    assert values(got, "position") == [1.0, 1.0, 0.5, 1.0]
    assert values(got, "overlay_return")[2] == pytest.approx(0.005 - 0.5 * 0.0001)


def test_bootstrap_of_single_rows_has_the_mean(spark):
    df = spark.createDataFrame([("a", k, float(k % 5)) for k in range(50)], "key string, t int, e double")
    got = backtest.block_bootstrap(df, ["key"], "t", "e", block=1, replicates=400).first()
    assert got["mean_excess"] == pytest.approx(2.0 * 252) and abs(got["p50"] - 504) < 25


def test_matrix_without_a_list_takes_every_name(spark):
    store = spark.createDataFrame([("a", "vix", 1.0, D(2024, 1, 1)), ("a", "move", 2.0, D(2024, 1, 2)), ("b", None, 3.0, D(2024, 1, 1))], "k string, feature_name string, value double, earliest_valid_prediction_timestamp timestamp")
    forecasts = spark.createDataFrame([("a", D(2024, 1, 3))], "k string, forecast_timestamp timestamp")
    row = pit.pit_feature_matrix(forecasts, store, None, ["k"]).first()
    assert row.asDict() == {"k": "a", "forecast_timestamp": D(2024, 1, 3), "move": 2.0, "move__available_at": D(2024, 1, 2), "vix": 1.0, "vix__available_at": D(2024, 1, 1)}


def bars(spark):
    base = [0.001] * 120 + [-0.02 + 0.01 * k / 9 for k in range(10)] + [0.001] * 50
    rows = [(t, D(2024, 1, 1) + dt.timedelta(hours=k), r * f + (k % 7) * 1e-5 * (1 + 0.3 * ((k * len(t) + ord(t[0])) % 5))) for t, f in (("ES1", 1.0), ("NQ1", 1.2), ("TY1", -0.7), ("DXY", -0.2)) for k, r in enumerate(base)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, ret double")


def test_impulses_and_pca(spark):
    returns = bars(spark)
    events = impulse.impulse_events(returns.where("ticker = 'ES1'"), ["ticker"], 0.9, days=2, least=20)
    assert events.where("large_down").count() > 0
    assert events.select("rolling_window_bars", "estimated_bars_per_date").distinct().collect() == [(48, 24.0)]
    aligned = impulse.reference_align(returns, events)
    table = impulse.conditional_correlation(aligned)
    assert table.agg(F.max("n_obs")).first()[0] >= 5 and table.where("sample = 'all' and ticker = 'TY1'").first()["corr"] < 0
    summary, loadings = pca.conditional_pca(aligned, reference="ES1", least=5)
    fitted = summary.where("status = 'fit' and sample = 'threshold_ready'").orderBy("component").collect()
    x = aligned.where("threshold_ready").groupBy("ts", "ref_ret").pivot("ticker", ["DXY", "NQ1", "TY1"]).agg(F.max("ret")).toPandas()
    z = x[["DXY", "NQ1", "TY1"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    values, vectors = np.linalg.eigh(np.corrcoef(z, rowvar=False))
    order = np.argsort(values)[::-1]
    for r, i in zip(fitted, order, strict=True):
        assert r["n_drivers"] == 3 and r["explained"] == pytest.approx(values[i] / 3, abs=1e-9)
        scores = z @ vectors[:, i]
        assert r["abs_corr_reference"] == pytest.approx(abs(np.corrcoef(scores, x["ref_ret"])[0, 1]), abs=1e-6)
    first = {r["driver"]: r["loading"] for r in loadings.where("sample = 'threshold_ready' and component = 1").collect()}
    side = np.sign(np.corrcoef(z @ vectors[:, order[0]], x["ref_ret"])[0, 1])
    assert [first[n] for n in ("DXY", "NQ1", "TY1")] == pytest.approx((vectors[:, order[0]] * side).tolist(), abs=1e-6)
    assert fitted[0]["top_positive"].startswith("NQ1") and "TY1" in fitted[0]["top_negative"]
    none, _ = pca.conditional_pca(aligned, reference="ES1", least=500)
    assert {(r["status"], r["component"]) for r in none.collect()} == {("insufficient_complete_rows", None)}


def test_sparse_drivers_leave_first(spark):
    rows = [(k, None if k % 2 else 1.0 * k, None if k % 3 else 2.0 * (k % 7), 1.0 * (k % 5), float(k)) for k in range(60)]
    wide = spark.createDataFrame(rows, "ts int, a double, b double, c double, ref_ double").withColumn("sample", F.explode(F.array(F.lit("one"), F.lit("two"))))
    orders = {"one": ["c", "a", "b"], "two": ["c", "b"], "three": ["c"]}
    assert pca._complete_drivers(wide, orders, 11) == {"one": ["c", "a"], "two": ["c", "b"]}
    assert pca._complete_drivers(wide, orders, 10)["one"] == ["c", "a", "b"]
    assert pca._complete_drivers(wide, orders, 30) == {"one": ["c", "a"]}
    assert pca._complete_drivers(wide, orders, 31) == {}


def test_rolling_absorption_equals_windows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x[rng.random((90, 4)) < 0.15] = np.nan
    flags = rng.random(90) < 0.4
    rows = [(k, *[None if math.isnan(v) else float(v) for v in x[k]], bool(flags[k])) for k in range(90)]
    wide = spark.createDataFrame(rows, "ts int, a double, b double, c double, d double, hit boolean")
    for share in (None, 0.8):
        got = {r["ts"]: r for r in pca.rolling_absorption(wide, list("abcd"), "ts", 30, 4, 12, 2, share, flag="hit", chunk_ends=3).collect()}
        ends = list(range(30, 90, 4))
        assert sorted(got) == [e - 1 for e in ends]
        for e in ends:
            n_rows, n_columns, value = pca.absorption(x[e - 30 : e], 12, 2, 3, share)
            r, inside = got[e - 1], flags[e - 30 : e]
            assert (r["n_rows"], r["n_columns"], r["flagged_rows"]) == (n_rows, n_columns, inside.sum())
            assert r["absorption"] == (None if value is None else pytest.approx(value))
            part = pca.absorption(x[e - 30 : e][inside], 8, 2, 3, share)[2]
            assert r["flagged_absorption"] == (None if part is None else pytest.approx(part))
    full = x[:30][np.isfinite(x[:30]).all(axis=1)]
    values = np.linalg.eigvalsh(np.corrcoef(full, rowvar=False))
    assert pca.absorption(x[:30], len(full), 2, 1, None)[2] == pytest.approx(values[-1] / 4)


def test_event_labels_at_their_edges(spark):
    """A value exactly at the level, a missing volatility at the horizon, and a run of ones."""
    price = [100.0, 100.0, 90.0, 80.0, 70.0, 70.0, 70.0]
    vol = [0.1, 0.2, 0.3, None, 0.4, 0.2, 0.1]
    vix = [20.0, 35.0, 20.0, 20.0, 20.0, 20.0, 20.0]
    df = spark.createDataFrame([("a", k, p, v, x, float(k)) for k, (p, v, x) in enumerate(zip(price, vol, vix, strict=True))], "key string, t int, p double, v double, x double, c double")
    got = labels.build_event_labels(df, ["key"], "t", "p", "v", "x", credit="c", horizon=2, threshold=0.05, vol_q=0.5, vix_level=35).orderBy("t").collect()
    assert [r["drawdown_5pct_h2"] for r in got] == [1, 1, 1, 1, 0, None, None]
    assert [r["vix_gt_35_h2"] for r in got] == [1, 0, 0, 0, 0, None, None]
    assert [r["realized_vol_top_50pct_h2"] for r in got] == [1, None, 1, 1, 1, None, None]
    assert [r["joint_stress_h2"] for r in got] == [0, 0, 0, 0, 0, None, None]
    assert [r["event_phase"] for r in got][:5] == ["onset", "continuation", "continuation", "continuation", "recovery"]
    assert [r["overlapping_event_window"] for r in got] == [False, True, True, True, False, False, False]
    assert {r["forecast_horizon_days"] for r in got} == {2}


def test_running_sums_over_ranges(spark):
    rows = [(k % 3, k * 7 % 50, 1 + k % 4) for k in range(50)]
    df = spark.createDataFrame(rows, "g int, x int, n int").repartition(5)
    got = {(r["g"], r["x"]): r["upto"] for r in win.running_sum(df, ["g", "x"], {"upto": "n"}, ["g"]).collect()}
    assert got == {(g, x): sum(m for h, y, m in rows if h == g and y <= x) for g, x, _ in rows}
    odd = spark.createDataFrame([(1.0, None), (3.0, None), (2.0, 5.0), (9.0, 6.0), (None, 7.0)], "a double, b double").withColumn("c", F.lit(None).cast("double"))
    got = win.exact_quantiles(odd, {"a5": ("a", 0.5), "a9": ("a", 0.9), "b": ("b", 0.5), "c": ("c", 0.5)})
    assert got == {"a5": 2.5, "a9": pytest.approx(7.2), "b": 6.0, "c": None}


def test_expanding_quantile_equals_numpy(spark):
    x = [5.0, None, 1.0, 4.0, 4.0, None, 9.0, 2.0]
    got = quantiles.expanding_quantile(series(spark, x), "price", ["key"], "t", "q", 0.85, 3)
    want = []
    for k in range(len(x)):
        before = [v for v in x[:k] if v is not None]
        want.append(pytest.approx(np.quantile(before, 0.85)) if len(before) >= 3 else None)
    assert values(got, "q") == want


def test_quantile_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8]], "x double")
    got = sorted((r["x"], r["decile"]) for r in lift.quantile_bins(df, "x", 4).collect())
    assert got[0] == (1.0, 1) and got[-1][1] == got[-2][1]


def test_sources(spark, tmp_path):
    (tmp_path / "ES1 Index.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 10:00:00,1,2,0.5,1.5,x\nbad,1,1,1,1,1\n2024-01-01 10:00:00,1,2,0.5,,3\n")
    rows = io.read_bars(spark, str(tmp_path)).collect()
    assert [(r["ticker"], r["close"], r["volume"]) for r in rows] == [("ES1", 1.5, None)]
    (tmp_path / "panel").mkdir()
    (tmp_path / "panel" / "p.csv").write_text("Date,SPX Index,VIX Index\n2024-01-02,100,n/a\noops,1,2\n")
    wide = io.read_wide_panel(spark, str(tmp_path / "panel")).collect()
    assert [(r["SPX"], r["VIX"]) for r in wide] == [(100.0, None)]
    with pytest.raises(ValueError, match="x"):
        io.require_columns(spark.range(1), ["id", "x"])
    io.save(spark.range(3), str(tmp_path / "out"), "json")
    io.save_metadata(spark, str(tmp_path / "meta"), rows=3)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
