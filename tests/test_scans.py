"""Scans and windows that split a key over tasks, against plain Python; one key holds most rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.operators import backtest, labels, pit, quantiles, scans, splits
from stormglass.operators import windows as win
from stormglass.operators.scans import Scan


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small tables would be dealt to one range; here they lie in as many as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = [("hot", t, None if rng.random() < 0.1 else round(rng.uniform(90, 110), 2), float(rng.random() < 0.2) if rng.random() > 0.05 else None) for t in range(700)]
    rows += [(k, t, round(rng.uniform(90, 110), 2), float(rng.random() < 0.5)) for k, n in (("b", 1), ("c", 7), (None, 40)) for t in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k string, t int, x double, label double").repartition(3).cache()


def by_key(data):
    out = {}
    for k, t, x, y in sorted(data, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append((t, x, y))
    return out


def same(df, name, data, want):
    """want(rows of a key, place) gives the value of each row."""
    got = {(r["k"], r["t"]): r[name] for r in df.collect()}
    assert len(got) == len(data)
    for k, rows in by_key(data).items():
        for i, (t, _, _) in enumerate(rows):
            expected = want(rows, i)
            assert got[k, t] == (None if expected is None else pytest.approx(expected, rel=1e-12)), (k, t)


def lowest(values):
    return min((v for v in values if v is not None), default=None)


def test_scans_in_both_directions(spark, table, data):
    d = scans.deal(table, ["k"], ["t"])
    assert d.rows.where("k = 'hot'").select("part_").distinct().count() > 1  # several tasks have the key
    x = F.col("x")
    found = d.scan({"last": Scan("last", x), "before": Scan("last", x, own=False), "next": Scan("last", x, back=True), "low": Scan("min", x), "total": Scan("sum", x, back=True, own=False), "high": Scan("max", x, own=False)})
    rows = found.plain().cache()
    known = lambda part: [v for _, v, _ in part if v is not None]
    same(rows, "last", data, lambda r, i: (known(r[: i + 1]) or [None])[-1])
    same(rows, "before", data, lambda r, i: (known(r[:i]) or [None])[-1])
    same(rows, "next", data, lambda r, i: (known(r[i:]) or [None])[0])
    same(rows, "low", data, lambda r, i: lowest(v for _, v, _ in r[: i + 1]))
    same(rows, "high", data, lambda r, i: max(known(r[:i]), default=None))
    same(rows, "total", data, lambda r, i: sum(known(r[i + 1 :])) if known(r[i + 1 :]) else None)
    same(d.numbered().plain().withColumn("one", F.lit(1)), "one", data, lambda r, i: 1)


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_extremes_and_counts_of_any_window(spark, table, data, chunk, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    for windows in ([(1, 5), (-3, 1), (2, 2), (-6, -2)], [(1, 40), (-39, 0), (0, 900), (-900, -1)]):
        d = win.chunks(table, ["k"], "t", max(0, *(-s for s, _ in windows)), max(0, *(e for _, e in windows)))
        d = d.extremes({f"low{i}": ("min", F.col("x"), *w) for i, w in enumerate(windows)}).counts({f"n{i}": (F.col("x"), *w) for i, w in enumerate(windows)})
        for i, (_, end) in enumerate(windows):
            d = d.shifted(f"then{i}", F.col("x"), end)
        rows = d.whole().plain().cache()
        for i, (start, end) in enumerate(windows):
            part = lambda r, j: [v for _, v, _ in r[max(0, j + start) : max(0, j + end + 1)]]  # noqa: B023, E731
            same(rows, f"low{i}", data, lambda r, j: lowest(part(r, j)))  # noqa: B023
            same(rows, f"n{i}", data, lambda r, j: sum(v is not None for v in part(r, j)))  # noqa: B023
            same(rows, f"then{i}", data, lambda r, j: r[j + end][1] if 0 <= j + end < len(r) else None)  # noqa: B023


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_quantiles_over_time(spark, table, data, chunk, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", chunk)
    known = lambda part: [v for _, v, _ in part if v is not None]
    rolled = quantiles.rolling_quantile(table, "x", ["k"], "t", 30, 0.95, 10, "q")
    same(rolled, "q", data, lambda r, i: np.quantile(known(r[max(0, i - 30) : i]), 0.95) if len(known(r[max(0, i - 30) : i])) >= 10 else None)
    for q in (0.85, 0.0, 1.0):
        grown = quantiles.expanding_quantile(table, "x", ["k"], "t", "q", q, 5)
        assert grown.columns == [*table.columns, "q"]
        same(grown, "q", data, lambda r, i: np.quantile(known(r[:i]), q) if len(known(r[:i])) >= 5 else None)  # noqa: B023


def test_expanding_quantile_of_trends_and_ties(spark, monkeypatch):
    """Rising values and long ties: the quantile moves through all buckets, or stays in one."""
    monkeypatch.setattr(scans, "CHUNK", 10)
    for x in ([float(t) for t in range(300)], [float(-t) for t in range(300)], [float(t // 90) for t in range(300)], [None] * 250 + [1.0, 2.0, 3.0] + [None] * 200):
        rows = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "k string, t int, x double")
        got = {r["t"]: r["q"] for r in quantiles.expanding_quantile(rows, "x", ["k"], "t", "q", 0.85, 2).collect()}
        for t in range(len(x)):
            own = [v for v in x[:t] if v is not None]
            assert got[t] == (pytest.approx(np.quantile(own, 0.85)) if len(own) >= 2 else None)


def test_quantiles_of_keys(spark, table, data):
    got = {r["k"]: (r["mid"], r["high"]) for r in quantiles.key_quantiles(table, ["k"], "x", {"mid": 0.5, "high": 0.9}).collect()}
    for k, rows in by_key(data).items():
        x = [v for _, v, _ in rows if v is not None]
        assert got[k] == pytest.approx((np.quantile(x, 0.5), np.quantile(x, 0.9)))


def test_quantiles_of_columns_by_null_and_empty_keys(spark):
    rows = [("a", float(t % 7), float(-t)) for t in range(90)] + [(None, 2.0, None), (None, 4.0, None), ("e", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    wanted = {"x_mid": ("x", 0.5), "x_high": ("x", 0.9), "y_low": ("y", 0.1)}
    own = [np.quantile([x for _, x, _ in rows[:90]], q) for q in (0.5, 0.9)] + [np.quantile([y for _, _, y in rows[:90]], 0.1)]
    got = {r["k"]: [r[c] for c in wanted] for r in quantiles.column_quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"a", None} and got["a"] == pytest.approx(own) and got[None] == [3.0, pytest.approx(3.8), None]
    beside = quantiles.with_quantiles(df, ["k"], wanted)
    assert beside.columns == [*df.columns, *wanted] and beside.count() == len(rows)
    assert {(r["k"], r["x_mid"]) for r in beside.collect()} == {("a", own[0]), (None, 3.0), ("e", None)}
    empty = df.limit(0)
    assert quantiles.with_quantiles(empty, ["k"], wanted).count() == 0
    assert [tuple(r) for r in quantiles.column_quantiles(empty, [], wanted).collect()] == [(None, None, None)]


def test_phases_runs_and_onsets_of_a_hot_key(spark, table, data):
    rows = labels.phased(table, "label", ["k"], "t").cache()
    was = lambda r, i: (r[i - 1][2] or 0.0) if i else 0.0
    starts = lambda r, i: r[i][2] == 1 and was(r, i) != 1

    def phase(r, i):
        y = r[i][2]
        return "insufficient_forward_window" if y is None else "continuation" if y == 1 == was(r, i) else "onset" if y == 1 else "recovery" if was(r, i) == 1 else "calm"

    got = {(r["k"], r["t"]): r["event_phase"] for r in rows.collect()}
    assert all(got[k, r[i][0]] == phase(r, i) for k, r in by_key(data).items() for i in range(len(r)))
    same(rows, "event_id", data, lambda r, i: sum(starts(r, j) for j in range(i + 1)) if r[i][2] == 1 else None)
    same(rows, "time_to_next_event", data, lambda r, i: next((j - i for j in range(i, len(r)) if starts(r, j)), None))


def test_as_of_join_of_a_hot_key(spark):
    rng = random.Random(2)
    records = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randrange(1000), n, rng.choice([None, float(n)])) for n in range(600)]
    asked = [(rng.choice(["hot"] * 9 + ["b", None, "none"]), rng.randrange(1000), n) for n in range(400)]
    left = spark.createDataFrame(asked, "k string, at int, n int")
    right = spark.createDataFrame(records, "k string, available int, seq int, value double")
    got = {r["n"]: (r["seq"], r["value"]) for r in pit.as_of_join(left, right, ["k"], "at", "available", ["seq"]).collect()}
    for k, at, n in asked:
        best = max(((a, s, v) for key, a, s, v in records if key == k and a <= at), key=lambda x: x[:2], default=(None, None, None))
        assert got[n] == best[1:]
    plan = pit.as_of_join(left, right, ["k"], "at", "available", ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(part_" in plan


def test_horizon_must_be_positive(table):
    for add in (win.add_forward_drawdown, win.add_forward_max):
        with pytest.raises(ValueError):
            add(table, "x", ["k"], "t", 0, "value")


def test_path_metrics_of_a_hot_key(spark, data, monkeypatch):
    """Growth, worst drawdown and the rest over many parts equal those of the whole path; a grid is its runs one by one."""
    monkeypatch.setattr(scans, "CHUNK", 32)
    rng = random.Random(3)
    rows = [("hot", t, None if rng.random() < 0.05 else rng.gauss(0.001, 0.02), rng.choice([None, rng.random()])) for t in range(500)] + [("b", 0, 0.01, 0.5), ("c", 0, -0.01, 0.2), ("c", 1, 0.03, 0.9)]
    table = spark.createDataFrame(rows, "k string, t int, r double, score double")
    grid = backtest.sensitivity_grid(table, ["k"], "t", "r", "score", F.col("t") < 300, (0.5, 0.8), (0.0, 0.5)).collect()
    assert len(grid) == 3 * 4
    for g in grid:
        own = sorted((x for x in rows if x[0] == g["k"]), key=lambda x: x[1])
        cut = np.quantile([s for _, t, _, s in own if s is not None and t < 300], g["quantile"])
        exposure = [g["low_exposure"] if s is not None and s >= cut else 1.0 for *_, s in own]
        position = [1.0, *exposure[:-1]]
        turn = [0.0, *(abs(a - b) for a, b in zip(position[1:], position, strict=False))]
        run = [(p * r - c * 0.0001, p, c) for (_, _, r, _), p, c in zip(own, position, turn, strict=True) if r is not None]
        equity = np.cumprod([1 + r for r, _, _ in run])
        assert g["n"] == len(run) and g["cumulative_return"] == pytest.approx(equity[-1] - 1)
        assert g["max_drawdown"] == pytest.approx(min(equity / np.maximum.accumulate(equity) - 1))
        assert g["worst_day"] == pytest.approx(min(r for r, _, _ in run)) and g["turnover"] == pytest.approx(sum(c for _, _, c in run))
        assert g["mean_exposure"] == pytest.approx(np.mean([p for _, p, _ in run]))
        assert g["annual_vol"] == (pytest.approx(np.std([r for r, _, _ in run], ddof=1) * 252**0.5) if len(run) > 1 else None)
    one = backtest.overlay(table.withColumn("risk", F.col("score") >= 0.5), ["k"], "t", "r", "risk", 0.5)
    single = {r["k"]: r for r in backtest.strategy_metrics(one, ["k"], "t", "overlay_return").collect()}
    path = np.cumprod([1 + r["overlay_return"] for r in one.where("k = 'hot'").orderBy("t").collect() if r["overlay_return"] is not None])
    assert single["hot"]["max_drawdown"] == pytest.approx(min(path / np.maximum.accumulate(path) - 1))


@pytest.mark.parametrize("future", [True, False])
def test_interval_folds_equal_their_rows(spark, future):
    """What folds say of their rows, without making them, is what the rows say."""
    rows = splits.indexed(spark.createDataFrame([(k, t, float(t % 7)) for k, n in (("a", 100), ("b", 31), ("c", 3)) for t in range(n)], "k string, t int, v double"), ["k"], "t").cache()
    sizes = splits.sizes_of(rows, ["k"])
    for folds in (splits.expanding_intervals(sizes, ["k"], 20, 7, 3, 2, future), splits.purged_intervals(sizes, ["k"], 4, 5, 2)):
        made = splits.assigned(rows, folds, ["k"])
        by = ["k", "fold", "role"]
        want = made.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("a"), F.max("row_idx").alias("b"), F.sum("v").alias("v")).collect()
        got = splits.fold_bounds(folds, ["k"]).join(splits.fold_sums(rows, folds, ["k"], ["v"]).drop("n"), by).select(*by, "n", "first_idx", "last_idx", "v").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
        times = {(r["k"], r["fold"]): (r["train_start"], r["test_end_time"]) for r in splits.fold_summary(rows, folds, ["k"], "t").collect()}
        assert all(times[r["k"], r["fold"]][0 if r["role"] == "train" else 1] == (r["a"] if r["role"] == "train" else r["b"]) for r in want)


def test_bootstrap_of_hot_and_short_keys(spark, monkeypatch):
    """Each replicate is the sum of its blocks, whichever ranges they begin and end in."""
    sizes = {"a": 203, "b": 7, "c": 20}
    data = {k: np.random.default_rng(n).normal(size=n) for k, n in sizes.items()}
    rows = [(k, t, float(x)) for k, v in data.items() for t, x in enumerate(v)] + [("a", 1000 + t, None) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, e double").repartition(4)
    for chunk in (1 << 16, 20):
        monkeypatch.setattr(scans, "CHUNK", chunk)
        got = {r["k"]: r for r in backtest.block_bootstrap(df, ["k"], "t", "e", block=20, replicates=40, seed=3).collect()}
        assert set(got) == set(data)
        for k, x in data.items():
            means, n = [], len(x)
            for rep in range(1, 41):
                taken = []
                for b in range(-(-n // 20)):
                    begin = int(hashlib.md5(f"{rep}-{b}-3".encode()).hexdigest()[:12], 16) % max(n - 19, 1)
                    taken += x[begin : begin + min(20, n - b * 20)].tolist()
                means.append(sum(taken) / n * 252)
            assert got[k]["replicates"] == 40 and got[k]["mean_excess"] == pytest.approx(x.mean() * 252)
            assert [got[k][p] for p in ("p05", "p50", "p95")] == pytest.approx(np.quantile(means, [0.05, 0.5, 0.95]).tolist())
