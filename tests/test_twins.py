"""Queries that SQL does not express, against numpy on the same tables, and their inner parts against plain forms."""

from __future__ import annotations

import os

import numpy as np
import pytest

from stormglass.operators import impulse, panel, pca
from stormglass.plans import frames, queries

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_gram_blocks_equal_windows_of_rows():
    rng = np.random.default_rng(1)
    for t in range(200):
        n, p = int(rng.integers(20, 120)), int(rng.integers(1, 7))
        x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) * rng.random() + 100 * rng.random()
        if t % 3 == 0:
            x[rng.random(x.shape) < 0.1] = np.nan
        if t % 5 == 0:
            x[:, 0] = 3.25
        if t % 7 == 0:
            x[: n // 2, -1] = np.nan
        marked, cuts = rng.random(n) < 0.4, np.unique(rng.integers(0, n + 1, 8))
        blocks = pca.GramBlocks(x, marked, cuts)
        for a in range(len(cuts)):
            for b in range(a + 1, len(cuts)):
                rows, chosen = x[cuts[a] : cuts[b]], marked[cuts[a] : cuts[b]]
                for share in (None, 0.8, 0.3):
                    for of, own in ((np.ones(blocks.shape[1], bool), rows), (blocks.marked, rows[chosen])):
                        got, want = blocks.absorption(a, b, of, 5, 2, 3, share), pca.absorption(own, 5, 2, 3, share)
                        assert got[:2] == want[:2] and got[2] == (None if want[2] is None else pytest.approx(want[2], abs=1e-9))


def windows(x, marked, width, step, least_rows, least_columns, share):
    """(last row, rows, columns, absorption, flagged rows, flagged absorption) of every window, from its rows."""
    out = []
    for end in range(width, len(x)):
        if (end - width) % step == 0:
            own, flags = x[end - width : end], marked[end - width : end]
            out.append((end - 1, *pca.absorption(own, least_rows, least_columns, 3, share), int(flags.sum()), pca.absorption(own[flags], max(8, least_rows // 4), least_columns, 3, share)[2]))
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 2e-6


@tables
def test_rolling_pca_equals_its_windows(spark):
    ev = queries._events(spark, SF)
    names, per_date = [t for t in queries._event_types(spark, SF) if t != "click"], impulse.bars_per_date(ev)
    flags = {r["ts"]: bool(r["large_abs"]) for r in ev.collect()}
    rets = {(r["ticker"], r["ts"]): r["ret"] for r in frames.returns(spark, SF).collect()}
    times = sorted(flags)
    x = np.array([[rets.get((n, t)) for n in names] for t in times], float)
    want = windows(x, np.array([flags[t] for t in times]), max(40, round(20 * per_date)), max(1, round(per_date)), 40, 2, None)
    got = {r["ts"]: r for r in queries.QUERIES["rolling_pca_absorption"](spark, SF).collect()}
    assert len(got) == len(want) > 0
    for at, rows, columns, first, flagged, chosen in want:
        r = got[times[at]]
        assert (r["n_rows"], r["n_columns"], r["flagged_rows"]) == (rows, columns, flagged)
        assert close(r["absorption"], first) and close(r["flagged_absorption"], chosen)


@tables
def test_panel_pca_equals_its_windows(spark):
    long = panel.root_panel(panel.constant_tenor(frames.chain(spark, SF), frames.TIE, target_days=(30,), fields=["atm"]), "atm", 30)
    cells = {(r["date"], r["ticker"]): r["value"] for r in long.collect()}
    dates = sorted({d for d, _ in cells})
    names = sorted(r[0] for r in frames.table(spark, SF, "nation").select("n_name").collect())
    x = np.array([[cells.get((d, n)) for n in names] for d in dates], float)
    want = windows(x, np.zeros(len(x), bool), 252, 5, 160, 6, 0.8)
    got = {r["date"]: r for r in queries.QUERIES["panel_pca_absorption"](spark, SF).collect()}
    assert len(got) == len(want) > 0
    for at, rows, columns, first, _, _ in want:
        r = got[dates[at]]
        assert (r["n_rows"], r["n_columns"]) == (rows, columns) and close(r["absorption"], first)
