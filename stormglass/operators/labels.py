"""Forward-looking event labels and the states derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.operators.quantiles import key_quantiles, with_quantiles
from stormglass.operators.scans import Dealt, Scan, deal
from stormglass.operators.windows import Keys, chunks, forward_drawdown, ordered

# The names of the phases.
CALM, ONSET, CONTINUATION, RECOVERY, UNKNOWN = "calm", "onset", "continuation", "recovery", "insufficient_forward_window"


def drawdown_label(price: Column, keys: Keys, time: str, horizon: int, threshold: float) -> Column:
    """1 if the price falls by the threshold within the horizon, else 0; null if the price at the horizon is missing."""
    hit = F.coalesce(forward_drawdown(price, keys, time, horizon) <= -abs(threshold), F.lit(False))
    return F.when(F.lead(price, horizon).over(ordered(keys, time)).isNotNull(), hit.cast("double"))


def add_drawdown_label(df: DataFrame, price: str, keys: Keys, time: str, horizon: int, threshold: float, name: str) -> DataFrame:
    """df with drawdown_label(); a row costs the same for any horizon, and a long key runs in many tasks."""
    d = chunks(df, keys, time, 0, horizon).extremes({"low_": ("min", F.col(price), 1, horizon)}).shifted("then_", F.col(price), horizon)
    hit = F.coalesce(F.try_divide("low_", F.col(price)) - 1 <= -abs(threshold), F.lit(False))
    return d.whole().plain().withColumn(name, F.when(F.col("then_").isNotNull(), hit.cast("double"))).drop("low_", "then_")


def quantile_label(df: DataFrame, x: str, keys: Keys, time: str, horizon: int, q: float, name: str) -> DataFrame:
    """1 if x reaches its full-sample quantile within the horizon; the tail is 0, not null."""
    cut = key_quantiles(df, keys, x, {"cut_": q})
    ahead = chunks(df, keys, time, 0, horizon).extremes({"top_": ("max", F.col(x), 1, horizon)}).whole().plain()
    return ahead.join(cut, keys, "left").withColumn(name, F.coalesce(F.col("top_") >= F.col("cut_"), F.lit(False)).cast("double")).drop("cut_", "top_")


def _onsets(d: Dealt, label: str) -> Dealt:
    """Dealt rows with was_ (the label before, 0 on a key's first row) and onset_."""
    before = d.scan({"was_": Scan("last", F.struct(F.col(label).alias("l")), own=False)})
    rows = before.rows.withColumn("was_", F.coalesce("was_.l", F.lit(0.0)))
    return Dealt(rows.withColumn("onset_", F.coalesce((F.col(label) == 1) & (F.col("was_") != 1), F.lit(False))), d.keys)


def phased(df: DataFrame, label: str, keys: Keys, time: str, phase: str | None = "event_phase", run: str | None = "event_id", ahead: str | None = "time_to_next_event") -> DataFrame:
    """df with the phase of each row, the number of its run of ones (from 1 within the key; null
    outside runs) and the rows until the next onset (0 at one, null after the last); None leaves one out.

    Scans over ranges of (key, time): the label before, then counts of onsets from the one
    side and the nearest onset from the other, each with what the key's other ranges hold.
    """
    d = _onsets(deal(df, keys, [time]), label)
    if run or ahead:
        d = d.numbered().settled()
    scans = {}
    if run:
        scans["run_"] = Scan("sum", F.col("onset_").cast("int"))
    if ahead:
        scans["next_"] = Scan("min", F.when(F.col("onset_"), F.col("place_")), back=True)
    rows = (d.scan(scans) if scans else d).rows
    is_event = F.col(label) == 1
    if phase:
        state = F.when(F.col(label).isNull(), UNKNOWN).when(is_event & (F.col("was_") == 1), CONTINUATION).when(is_event, ONSET).when(F.col("was_") == 1, RECOVERY).otherwise(CALM)
        rows = rows.withColumn(phase, state)
    if run:
        rows = rows.withColumn(run, F.when(is_event, F.col("run_")))
    if ahead:
        rows = rows.withColumn(ahead, (F.col("next_") - F.col("place_")).cast("int"))
    return Dealt(rows, d.keys).plain().drop("was_", "onset_", "run_", "next_")


def run_ids(df: DataFrame, label: str, keys: Keys, time: str, name: str = "event_id") -> DataFrame:
    """Number of each run of ones, from 1 within the key; null outside runs."""
    return phased(df, label, keys, time, phase=None, run=name, ahead=None)


def time_to_onset(df: DataFrame, label: str, keys: Keys, time: str, name: str = "time_to_next_event") -> DataFrame:
    """Rows until the next onset, 0 at one, null after the last."""
    return phased(df, label, keys, time, phase=None, run=None, ahead=name)


def transitions(df: DataFrame, phase: str, keys: Keys, time: str) -> DataFrame:
    """How often each phase follows each other; the first row of a key follows `start`."""
    before = F.coalesce(F.lag(phase).over(ordered(keys, time)), F.lit("start"))
    return df.select(before.alias("previous_phase"), F.col(phase).alias("current_phase")).groupBy("previous_phase", "current_phase").agg(F.count(F.lit(1)).alias("n"))


def build_event_labels(
    df: DataFrame, keys: Keys, time: str, price: str, vol: str, vix: str, credit: str | None = None, liquidity: str | None = None,
    horizon: int = 20, threshold: float = 0.05, vol_q: float = 0.95, vix_level: float = 35.0, stress_q: float = 0.9,
) -> DataFrame:
    """All labels of one horizon: drawdown, volatility, level, joint stress, phase, run, overlap and time to the next onset.

    A volatility or level label is missing where its own column is, `horizon` rows ahead; the
    joint label counts a missing one as no and is missing with the drawdown label. Overlap
    means that an event goes on. Full-sample quantiles come from counts of values and are
    joined back, one row a key; credit and liquidity are optional.
    """
    wanted = {"vol_cut": (vol, vol_q)} | {f"{k}_cut": (c, stress_q) for k, c in (("credit", credit), ("liquidity", liquidity)) if c}
    dd, vol_name, vix_name, joint = (
        f"drawdown_{round(threshold * 100)}pct_h{horizon}",
        f"realized_vol_top_{round((1 - vol_q) * 100)}pct_h{horizon}",
        f"vix_gt_{int(vix_level)}_h{horizon}",
        f"joint_stress_h{horizon}",
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = {c: f"then_{k}_" for k, c in enumerate(dict.fromkeys((price, vol, vix)))}
    tops = {c: f"top_{k}_" for k, c in enumerate(dict.fromkeys(c for c in (vol, vix, credit, liquidity) if c))}
    d = chunks(with_quantiles(df, keys, wanted), keys, time, 0, horizon)
    d = d.extremes({"low_": ("min", F.col(price), 1, horizon)} | {t: ("max", F.col(c), 1, horizon) for c, t in tops.items()})
    for c, then in known.items():
        d = d.shifted(then, F.col(c), horizon)

    def masked(hit: Column, own: str) -> Column:
        return F.when(F.col(known[own]).isNotNull(), yes(hit).cast("double"))

    stress = F.lit(False)
    for k, c in (("credit", credit), ("liquidity", liquidity)):
        if c:
            stress = stress | yes(F.col(tops[c]) >= F.col(f"{k}_cut"))
    fall = F.try_divide("low_", F.col(price)) - 1
    out = (
        d.whole().plain()
        .withColumn("forecast_horizon_days", F.lit(horizon))
        .withColumn("forward_drawdown", fall)
        .withColumn(dd, masked(fall <= -abs(threshold), price))
        .withColumn(vol_name, masked(F.col(tops[vol]) >= F.col("vol_cut"), vol))
        .withColumn(vix_name, masked(F.col(tops[vix]) >= vix_level, vix))
        .withColumn("stress_", stress)
    )
    hit = (F.col(dd) == 1) & (yes(F.col(vol_name) == 1) | yes(F.col(vix_name) == 1)) & F.col("stress_")
    out = out.withColumn(joint, F.when(F.col(dd).isNotNull(), hit.cast("double")))
    out = phased(out.drop(*wanted, "stress_", "low_", *known.values(), *tops.values()), dd, keys, time)
    return out.withColumn("overlapping_event_window", yes(F.col(dd) == 1) & (F.col("event_phase") == CONTINUATION))
