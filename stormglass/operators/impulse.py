"""Impulse bars of a reference series and what moves with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.columns import guarded_corr
from stormglass.operators.quantiles import key_quantiles, rolling_quantile

SAMPLES = ["all", "threshold_ready", "large_abs", "large_down", "large_up"]


def bars_per_date(bars: DataFrame, time: str = "ts") -> float:
    """Median number of bars a date; 24 without bars."""
    per = bars.groupBy(F.to_date(time)).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.percentile("n", F.lit(0.5))).first()[0] or 24.0


def window_sizes(per_date: float, days: int = 20, least: int = 60) -> tuple[int, int]:
    """(rows of the window, least rows), rounded half to even."""
    width = max(least, round(days * per_date))
    return width, max(least, round(0.35 * width))


def impulse_events(returns: DataFrame, keys: list[str], q: float = 0.95, days: int = 20, least: int = 60, time: str = "ts", ret: str = "ret") -> DataFrame:
    """Flags of bars whose absolute return reaches the quantile of the bars before, over so many days of bars.

    rolling_window_bars and estimated_bars_per_date say how wide the window is; bars without a
    return are left out.
    """
    rows = returns.where(F.col(ret).isNotNull())
    per_date = bars_per_date(rows, time)
    width, enough = window_sizes(per_date, days, least)
    out = rolling_quantile(rows.withColumn("abs_ret", F.abs(ret)), "abs_ret", keys, time, width, q, enough, "threshold")
    big = F.coalesce(F.col("abs_ret") >= F.col("threshold"), F.lit(False))
    flags = {"threshold_ready": F.col("threshold").isNotNull(), "large_abs": big, "large_down": big & (F.col(ret) < 0), "large_up": big & (F.col(ret) > 0)}
    return out.withColumns(flags | {"rolling_window_bars": F.lit(width), "estimated_bars_per_date": F.lit(float(per_date))})


def impulse_summary(events: DataFrame, ret: str = "ret") -> DataFrame:
    """Per kind of event: bars that were eligible, events, rate, and return statistics in basis points."""
    kind = F.explode(F.array(*[F.struct(F.lit(n).alias("event"), F.col(n).alias("hit")) for n in ("large_abs", "large_down", "large_up")])).alias("k")
    rows = events.where("threshold_ready").select(F.col(ret).alias("r"), kind).select("r", "k.*")
    rows = rows.withColumn("bp", F.when(F.col("hit"), F.col("r") * 10000))
    sums = rows.groupBy("event").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("hit").alias("n_events"), F.avg(F.col("hit").cast("double")).alias("rate"), F.avg(F.abs("bp")).alias("mean_abs_bp"))
    points = key_quantiles(rows, ["event"], "bp", {"median_bp": 0.5, "p10_bp": 0.1, "p90_bp": 0.9})
    return sums.join(points, "event", "left").select("event", "eligible", "n_events", "rate", "median_bp", "p10_bp", "p90_bp", "mean_abs_bp")


def sample_flags() -> Column:
    return F.filter(F.array(F.lit("all"), *[F.when(F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in SAMPLES[1:]]), lambda s: s.isNotNull())


def reference_align(returns: DataFrame, events: DataFrame, time: str = "ts") -> DataFrame:
    """Every series beside the reference's return and flags at the same time; rows where the reference traded."""
    return returns.join(events.select(time, F.col("ret").alias("ref_ret"), *SAMPLES[1:]), time)


def conditional_correlation(aligned: DataFrame, key: str = "ticker", least: int = 3) -> DataFrame:
    """Per sample and series: complete pairs, correlation with the reference, and its change against ready bars.

    Flags are exploded once and all moments come from one aggregation; pairs without rows are listed.
    """
    rows = aligned.withColumn("sample", F.explode(sample_flags()))
    both = F.col("ret").isNotNull() & F.col("ref_ret").isNotNull()
    stats = rows.groupBy("sample", key).agg(F.count_if(both).alias("n_obs"), guarded_corr(F.col("ret"), F.col("ref_ret")).alias("corr"))
    scaffold = aligned.select(key).distinct().withColumn("sample", F.explode(F.array(*[F.lit(s) for s in SAMPLES])))
    full = scaffold.join(stats, ["sample", key], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    full = full.withColumn("corr", F.when(F.col("n_obs") >= least, F.col("corr"))).withColumn("abs_corr", F.abs("corr"))
    ready = F.max(F.when(F.col("sample") == "threshold_ready", F.col("corr"))).over(Window.partitionBy(key))
    return full.withColumn("delta_vs_ready", F.col("corr") - ready)


def top_drivers(correlations: DataFrame, key: str = "ticker", n: int = 8) -> DataFrame:
    by = Window.partitionBy("sample").orderBy(F.col("abs_corr").desc_nulls_last(), F.col("n_obs").desc(), key)
    return correlations.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
