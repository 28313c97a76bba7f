"""Trailing, forward and running features.

Functions of a value, the keys and the time column return a Column, computed in one sort per
key; those of a DataFrame split a key over many tasks and cost the same for any horizon.
Missing is null; a window with fewer than `least` values gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from stormglass.functions.scratch import cut, drop
from stormglass.operators.quantiles import column_quantiles
from stormglass.operators.scans import Dealt, Scan, deal

Keys = list[str]


def ordered(keys: Keys, time: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def rows(keys: Keys, time: str, start: int, end: int) -> WindowSpec:
    return ordered(keys, time).rowsBetween(start, end)


def trailing(keys: Keys, time: str, width: int) -> WindowSpec:
    """The last `width` rows, the current one included."""
    return rows(keys, time, -(width - 1), 0)


def prior(keys: Keys, time: str, width: int) -> WindowSpec:
    """The `width` rows before the current one."""
    return rows(keys, time, -width, -1)


def enough(x: Column, frame: WindowSpec, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def log_return(price: Column, keys: Keys, time: str, n: int = 1) -> Column:
    w = ordered(keys, time)
    return F.ln(F.when(price > 0, price)) - F.ln(F.when(F.lag(price, n).over(w) > 0, F.lag(price, n).over(w)))


def series_change(x: Column, keys: Keys, time: str, n: int = 1) -> Column:
    return x - F.lag(x, n).over(ordered(keys, time))


def simple_return(price: Column, keys: Keys, time: str) -> Column:
    """price / price before - 1; 0 on the first row."""
    before = F.lag(price).over(ordered(keys, time))
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.try_divide(price, before) - 1)


def rolling_momentum(ret: Column, keys: Keys, time: str, width: int) -> Column:
    w = trailing(keys, time, width)
    return enough(ret, w, max(2, width // 4), F.sum(ret).over(w))


def realized_volatility(ret: Column, keys: Keys, time: str, width: int, least: int | None = None, scale: float = math.sqrt(252)) -> Column:
    w = trailing(keys, time, width)
    return enough(ret, w, max(5, width // 4) if least is None else least, F.stddev_samp(ret).over(w) * scale)


def downside_semivariance(ret: Column, keys: Keys, time: str, width: int) -> Column:
    w = trailing(keys, time, width)
    loss = F.when(ret.isNotNull(), F.pow(F.least(ret, F.lit(0.0)), 2))
    return enough(ret, w, max(5, width // 4), F.avg(loss).over(w))


def rolling_mean_abs(ret: Column, keys: Keys, time: str, width: int = 20, least: int = 10) -> Column:
    w = trailing(keys, time, width)
    return enough(ret, w, least, F.avg(F.abs(ret)).over(w))


def rolling_zscore(x: Column, keys: Keys, time: str, width: int) -> Column:
    """Against the window that ends with the row itself."""
    w = trailing(keys, time, width)
    return enough(x, w, max(5, width // 4), F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def shifted_zscore(x: Column, keys: Keys, time: str, width: int = 252, least: int = 126) -> Column:
    """Against the rows before; null where these are constant."""
    w = prior(keys, time, width)
    return enough(x, w, least, F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))))


def trailing_drawdown(price: Column, keys: Keys, time: str, width: int, least: int = 1) -> Column:
    w = trailing(keys, time, width)
    return enough(price, w, least, F.try_divide(price, F.max(price).over(w)) - 1)


def forward_drawdown(price: Column, keys: Keys, time: str, horizon: int) -> Column:
    """Lowest of the next prices over the price, minus 1; the tail uses what there is."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    return F.try_divide(F.min(price).over(rows(keys, time, 1, horizon)), price) - 1


def forward_max(x: Column, keys: Keys, time: str, horizon: int) -> Column:
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    return F.max(x).over(rows(keys, time, 1, horizon))


def chunks(df: DataFrame, keys: Keys, time: str, before: int, after: int, keep: list[str] | None = None) -> Dealt:
    """df in chunks of rows along time, each with the rows that windows of such a reach need."""
    return deal(df, keys, [time], keep).numbered().chunked(before, after)


def _positive(horizon: int) -> None:
    if horizon <= 0:
        raise ValueError("horizon must be positive")


def add_trailing_drawdown(df: DataFrame, price: str, keys: Keys, time: str, width: int, name: str, least: int = 1) -> DataFrame:
    """df with trailing_drawdown(); a row costs the same for any width, and a long key runs in many tasks."""
    d = chunks(df, keys, time, width - 1, 0).extremes({"top_": ("max", F.col(price), 1 - width, 0)}).counts({"n_": (F.col(price), 1 - width, 0)})
    value = F.when(F.col("n_") >= least, F.try_divide(F.col(price), F.col("top_")) - 1)
    return d.whole().plain().withColumn(name, value).drop("top_", "n_")


def add_forward_drawdown(df: DataFrame, price: str, keys: Keys, time: str, horizon: int, name: str) -> DataFrame:
    """df with forward_drawdown(); a row costs the same for any horizon, and a long key runs in many tasks."""
    _positive(horizon)
    d = chunks(df, keys, time, 0, horizon).extremes({"low_": ("min", F.col(price), 1, horizon)})
    return d.whole().plain().withColumn(name, F.try_divide("low_", F.col(price)) - 1).drop("low_")


def add_forward_max(df: DataFrame, x: str, keys: Keys, time: str, horizon: int, name: str) -> DataFrame:
    """df with forward_max(); a row costs the same for any horizon, and a long key runs in many tasks."""
    _positive(horizon)
    return chunks(df, keys, time, 0, horizon).extremes({name: ("max", F.col(x), 1, horizon)}).whole().plain()


def add_growth(df: DataFrame, ret: str, keys: Keys, time: str) -> DataFrame:
    """df with growth (of 1) and drawdown (against its highest so far), as scans over ranges of time."""
    grown = deal(df, keys, [time]).scan({"growth": Scan("product", 1 + F.col(ret))}).settled()
    top = grown.scan({"top_": Scan("max", F.col("growth"))}).rows
    return Dealt(top.withColumn("drawdown", F.try_divide("growth", F.col("top_")) - 1).drop("top_"), keys).plain()


def add_drawdown(df: DataFrame, value: str, keys: Keys, time: str, name: str) -> DataFrame:
    """df with the value against its highest so far, minus 1, as a scan over ranges of time."""
    rows = deal(df, keys, [time]).scan({"top_": Scan("max", F.col(value))}).rows
    return Dealt(rows.withColumn(name, F.try_divide(F.col(value), F.col("top_")) - 1).drop("top_"), keys).plain()


def rolling_event_frequency(label: Column, keys: Keys, time: str, width: int = 252, least: int = 20) -> Column:
    w = prior(keys, time, width)
    return enough(label, w, least, F.avg(label).over(w))


def bounded_ffill(x: Column, keys: Keys, time: str, limit: int = 5) -> Column:
    return F.last(x, ignorenulls=True).over(rows(keys, time, -limit, 0))


def row_index(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """df with its place in the order, from 0, without a single-task sort.

    Rows are dealt by ranges and sorted within them; what the ranges hold is counted, and the
    offsets, one row a partition, meet the rows again. The dealt rows are cut, so that both
    passes see the same partitions.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mono_", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("part_", F.shiftright("mono_", 33)).withColumn("local_", F.col("mono_").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part_", before.alias("offset_"))
    return dealt.join(offsets, "part_").withColumn(name, F.col("offset_") + F.col("local_")).drop("part_", "mono_", "local_", "offset_")


def running_sum(df: DataFrame, order: list[str | Column], values: dict[str, str | Column], by: list[str]) -> DataFrame:
    """df with the sums (name -> column) over the rows up to here in the order, for each key of by (never null).

    order begins with the keys. No key is sorted in one task: ranges of the order are summed on
    their own, and each adds what the ranges before it hold, one row a key and range.
    """
    parts = {f"v{k}_": F.col(v) if isinstance(v, str) else v for k, v in enumerate(values.values())}
    dealt = cut(df.withColumns(parts).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    local = dealt.withColumns({n: F.sum(v).over(Window.partitionBy("part_", *by).orderBy(*order)) for n, v in zip(values, parts, strict=True)})
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "part_").agg(*[F.sum(v).alias(v) for v in parts])
    offsets = sizes.select(*by, "part_", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"o{v}") for v in parts])
    out = local.join(offsets, [*by, "part_"]).withColumns({n: F.col(n) + F.col(f"o{v}") for n, v in zip(values, parts, strict=True)})
    return out.drop("part_", *parts, *[f"o{v}" for v in parts])


def exact_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Quantiles (name -> (column, share)) of whole columns, linear between neighbours; None without values.

    No task holds a column, and one row reaches the driver.
    """
    if not wanted:
        return {}
    written: list[str] = []
    found = column_quantiles(rows, [], wanted, written).first()
    drop(rows.sparkSession, written)
    return {k: found[k] for k in wanted}


def with_halo(df: DataFrame, index: str, chunk: int, halo: int, keys: Keys) -> DataFrame:
    """df in chunks of `chunk` rows by index, each with copies of the `halo` rows before it (is_halo).

    Windows over (keys, chunk) then see all they need, so that one long series runs in parallel.
    """
    last = F.floor((F.col(index) + halo) / chunk)
    spread = df.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(index) / chunk), last)))
    ends = F.max(index).over(Window.partitionBy(*keys))
    return spread.withColumn("is_halo", F.col("chunk") > F.floor(F.col(index) / chunk)).withColumn("end_", ends).where("chunk * %d <= end_" % chunk).drop("end_")
