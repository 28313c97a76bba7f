"""Reshaping: tenor selection, panels, cross sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["futures", "atm", "rr25", "rr10", "fly25", "fly10"]


def constant_tenor(chain: DataFrame, tie: list[str], target_days: tuple[int, ...] = (30, 60, 90), max_distance: int = 20, fields: list[str] | None = None) -> DataFrame:
    """Long form (date, ticker, feature, target_days, value): the expiry nearest to each tenor.

    Distance is filtered before the only shuffle; the nearest row is a min_by that combines on
    the map side. Ties go to the shorter expiry, then to `tie`. Fields that the chain lacks
    are skipped.
    """
    fields = [f for f in (fields or FIELDS) if f in chain.columns]
    near = (
        chain.where("date is not null and ticker is not null and dte is not null")
        .withColumn("target_days", F.explode(F.array(*[F.lit(t) for t in target_days])))
        .withColumn("distance", F.abs(F.col("dte") - F.col("target_days")))
        .where(F.col("distance") <= max_distance)
    )
    picked = near.groupBy("ticker", "date", "target_days").agg(F.min_by(F.struct(*fields), F.struct("distance", "dte", *tie)).alias("row"))
    long = picked.select("ticker", "date", "target_days", "row.*").unpivot(["ticker", "date", "target_days"], fields, "field", "value")
    return long.withColumn("feature", F.concat_ws("_", "ticker", "field", F.concat(F.col("target_days").cast("string"), F.lit("d"))))


def root_panel(long: DataFrame, field: str, tenor: int) -> DataFrame:
    return long.where((F.col("field") == field) & (F.col("target_days") == tenor)).select("date", "ticker", "value")


def pivot_last(long: DataFrame, row: str, column: str, value: str, tie: str, names: list[str]) -> DataFrame:
    """One column a name, the last value of each cell by `tie`."""
    return long.groupBy(row).pivot(column, names).agg(F.max_by(value, tie))


def return_panel(bars: DataFrame, time: str, key: str, price: str, names: list[str]) -> DataFrame:
    """Log returns by time and key, rows without any dropped."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(time))
    long = bars.withColumn("ret", F.ln(F.when(F.col(price) > 0, F.col(price))) - F.ln(F.when(before > 0, before)))
    wide = long.groupBy(time).pivot(key, names).agg(F.max("ret"))
    return wide.where(F.coalesce(*names).isNotNull())


def to_feature_store(market: DataFrame, entity: str, features: list[str], leaked: list[str]) -> DataFrame:
    """Long records with their window and leak flags, by one unpivot."""
    ids = [entity, "event_time", "release_time", "ingestion_time", "earliest_valid_prediction_timestamp"]
    long = market.unpivot(ids, features, "feature_name", "value")
    window = F.when(F.endswith("feature_name", F.lit("_20")), "20d").when(F.endswith("feature_name", F.lit("_60")), "60d").otherwise("point")
    leak = F.col("feature_name").isin(leaked) if leaked else F.lit(False)
    return long.withColumn("transformation_window", window).withColumn("is_known_leak", leak).withColumn("leak_reason", F.when(leak, "uses later prices"))


def cross_section(long: DataFrame, date: str, group: str, value: str, groups: list[str]) -> DataFrame:
    """Per date the mean, the dispersion and the mean of every group."""
    means = [F.avg(F.when(F.col(group) == g, F.col(value))).alias(f"mean_{g}") for g in groups]
    return long.groupBy(date).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dispersion"), *means)


def enrich(bars: DataFrame, dim: DataFrame, on: str = "ticker") -> DataFrame:
    """Instrument data beside each row; `unknown` where there is none. The dimension holds one row an instrument."""
    out = bars.join(dim, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in dim.columns if c != on})


def dedupe(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    numbered = rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("rn_ = 1").drop("rn_")


def nearest_dates(daily: DataFrame, cases: DataFrame, key: str, date: str, price: str, back: tuple[int, int] = (20, 60)) -> DataFrame:
    """For each key and named date the nearest row and the price changes before it.

    cases is a handful of named dates; earlier rows are clamped to the first.
    """
    w = Window.partitionBy(key).orderBy(date)
    for n in back:
        daily = daily.withColumn(f"before_{n}", F.coalesce(F.lag(price, n).over(w), F.first(price).over(w)))
    columns = [date, price, *[f"before_{n}" for n in back]]
    away = F.abs(F.datediff(date, "case_date"))
    best = daily.crossJoin(F.broadcast(cases)).groupBy(key, "case_name").agg(F.min_by(F.struct(*columns), F.struct(away, date)).alias("row"))
    return best.select(key, "case_name", "row.*").withColumns({f"change_{n}": F.try_divide(price, f"before_{n}") - 1 for n in back})
