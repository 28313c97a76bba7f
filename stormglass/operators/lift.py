"""Event rates given an indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.operators.quantiles import with_quantiles
from stormglass.operators.windows import exact_quantiles


def conditional_lift(panel: DataFrame, specs: dict[str, tuple[str, str]], targets: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per indicator and target: coverage, base rate, rate in the tail and lift.

    specs: label -> (column, "high" or "low"): at or above the 0.9 quantile, or at or below the
    0.1 quantile, of the key or, without keys, of the whole column.
    """
    keys = keys or []
    shares = {f"cut_{k}": (c, 0.9 if side == "high" else 0.1) for k, (c, side) in enumerate(specs.values())}
    if keys:
        joined = with_quantiles(panel, keys, shares)
    else:
        joined = panel.withColumns({k: F.lit(v).cast("double") for k, v in exact_quantiles(panel, shares).items()})
    flags = []
    for k, (label, (c, side)) in enumerate(specs.items()):
        inside = F.col(c) >= F.col(f"cut_{k}") if side == "high" else F.col(c) <= F.col(f"cut_{k}")
        flags.append(F.struct(F.lit(label).alias("indicator"), F.coalesce(inside, F.lit(False)).alias("inside")))
    rows = joined.select(*keys, F.explode(F.array(*flags)).alias("i"), F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets]).alias("ts"))
    rows = rows.select(*keys, "i.*", F.explode("ts").alias("t")).select(*keys, "indicator", "inside", "t.*")
    valid = F.col("inside") & F.col("y").isNotNull()
    out = rows.groupBy(*keys, "indicator", "target").agg(
        (F.count_if(valid) / F.count(F.lit(1))).alias("coverage"), F.avg("y").alias("base_rate"), F.avg(F.when(F.col("inside"), F.col("y"))).alias("conditional_rate"),
    )
    return out.withColumn("lift", F.try_divide("conditional_rate", "base_rate"))


def indicator_table(panel: DataFrame, specs: dict[str, tuple[str, str, float]], targets: list[str], keys: list[str]) -> DataFrame:
    """Per key, target and indicator: coverage, base rate, rate where the indicator holds, lift, and rank by lift.

    specs: label -> (column, test, level), where test is "above", "below", "at_most" or "top"
    (at or above the quantile `level` of the key). All quantiles come from one table of counts.
    """
    tops = {f"cut_{k}": (c, q) for k, (c, test, q) in enumerate(specs.values()) if test == "top"}
    tests = {"above": lambda c, k, x: c > x, "below": lambda c, k, x: c < x, "at_most": lambda c, k, x: c <= x, "top": lambda c, k, x: c >= F.col(f"cut_{k}")}
    flags = [F.struct(F.lit(label).alias("indicator"), F.coalesce(tests[test](F.col(c), k, x), F.lit(False)).alias("inside")) for k, (label, (c, test, x)) in enumerate(specs.items())]
    ys = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])
    rows = with_quantiles(panel, keys, tops).select(*keys, F.array(*flags).alias("is"), F.explode(ys).alias("t")).select(*keys, "t.*", F.explode("is").alias("i")).select(*keys, "target", "y", "i.*")
    valid = F.col("inside") & F.col("y").isNotNull()
    out = rows.groupBy(*keys, "target", "indicator").agg(
        (F.count_if(valid) / F.count(F.lit(1))).alias("coverage"), F.avg("y").alias("base_rate"), F.avg(F.when(F.col("inside"), F.col("y"))).alias("conditional_rate"),
    )
    out = out.withColumn("lift", F.try_divide("conditional_rate", "base_rate"))
    order = Window.partitionBy(*keys, "target").orderBy(F.round("lift", 9).desc_nulls_last(), "indicator")
    return out.withColumn("rank", F.row_number().over(order))


def quantile_bins(df: DataFrame, x: str, bins: int = 10, name: str = "decile") -> DataFrame:
    """Right-closed bins at exact quantiles, the lowest edge included, equal edges merged; from 1."""
    found = exact_quantiles(df, {str(k): (x, k / bins) for k in range(bins + 1)}).values()
    edges = sorted({e for e in found if e is not None})
    number = sum(((F.col(x) > e).cast("int") for e in edges[1:-1]), F.lit(1))
    return df.withColumn(name, F.when(F.col(x).isNotNull(), number))


def base_rates(df: DataFrame, labels: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in labels])
    return means.unpivot([], labels, "label", "rate").withColumn("percent", F.col("rate") * 100)
