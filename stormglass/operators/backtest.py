"""Overlay backtests: exposure follows a signal one row later."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stormglass.operators import scans
from stormglass.operators.quantiles import key_quantiles
from stormglass.operators.scans import Dealt, deal
from stormglass.operators.windows import chunks


def overlay(df: DataFrame, keys: list[str], time: str, ret: str, high_risk: str, low_exposure: Column | float, cost: float = 0.0001) -> DataFrame:
    """position and overlay_return; the position is the last row's exposure (1 at first), a missing signal is no risk."""
    low = F.lit(low_exposure) if isinstance(low_exposure, float) else low_exposure
    exposure = F.when(F.coalesce(F.col(high_risk), F.lit(False)), low).otherwise(F.lit(1.0))
    w = Window.partitionBy(*keys).orderBy(time)
    out = df.withColumn("exposure", exposure).withColumn("position", F.coalesce(F.lag("exposure").over(w), F.lit(1.0)))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.col("position")))
    return out.withColumn("turn", turn).withColumn("overlay_return", F.col("position") * F.col(ret) - F.col("turn") * cost)


def _paths(d: Dealt, runs: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(key_, run, metrics) of each run (return, position, turn) over dealt rows; rows without a return are left out.

    What a part of a key comes to, its growth, its highest and lowest point and its worst
    drawdown, is one row a part: two neighbours make one by (growth x growth, the higher peak,
    the lower trough, the worst of both drawdowns and of the second's trough under the first's
    peak). So all runs take one pass over the rows, and no key is multiplied out in one task.
    Returns are above -1.
    """
    rows, along = d.rows, Window.partitionBy("part_", "key_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    names = list(runs)
    rows = rows.select("key_", "part_", "at_", *[c.alias(f"{x}{k}") for k, name in enumerate(names) for x, c in zip(("r", "p", "t"), runs[name], strict=True)])
    rows = rows.withColumns({f"e{k}": F.product(1 + F.col(f"r{k}")).over(along) for k in range(len(names))})
    rows = rows.withColumns({f"d{k}": F.col(f"e{k}") / F.max(f"e{k}").over(along) - 1 for k in range(len(names))})
    own = lambda x, k: F.when(F.col(f"r{k}").isNotNull(), F.col(f"{x}{k}"))
    sums = [
        f.alias(f"{x}{k}") for k in range(len(names)) for x, f in {
            "g": F.product(1 + F.col(f"r{k}")), "peak": F.max(f"e{k}"), "trough": F.min(f"e{k}"), "worst": F.min(f"d{k}"), "low": F.min(f"r{k}"), "n": F.count(f"r{k}"),
            "sum": F.sum(f"r{k}"), "var": F.var_pop(f"r{k}"), "pos": F.sum(own("p", k)), "turn": F.sum(own("t", k)),
        }.items()
    ]
    parts = rows.groupBy("key_", "part_").agg(*sums)
    fields = ("g", "peak", "trough", "worst", "low", "n", "sum", "var", "pos", "turn")
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("run"), *[F.col(f"{x}{k}").alias(x) for x in fields]) for k, name in enumerate(names)]))
    # one row a part and run from here on
    each = parts.select("key_", "part_", cells.alias("c")).select("key_", "part_", "c.*").where("n > 0")
    ahead = Window.partitionBy("key_", "run").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.product("g").over(ahead), F.lit(1.0))).withColumn("top", F.col("before") * F.col("peak"))
    worst = F.least("worst", F.try_divide(F.col("before") * F.col("trough"), F.max("top").over(ahead)) - 1)
    whole = Window.partitionBy("key_", "run")
    each = each.withColumn("worst", worst).withColumn("mean", F.sum("sum").over(whole) / F.sum("n").over(whole))
    spread = F.sum(F.col("n") * (F.col("var") + F.pow(F.col("sum") / F.col("n") - F.col("mean"), 2)))
    out = each.groupBy("key_", "run").agg(
        F.sum("n").alias("n"), (F.product("g") - 1).alias("cumulative_return"), (F.sqrt(F.try_divide(spread, F.sum("n") - 1)) * math.sqrt(252)).alias("annual_vol"),
        F.min("worst").alias("max_drawdown"), F.min("low").alias("worst_day"), (F.sum("pos") / F.sum("n")).alias("mean_exposure"), F.sum("turn").alias("turnover"),
    )
    out = out.withColumn("annual_return", F.pow(1 + F.col("cumulative_return"), F.lit(252.0) / F.col("n")) - 1)
    return out.withColumn("sharpe", F.try_divide("annual_return", "annual_vol"))


def strategy_metrics(df: DataFrame, keys: list[str], time: str, ret: str, position: str = "position", turn: str = "turn") -> DataFrame:
    """n, returns, volatility, sharpe, drawdown, worst day, exposure and turnover per key."""
    found = _paths(deal(df.select(*keys, time, ret, position, turn), keys, [time]), {"own": (F.col(ret), F.col(position), F.col(turn))})
    return found.select("key_.*", *found.columns[2:])


def sensitivity_grid(df: DataFrame, keys: list[str], time: str, ret: str, score: str, train: Column, quantiles: tuple[float, ...] = (0.75, 0.8, 0.85, 0.9), exposures: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75), cost: float = 0.0001) -> DataFrame:
    """Metrics of every quantile and exposure; thresholds come from the train rows.

    A scenario follows from the scores of this row and the two before it, so all scenarios are
    columns of one pass over chunks of rows; keys without a train score have no rows.
    """
    cuts = key_quantiles(df.where(train), keys, score, {f"cut_{k}": q for k, q in enumerate(quantiles)})
    d = chunks(df.select(*keys, time, ret, score).join(cuts, keys), keys, time, 2, 0)
    d = d.shifted("score_1", F.col(score), -1).shifted("score_2", F.col(score), -2).whole()
    runs, risky = {}, []
    for k, q in enumerate(quantiles):
        high = {n: F.coalesce(F.col(c) >= F.col(f"cut_{k}"), F.lit(False)) for n, c in enumerate((score, "score_1", "score_2"))}
        risky.append((100 * F.avg(high[0].cast("double"))).alias(f"{k}"))
        for e in exposures:
            position, before = (F.when(high[n], F.lit(e)).otherwise(F.lit(1.0)) for n in (1, 2))
            turn = F.when(F.col("place_") > 0, F.abs(position - before)).otherwise(F.lit(0.0))
            runs[f"{k}/{e}"] = (position * F.col(ret) - turn * cost, position, turn)
    settled = d.settled()
    found = _paths(settled, runs)
    part = F.split("run", "/")
    shares = settled.rows.groupBy("key_").agg(*risky).unpivot(["key_"], [f"{k}" for k in range(len(quantiles))], "k", "pct_high_risk")
    found = found.withColumns({"k": part[0], "low_exposure": part[1].cast("double")}).drop("run").join(shares, ["key_", "k"])
    named = F.element_at(F.array(*[F.lit(q) for q in quantiles]), F.col("k").cast("int") + 1)
    return found.withColumn("quantile", named).select("key_.*", "quantile", "low_exposure", *[c for c in found.columns if c not in ("key_", "k", "low_exposure")])


def rank_strategies(metrics: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """The best rows of a grid by sharpe, then by drawdown."""
    by = Window.partitionBy(*keys).orderBy(F.col("sharpe").desc_nulls_last(), F.col("max_drawdown").desc(), "quantile", "low_exposure")
    return metrics.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


#: Draws that a range of block_bootstrap may be expected to get, four bytes each.
DRAWS = 1 << 23


def block_bootstrap(df: DataFrame, keys: list[str], time: str, excess: str, block: int = 20, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Annualised mean excess and its 5, 50 and 95 percent points over moving-block resamples.

    Block starts are hashes of (replicate, block), so reruns agree. A draw travels as the four
    bytes of its place within a range of rows, packed by replicate; the range, with the rows
    that its last blocks reach into, sums its blocks as differences of running sums and sends
    one number a replicate. Replicates are made in tasks of their own, so neither a key's rows
    nor its draws meet in one task. Rows without an excess are left out.
    """
    size = max(1, min(scans.CHUNK, DRAWS * block // replicates))
    numbered = deal(df.where(F.col(excess).isNotNull()).select(*keys, time, F.col(excess).cast("double").alias("x_")), keys, [time]).numbered()
    sizes = numbered.rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n"), F.avg("x_").alias("mean_"))
    ranges = numbered.chunked(0, block, size).rows.select("key_", "part_", "place_", "last_", "x_")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = sizes.select(F.col("key_").alias("of_"), "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).repartition(tasks, "of_", "rep")
    plan = plan.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    digest = F.md5(F.concat_ws("-", "rep", "b", F.lit(seed)))
    begin = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.greatest(F.col("n") - block + 1, F.lit(1)))
    length = max(size, block)
    plan = plan.withColumn("begin", begin).withColumn("range_", F.floor(F.col("begin") / length))
    at = (F.col("begin") - F.col("range_") * length).cast("int")
    # the last block of a replicate may be a shorter one: its places are told by their sign
    code = F.when(F.col("b") == F.ceil(F.col("n") / block) - 1, -1 - at).otherwise(at)
    packed = plan.groupBy("of_", "rep", "range_").agg(F.collect_list(code).alias("draws"))

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        if not len(draws):
            return draws.select(["of_", "rep"]).append_column("sum_", pa.array([], pa.float64()))
        rows = rows.sort_by("place_")
        upto = np.concatenate([[0.0], np.cumsum(rows.column("x_").to_numpy())])
        n = rows.column("last_")[0].as_py() + 1
        lists = draws.column("draws").combine_chunks()
        places = lists.flatten().to_numpy()
        short = places < 0
        first = np.where(short, -1 - places, places)
        sums = upto[first + np.where(short, n - (n - 1) // block * block, block)] - upto[first]
        ends = np.cumsum(lists.value_lengths().to_numpy())
        each = np.add.reduceat(sums, np.concatenate([[0], ends[:-1]]))
        return draws.select(["of_", "rep"]).append_column("sum_", pa.array(each, pa.float64()))

    schema = StructType([packed.schema["of_"], packed.schema["rep"], StructField("sum_", DoubleType())])
    drawn = ranges.groupBy("key_", "part_").cogroup(packed.groupBy("of_", "range_")).applyInArrow(run, schema)
    reps = drawn.groupBy(F.col("of_").alias("key_"), "rep").agg(F.sum("sum_").alias("sum_")).join(sizes, "key_").withColumn("mean", F.col("sum_") / F.col("n") * 252)
    out = reps.groupBy("key_").agg(F.percentile("mean", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.count(F.lit(1)).alias("replicates"), F.first("mean_").alias("mean_"))
    return out.select("key_.*", (F.col("mean_") * 252).alias("mean_excess"), F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "replicates")
