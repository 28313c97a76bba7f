"""Scores of rare-event probabilities, per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.functions.scratch import cut, drop
from stormglass.operators.windows import running_sum

# The edges of ten equal bins as floating point makes them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def probability_metrics(scores: DataFrame, key: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """n, positive_rate, brier, log_loss, average_precision, roc_auc (null when one class is missing).

    Rows collapse to distinct scores first, with their positives and negatives; ranking
    measures are running sums over ranges of those, so ties share one step and no model is
    sorted in one task.
    """
    rows = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    plain = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"), F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("brier"),
        F.avg(-(F.col(y) * F.ln(clipped) + (1 - F.col(y)) * F.ln(1 - clipped))).alias("log_loss"),
    )
    steps = rows.groupBy(key, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    steps = running_sum(steps, [key, F.col(p).desc()], {"tp": "pos", "fp": "neg"}, [key])
    ranked = steps.groupBy(key).agg(
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
    )
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return plain.join(ranked, key).select(
        key, "n", "positive_rate", "brier", "log_loss", F.when(both, F.col("ap") / F.col("np")).alias("average_precision"), F.when(both, F.col("area") / (F.col("np") * F.col("nn"))).alias("roc_auc")
    )


def calibration_error(scores: DataFrame, key: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """Expected calibration error over ten bins (a, b], the first with 0."""
    number = sum(((F.col(p) > e).cast("int") for e in EDGES[1:-1]), F.lit(0))
    bins = scores.where(F.col(p).between(0, 1) & F.col(y).isNotNull()).groupBy(key, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"))
    return bins.groupBy(key).agg((F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))) / F.sum("n")).alias("ece"))


def paired_brier(scores: DataFrame, y: str, a: str, b: str) -> DataFrame:
    return scores.agg(F.avg(F.pow(F.col(y) - F.col(a), 2) - F.pow(F.col(y) - F.col(b), 2)).alias("brier_difference"))


def calibration_line(scores: DataFrame, key: str = "model", y: str = "y", p: str = "p", steps: int = 25) -> DataFrame:
    """Slope and intercept of y on the logit of p, by reweighted least squares; null where one class is missing.

    Two parameters a model: each step is one aggregation over the distinct (model, p, y). The
    state is a table of one row a model, written at each step in place of the one before; one
    number reaches the driver.
    """
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    x = F.ln(clipped / (1 - clipped))
    known = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    points = cut(known.groupBy(F.col(key).alias("key_"), x.alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    both = points.groupBy("key_").agg(F.count_distinct("y").alias("c")).where("c > 1")
    last: list[str] = []
    state = cut(both.select("key_", F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), last)
    for _ in range(steps):
        m = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w = F.col("n") * F.col("m") * (1 - F.col("m"))
        r = F.col("n") * (F.col("y") - F.col("m"))
        sums = {"h0": w, "h1": w * F.col("x"), "h2": w * F.col("x") * F.col("x"), "g0": r, "g1": r * F.col("x")}
        got = points.join(state, "key_").withColumn("m", m).groupBy("key_", "a", "b").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        solved = lambda top: F.when(F.abs(det) >= 1e-12, top / det).otherwise(0.0)  # noqa: B023, E731
        da, db = solved(F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")), solved(F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0"))
        after = cut(got.select("key_", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("moved")), fresh := [])
        drop(scores.sparkSession, last)
        last = fresh
        state, moved = after.drop("moved"), after.agg(F.max("moved")).first()[0]
        if moved is None or moved < 1e-10:
            break
    fitted = state.select(F.col("key_").alias(key), F.col("b").alias("slope"), F.col("a").alias("intercept"))
    return scores.select(key).distinct().join(fitted, key, "left")
