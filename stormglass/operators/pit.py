"""Point-in-time joins and audits: nothing may be seen before it was available."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.functions.columns import guarded_corr, suspicious_part
from stormglass.operators.scans import Scan, deal


def as_of_join(forecasts: DataFrame, records: DataFrame, by: list[str], forecast_time: str = "forecast_timestamp", available: str = "earliest_valid_prediction_timestamp", tie: list[str] | None = None, suffix: str = "_pit", direction: str = "backward") -> DataFrame:
    """Each forecast with the whole latest record that was available by then; nulls if none.

    Both sides are stacked and dealt by ranges of (key, time), so a key with most of the rows
    lies in many ranges; each is swept on its own and starts from the last record that the
    ranges before it hold. Equal times match, and of records that tie the last in `tie` order
    wins. The record travels as a struct, so a null value in the latest record is not skipped.
    Record columns that clash get the suffix; null keys match each other.
    """
    if direction != "backward":
        raise ValueError("only backward joins keep to what was known")
    payload = [c for c in records.columns if c not in by]
    tie = tie or []
    pack = F.struct(*payload)
    left = forecasts.select(*by, F.col(forecast_time).alias("time_"), F.lit(1).alias("side_"), *[F.lit(None).cast(records.schema[c].dataType).alias(f"tie_{k}") for k, c in enumerate(tie)], F.struct(*forecasts.columns).alias("row_"), F.lit(None).cast(records.select(pack.alias("r")).schema["r"].dataType).alias("rec_"))
    right = records.where(F.col(available).isNotNull()).select(*by, F.col(available).alias("time_"), F.lit(0).alias("side_"), *[F.col(c).alias(f"tie_{k}") for k, c in enumerate(tie)], F.lit(None).cast(left.schema["row_"].dataType).alias("row_"), pack.alias("rec_"))
    stacked = deal(left.unionByName(right), by, ["time_", "side_", *[f"tie_{k}" for k in range(len(tie))]])
    seen = stacked.scan({"seen_": Scan("last", F.col("rec_"))}).rows.where("side_ = 1")
    names = {c: c + suffix if c in forecasts.columns else c for c in payload}
    return seen.select("row_.*", *[F.col(f"seen_.{c}").alias(n) for c, n in names.items()])


def pit_feature_matrix(forecasts: DataFrame, store: DataFrame, features: list[str] | None, by: list[str], forecast_time: str = "forecast_timestamp", available: str = "earliest_valid_prediction_timestamp") -> DataFrame:
    """Distinct forecasts with, for every feature, its latest value and `<feature>__available_at`.

    One sweep over ranges of (key, time) serves all features: a conditional last for each,
    instead of a join for each. Without a list, all non-null names of the store are features.
    """
    if features is None:
        features = sorted(r[0] for r in store.where("feature_name is not null").select("feature_name").distinct().collect())
    left = forecasts.select(*by, F.col(forecast_time).alias("time_"), F.lit(1).alias("side_"), F.lit(None).cast("string").alias("feature_name"), F.lit(None).cast("double").alias("value")).distinct()
    right = store.where(F.col("feature_name").isin(features) & F.col(available).isNotNull()).select(*by, F.col(available).alias("time_"), F.lit(0).alias("side_"), "feature_name", F.col("value").cast("double").alias("value"))
    of = {f"f{k}_": Scan("last", F.when(F.col("feature_name") == f, F.struct("value", F.col("time_").alias("at")))) for k, f in enumerate(features)}
    rows = deal(left.unionByName(right), by, ["time_", "side_", "value"]).scan(of).rows
    picked = [c for k, f in enumerate(features) for c in (F.col(f"f{k}_.value").alias(f), F.col(f"f{k}_.at").alias(f"{f}__available_at"))]
    return rows.where("side_ = 1").select(*by, F.col("time_").alias(forecast_time), *picked)


def future_availability(matrix: DataFrame, forecast_time: str = "forecast_timestamp", columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Per availability column the rows that were not yet available; raises if strict and any is."""
    columns = [c for c in (columns or [c for c in matrix.columns if c.endswith("__available_at")]) if c in matrix.columns]
    counts = matrix.agg(*[F.coalesce(F.sum((F.col(c) > F.col(forecast_time)).cast("long")), F.lit(0)).alias(c) for c in columns])
    out = counts.unpivot([], columns, "column", "violations")
    if strict and not out.where("violations > 0").isEmpty():
        raise ValueError("features from the future: " + ", ".join(r["column"] for r in out.where("violations > 0").collect()))
    return out


def availability_violations(store: DataFrame) -> DataFrame:
    """Rows that break the order of clocks or hide a known leak, with the names of the broken rules."""
    rules = {
        "ingestion_before_release": F.col("ingestion_time") < F.col("release_time"),
        "valid_before_release": F.col("earliest_valid_prediction_timestamp") < F.col("release_time"),
        "valid_before_ingestion": F.col("earliest_valid_prediction_timestamp") < F.col("ingestion_time"),
        "leak_without_reason": F.col("is_known_leak") & (F.coalesce(F.trim("leak_reason"), F.lit("")) == ""),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return store.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def suspicious_features(names: DataFrame, column: str = "feature_name") -> DataFrame:
    return names.select(column).distinct().withColumn("pattern", suspicious_part(F.col(column))).where("pattern is not null")


def target_correlation(long: DataFrame, feature: str, value: str, target: str, least: int = 10, limit: float = 0.9) -> DataFrame:
    """Features whose correlation with the target is suspiciously high, in one pass."""
    both = F.col(value).isNotNull() & F.col(target).isNotNull()
    stats = long.groupBy(feature).agg(F.count_if(both).alias("n_valid"), F.count_distinct(F.when(both, F.col(target))).alias("n_targets"), guarded_corr(F.col(value), F.col(target)).alias("corr"))
    return stats.where((F.col("n_valid") >= least) & (F.col("n_targets") >= 2) & (F.abs("corr") >= limit))


def leakage_audit(matrix: DataFrame, target: str, forecast_time: str = "forecast_timestamp") -> DataFrame:
    """Findings on names, availability and correlation: severity, check, column, message."""
    features = [c for c, kind in matrix.dtypes if c not in (target, forecast_time) and not c.startswith("event_") and not c.endswith("__available_at") and kind in ("double", "float", "int", "bigint")]
    spark = matrix.sparkSession
    names = suspicious_features(spark.createDataFrame([(f,) for f in features], "feature_name string"))
    by_name = names.select(F.lit("high").alias("severity"), F.lit("feature_name").alias("check"), F.col("feature_name").alias("column"), F.concat(F.lit("name contains "), "pattern").alias("message"))
    long = matrix.select(F.col(target).cast("double").alias("target_"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["target_"], features, "feature_name", "value")
    by_corr = target_correlation(long, "feature_name", "value", "target_").select(F.lit("critical").alias("severity"), F.lit("target_correlation").alias("check"), F.col("feature_name").alias("column"), F.lit("moves with the target").alias("message"))
    out = by_name.unionByName(by_corr)
    if any(c.endswith("__available_at") for c in matrix.columns):
        late = future_availability(matrix, forecast_time).where("violations > 0")
        out = out.unionByName(late.select(F.lit("critical").alias("severity"), F.lit("future_availability").alias("check"), "column", F.concat(F.col("violations").cast("string"), F.lit(" rows from the future")).alias("message")))
    return out
