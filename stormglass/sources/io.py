"""Readers with lenient parsing, writers, and checks on what was read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.columns import canonical_ticker, clean_name


def wide_panel(raw: DataFrame) -> DataFrame:
    """A table of strings: the first column is the date, rows without one go, all others become numbers or null."""
    date, *others = raw.columns
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return raw.select(F.expr(f"to_date(try_cast(`{date}` AS timestamp))").alias("date"), *[number(c).alias(clean_name(c)) for c in others]).where("date is not null")


def read_wide_panel(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, read as strings."""
    return wide_panel(spark.read.option("header", True).csv(path))


def bars_from_sheets(raw: DataFrame, label: str, time: str = "timestamp") -> DataFrame:
    """String rows of one sheet an instrument -> typed bars; rows without a time or a close go, one row a (ticker, time)."""
    from stormglass.operators.panel import dedupe

    fields = [c for c in ("open", "high", "low", "close", "volume") if c in raw.columns]
    rows = raw.select(canonical_ticker(F.col(label)).alias("ticker"), F.expr(f"try_cast(`{time}` AS timestamp)").alias("ts"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in fields])
    rows = rows.where("ts is not null and close is not null")
    return dedupe(rows, ["ticker", "ts"], [F.col(c).desc_nulls_last() for c in reversed(fields)])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A folder of CSV files, each named after its instrument."""
    raw = spark.read.option("header", True).csv(path).withColumn("label", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))
    return bars_from_sheets(raw.withColumn("label", F.url_decode("label")), "label")


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def dataset_summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row a table: rows, first and last time, number of columns."""
    out = None
    for name, (df, time) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col(time).cast("timestamp")).alias("first_time"), F.max(F.col(time).cast("timestamp")).alias("last_time"))
        row = row.select(F.lit(name).alias("dataset"), "*", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    getattr(writer, kind)(path)


def save_metadata(spark: SparkSession, path: str, **facts: object) -> None:
    """A JSON record of a run, written by Spark so that any store will do."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
