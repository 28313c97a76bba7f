"""The canonical frames on the driver's tables, once in Spark and once in SQL.

Both sides compute on integers as long as they can, so that equal inputs give equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, date, ret_micro, price, vix, vix3m, credit): one series for each return flag."""
    rows = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    per = rows.groupBy(F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long"))).alias("qf"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("nf"),
    )
    per = per.withColumn("ret_micro", F.floor(F.col("d") * 10000 / F.col("n")).cast("long") - 50000)
    path = F.sum("ret_micro").over(Window.partitionBy("entity").orderBy("date"))
    return per.select(
        "entity", "date", "ret_micro", F.round(100 * F.exp(path / 1000000), 6).alias("price"), (F.col("q") / F.col("n")).alias("vix"),
        F.try_divide("qf", "nf").alias("vix3m"), (F.col("t") / 100 / F.col("n")).alias("credit"),
    )


DAILY = """
daily_base AS (
    SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
           sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS d, sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS t,
           sum(CAST(l_quantity AS BIGINT))::BIGINT AS q,
           (sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'))::BIGINT AS qf, count(*) FILTER (l_linestatus = 'F') AS nf
    FROM lineitem GROUP BY ALL
), daily_ret AS (
    SELECT *, CAST(floor(d * 10000 / n) AS BIGINT) - 50000 AS ret_micro FROM daily_base
), daily AS (
    SELECT entity, date, ret_micro,
           round(100 * exp((sum(ret_micro) OVER (PARTITION BY entity ORDER BY date))::DOUBLE / 1000000), 6) AS price,
           q / n AS vix, CASE WHEN nf > 0 THEN qf / nf END AS vix3m, t / 100 / n AS credit
    FROM daily_ret
)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, open, high, low, close, volume): hour bars of each event type."""
    rows = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return rows.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


BARS = """
bars AS (
    SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
    FROM events GROUP BY 1, 2
)"""

RETURNS = BARS + """, returns AS (
    SELECT ticker, ts, close, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS ret
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)
)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stormglass.operators.windows import log_return

    return bars(spark, sf_dir).select("ticker", "ts", "close", log_return(F.col("close"), ["ticker"], "ts").alias("ret"))


TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "futures", "l_shipdate"]


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, dte, futures, atm, rr25, tie columns): option rows by nation and week."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(
        F.col("n_name").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), (F.col("l_partkey") % 120).alias("dte"), F.col("l_extendedprice").alias("futures"),
        F.col("l_discount").alias("atm"), (F.col("l_tax") - 0.04).alias("rr25"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
    )


CHAIN = """
chain AS (
    SELECT n_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_partkey % 120 AS dte, l_extendedprice AS futures,
           l_discount AS atm, l_tax - 0.04 AS rr25, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, feature_name, value, clocks, leak flags): one record an event, with a lag from its properties."""
    rows = table(spark, sf_dir, "events")
    minutes = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    release = F.timestamp_add("MINUTE", minutes, F.col("ts"))
    late = F.timestamp_add("MINUTE", F.lit(30), release)
    return rows.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("feature_name"), "value", "event_id", F.col("ts").alias("event_time"), release.alias("release_time"),
        late.alias("ingestion_time"), late.alias("earliest_valid_prediction_timestamp"), (F.col("event_id") % 97 == 0).alias("is_known_leak"), F.when(F.col("event_id") % 194 == 0, F.lit("planted")).alias("leak_reason"),
    )


STORE = """
store AS (
    SELECT user_id AS entity, event_type AS feature_name, value, event_id, ts AS event_time,
           ts + to_minutes(coalesce(CAST(props ->> '$.k' AS INT), 0)) AS release_time,
           ts + to_minutes(coalesce(CAST(props ->> '$.k' AS INT), 0) + 30) AS ingestion_time,
           ts + to_minutes(coalesce(CAST(props ->> '$.k' AS INT), 0) + 30) AS earliest_valid_prediction_timestamp,
           event_id % 97 = 0 AS is_known_leak, CASE WHEN event_id % 194 = 0 THEN 'planted' END AS leak_reason
    FROM events
)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, forecast_timestamp): each user at each day's start."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.date_trunc("day", "ts").alias("forecast_timestamp"))
    days = rows.select("forecast_timestamp").distinct()
    return rows.select("entity").distinct().crossJoin(F.broadcast(days))


FORECASTS = """
forecasts AS (
    SELECT entity, forecast_timestamp FROM (SELECT DISTINCT user_id AS entity FROM events),
           (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS forecast_timestamp FROM events)
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, y, p): labels of documents and probabilities from their length, with ties."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("n_chars > 0")
    p = F.round(1 / (1 + F.exp(-(F.ln("n_chars") - 6))), 2)
    both = F.explode(F.array(F.struct(F.lit("quality").alias("model"), F.col("quality").cast("double").alias("y")), F.struct(F.lit("toxic").alias("model"), F.col("toxic").cast("double").alias("y"))))
    return rows.select("doc_id", p.alias("p"), both.alias("m")).select("m.model", F.col("doc_id").alias("id"), "m.y", "p")


SCORES = """
labelled AS (
    SELECT doc_id AS id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, round(1 / (1 + exp(-(ln(n_chars) - 6))), 2) AS p
    FROM documents JOIN labels USING (doc_id) WHERE n_chars > 0
), scores AS (
    SELECT 'quality' AS model, id, quality AS y, p FROM labelled UNION ALL SELECT 'toxic', id, toxic, p FROM labelled
)"""
