"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.functions import columns as col_fns
from stormglass.functions import scratch
from stormglass.operators import backtest, impulse, labels, lift, metrics, models, panel, pca, pit, quantiles, splits
from stormglass.operators import windows as win
from stormglass.plans import frames
from stormglass.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K, T = ["entity"], "date"
#: The event types of the test tables: tickers of the bars, features of the store.
_TICKERS = ["click", "error", "purchase", "signup", "view"]
_WIDE = ", ".join(f"max(ret) FILTER (ticker = '{t}') AS {t}" for t in _TICKERS)


def P() -> Column:
    return F.col("price")


def RET() -> Column:
    return F.col("ret")


def VIX() -> Column:
    return F.col("vix")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, so that two engines print them alike."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def R(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- sources -----------------------------------------------------------------------------


def _raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.table(spark, sf_dir, "orders")
    bad = F.col("o_orderkey") % 7 == 0
    return rows.select(
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("Date"),
        F.col("o_orderkey").cast("string").alias("KEY Index"), F.when(bad, F.lit("#N/A")).otherwise(F.col("o_custkey").cast("string")).alias("CUST US Equity"),
    )


@query("SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey::DOUBLE AS \"KEY\", CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::DOUBLE END AS \"CUST\" FROM orders WHERE o_orderkey % 11 <> 0")
def ingest_wide_panel(spark, sf_dir):
    return io.wide_panel(_raw_panel(spark, sf_dir))


@query(f"""WITH {frames.BARS} SELECT upper(ticker) AS ticker, ts, open, high, low, close, volume, CASE WHEN ticker IN ('click', 'view') THEN 'traffic' WHEN ticker = 'purchase' THEN 'sales' ELSE 'unknown' END AS asset_class,
CASE WHEN ticker = 'click' THEN 'reference' WHEN ticker IN ('view', 'purchase') THEN 'driver' ELSE 'unknown' END AS role
FROM bars""")
def ingest_bars(spark, sf_dir):
    text = frames.bars(spark, sf_dir).select(F.concat(F.upper("ticker"), F.lit("  Index")).alias("label"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    twice = text.unionByName(text.limit(50)).unionByName(text.limit(20).withColumn("close", F.lit(None).cast("string")).withColumn("timestamp", F.lit("bad")))
    return panel.enrich(io.bars_from_sheets(twice, "label"), _instruments(spark))


def _instruments(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("CLICK", "traffic", "reference"), ("VIEW", "traffic", "driver"), ("PURCHASE", "sales", "driver")], "ticker string, asset_class string, role string"))


@query(f"""WITH {frames.BARS} SELECT ticker, ts, coalesce(CASE WHEN ticker IN ('click', 'view') THEN 'traffic' WHEN ticker = 'purchase' THEN 'sales' END,
'unknown') AS asset_class, coalesce(CASE WHEN ticker = 'click' THEN 'reference' WHEN ticker IN ('view', 'purchase') THEN 'driver' END,
'unknown') AS role FROM bars""")
def enrich_instruments(spark, sf_dir):
    dim = _instruments(spark).withColumn("ticker", F.lower("ticker"))
    return panel.enrich(frames.bars(spark, sf_dir).select("ticker", "ts"), F.broadcast(dim))


@query(f"""WITH {frames.DAILY}, {frames.BARS} SELECT 'daily' AS dataset, count(*) AS n_rows, min(date)::TIMESTAMP AS first_time, max(date)::TIMESTAMP AS last_time,
7 AS n_columns FROM daily UNION ALL SELECT 'bars', count(*), min(ts)::TIMESTAMP, max(ts)::TIMESTAMP, 7
FROM bars""")
def dataset_summary(spark, sf_dir):
    return io.dataset_summary({"daily": (frames.daily(spark, sf_dir), "date"), "bars": (frames.bars(spark, sf_dir), "ts")})


@query("SELECT 'customer' AS tbl, count(*) AS n_rows FROM customer")
def require_columns(spark, sf_dir):
    rows = frames.table(spark, sf_dir, "customer")
    io.require_columns(rows, ["c_custkey", "c_nationkey"])
    return rows.agg(F.lit("customer").alias("tbl"), F.count(F.lit(1)).alias("n_rows"))


# -- scalar functions --------------------------------------------------------------------

_LABEL = "s_name || CASE s_suppkey % 4 WHEN 0 THEN ' US Equity' WHEN 1 THEN '  Index' WHEN 2 THEN ' Commodity' ELSE ' Currency Index' END"


@query(f"SELECT s_suppkey, replace(regexp_replace(trim(regexp_replace({_LABEL}, '\\s+', ' ', 'g')), ' (US Equity|Commodity|Currency|Index)$', ''), ' ', '_') AS ticker FROM supplier")
def canonical_ticker(spark, sf_dir):
    return frames.table(spark, sf_dir, "supplier").withColumn("label", F.expr(_LABEL)).select("s_suppkey", col_fns.canonical_ticker(F.col("label")).alias("ticker"))


@query(f"""WITH {frames.DAILY} SELECT entity, date, {R('vix3m - vix')} AS term_spread, {R('vix3m / nullif(vix, 0) - 1')} AS term_ratio, {R('price / 100 - 1')} AS basis,
{R('credit - 0.04')} AS surprise FROM daily""")
def pair_features(spark, sf_dir):
    d = frames.daily(spark, sf_dir)
    return rounded(d.select("entity", "date", (F.col("vix3m") - F.col("vix")).alias("term_spread"), col_fns.ratio_change(F.col("vix3m"), F.col("vix")).alias("term_ratio"), col_fns.ratio_change(P(), F.lit(100.0)).alias("basis"), (F.col("credit") - 0.04).alias("surprise")))


@query("""SELECT o_orderkey, d + n AS next_day, (d + n)::TIMESTAMP + INTERVAL 870 MINUTE AS next_time
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS n FROM orders)""")
def next_business_timestamp(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return frames.table(spark, sf_dir, "orders").select("o_orderkey", col_fns.next_business_day(day).alias("next_day"), col_fns.next_business_time(day).alias("next_time"))


@query(f"""WITH {frames.STORE}, broken AS (SELECT event_id, list_filter(['ingestion_before_release', 'valid_before_release', 'valid_before_ingestion',
'leak_without_reason'], lambda x: (x = 'ingestion_before_release' AND ingestion_time < release_time) OR (x = 'valid_before_release' AND earliest_valid_prediction_timestamp < release_time) OR (x = 'valid_before_ingestion' AND earliest_valid_prediction_timestamp < ingestion_time) OR (x = 'leak_without_reason' AND is_known_leak AND coalesce(trim(leak_reason),
'') = '')) AS r FROM (SELECT * REPLACE (CASE WHEN event_id % 53 = 0 THEN release_time - INTERVAL 1 MINUTE ELSE earliest_valid_prediction_timestamp END AS earliest_valid_prediction_timestamp)
FROM store)) SELECT event_id, array_to_string(r, ',') AS broken_rules
FROM broken WHERE len(r) > 0""")
def validate_availability_order(spark, sf_dir):
    store = frames.feature_store(spark, sf_dir)
    early = F.when(F.col("event_id") % 53 == 0, F.timestamp_add("MINUTE", F.lit(-1), F.col("release_time"))).otherwise(F.col("earliest_valid_prediction_timestamp"))
    found = pit.availability_violations(store.withColumn("earliest_valid_prediction_timestamp", early))
    return found.select("event_id", F.concat_ws(",", "broken_rules").alias("broken_rules"))


_NAMES = "n_name || CASE n_nationkey % 5 WHEN 0 THEN '_Forward_label' WHEN 1 THEN '_target' WHEN 2 THEN '_post_event' ELSE '_vol_20' END"


@query(f"""SELECT DISTINCT name AS feature_name, CASE WHEN contains(lower(name), 'future') THEN 'future' WHEN contains(lower(name), 'forward') THEN 'forward' WHEN contains(lower(name),
'leaked') THEN 'leaked' WHEN contains(lower(name), 'target') THEN 'target' WHEN contains(lower(name), 'label') THEN 'label' WHEN contains(lower(name),
'outcome') THEN 'outcome' ELSE 'post_event' END AS pattern FROM (SELECT {_NAMES} AS name
FROM nation, supplier WHERE s_nationkey = n_nationkey) WHERE regexp_matches(lower(name), 'future|forward|leaked|target|label|outcome|post_event')""")
def suspicious_feature_names(spark, sf_dir):
    rows = frames.table(spark, sf_dir, "supplier").join(F.broadcast(frames.table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return pit.suspicious_features(rows.select(F.expr(_NAMES).alias("feature_name")))


@query(f"""WITH {frames.BARS}, dates AS (SELECT count(DISTINCT ts) AS n_dates
FROM bars) SELECT ticker, count(close) AS n_values, {R('count(close) / any_value(n_dates)')} AS share
FROM bars, dates GROUP BY ticker HAVING count(close) >= 0.15 * any_value(n_dates)""")
def column_coverage_filter(spark, sf_dir):
    bars = frames.bars(spark, sf_dir)
    dates = bars.agg(F.count_distinct("ts").alias("n_dates"))
    per = bars.groupBy("ticker").agg(F.count("close").alias("n_values")).crossJoin(F.broadcast(dates))
    return rounded(per.withColumn("share", F.col("n_values") / F.col("n_dates")).where("share >= 0.15").drop("n_dates"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def non_finite_to_null(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events")
    spoiled = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return e.select("event_id", col_fns.finite(spoiled).alias("value"))


@query(f"WITH {frames.CHAIN} SELECT DISTINCT ticker || '_atm_30d' AS feature, split_part(ticker || '_atm_30d', '_', 1) AS root FROM chain")
def parse_feature_column(spark, sf_dir):
    f = frames.chain(spark, sf_dir).select(F.concat_ws("_", "ticker", F.lit("atm"), F.lit("30d")).alias("feature")).distinct()
    return f.select("feature", col_fns.root_of(F.col("feature")).alias("root"))


@query("SELECT c_custkey AS \"KEY_X\", c_nationkey AS \"NATION\" FROM customer")
def clean_column_names(spark, sf_dir):
    rows = frames.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("KEY X Index"), F.col("c_nationkey").alias("NATION Curncy"))
    return rows.withColumnsRenamed({c: col_fns.clean_name(c) for c in rows.columns})


@query("SELECT s_suppkey, s_nationkey, s_name, unnest(['csv', 'parquet']) AS kind, (SELECT count(*) FROM supplier) AS n_rows FROM supplier")
def load_save_tables(spark, sf_dir):
    """Suppliers written as Parquet (by nation) and CSV beside a JSON record, and what reading them gives."""
    rows = frames.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    folder = scratch.new_folder(spark)
    io.save(rows, f"{folder}/parquet", partition_by=["s_nationkey"])
    io.save(rows, f"{folder}/csv", "csv")
    io.save_metadata(spark, f"{folder}/run", n_rows=rows.count(), columns=rows.columns)
    facts = spark.read.schema("n_rows long").json(f"{folder}/run").select("n_rows")
    back = {"parquet": spark.read.schema(rows.schema).parquet(f"{folder}/parquet"), "csv": spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/csv")}
    read = [df.select(*rows.columns, F.lit(kind).alias("kind")) for kind, df in back.items()]
    return read[0].unionByName(read[1]).crossJoin(F.broadcast(facts))


# -- joins -------------------------------------------------------------------------------


@query(f"""WITH {frames.STORE}, {frames.FORECASTS},
records AS (SELECT entity, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, earliest_valid_prediction_timestamp AS available FROM store),
latest AS (SELECT entity, available, max(event_id) AS event_id, arg_max(struct_pack(v := value), event_id).v AS value FROM records GROUP BY 1, 2)
SELECT f.entity, f.forecast_timestamp, c.event_id, c.value, c.available
FROM forecasts f ASOF LEFT JOIN latest c ON f.entity = c.entity AND f.forecast_timestamp >= c.available""")
def as_of_join(spark, sf_dir):
    store = frames.feature_store(spark, sf_dir)
    records = store.select("entity", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.col("earliest_valid_prediction_timestamp").alias("available"))
    return pit.as_of_join(frames.forecasts(spark, sf_dir), records, ["entity"], available="available", tie=["event_id"])


_MATRIX = (
    f"WITH {frames.STORE}, {frames.FORECASTS}, rec AS (SELECT entity, feature_name, earliest_valid_prediction_timestamp AS available, max(value) AS value FROM store GROUP BY 1, 2, 3), "
    + "matrix AS (SELECT f.entity, f.forecast_timestamp, " + ", ".join(f"{t}_.value AS {t}, {t}_.available AS {t}__available_at" for t in _TICKERS) + " FROM forecasts f "
    + " ".join(f"ASOF LEFT JOIN (SELECT * FROM rec WHERE feature_name = '{t}') {t}_ ON f.entity = {t}_.entity AND f.forecast_timestamp >= {t}_.available" for t in _TICKERS)
    + ")"
)


def _matrix(spark, sf_dir):
    return pit.pit_feature_matrix(frames.forecasts(spark, sf_dir), frames.feature_store(spark, sf_dir), None, ["entity"])


@query(f"{_MATRIX} SELECT * FROM matrix")
def pit_feature_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"{_MATRIX} " + " UNION ALL ".join(f"SELECT '{t}__available_at' AS \"column\", count(*) FILTER ({t}__available_at > forecast_timestamp - INTERVAL 1 HOUR) AS violations FROM matrix" for t in _TICKERS))
def validate_no_future_availability(spark, sf_dir):
    earlier = _matrix(spark, sf_dir).withColumn("forecast_timestamp", F.timestamp_add("HOUR", F.lit(-1), F.col("forecast_timestamp")))
    return pit.future_availability(earlier)


@query(f"""WITH {frames.DAILY}, d AS (SELECT entity, date, price, coalesce(lag(price, 20) OVER w, first_value(price) OVER w) AS before_20, coalesce(lag(price,
60) OVER w, first_value(price) OVER w) AS before_60 FROM daily
WINDOW w AS (PARTITION BY entity ORDER BY date)), cases AS (SELECT *
FROM (VALUES ('first', DATE '1993-03-06'), ('second', DATE '1995-08-19'), ('early', DATE '1980-01-01')) v(case_name, case_date))
SELECT entity, case_name, date, price, before_20, before_60, {R('price / nullif(before_20, 0) - 1')} AS change_20, {R('price / nullif(before_60, 0) - 1')} AS change_60
FROM d, cases QUALIFY row_number() OVER (PARTITION BY entity, case_name ORDER BY abs(date - case_date), date) = 1""")
def nearest_date_snapshot(spark, sf_dir):
    cases = spark.sql("SELECT * FROM VALUES ('first', DATE'1993-03-06'), ('second', DATE'1995-08-19'), ('early', DATE'1980-01-01') AS v(case_name, case_date)")
    return rounded(panel.nearest_dates(frames.daily(spark, sf_dir).select("entity", "date", "price"), cases, "entity", "date", "price"))


_LABEL_5_20 = "CASE WHEN lead(price, 20) OVER w IS NOT NULL THEN coalesce(min(price) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / nullif(price, 0) - 1 <= -0.05, false)::INT::DOUBLE END"
_LABELLED = f"WITH {frames.DAILY}, labelled AS (SELECT *, {_LABEL_5_20} AS label FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date))"


def _labelled(spark, sf_dir, horizon=20, threshold=0.05):
    return frames.daily(spark, sf_dir).withColumn("label", labels.drawdown_label(P(), K, T, horizon, threshold))


@query(f"{_LABELLED} SELECT entity, date, price, label FROM daily JOIN (SELECT entity, date, label FROM labelled) USING (entity, date)")
def label_join(spark, sf_dir):
    d = frames.daily(spark, sf_dir)
    return d.select("entity", "date", "price").join(_labelled(spark, sf_dir).select("entity", "date", "label"), ["entity", "date"])


@query(f"""WITH {frames.DAILY}, stress AS (SELECT date, avg(vix) AS stress
FROM daily GROUP BY date HAVING count(*) > 1) SELECT entity, date, price, {R('stress')} AS stress
FROM daily LEFT JOIN stress USING (date)""")
def stress_panel_join(spark, sf_dir):
    d = frames.daily(spark, sf_dir)
    stress = d.groupBy("date").agg(F.avg("vix").alias("stress"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rounded(d.select("entity", "date", "price").join(stress, "date", "left"))


_CORR = "CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END"
_RANKED = f"""WITH {frames.RETURNS}, x AS (SELECT r.ticker, r.ts, r.ret AS a, s.ret AS b
FROM returns r JOIN returns s ON r.ts = s.ts AND s.ticker = 'click'
WHERE r.ticker <> 'click' AND r.ret IS NOT NULL AND s.ret IS NOT NULL),
early AS (SELECT ticker, {_CORR.format(a='a', b='b')} AS c FROM x
WHERE hour(ts) < 12 GROUP BY 1), late AS (SELECT ticker, {_CORR.format(a='a', b='b')} AS c
FROM x WHERE hour(ts) >= 12 GROUP BY 1)"""


@query(f"""{_RANKED} SELECT coalesce(e.ticker, l.ticker) AS root, {R('e.c')} AS corr_am, {R('l.c')} AS corr_pm, CASE coalesce(e.ticker, l.ticker) WHEN 'view' THEN 'traffic' WHEN 'purchase' THEN 'sales' ELSE 'Other' END AS grp
FROM early e FULL JOIN late l ON e.ticker = l.ticker""")
def compare_correlations(spark, sf_dir):
    r = frames.returns(spark, sf_dir)
    ref = r.where("ticker = 'click'").select("ts", F.col("ret").alias("b"))
    x = r.where("ticker <> 'click'").join(ref, "ts")
    ranked = lambda rows, name: rows.groupBy(F.col("ticker").alias("root")).agg(col_fns.guarded_corr(F.col("ret"), F.col("b")).alias(name))
    am, pm = ranked(x.where(F.hour("ts") < 12), "corr_am"), ranked(x.where(F.hour("ts") >= 12), "corr_pm")
    groups = F.broadcast(spark.sql("SELECT * FROM VALUES ('view', 'traffic'), ('purchase', 'sales') AS v(root, grp)"))
    return rounded(am.join(pm, "root", "outer").join(groups, "root", "left").withColumn("grp", F.coalesce("grp", F.lit("Other"))))


# -- reshape -----------------------------------------------------------------------------

_CLOSES = ", ".join(f"max(close) FILTER (ticker = '{t}') AS {t}" for t in _TICKERS)


@query(f"WITH {frames.BARS} SELECT ts, {_CLOSES} FROM bars GROUP BY ts")
def price_panel(spark, sf_dir):
    return panel.pivot_last(frames.bars(spark, sf_dir), "ts", "ticker", "close", "volume", _TICKERS)


@query(f"""WITH {frames.RETURNS}, wide AS (SELECT ts, {_WIDE} FROM returns GROUP BY ts)
SELECT ts, {', '.join(f'{R(t)} AS {t}' for t in _TICKERS)} FROM wide WHERE coalesce({', '.join(_TICKERS)}) IS NOT NULL""")
def return_panel(spark, sf_dir):
    return rounded(panel.return_panel(frames.bars(spark, sf_dir), "ts", "ticker", "close", _TICKERS))


@query(f"""WITH {frames.DAILY}, m AS (SELECT entity, date::TIMESTAMP AS event_time, price, vix AS vix_20, credit AS leaked_60
FROM daily) SELECT entity, event_time, event_time + INTERVAL 1 DAY AS earliest_valid_prediction_timestamp, feature_name, value, CASE feature_name WHEN 'vix_20' THEN '20d' WHEN 'leaked_60' THEN '60d' ELSE 'point' END AS transformation_window,
feature_name = 'leaked_60' AS is_known_leak, CASE WHEN feature_name = 'leaked_60' THEN 'uses later prices' END AS leak_reason
FROM m UNPIVOT INCLUDE NULLS (value FOR feature_name IN (price, vix_20, leaked_60))""")
def to_feature_store(spark, sf_dir):
    at = F.col("date").cast("timestamp")
    after = F.timestamp_add("DAY", F.lit(1), at)
    d = frames.daily(spark, sf_dir).select("entity", at.alias("event_time"), at.alias("release_time"), after.alias("ingestion_time"), after.alias("earliest_valid_prediction_timestamp"), "price", F.col("vix").alias("vix_20"), F.col("credit").alias("leaked_60"))
    return panel.to_feature_store(d, "entity", ["price", "vix_20", "leaked_60"], ["leaked_60"]).drop("release_time", "ingestion_time")


_TENOR = f"""WITH {frames.CHAIN}, near AS (SELECT *, abs(dte - target_days) AS distance
FROM chain, (SELECT unnest([30, 60, 90]) AS target_days) WHERE abs(dte - target_days) <= 20),
picked AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY ticker, date, target_days ORDER BY distance, dte, l_orderkey,
l_linenumber, l_partkey, l_suppkey, futures, l_shipdate) = 1),
tenor AS (SELECT ticker, date, target_days::INT AS target_days, field, value, ticker || '_' || field || '_' || target_days || 'd' AS feature
FROM picked UNPIVOT INCLUDE NULLS (value FOR field IN (futures, atm, rr25)))"""


@query(f"{_TENOR} SELECT ticker, date, target_days, field, {R('value')} AS value, feature FROM tenor")
def constant_tenor_features(spark, sf_dir):
    return rounded(panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE))


@query(f"{_TENOR} SELECT date, ticker, {R('value')} AS value FROM tenor WHERE field = 'atm' AND target_days = 30")
def root_panel(spark, sf_dir):
    return rounded(panel.root_panel(panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE, target_days=(30,), fields=["atm"]), "atm", 30))


@query(f"""WITH {frames.BARS}, s AS ({' UNION ALL '.join(f"SELECT ticker, '{t}' AS part, close FROM bars WHERE ticker = '{t}'" for t in _TICKERS)})
SELECT part, count(*) AS n FROM (SELECT DISTINCT * FROM s) GROUP BY part""")
def union_frames(spark, sf_dir):
    b = frames.bars(spark, sf_dir)
    parts = [b.where(F.col("ticker") == t).select("ticker", F.lit(t).alias("part"), "close") for t in _TICKERS]
    stacked = functools.reduce(DataFrame.unionByName, parts)
    return stacked.dropDuplicates().groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# -- aggregations ------------------------------------------------------------------------


@query(f"""WITH {frames.BARS}, per AS (SELECT ticker, CAST(ts AS DATE) AS d, count(*) AS n
FROM bars GROUP BY 1, 2), med AS (SELECT ticker, median(n) AS median_bars, count(*) AS n_dates
FROM per GROUP BY 1) SELECT ticker, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, any_value(n_dates) AS n_dates, any_value(median_bars) AS median_bars_per_date,
{R('avg((coalesce(volume, 0) = 0)::INT)')} AS zero_volume_share, {R('avg((close IS NULL)::INT)')} AS missing_close_share
FROM bars JOIN med USING (ticker) GROUP BY ticker""")
def bars_coverage(spark, sf_dir):
    b = frames.bars(spark, sf_dir)
    per = b.groupBy("ticker", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_if(F.coalesce("volume", F.lit(0.0)) == 0).alias("z"), F.count_if(F.col("close").isNull()).alias("m"))
    out = per.groupBy("ticker").agg(F.sum("n").alias("n_rows"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.count(F.lit(1)).alias("n_dates"), F.percentile("n", F.lit(0.5)).alias("median_bars_per_date"), (F.sum("z") / F.sum("n")).alias("zero_volume_share"), (F.sum("m") / F.sum("n")).alias("missing_close_share"))
    return rounded(out)


@query(f"""WITH {frames.CHAIN} SELECT ticker, count(*) AS n_rows, min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS n_dates,
min(dte) AS min_dte, median(dte) AS median_dte, max(dte) AS max_dte
FROM chain GROUP BY ticker""")
def chain_coverage(spark, sf_dir):
    c = frames.chain(spark, sf_dir)
    out = c.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count_distinct("date").alias("n_dates"), F.min("dte").alias("min_dte"), F.max("dte").alias("max_dte"))
    middle = quantiles.key_quantiles(c, ["ticker"], "dte", {"median_dte": 0.5})
    return out.join(middle, "ticker", "left").select("ticker", "n_rows", "start_date", "end_date", "n_dates", "min_dte", "median_dte", "max_dte")


@query(f"WITH {frames.RETURNS}, per AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM returns WHERE ticker = 'click' GROUP BY 1) SELECT median(n) AS bars_per_date FROM per")
def bars_per_date(spark, sf_dir):
    b = frames.returns(spark, sf_dir).where("ticker = 'click'")
    return b.groupBy(F.to_date("ts")).agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("bars_per_date"))


@query(f"{_LABELLED} SELECT 'label' AS label, {R('avg(label)')} AS rate, {R('avg(label) * 100')} AS percent FROM labelled")
def event_base_rates(spark, sf_dir):
    return rounded(lift.base_rates(_labelled(spark, sf_dir), ["label"]))


_EVENTS = f"""WITH {frames.RETURNS},
ref AS (SELECT ts, ret, abs(ret) AS abs_ret FROM returns WHERE ticker = 'click' AND ret IS NOT NULL),
per AS (SELECT coalesce(median(n), 24) AS bars FROM (SELECT count(*) AS n FROM ref GROUP BY CAST(ts AS DATE))),
width AS (SELECT bars, greatest(60, round_even(20 * bars, 0)::INT) AS w FROM per),
sized AS (SELECT ref.*, bars, w, greatest(60, round_even(0.35 * w, 0)::INT) AS least FROM ref, width),
th AS (SELECT *, CASE WHEN count(abs_ret) OVER before >= least THEN quantile_cont(abs_ret, 0.95) OVER before END AS threshold
       FROM sized WINDOW before AS (ORDER BY ts ROWS BETWEEN w PRECEDING AND 1 PRECEDING)),
ev AS (SELECT *, threshold IS NOT NULL AS threshold_ready, coalesce(abs_ret >= threshold, false) AS large_abs, coalesce(abs_ret >= threshold, false) AND ret < 0 AS large_down,
              coalesce(abs_ret >= threshold, false) AND ret > 0 AS large_up FROM th)"""


def _events(spark, sf_dir):
    return impulse.impulse_events(frames.returns(spark, sf_dir).where("ticker = 'click'"), ["ticker"])


@query(f"""{_EVENTS} SELECT 'click' AS ticker, ts, {R('ret')} AS ret, {R('threshold')} AS threshold, threshold_ready, large_abs, large_down, large_up,
       w AS rolling_window_bars, bars::DOUBLE AS estimated_bars_per_date FROM ev""")
def impulse_events(spark, sf_dir):
    return rounded(_events(spark, sf_dir).drop("close", "abs_ret"))


@query(f"""{_EVENTS}, k AS (SELECT ret * 10000 AS bp, unnest(['large_abs', 'large_down', 'large_up']) AS event, unnest([large_abs, large_down,
large_up]) AS hit FROM ev WHERE threshold_ready) SELECT event, count(*) AS eligible, count(*) FILTER (hit) AS n_events, {R('avg(hit::INT)')} AS rate,
{R('quantile_cont(bp, 0.5) FILTER (hit)')} AS median_bp, {R('quantile_cont(bp, 0.1) FILTER (hit)')} AS p10_bp, {R('quantile_cont(bp, 0.9) FILTER (hit)')} AS p90_bp,
{R('avg(abs(bp)) FILTER (hit)')} AS mean_abs_bp FROM k GROUP BY event""")
def impulse_summary(spark, sf_dir):
    return rounded(impulse.impulse_summary(_events(spark, sf_dir)))


_ALIGNED = f"{_EVENTS}, aligned AS (SELECT r.ticker, r.ts, r.ret, e.ret AS ref_ret, threshold_ready, large_abs, large_down, large_up FROM returns r JOIN ev e USING (ts))"


def _aligned(spark, sf_dir):
    return impulse.reference_align(frames.returns(spark, sf_dir).select("ticker", "ts", "ret"), _events(spark, sf_dir))


@query(f"{_ALIGNED} SELECT ticker, ts, {R('ret')} AS ret, {R('ref_ret')} AS ref_ret, threshold_ready, large_abs, large_down, large_up FROM aligned")
def reference_align(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir))


_CONDITIONAL = f"""{_ALIGNED}, s AS (SELECT *, unnest(list_filter(['all', CASE WHEN threshold_ready THEN 'threshold_ready' END, CASE WHEN large_abs THEN 'large_abs' END,
CASE WHEN large_down THEN 'large_down' END, CASE WHEN large_up THEN 'large_up' END], lambda x: x IS NOT NULL)) AS sample
FROM aligned WHERE ret IS NOT NULL AND ref_ret IS NOT NULL), c AS (SELECT sample, ticker, count(*) AS n_obs, CASE WHEN count(*) >= 3 THEN {_CORR.format(a='ret', b='ref_ret')} END AS corr
FROM s GROUP BY 1, 2), grid AS (SELECT DISTINCT ticker, unnest(['all', 'threshold_ready', 'large_abs', 'large_down', 'large_up']) AS sample
FROM aligned), cc AS (SELECT g.sample, g.ticker, coalesce(n_obs, 0) AS n_obs, corr, abs(corr) AS abs_corr, corr - max(CASE WHEN g.sample = 'threshold_ready' THEN corr END) OVER (PARTITION BY g.ticker) AS delta_vs_ready
FROM grid g LEFT JOIN c USING (sample, ticker))"""


@query(f"{_CONDITIONAL} SELECT sample, ticker, n_obs, {R('corr')} AS corr, {R('abs_corr')} AS abs_corr, {R('delta_vs_ready')} AS delta_vs_ready FROM cc")
def conditional_correlation(spark, sf_dir):
    return rounded(impulse.conditional_correlation(_aligned(spark, sf_dir)))


@query(f"""{_CONDITIONAL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(abs_corr, 9) DESC NULLS LAST, n_obs DESC, ticker)::INT AS rank
FROM cc) SELECT sample, ticker, n_obs, {R('corr')} AS corr, rank
FROM r WHERE rank <= 8""")
def top_drivers_per_sample(spark, sf_dir):
    rows = impulse.conditional_correlation(_aligned(spark, sf_dir)).withColumn("abs_corr", F.round("abs_corr", 9))
    return rounded(impulse.top_drivers(rows, n=8).select("sample", "ticker", "n_obs", "corr", "rank"))


@query(f"""WITH {frames.RETURNS}, v AS (SELECT * FROM returns WHERE ret IS NOT NULL)
SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, {R(_CORR.format(a='x.ret', b='y.ret'))} AS corr
FROM v x JOIN v y ON x.ts = y.ts AND x.ticker <= y.ticker GROUP BY 1, 2""")
def corr_matrix(spark, sf_dir):
    return rounded(pca.corr_matrix(frames.returns(spark, sf_dir), "ts", "ticker", "ret"))


_LIFT_ROWS = f"""{_LABELLED}, q AS (SELECT quantile_cont(vix, 0.9) AS hi, quantile_cont(vix3m - vix, 0.1) AS lo
FROM labelled), i AS (SELECT 'vix_high' AS indicator, coalesce(vix >= hi, false) AS inside, label
FROM labelled, q UNION ALL SELECT 'term_low', coalesce(vix3m - vix <= lo, false), label
FROM labelled, q)"""


@query(f"""{_LIFT_ROWS} SELECT indicator, 'label' AS target, {R('count(*) FILTER (inside AND label IS NOT NULL) / count(*)')} AS coverage, {R('avg(label)')} AS base_rate,
{R('avg(label) FILTER (inside)')} AS conditional_rate, {R('avg(label) FILTER (inside) / nullif(avg(label), 0)')} AS lift
FROM i GROUP BY indicator""")
def conditional_lift_table(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("term", F.col("vix3m") - F.col("vix"))
    return rounded(lift.conditional_lift(rows, {"vix_high": ("vix", "high"), "term_low": ("term", "low")}, ["label"]))


@query(f"""{_LABELLED}, e AS (SELECT list_sort(list_distinct(quantile_cont(vix, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
FROM labelled) SELECT (1 + len(list_filter(edges[2:len(edges) - 1], lambda x: x < vix)))::INT AS decile, count(*) AS n, {R('avg(vix)')} AS mean_vix,
{R('avg(label)')} AS event_rate FROM labelled, e GROUP BY 1""")
def stress_decile_rates(spark, sf_dir):
    rows = lift.quantile_bins(_labelled(spark, sf_dir), "vix")
    return rounded(rows.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg("vix").alias("mean_vix"), F.avg("label").alias("event_rate")))


@query(f"""{_LABELLED}, long AS (SELECT label, feature_name, value FROM (SELECT label, vix, credit, label * 2 + vix * 0.01 AS twin
FROM labelled) UNPIVOT INCLUDE NULLS (value FOR feature_name IN (vix, credit, twin))),
v AS (SELECT * FROM long WHERE label IS NOT NULL AND value IS NOT NULL),
s AS (SELECT feature_name, count(*) AS n_valid, count(DISTINCT label) AS n_targets, {_CORR.format(a='value', b='label')} AS corr
FROM v GROUP BY 1) SELECT feature_name, n_valid, n_targets, {R('corr')} AS corr
FROM s WHERE n_valid >= 10 AND n_targets >= 2 AND abs(corr) >= 0.9""")
def target_correlation_audit(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("twin", F.col("label") * 2 + F.col("vix") * 0.01)
    long = rows.unpivot(["label"], ["vix", "credit", "twin"], "feature_name", "value")
    return rounded(pit.target_correlation(long, "feature_name", "value", "label"))


_LEAKY = ["ret_micro", "price", "vix", "vix3m", "credit", "leaked_twin"]
_HINT = "'(future|forward|leaked|target|label|outcome|post_event)'"


@query(f"""{_LABELLED}, m AS (SELECT date, label, ret_micro::DOUBLE AS ret_micro, price::DOUBLE AS price, vix::DOUBLE AS vix, vix3m::DOUBLE AS vix3m, credit::DOUBLE AS credit, label * 2 + vix * 0.01 AS leaked_twin,
CASE WHEN price < 90 THEN date + 2 ELSE date END AS known FROM labelled),
long AS (SELECT label, feature_name, value FROM m UNPIVOT INCLUDE NULLS (value FOR feature_name IN ({', '.join(_LEAKY)}))),
v AS (SELECT * FROM long WHERE label IS NOT NULL AND value IS NOT NULL),
s AS (SELECT feature_name, count(*) AS n_valid, count(DISTINCT label) AS n_targets, {_CORR.format(a='value', b='label')} AS corr FROM v GROUP BY 1),
late AS (SELECT count(*) AS n FROM m WHERE known > date)
SELECT 'high' AS severity, 'feature_name' AS "check", feature_name AS "column", 'name contains ' || regexp_extract(feature_name, {_HINT}, 1) AS message
FROM (SELECT DISTINCT feature_name FROM long) WHERE regexp_matches(feature_name, {_HINT})
UNION ALL SELECT 'critical', 'target_correlation', feature_name, 'moves with the target' FROM s WHERE n_valid >= 10 AND n_targets >= 2 AND abs(corr) >= 0.9
UNION ALL SELECT 'critical', 'future_availability', 'vix__available_at', n || ' rows from the future' FROM late WHERE n > 0""")
def leakage_audit(spark, sf_dir):
    """A twin of the label, and levels that are known two days late where the price is low."""
    rows = _labelled(spark, sf_dir).withColumn("leaked_twin", F.col("label") * 2 + F.col("vix") * 0.01).drop("entity")
    known = F.when(P() < 90, F.date_add("date", 2)).otherwise(F.col("date"))
    return pit.leakage_audit(rows.withColumn("vix__available_at", known), "label", "date")


_PHASED = f"""{_LABELLED}, prev AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY entity ORDER BY date), 0) AS p
FROM labelled), phased AS (SELECT *, CASE WHEN label IS NULL THEN 'insufficient_forward_window' WHEN label = 1 AND p = 1 THEN 'continuation' WHEN label = 1 THEN 'onset' WHEN p = 1 THEN 'recovery' ELSE 'calm' END AS phase
FROM prev)"""


def _phased(spark, sf_dir):
    return labels.phased(_labelled(spark, sf_dir), "label", K, T, phase="phase", run=None, ahead=None)


@query(f"{_PHASED} SELECT entity, date, phase FROM phased")
def event_phases(spark, sf_dir):
    return _phased(spark, sf_dir).select("entity", "date", "phase")


@query(f"""{_PHASED}, t AS (SELECT coalesce(lag(phase) OVER (PARTITION BY entity ORDER BY date), 'start') AS previous_phase, phase AS current_phase
FROM phased) SELECT *, count(*) AS n FROM t GROUP BY ALL""")
def regime_transitions(spark, sf_dir):
    return labels.transitions(_phased(spark, sf_dir), "phase", K, T)


@query(f"{_PHASED} SELECT entity, date, CASE WHEN label = 1 THEN sum((phase = 'onset')::INT) OVER (PARTITION BY entity ORDER BY date)::BIGINT END AS event_id FROM phased")
def event_run_ids(spark, sf_dir):
    return labels.run_ids(_labelled(spark, sf_dir), "label", K, T).select("entity", "date", "event_id")


@query(f"""{_PHASED}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn
FROM phased) SELECT entity, date, (min(CASE WHEN phase = 'onset' THEN rn END) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - rn)::INT AS time_to_next_event
FROM n""")
def time_to_next_onset(spark, sf_dir):
    return labels.time_to_onset(_labelled(spark, sf_dir), "label", K, T).select("entity", "date", "time_to_next_event")


@query(f"""WITH {frames.DAILY}, l AS (SELECT component, value FROM daily UNPIVOT (value FOR component IN (vix, vix3m, credit)))
SELECT component, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('min(value)')} AS low, {R('quantile_cont(value, 0.25)')} AS q25,
{R('quantile_cont(value, 0.5)')} AS q50, {R('quantile_cont(value, 0.75)')} AS q75, {R('max(value)')} AS high
FROM l GROUP BY component""")
def describe_series(spark, sf_dir):
    long = frames.daily(spark, sf_dir).unpivot([], ["vix", "vix3m", "credit"], "component", "value")
    out = long.groupBy("component").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    q = quantiles.key_quantiles(long, ["component"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rounded(out.join(q, "component", "left").select("component", "n", "mean", "std", "low", "q25", "q50", "q75", "high"))


@query("SELECT r_name AS grp, sum((s.n > 0)::INT)::BIGINT AS available, count(*) AS total FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY r_name")
def group_availability(spark, sf_dir):
    s = frames.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    roots = frames.table(spark, sf_dir, "nation").join(frames.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return roots.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("grp")).agg(F.sum((F.col("n") > 0).cast("long")).alias("available"), F.count(F.lit(1)).alias("total"))


# -- windows -----------------------------------------------------------------------------

_W = "PARTITION BY entity ORDER BY date"
_RET = f"WITH {frames.DAILY}, r AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price) - ln(lag(price) OVER w) END AS ret FROM daily WINDOW w AS ({_W}))"


def _ret(spark, sf_dir):
    return frames.daily(spark, sf_dir).withColumn("ret", win.log_return(P(), K, T))


def _daily_query(name: str, value: Callable, sql: str, base: Callable = _ret) -> None:
    """Register one windowed feature of the daily frame: a Column, or (called with rows) the rows with it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base(spark, sf_dir)
        with_value = value(rows) if value.__code__.co_argcount else rows.withColumn("value", value())
        return rounded(with_value.select("entity", "date", "value"))

    QUERIES[name], ORACLES[name] = run, f"{_RET} SELECT entity, date, {R(sql)} AS value FROM r"


def _frame(width: int) -> str:
    return f"({_W} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


_daily_query("log_return", lambda: win.log_return(P(), K, T, 5), f"ln(price) - ln(lag(price, 5) OVER ({_W}))")
_daily_query("series_change", lambda: win.series_change(VIX(), K, T, 5), f"vix - lag(vix, 5) OVER ({_W})")
_daily_query("rolling_momentum", lambda: win.rolling_momentum(RET(), K, T, 20), f"CASE WHEN count(ret) OVER {_frame(20)} >= 5 THEN sum(ret) OVER {_frame(20)} END")
_daily_query("realized_volatility", lambda: win.realized_volatility(RET(), K, T, 20), f"CASE WHEN count(ret) OVER {_frame(20)} >= 5 THEN stddev_samp(ret) OVER {_frame(20)} * sqrt(252) END")
_daily_query("downside_semivariance", lambda: win.downside_semivariance(RET(), K, T, 20), f"CASE WHEN count(ret) OVER {_frame(20)} >= 5 THEN avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret >= 0 THEN 0 END) OVER {_frame(20)} END")
_daily_query("rolling_mean_abs", lambda: win.rolling_mean_abs(RET(), K, T), f"CASE WHEN count(ret) OVER {_frame(20)} >= 10 THEN avg(abs(ret)) OVER {_frame(20)} END")
_daily_query("rolling_zscore", lambda: win.rolling_zscore(VIX(), K, T, 60), f"CASE WHEN count(vix) OVER {_frame(60)} >= 15 THEN (vix - avg(vix) OVER {_frame(60)}) / nullif(stddev_samp(vix) OVER {_frame(60)}, 0) END")
_PRIOR = f"({_W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
_Z = f"CASE WHEN count(vix) OVER {_PRIOR} >= 126 THEN (vix - avg(vix) OVER {_PRIOR}) / nullif(stddev_samp(vix) OVER {_PRIOR}, 0) END"
_daily_query("shifted_zscore", lambda: win.shifted_zscore(VIX(), K, T), _Z)
_daily_query("trailing_drawdown", lambda rows: win.add_trailing_drawdown(rows, "price", K, T, 60, "value", 20), f"CASE WHEN count(price) OVER {_frame(60)} >= 20 THEN price / max(price) OVER {_frame(60)} - 1 END")
_NEXT20 = f"({_W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
_daily_query("forward_drawdown", lambda rows: win.add_forward_drawdown(rows, "price", K, T, 20, "value"), f"min(price) OVER {_NEXT20} / price - 1")
_daily_query("forward_window_max", lambda rows: win.add_forward_max(rows, "vix", K, T, 20, "value"), f"max(vix) OVER {_NEXT20}")
_daily_query("forward_drawdown_label", lambda rows: labels.add_drawdown_label(rows, "price", K, T, 20, 0.05, "value"), f"CASE WHEN lead(price, 20) OVER ({_W}) IS NOT NULL THEN coalesce(min(price) OVER {_NEXT20} / price - 1 <= -0.05, false)::INT::DOUBLE END")
_daily_query("bounded_ffill", lambda: win.bounded_ffill(F.col("vix3m"), K, T), f"last_value(vix3m IGNORE NULLS) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")


@query(f"""{_RET} SELECT entity, date, {R('CASE WHEN count(vix) OVER x >= 756 THEN quantile_cont(vix, 0.85) OVER x END')} AS value
FROM r WINDOW x AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_quantile_threshold(spark, sf_dir):
    rows = frames.daily(spark, sf_dir).select("entity", "date", "vix")
    return rounded(quantiles.expanding_quantile(rows, "vix", K, T, "value").drop("vix"))


@query(f"""WITH {frames.DAILY}, r AS (SELECT *, coalesce(price / lag(price) OVER ({_W}) - 1, 0) AS ret
FROM daily), g AS (SELECT *, product(1 + ret) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth
FROM r) SELECT entity, date, {R('ret', 9)} AS ret, {R('growth', 9)} AS growth, {R(f'growth / max(growth) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1', 9)} AS drawdown
FROM g""")
def pct_change_growth(spark, sf_dir):
    rows = frames.daily(spark, sf_dir).withColumn("ret", win.simple_return(P(), K, T))
    return rounded(win.add_growth(rows, "ret", K, T).select("entity", "date", "ret", "growth", "drawdown"), 9)


@query(f"""WITH {frames.DAILY}, c AS (SELECT entity, quantile_cont(vix, 0.95) AS hi
FROM daily GROUP BY entity) SELECT entity, date, coalesce(max(vix) OVER {_NEXT20} >= hi, false)::INT::DOUBLE AS label
FROM daily JOIN c USING (entity)""")
def forward_quantile_label(spark, sf_dir):
    return labels.quantile_label(frames.daily(spark, sf_dir), "vix", K, T, 20, 0.95, "label").select("entity", "date", "label")


@query(f"""{_LABELLED} SELECT entity, date, {R(f'CASE WHEN count(label) OVER x >= 20 THEN avg(label) OVER x END')} AS frequency
FROM labelled WINDOW x AS ({_W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""")
def rolling_event_frequency(spark, sf_dir):
    return rounded(_labelled(spark, sf_dir).withColumn("frequency", win.rolling_event_frequency(F.col("label"), K, T)).select("entity", "date", "frequency"))


_BUILD = f"""{_RET}, v AS (SELECT *, CASE WHEN count(ret) OVER {_frame(20)} >= 5 THEN stddev_samp(ret) OVER {_frame(20)} * sqrt(252) END AS vol FROM r),
cuts AS (SELECT entity, quantile_cont(vol, 0.95) AS vol_cut, quantile_cont(credit, 0.9) AS credit_cut FROM v GROUP BY entity),
a AS (SELECT v.*, lead(price, 20) OVER w IS NOT NULL AS known, lead(vol, 20) OVER w IS NOT NULL AS vol_known, lead(vix, 20) OVER w IS NOT NULL AS vix_known,
             min(price) OVER {_NEXT20} / price - 1 AS dd, coalesce(max(vol) OVER {_NEXT20} >= vol_cut, false) AS hot, coalesce(max(vix) OVER {_NEXT20} >= 35, false) AS fear,
             coalesce(max(credit) OVER {_NEXT20} >= credit_cut, false) AS tight
      FROM v JOIN cuts USING (entity) WINDOW w AS ({_W})),
b AS (SELECT *, CASE WHEN known THEN coalesce(dd <= -0.05, false)::INT::DOUBLE END AS label, CASE WHEN vol_known THEN hot::INT::DOUBLE END AS vol_label, CASE WHEN vix_known THEN fear::INT::DOUBLE END AS vix_label FROM a),
c AS (SELECT *, coalesce(lag(label) OVER ({_W}), 0) AS p, row_number() OVER ({_W}) AS rn FROM b)
SELECT entity, date, 20 AS forecast_horizon_days, {R('dd')} AS forward_drawdown, label AS drawdown_5pct_h20, vol_label AS realized_vol_top_5pct_h20, vix_label AS vix_gt_35_h20,
       CASE WHEN label IS NOT NULL THEN (label = 1 AND (coalesce(vol_label = 1, false) OR coalesce(vix_label = 1, false)) AND tight)::INT::DOUBLE END AS joint_stress_h20,
       CASE WHEN label IS NULL THEN 'insufficient_forward_window' WHEN label = 1 AND p = 1 THEN 'continuation' WHEN label = 1 THEN 'onset' WHEN p = 1 THEN 'recovery' ELSE 'calm' END AS event_phase,
       CASE WHEN label = 1 THEN sum((label = 1 AND p <> 1)::INT) OVER ({_W})::BIGINT END AS event_id, coalesce(label = 1 AND p = 1, false) AS overlapping_event_window,
       (min(CASE WHEN label = 1 AND p <> 1 THEN rn END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - rn)::INT AS time_to_next_event
FROM c"""


@query(_BUILD)
def build_event_labels(spark, sf_dir):
    rows = _ret(spark, sf_dir).withColumn("vol", win.realized_volatility(RET(), K, T, 20))
    out = labels.build_event_labels(rows, K, T, "price", "vol", "vix", credit="credit")
    return rounded(out.drop("price", "ret", "ret_micro", "vix", "vix3m", "credit", "vol"))


@query(f"""{_TENOR} SELECT date, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS dispersion, {R('avg(value) FILTER (ticker < $$J$$)')} AS mean_first,
{R('avg(value) FILTER (ticker >= $$J$$)')} AS mean_second FROM tenor
WHERE field = 'atm' AND target_days = 30 GROUP BY date""")
def cross_section_stats(spark, sf_dir):
    rows = panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE, target_days=(30,), fields=["atm"])
    rows = rows.withColumn("grp", F.when(F.col("ticker") < "J", "first").otherwise("second"))
    return rounded(panel.cross_section(rows, "date", "grp", "value", ["first", "second"]))


_STRESS = f"{_RET}, z AS (SELECT entity, date, {_Z} AS z1 FROM r)"

#: The root whose skew is a part of the stress score.
_SKEW_ROOT = "FRANCE"


def _z_of(column: str) -> str:
    w = "(ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({column}) OVER {w} >= 126 THEN ({column} - avg({column}) OVER {w}) / nullif(stddev_samp({column}) OVER {w}, 0) END"


_PARTS = ["equity_vol", "broad_vol", "dispersion", "skew_pressure", "absorption"]
_SCORE = f"""{_TENOR},
market AS (SELECT date, avg(value) FILTER (field = 'atm') AS broad, stddev_samp(value) FILTER (field = 'atm') AS dispersion, avg(value) FILTER (field = 'atm' AND ticker < 'J') AS equity,
                  avg(value) FILTER (field = 'atm' AND ticker >= 'J') AS other, max(value) FILTER (field = 'rr25' AND ticker = '{_SKEW_ROOT}') AS skew
           FROM tenor WHERE target_days = 30 GROUP BY date),
i AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM market),
ends AS (SELECT e.date, count(*) AS complete, {_CORR.format(a='x.equity', b='x.other')} AS c, count(x.equity) AS ne, count(x.other) AS no
         FROM i e JOIN i x ON x.i > e.i - 52 AND x.i <= e.i WHERE e.i >= 51 AND e.i < e.n - 1 AND (e.i - 51) % 5 = 0 GROUP BY e.date),
held AS (SELECT i.*, CASE WHEN ne >= 41.6 AND no >= 41.6 THEN (1 + abs(c)) / 2 END AS absorbed FROM i LEFT JOIN ends USING (date)),
filled AS (SELECT *, last_value(absorbed IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS absorption_level FROM held),
parts AS (SELECT date, {_z_of('equity')} AS equity_vol, {_z_of('broad')} AS broad_vol, {_z_of('dispersion')} AS dispersion, -({_z_of('skew')}) AS skew_pressure,
                 {_z_of('absorption_level')} AS absorption FROM filled),
scored AS (SELECT *, ({' + '.join(f'coalesce({p}, 0)' for p in _PARTS)}) / nullif({' + '.join(f'({p} IS NOT NULL)::INT' for p in _PARTS)}, 0) AS score FROM parts),
stress AS (SELECT date, score, {_z_of('score')} AS score_z FROM scored)"""


def _stress(spark, sf_dir):
    """Per date the score, the mean of five z-scores that are known, and the z-score of the score."""
    chosen = panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE, target_days=(30,), fields=["atm", "rr25"])
    atm = lambda test=None: F.when((F.col("field") == "atm") & (F.lit(True) if test is None else test), F.col("value"))
    market = chosen.groupBy("date").agg(
        F.avg(atm()).alias("broad"), F.stddev_samp(atm()).alias("dispersion"), F.avg(atm(F.col("ticker") < "J")).alias("equity"), F.avg(atm(F.col("ticker") >= "J")).alias("other"),
        F.max(F.when((F.col("field") == "rr25") & (F.col("ticker") == _SKEW_ROOT), F.col("value"))).alias("skew"),
    )
    # the share of the first of two components; a universe of many roots passes all of them and top=3
    absorbed = pca.rolling_absorption(market, ["equity", "other"], "date", 52, 5, 20, 2, 0.8, top=1).select("date", F.col("absorption").alias("absorbed"))
    rows, by = market.join(absorbed, "date", "left").withColumn("universe", F.lit("all")), ["universe"]
    rows = rows.withColumn("absorption_level", win.bounded_ffill(F.col("absorbed"), by, "date", 5))
    z = lambda c: win.shifted_zscore(F.col(c), by, "date")
    parts = rows.select("universe", "date", z("equity").alias("equity_vol"), z("broad").alias("broad_vol"), z("dispersion").alias("dispersion"), (-z("skew")).alias("skew_pressure"), z("absorption_level").alias("absorption"))
    scored = parts.withColumn("score", col_fns.skip_null_mean(*[F.col(p) for p in _PARTS]))
    return scored.withColumn("score_z", z("score")).drop("universe")


@query(f"{_SCORE} SELECT date, {R('score')} AS score, {R('score_z')} AS score_z FROM stress")
def stress_score(spark, sf_dir):
    return rounded(_stress(spark, sf_dir).select("date", "score", "score_z"))


def _panel_frame(spark, sf_dir):
    """Every trailing feature and the twelve labels over one window specification an entity."""
    rows = _ret(spark, sf_dir).where("price is not null and vix is not null")
    rows = rows.withColumns({
        "forecast_day": col_fns.next_business_day(F.col("date")), "ret_5": win.log_return(P(), K, T, 5), "ret_20": win.log_return(P(), K, T, 20), "vol_20": win.realized_volatility(RET(), K, T, 20, 10, 100 * 252**0.5), "vol_60": win.realized_volatility(RET(), K, T, 60, 20, 100 * 252**0.5),
        "dd_60": win.trailing_drawdown(P(), K, T, 60, 20), "dd_252": win.trailing_drawdown(P(), K, T, 252, 60), "vix_change_5": win.series_change(VIX(), K, T, 5), "term": F.col("vix3m") - VIX(), **{f"forward_dd_{h}": win.forward_drawdown(P(), K, T, h) for h in (5, 20, 60)},
    })
    return rows.withColumns({f"event_dd{round(100 * t)}_h{h}": labels.drawdown_label(P(), K, T, h, t) for h in (5, 20, 60) for t in (0.05, 0.1, 0.15, 0.2)})


def _next(h: int) -> str:
    return f"({_W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


_PANEL = (
    f"{_RET} SELECT entity, date, CAST(date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS forecast_day, {R('ret')} AS ret, {R('vix')} AS vix, "
    + f"{R(f'ln(price) - ln(lag(price, 5) OVER ({_W}))')} AS ret_5, {R(f'ln(price) - ln(lag(price, 20) OVER ({_W}))')} AS ret_20, "
    + ", ".join(f"{R(f'CASE WHEN count(ret) OVER {_frame(n)} >= {m} THEN stddev_samp(ret) OVER {_frame(n)} * 100 * sqrt(252) END')} AS vol_{n}" for n, m in ((20, 10), (60, 20)))
    + ", " + ", ".join(f"{R(f'CASE WHEN count(price) OVER {_frame(n)} >= {m} THEN price / max(price) OVER {_frame(n)} - 1 END')} AS dd_{n}" for n, m in ((60, 20), (252, 60)))
    + f", {R(f'vix - lag(vix, 5) OVER ({_W})')} AS vix_change_5, {R('vix3m - vix')} AS term, "
    + ", ".join(f"{R(f'min(price) OVER {_next(h)} / price - 1')} AS forward_dd_{h}" for h in (5, 20, 60))
    + ", " + ", ".join(f"CASE WHEN lead(price, {h}) OVER ({_W}) IS NOT NULL THEN coalesce(min(price) OVER {_next(h)} / price - 1 <= -{t}, false)::INT::DOUBLE END AS event_dd{round(100 * t)}_h{h}" for h in (5, 20, 60) for t in (0.05, 0.1, 0.15, 0.2))
    + " FROM r"
)


@query(_PANEL)
def build_daily_panel(spark, sf_dir):
    return rounded(_panel_frame(spark, sf_dir).drop("ret_micro", "price", "vix3m", "credit"))


#: Label, column, test and level of the indicators, in the order of the table.
_INDICATORS = {
    "level over 30": ("vix", "above", 30.0),
    "level top decile": ("vix", "top", 0.9),
    "term below 0": ("term", "below", 0.0),
    "level fell": ("vix_change_5", "below", 0.0),
    "credit top decile": ("credit", "top", 0.9),
    "term top decile": ("term", "top", 0.9),
    "drawdown of 5 percent": ("dd_60", "at_most", -0.05),
    "volatility top decile": ("vol_20", "top", 0.9),
    "credit below 0.04": ("credit", "below", 0.04),
}
_EVENT_TARGETS = ["event_dd5_h20", "event_dd10_h20"]
_TESTS = {"above": "{c} > {x}", "below": "{c} < {x}", "at_most": "{c} <= {x}", "top": "{c} >= (quantile_cont({c}, {x}) OVER (PARTITION BY entity))"}
_INDICATOR_SQL = f"""{_RET}, f AS (
    SELECT entity, date, vix, credit, vix3m - vix AS term, vix - lag(vix, 5) OVER ({_W}) AS vix_change_5,
           CASE WHEN count(price) OVER {_frame(60)} >= 20 THEN price / max(price) OVER {_frame(60)} - 1 END AS dd_60,
           CASE WHEN count(ret) OVER {_frame(20)} >= 10 THEN stddev_samp(ret) OVER {_frame(20)} * 100 * sqrt(252) END AS vol_20,
           {', '.join(f'CASE WHEN lead(price, 20) OVER ({_W}) IS NOT NULL THEN coalesce(min(price) OVER {_next(20)} / price - 1 <= -{t}, false)::INT::DOUBLE END AS {n}' for n, t in zip(_EVENT_TARGETS, (0.05, 0.1), strict=True))}
    FROM r WHERE vix IS NOT NULL
), flags AS (SELECT *, {', '.join(f"coalesce({_TESTS[t].format(c=c, x=x)}, false) AS i{k}" for k, (c, t, x) in enumerate(_INDICATORS.values()))} FROM f),
long AS ({' UNION ALL '.join(f"SELECT entity, '{y}' AS target, '{label}' AS indicator, {y} AS y, i{k} AS inside FROM flags" for y in _EVENT_TARGETS for k, label in enumerate(_INDICATORS))}),
rates AS (SELECT entity, target, indicator, count(*) FILTER (inside AND y IS NOT NULL) / count(*) AS coverage, avg(y) AS base_rate, avg(y) FILTER (inside) AS conditional_rate FROM long GROUP BY ALL),
lifts AS (SELECT *, conditional_rate / nullif(base_rate, 0) AS lift FROM rates)"""


@query(f"""{_INDICATOR_SQL} SELECT entity, target, indicator, {R('coverage')} AS coverage, {R('base_rate')} AS base_rate, {R('conditional_rate')} AS conditional_rate, {R('lift')} AS lift,
       row_number() OVER (PARTITION BY entity, target ORDER BY round(lift, 9) DESC NULLS LAST, indicator)::INT AS rank FROM lifts""")
def conditional_indicator_table(spark, sf_dir):
    rows = _panel_frame(spark, sf_dir).select("entity", "date", "vix", "credit", "term", "vix_change_5", "dd_60", "vol_20", *_EVENT_TARGETS)
    return rounded(lift.indicator_table(rows, _INDICATORS, _EVENT_TARGETS, K))


#: Rolling state of the reference, over the rows of the panel: name -> (rows, least rows).
_STATE = ["ref_vol_20", "ref_vol_60", "ref_abs_20", "price_spread", "price_ratio", "click_spread"]


def _rolls(expression: str, n: int, least: int) -> str:
    w = f"(ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(click) OVER {w} >= {least} THEN {expression} OVER {w} END"


@query(f"""{_EVENTS},
target AS (SELECT ts, lead(large_abs::INT) OVER (ORDER BY ts) AS next_abs, lead(large_down::INT) OVER (ORDER BY ts) AS next_down, threshold_ready FROM ev),
wide AS (SELECT ts, {_WIDE}, max(close) FILTER (ticker = 'purchase') - max(close) FILTER (ticker = 'view') AS price_spread,
                CASE WHEN max(close) FILTER (ticker = 'view') <> 0 THEN max(close) FILTER (ticker = 'purchase') / max(close) FILTER (ticker = 'view') - 1 END AS price_ratio
         FROM returns GROUP BY ts),
state AS (SELECT *, {_rolls('stddev_samp(click)', 20, 10)} AS ref_vol_20, {_rolls('stddev_samp(click)', 60, 20)} AS ref_vol_60, {_rolls('avg(abs(click))', 20, 10)} AS ref_abs_20 FROM wide)
SELECT ts, {', '.join(f'{R(t)} AS {t}' for t in _TICKERS)}, {R('ref_vol_20')} AS ref_vol_20, {R('ref_vol_60')} AS ref_vol_60, {R('ref_abs_20')} AS ref_abs_20,
       {R('price_spread')} AS price_spread, {R('price_ratio')} AS price_ratio, {R('view - click')} AS view_spread, {R('purchase - click')} AS click_spread, next_abs, next_down
FROM state JOIN target USING (ts) WHERE threshold_ready""")
def predictive_frame(spark, sf_dir):
    return rounded(_predictive(spark, sf_dir))


def _predictive(spark, sf_dir, names=tuple(_TICKERS)):
    """Returns, rolling state and spreads known at a bar's close; the next reference bar's flags; ready rows."""
    ev = _events(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("ts")
    flag = lambda c: F.lead(F.col(c).cast("int")).over(w)
    target = ev.select("ts", flag("large_abs").alias("next_abs"), flag("large_down").alias("next_down"), "threshold_ready")
    returns = frames.returns(spark, sf_dir)
    close = lambda t: F.max(F.when(F.col("ticker") == t, F.col("close")))
    prices = returns.groupBy("ts").agg((close("purchase") - close("view")).alias("price_spread"), (F.try_divide(close("purchase"), close("view")) - 1).alias("price_ratio"))
    wide = returns.groupBy("ts").pivot("ticker", list(names)).agg(F.max("ret")).join(prices, "ts").withColumn("reference", F.lit("click"))
    ref, by = F.col("click"), ["reference"]
    state = {
        "ref_vol_20": win.enough(ref, win.trailing(by, "ts", 20), 10, F.stddev_samp(ref).over(win.trailing(by, "ts", 20))),
        "ref_vol_60": win.enough(ref, win.trailing(by, "ts", 60), 20, F.stddev_samp(ref).over(win.trailing(by, "ts", 60))),
        "ref_abs_20": win.rolling_mean_abs(ref, by, "ts", 20, 10),
        "view_spread": F.col("view") - ref,
        "click_spread": F.col("purchase") - ref,
    }
    ready = wide.withColumns(state).join(target, "ts").where("threshold_ready")
    return ready.select("ts", *names, *_STATE, "view_spread", "next_abs", "next_down")


# -- top k -------------------------------------------------------------------------------


@query(f"WITH {frames.SCORES} SELECT model, id, y, p FROM scores WHERE model = 'quality' ORDER BY p DESC, id LIMIT 25")
def top_risk_dates(spark, sf_dir):
    return frames.scores(spark, sf_dir).where("model = 'quality'").orderBy(F.desc("p"), "id").limit(25)


@query(f"""{_RET}, d AS (SELECT entity, date, price, vix, {R('price / max(price) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1', 8)} AS drawdown
FROM r) SELECT entity, date, {R('drawdown')} AS drawdown, {R('vix')} AS vix
FROM d ORDER BY d.drawdown, entity, date LIMIT 10""")
def largest_drawdowns(spark, sf_dir):
    rows = win.add_drawdown(frames.daily(spark, sf_dir), "price", K, T, "drawdown").withColumn("drawdown", F.round("drawdown", 8))
    return rounded(rows.select("entity", "date", "drawdown", "vix").orderBy("drawdown", "entity", "date").limit(10))


# -- splits ------------------------------------------------------------------------------

_IDX = f"WITH {frames.DAILY}, i AS (SELECT entity, date, row_number() OVER ({_W}) - 1 AS row_idx, count(*) OVER (PARTITION BY entity) AS n_rows FROM daily)"


def _indexed(spark, sf_dir):
    return splits.indexed(frames.daily(spark, sf_dir).select("entity", "date"), K, T)


@query(f"{_IDX} SELECT *, CASE WHEN row_idx < floor(n_rows * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM i")
def chronological_split(spark, sf_dir):
    return splits.chronological(_indexed(spark, sf_dir), 0.7)


_FOLDS = f"""{_IDX}, f AS (SELECT entity, fold, fold * (n // 3) + least(fold, n % 3) AS s, n // 3 + (fold < n % 3)::INT AS size
FROM (SELECT entity, any_value(n_rows) AS n FROM i GROUP BY entity), (SELECT unnest([0, 1, 2]) AS fold)),
a AS (SELECT i.entity, date, row_idx, fold::INT AS fold, CASE WHEN row_idx BETWEEN s AND s + size - 1 THEN 'test' WHEN row_idx + 20 < s OR row_idx > s + size - 1 + 5 THEN 'train' END AS role
FROM i JOIN f USING (entity))"""


@query(f"{_FOLDS} SELECT * FROM a WHERE role IS NOT NULL")
def purged_time_series_split(spark, sf_dir):
    return splits.purged_folds(_indexed(spark, sf_dir), K, 3, 20, 5).select("entity", "date", "row_idx", "fold", "role")


@query(f"""{_FOLDS} SELECT entity, fold, min(date) FILTER (role = 'train') AS train_start, max(date) FILTER (role = 'train') AS train_end, min(date) FILTER (role = 'test') AS test_start_time,
max(date) FILTER (role = 'test') AS test_end_time, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test
FROM a GROUP BY 1, 2""")
def split_summary(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    return splits.fold_summary(rows, splits.purged_intervals(splits.sizes_of(rows, K), K, 3, 20, 5), K, T)


@query(f"""{_IDX}, f AS (SELECT entity, s, least(s + 250, n) - 1 AS e, (row_number() OVER (PARTITION BY entity ORDER BY s) - 1)::INT AS fold
FROM (SELECT entity, n, unnest(range(1000, n, 250)) AS s FROM (SELECT entity, any_value(n_rows) AS n
FROM i GROUP BY entity))), a AS (SELECT i.entity, row_idx, fold, CASE WHEN row_idx BETWEEN s AND e THEN 'test' WHEN row_idx < s - 20 OR row_idx > e + 1 + 5 THEN 'train' END AS role
FROM i JOIN f USING (entity)) SELECT entity, fold, role, count(*) AS n, min(row_idx) AS first_idx, max(row_idx) AS last_idx
FROM a WHERE role IS NOT NULL GROUP BY ALL""")
def expanding_window_splits(spark, sf_dir):
    return splits.fold_bounds(splits.expanding_intervals(splits.sizes_of(_indexed(spark, sf_dir), K), K, 1000, 250, 20, 5), K)


@query(f"""{_FOLDS}, d AS (SELECT a.*, price, vix FROM a JOIN daily USING (entity, date)) SELECT entity, fold, role, count(*) AS n, {R('sum(price)')} AS price, {R('sum(vix)')} AS vix
FROM d WHERE role IS NOT NULL GROUP BY ALL""")
def fold_sums(spark, sf_dir):
    """Sums of prices and volatility over both roles of the purged folds, without a row a fold."""
    rows = splits.indexed(frames.daily(spark, sf_dir).select("entity", "date", "price", "vix"), K, T)
    folds = splits.purged_intervals(splits.sizes_of(rows, K), K, 3, 20, 5)
    return rounded(splits.fold_sums(rows, folds, K, ["price", "vix"]))


@query(f"{_IDX} SELECT entity, date, row_idx, row_idx + 20 < 600 AS purged_ok, row_idx > 700 + 10 AS embargo_ok FROM i")
def purge_embargo_masks(spark, sf_dir):
    i = F.col("row_idx")
    return _indexed(spark, sf_dir).select("entity", "date", "row_idx", splits.purge_mask(i, F.lit(600), 20).alias("purged_ok"), splits.embargo_mask(i, F.lit(700), 10).alias("embargo_ok"))


@query(f"""{_IDX}, h AS (SELECT entity, date, date < DATE '1996-01-01' AS early, row_number() OVER (PARTITION BY entity, date < DATE '1996-01-01' ORDER BY date DESC) AS back
FROM i) SELECT entity, date, CASE WHEN early THEN 'train' ELSE 'test' END AS role
FROM h WHERE NOT early OR back > 20""")
def holdout_with_purge(spark, sf_dir):
    return splits.holdout(frames.daily(spark, sf_dir).select("entity", "date"), K, T, "1996-01-01")


@query(f"""{_LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled WHERE label IS NOT NULL
GROUP BY 1) SELECT label, 'train' AS role, round(n * 0.7)::BIGINT AS n
FROM c UNION ALL SELECT label, 'test', n - round(n * 0.7)::BIGINT
FROM c""")
def stratified_random_split(spark, sf_dir):
    rows = splits.stratified_random(_labelled(spark, sf_dir).where("label is not null"), "label", ["entity", "date"])
    return rows.groupBy("label", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {frames.DAILY} SELECT entity, date, CASE WHEN date < DATE '1995-01-01' THEN 'train' WHEN date < DATE '1997-01-01' THEN 'validation' ELSE 'test' END AS role FROM daily")
def three_way_split(spark, sf_dir):
    return splits.three_way(frames.daily(spark, sf_dir).select("entity", "date"), T, "1995-01-01", "1997-01-01")


@query(f"WITH {frames.DAILY} SELECT entity, date, row_number() OVER (ORDER BY date, entity) - 1 AS row_idx FROM daily")
def global_row_index(spark, sf_dir):
    return win.row_index(frames.daily(spark, sf_dir).select("entity", "date"), ["date", "entity"]).select("entity", "date", "row_idx")


@query(f"{_RET} SELECT entity, date, {R(f'CASE WHEN count(vix) OVER {_frame(60)} >= 20 THEN avg(vix) OVER {_frame(60)} END')} AS value FROM r")
def halo_rolling_mean(spark, sf_dir):
    rows = splits.indexed(frames.daily(spark, sf_dir), K, T).drop("n_rows")
    spread = win.with_halo(rows, "row_idx", 500, 59, K)
    w = win.trailing([*K, "chunk"], T, 60)
    value = win.enough(VIX(), w, 20, F.avg("vix").over(w))
    return rounded(spread.withColumn("value", value).where("not is_halo").select("entity", "date", "value"))


# -- models, metrics, backtests ----------------------------------------------------------


@query(f"{_LABELLED} SELECT entity, date, {R('(SELECT avg(label) FROM labelled WHERE date < DATE $$1996-01-01$$)')} AS p FROM labelled WHERE date >= DATE '1996-01-01'")
def historical_frequency(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    early = F.col("date") < F.lit("1996-01-01").cast("date")
    return rounded(models.historical_frequency(rows.where(early), rows.where(~early).select("entity", "date"), "label"))


@query(f"""WITH {frames.SCORES}, s AS (SELECT model, p, sum((y = 1)::INT) AS pos, sum((y <> 1)::INT) AS neg
FROM scores GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC)), k AS (SELECT model, sum(pos) AS np, sum(neg) AS nn, sum(pos * tp / (tp + fp)) AS ap,
sum(neg * (tp - pos / 2)) AS area FROM c GROUP BY 1), b AS (SELECT model, count(*) AS n, avg(y) AS positive_rate, avg((y - p) * (y - p)) AS brier,
avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss
FROM scores GROUP BY 1) SELECT model, n, {R('positive_rate')} AS positive_rate, {R('brier')} AS brier, {R('log_loss')} AS log_loss,
{R('ap / np')} AS average_precision, {R('area / (np * nn)')} AS roc_auc
FROM b JOIN k USING (model)""")
def probability_metrics(spark, sf_dir):
    return rounded(metrics.probability_metrics(frames.scores(spark, sf_dir)))


@query(f"""WITH {frames.SCORES}, b AS (SELECT model, len(list_filter([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001,
0.8, 0.9]::DOUBLE[], lambda e: p > e)) AS bin, count(*) AS n, avg(y) AS my, avg(p) AS mp
FROM scores GROUP BY 1, 2) SELECT model, {R('sum(n * abs(my - mp)) / sum(n)')} AS ece
FROM b GROUP BY 1""")
def expected_calibration_error(spark, sf_dir):
    return rounded(metrics.calibration_error(frames.scores(spark, sf_dir)))


@query(f"WITH {frames.SCORES} SELECT {R('avg((y - p) * (y - p) - (y - 0.5) * (y - 0.5))')} AS brier_difference FROM scores WHERE model = 'quality'")
def paired_brier_difference(spark, sf_dir):
    return rounded(metrics.paired_brier(frames.scores(spark, sf_dir).where("model = 'quality'").withColumn("half", F.lit(0.5)), "y", "p", "half"))


@query()
def calibration_slope_intercept(spark, sf_dir):
    return rounded(metrics.calibration_line(frames.scores(spark, sf_dir)))


_FEATURES = ["vol_20", "vol_60", "dd_60", "vix", "term"]


def _holdout_panel(spark, sf_dir):
    return splits.holdout(_panel_frame(spark, sf_dir), K, T, "1996-01-01").select("entity", "date", "role", *_FEATURES, "event_dd5_h20", "event_dd5_h60")


@query()
def fit_predict_logistic(spark, sf_dir):
    rows = _holdout_panel(spark, sf_dir)
    return rounded(models.fit_predict_logistic(rows.where("role = 'train'"), rows.where("role = 'test'"), _FEATURES, "event_dd5_h20").select("entity", "date", "p", "fallback"), 4)


@query()
def feature_group_holdout(spark, sf_dir):
    groups = {"base_rate": [], "volatility": _FEATURES[:2], "levels": _FEATURES[2:]}
    return rounded(metrics.probability_metrics(models.feature_group_holdout(_holdout_panel(spark, sf_dir), groups, ["event_dd5_h20", "event_dd5_h60"])), 4)


def _event_types(spark, sf_dir):
    return sorted(r[0] for r in frames.table(spark, sf_dir, "events").where("event_type is not null").select("event_type").distinct().collect())


def _screened(spark, sf_dir):
    names = _event_types(spark, sf_dir)
    rows = win.row_index(_predictive(spark, sf_dir, names), ["ts"])
    rows = rows.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_rows"))))
    groups = {"logit_returns": names, "logit_all": [*names, "view_spread", *_STATE]}
    return models.predictive_screen(splits.chronological(rows, 0.7), groups, ["next_abs", "next_down"])


@query()
def predictive_screen(spark, sf_dir):
    """Scores of the next bar's events by a base rate and two logits."""
    return rounded(metrics.probability_metrics(_screened(spark, sf_dir)[0]), 4)


@query()
def predictive_screen_coefficients(spark, sf_dir):
    return rounded(_screened(spark, sf_dir)[1], 4)


@query()
def baseline_suite(spark, sf_dir):
    """Four evaluations side by side: shuffled with leaked features, constant, chronological, last purged fold."""
    rows = _panel_frame(spark, sf_dir).where("event_dd5_h20 is not null").select("entity", "date", *_FEATURES, F.col("event_dd5_h20").alias("y"), "forward_dd_20", F.col("event_dd10_h20").alias("leaked_next"))
    rows = rows.withColumnRenamed("forward_dd_20", "leaked_drawdown")
    leaky = [*_FEATURES, "leaked_drawdown", "leaked_next"]
    numbered = splits.indexed(rows, K, T)
    chrono = splits.chronological(numbered, 0.7)
    purged = splits.purged_folds(numbered, K, 3, 20, 5).where("fold = 2")
    shuffled = splits.stratified_random(rows, "y", ["entity", "date"])
    out = None
    for name, split, features in (("leaky_random", shuffled, leaky), ("naive", chrono, []), ("chronological", chrono, _FEATURES), ("purged", purged, _FEATURES)):
        part = models.feature_group_holdout(split, {name: features}, ["y"])
        out = part if out is None else out.unionByName(part)
    return rounded(metrics.probability_metrics(out), 4)


@query()
def conditional_pca(spark, sf_dir):
    return rounded(pca.conditional_pca(_aligned(spark, sf_dir), reference="click", least=25)[0])


@query()
def conditional_pca_loadings(spark, sf_dir):
    return rounded(pca.conditional_pca(_aligned(spark, sf_dir), reference="click", least=25)[1])


@query()
def rolling_pca_absorption(spark, sf_dir):
    """All drivers but the reference on its bars: three components, for all bars and for those of large impulses."""
    names, ev = [t for t in _event_types(spark, sf_dir) if t != "click"], _events(spark, sf_dir)
    per_date = impulse.bars_per_date(ev)
    wide = frames.returns(spark, sf_dir).groupBy("ts").pivot("ticker", names).agg(F.max("ret")).join(ev.select("ts", "large_abs"), "ts")
    return rounded(pca.rolling_absorption(wide, names, "ts", max(40, round(20 * per_date)), max(1, round(per_date)), 40, share=None, flag="large_abs"))


@query(f"""WITH {frames.RETURNS}, w AS (SELECT ts, max(ret) FILTER (ticker = 'click') AS a, max(ret) FILTER (ticker = 'view') AS b FROM returns GROUP BY ts),
i AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM w),
e AS (SELECT ts, i FROM i WHERE i >= 119 AND (i - 119) % 12 = 0 AND i < n - 1),
pairs AS (SELECT e.ts, x.a AS a0, x.b AS b0, CASE WHEN x.b IS NOT NULL THEN x.a END AS a, CASE WHEN x.a IS NOT NULL THEN x.b END AS b FROM e JOIN i x ON x.i > e.i - 120 AND x.i <= e.i),
c AS (SELECT ts, count(*) AS size, count(a0) AS na, count(b0) AS nb, count(a) AS full_rows, {_CORR.format(a='a', b='b')} AS r FROM pairs GROUP BY ts)
SELECT ts, CASE WHEN na >= 60 AND nb >= 60 THEN full_rows WHEN na >= 60 THEN na WHEN nb >= 60 THEN nb ELSE size END AS n_rows, (na >= 60)::BIGINT + (nb >= 60)::BIGINT AS n_columns,
       {R('CASE WHEN na >= 60 AND nb >= 60 AND full_rows >= 40 THEN (1 + abs(r)) / 2 END')} AS absorption FROM c""")
def rolling_pair_absorption(spark, sf_dir):
    """Two series, for which the first component's share is (1 + |r|) / 2."""
    wide = frames.returns(spark, sf_dir).groupBy("ts").pivot("ticker", ["click", "view"]).agg(F.max("ret"))
    return rounded(pca.rolling_absorption(wide, ["click", "view"], "ts", 120, 12, 40, share=0.5, top=1))


@query()
def panel_pca_absorption(spark, sf_dir):
    """Daily form: windows of 252 dates every 5, over the 30-day volatility of all roots."""
    long = panel.root_panel(panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE, target_days=(30,), fields=["atm"]), "atm", 30)
    names = sorted(r[0] for r in frames.table(spark, sf_dir, "nation").select("n_name").collect())
    wide = long.groupBy("date").pivot("ticker", names).agg(F.max("value"))
    return rounded(pca.rolling_absorption(wide, names, "date", 252, 5, 160, 6))


_OVER = f"""{_STRESS}, base AS (SELECT r.entity, r.date, coalesce(r.price / lag(r.price) OVER (PARTITION BY r.entity ORDER BY r.date) - 1, 0) AS base,
z1 FROM r JOIN z USING (entity, date)), x AS (SELECT *, CASE WHEN coalesce(z1 >= 1, false) THEN 0.5 ELSE 1.0 END AS exposure
FROM base), p AS (SELECT *, coalesce(lag(exposure) OVER ({_W}), 1.0) AS position
FROM x), o AS (SELECT *, abs(position - coalesce(lag(position) OVER ({_W}), position)) AS turn
FROM p), run AS (SELECT entity, date, position::DOUBLE AS position, turn::DOUBLE AS turn, position * base - turn * 0.0001 AS overlay_return
FROM o)"""


def _overlay(spark, sf_dir):
    rows = frames.daily(spark, sf_dir).withColumns({"base": win.simple_return(P(), K, T), "score": win.shifted_zscore(VIX(), K, T)})
    return rows.withColumn("high_risk", F.col("score") >= 1)


@query(f"{_OVER} SELECT entity, date, position, turn, {R('overlay_return', 9)} AS overlay_return FROM run")
def overlay_backtest(spark, sf_dir):
    return rounded(backtest.overlay(_overlay(spark, sf_dir), K, T, "base", "high_risk", 0.5).select("entity", "date", "position", "turn", "overlay_return"), 9)


_METRICS = "e AS (SELECT *, product(1 + overlay_return) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM {t}), d AS (SELECT *, equity / max(equity) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM e), m AS (SELECT {k}, count(*) AS n, arg_max(equity, date) - 1 AS cumulative_return, stddev_samp(overlay_return) * sqrt(252) AS annual_vol, min(drawdown) AS max_drawdown, min(overlay_return) AS worst_day, avg(position) AS mean_exposure, sum(turn) AS turnover FROM d GROUP BY ALL), s AS (SELECT *, pow(1 + cumulative_return, 252.0 / n) - 1 AS annual_return FROM m)"
_METRIC_COLUMNS = ", ".join(f"{R(c)} AS {c}" for c in ("cumulative_return", "annual_vol", "max_drawdown", "worst_day", "mean_exposure", "turnover", "annual_return")) + f", {R('annual_return / nullif(annual_vol, 0)')} AS sharpe"


@query(f"{_OVER}, {_METRICS.format(k='entity', t='run')} SELECT entity, n, {_METRIC_COLUMNS} FROM s")
def strategy_metrics(spark, sf_dir):
    run = backtest.overlay(_overlay(spark, sf_dir), K, T, "base", "high_risk", 0.5)
    return rounded(backtest.strategy_metrics(run, K, T, "overlay_return"))


_GRID = f"{_STRESS}, base AS (SELECT r.entity, r.date, coalesce(r.price / lag(r.price) OVER (PARTITION BY r.entity ORDER BY r.date) - 1, 0) AS base, z1 FROM r JOIN z USING (entity, date)), cuts AS (SELECT entity, quantile, quantile_cont(z1, quantile) AS cut FROM base, (SELECT unnest([0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS quantile) WHERE date < DATE '1996-01-01' AND quantile = 0.75 GROUP BY 1, 2 UNION ALL SELECT entity, 0.8, quantile_cont(z1, 0.8) FROM base WHERE date < DATE '1996-01-01' GROUP BY 1 UNION ALL SELECT entity, 0.85, quantile_cont(z1, 0.85) FROM base WHERE date < DATE '1996-01-01' GROUP BY 1 UNION ALL SELECT entity, 0.9, quantile_cont(z1, 0.9) FROM base WHERE date < DATE '1996-01-01' GROUP BY 1)".replace("quantile_cont(z1, quantile)", "quantile_cont(z1, 0.75)") + ", g AS (SELECT b.*, quantile, low_exposure, coalesce(z1 >= cut, false) AS risky FROM base b JOIN cuts USING (entity), (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS low_exposure)), x AS (SELECT *, CASE WHEN risky THEN low_exposure ELSE 1.0 END AS exposure FROM g), p AS (SELECT *, coalesce(lag(exposure) OVER gw, 1.0) AS position FROM x WINDOW gw AS (PARTITION BY entity, quantile, low_exposure ORDER BY date)), o AS (SELECT *, abs(position - coalesce(lag(position) OVER gw, position)) AS turn FROM p WINDOW gw AS (PARTITION BY entity, quantile, low_exposure ORDER BY date)), run AS (SELECT entity, quantile, low_exposure, date, position, turn, risky, position * base - turn * 0.0001 AS overlay_return FROM o), " + _METRICS.format(k="entity, quantile, low_exposure", t="run") + ", h AS (SELECT entity, quantile, low_exposure, 100 * avg(risky::INT) AS pct_high_risk FROM run GROUP BY ALL), final AS (SELECT * FROM s JOIN h USING (entity, quantile, low_exposure))"


def _grid(spark, sf_dir):
    rows = _overlay(spark, sf_dir).select("entity", "date", "base", "score")
    return backtest.sensitivity_grid(rows, K, T, "base", "score", F.col("date") < F.lit("1996-01-01").cast("date"))


@query(f"{_GRID} SELECT entity, quantile::DOUBLE AS quantile, low_exposure, n, {_METRIC_COLUMNS}, {R('pct_high_risk')} AS pct_high_risk FROM final")
def overlay_sensitivity_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir))


@query(f"{_GRID} SELECT entity, quantile::DOUBLE AS quantile, " + ", ".join(f"{R(f'max(annual_return / nullif(annual_vol, 0)) FILTER (low_exposure = {e})')} AS exposure_{round(100 * e)}" for e in (0.0, 0.25, 0.5, 0.75)) + " FROM final GROUP BY ALL")
def sensitivity_pivot(spark, sf_dir):
    named = _grid(spark, sf_dir).withColumn("column", F.concat(F.lit("exposure_"), F.round(100 * F.col("low_exposure")).cast("int").cast("string")))
    return rounded(named.groupBy("entity", "quantile").pivot("column", [f"exposure_{e}" for e in (0, 25, 50, 75)]).agg(F.max("sharpe")))


@query(f"""{_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(annual_return / nullif(annual_vol, 0), 9) DESC NULLS LAST,
round(max_drawdown, 9) DESC, quantile, low_exposure)::INT AS rank
FROM final) SELECT entity, quantile::DOUBLE AS quantile, low_exposure, rank, {R('annual_return / nullif(annual_vol, 0)')} AS sharpe
FROM k WHERE rank <= 8""")
def rank_strategies(spark, sf_dir):
    grid = _grid(spark, sf_dir).withColumns({"sharpe": F.round("sharpe", 9), "max_drawdown": F.round("max_drawdown", 9)})
    return rounded(backtest.rank_strategies(grid, K).select("entity", "quantile", "low_exposure", "rank", "sharpe"))


_CUT = "date < DATE '1996-01-01'"
_RUN = f"""p AS (SELECT *, coalesce(lag(exposure) OVER w, 1.0) AS position
FROM x WINDOW w AS (PARTITION BY {{k}} ORDER BY date)), o AS (SELECT *, abs(position - coalesce(lag(position) OVER w, position)) AS turn
FROM p WINDOW w AS (PARTITION BY {{k}} ORDER BY date)), run AS (SELECT {{k}}, date, position::DOUBLE AS position, turn::DOUBLE AS turn,
position * base - turn * 0.0001 AS overlay_return FROM o)"""
_RULE = "entity, quantile, low_exposure"
_SPLIT = f"""{_STRESS},
base AS (SELECT r.entity, r.date, coalesce(r.price / lag(r.price) OVER (PARTITION BY r.entity ORDER BY r.date) - 1, 0) AS base, z1 FROM r JOIN z USING (entity, date)),
cuts AS ({' UNION ALL '.join(f"SELECT entity, {q}::DOUBLE AS quantile, quantile_cont(z1, {q}) AS cut FROM base WHERE {_CUT} GROUP BY 1" for q in (0.75, 0.8, 0.85, 0.9))}),
best AS (WITH x AS (SELECT entity, date, base, quantile, low_exposure, CASE WHEN coalesce(z1 >= cut, false) THEN low_exposure ELSE 1.0 END AS exposure
                    FROM base JOIN cuts USING (entity), (SELECT unnest([0, 0.25, 0.5, 0.75]::DOUBLE[]) AS low_exposure) WHERE {_CUT}),
         {_RUN.format(k=_RULE)}, {_METRICS.format(k=_RULE, t='run')}
         SELECT {_RULE}, 'selected' AS rule FROM s
         QUALIFY row_number() OVER (PARTITION BY entity ORDER BY annual_return / nullif(annual_vol, 0) DESC NULLS LAST, max_drawdown DESC, quantile, low_exposure) = 1),
rules AS (SELECT * FROM best UNION ALL SELECT DISTINCT entity, 0.85, 0.5, 'fixed' FROM base),
x AS (SELECT b.entity, rule, u.quantile, low_exposure, b.date, base, CASE WHEN coalesce(z1 >= cut, false) THEN low_exposure ELSE 1.0 END AS exposure
      FROM base b JOIN rules u USING (entity) JOIN cuts c ON c.entity = b.entity AND c.quantile = u.quantile WHERE NOT ({_CUT})),
{_RUN.format(k=_RULE + ', rule')}, {_METRICS.format(k=_RULE + ', rule', t='run')}
SELECT entity, rule, quantile, low_exposure, n, {_METRIC_COLUMNS} FROM s"""


@query(_SPLIT)
def sample_split_selection(spark, sf_dir):
    """The best rule before the cutoff, evaluated after it beside a fixed rule."""
    rows = _overlay(spark, sf_dir).select("entity", "date", "base", "score")
    early = F.col("date") < F.lit("1996-01-01").cast("date")
    best = backtest.rank_strategies(backtest.sensitivity_grid(rows.where(early), K, T, "base", "score", F.lit(True)), K, 1).select("entity", "quantile", "low_exposure", F.lit("selected").alias("rule"))
    fixed = rows.select("entity").distinct().select("entity", F.lit(0.85).alias("quantile"), F.lit(0.5).alias("low_exposure"), F.lit("fixed").alias("rule"))
    cuts = quantiles.key_quantiles(rows.where(early), K, "score", {f"cut_{k}": q for k, q in enumerate((0.75, 0.8, 0.85, 0.9))})
    cuts = cuts.select("entity", F.array(*[F.col(f"cut_{k}") for k in range(4)]).alias("cuts"))
    rules = best.unionByName(fixed).join(cuts, "entity")
    late = rows.where(~early).join(rules, "entity")
    place = F.round((F.col("quantile") - 0.75) / 0.05).cast("int") + 1
    late = late.withColumn("high_risk", F.col("score") >= F.element_at("cuts", place))
    by = ["entity", "rule", "quantile", "low_exposure"]
    return rounded(backtest.strategy_metrics(backtest.overlay(late, by, T, "base", "high_risk", F.col("low_exposure")), by, T, "overlay_return"))


@query(f"""{_STRESS}, base AS (SELECT r.entity, r.date, coalesce(r.price / lag(r.price) OVER (PARTITION BY r.entity ORDER BY r.date) - 1, 0) AS base,
z1, CASE WHEN count(z1) OVER q >= 756 THEN quantile_cont(z1, 0.85) OVER q END AS cut
FROM r JOIN z USING (entity, date) WINDOW q AS (PARTITION BY r.entity ORDER BY r.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN coalesce(z1 >= cut, false) THEN 0.5 ELSE 1.0 END AS exposure
FROM base), p AS (SELECT *, coalesce(lag(exposure) OVER ({_W}), 1.0) AS position
FROM x), o AS (SELECT *, abs(position - coalesce(lag(position) OVER ({_W}), position)) AS turn
FROM p), run AS (SELECT entity, date, position::DOUBLE AS position, turn::DOUBLE AS turn, position * base - turn * 0.0001 AS overlay_return
FROM o), {_METRICS.format(k='entity', t='run')} SELECT entity, n, {_METRIC_COLUMNS}
FROM s""")
def expanding_overlay(spark, sf_dir):
    rows = _overlay(spark, sf_dir)
    rows = quantiles.expanding_quantile(rows.select("entity", "date", "base", "score"), "score", K, T, "cut").withColumn("high_risk", F.col("score") >= F.col("cut"))
    return rounded(backtest.strategy_metrics(backtest.overlay(rows, K, T, "base", "high_risk", 0.5), K, T, "overlay_return"))


@query(f"""{_OVER},
ex AS (SELECT entity, date, position * base - turn * 0.0001 - base AS e FROM o),
sums AS (SELECT entity, row_number() OVER ({_W}) AS i, sum(e) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM ex),
sizes AS (SELECT entity, max(i) AS n, arg_max(s, i) AS total FROM sums GROUP BY 1),
prefix AS (SELECT * FROM sums UNION ALL SELECT entity, 0, 0.0 FROM sizes),
plan AS (SELECT entity, n, rep, b, least(20, n - b * 20) AS size, ('0x' || substr(md5(rep || '-' || b || '-7'), 1, 12))::BIGINT % greatest(n - 19, 1) AS begin_
         FROM (SELECT entity, n, unnest(range(1, 2001)) AS rep FROM sizes) JOIN (SELECT entity, unnest(range(0, ceil(n / 20)::BIGINT)) AS b FROM sizes) USING (entity)),
reps AS (SELECT entity, rep, sum(y.s - x.s) / any_value(n) * 252 AS mean FROM plan JOIN prefix x USING (entity) JOIN prefix y USING (entity) WHERE x.i = begin_ AND y.i = begin_ + size GROUP BY 1, 2)
SELECT entity, {R('any_value(total / n * 252)')} AS mean_excess, {R('quantile_cont(mean, 0.05)')} AS p05, {R('quantile_cont(mean, 0.5)')} AS p50, {R('quantile_cont(mean, 0.95)')} AS p95, count(*) AS replicates
FROM reps JOIN sizes USING (entity) GROUP BY entity""")
def block_bootstrap_excess(spark, sf_dir):
    run = backtest.overlay(_overlay(spark, sf_dir), K, T, "base", "high_risk", 0.5)
    return rounded(backtest.block_bootstrap(run.withColumn("excess", F.col("overlay_return") - F.col("base")), K, T, "excess"))


_MONITOR_Z = {c: f"CASE WHEN count({c}) OVER {_PRIOR} >= 126 THEN ({c} - avg({c}) OVER {_PRIOR}) / nullif(stddev_samp({c}) OVER {_PRIOR}, 0) END" for c in ("atm", "dispersion", "vix")}


@query(f"""{_TENOR}, {frames.DAILY},
labelled AS (SELECT *, {_LABEL_5_20} AS label FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
market AS (SELECT date AS week, avg(value) AS atm, stddev_samp(value) AS dispersion FROM tenor WHERE field = 'atm' AND target_days = 30 GROUP BY 1),
joined AS (SELECT l.*, atm, dispersion FROM labelled l LEFT JOIN market m ON m.week = CAST(date_trunc('week', l.date) AS DATE)),
scored AS (SELECT *, {', '.join(f'{sql} AS {c}_z' for c, sql in _MONITOR_Z.items())} FROM joined),
stressed AS (SELECT *, (coalesce(atm_z, 0) + coalesce(dispersion_z, 0) + coalesce(vix_z, 0)) / nullif((atm_z IS NOT NULL)::INT + (dispersion_z IS NOT NULL)::INT + (vix_z IS NOT NULL)::INT, 0) AS stress FROM scored),
q AS (SELECT quantile_cont(stress, 0.9) AS s_cut, quantile_cont(atm_z, 0.9) AS a_cut FROM stressed),
i AS (SELECT 'stress_high' AS indicator, coalesce(stress >= s_cut, false) AS inside, label FROM stressed, q UNION ALL SELECT 'atm_high', coalesce(atm_z >= a_cut, false), label FROM stressed, q)
SELECT indicator, 'label' AS target, {R('count(*) FILTER (inside AND label IS NOT NULL) / count(*)')} AS coverage, {R('avg(label)')} AS base_rate, {R('avg(label) FILTER (inside)')} AS conditional_rate,
       {R('avg(label) FILTER (inside) / nullif(avg(label), 0)')} AS lift FROM i GROUP BY indicator""")
def stress_monitor(spark, sf_dir):
    """End to end: option chain to cross section, stress score, labels and event lift."""
    chain = panel.root_panel(panel.constant_tenor(frames.chain(spark, sf_dir), frames.TIE, target_days=(30,), fields=["atm"]), "atm", 30)
    market = chain.groupBy("date").agg(F.avg("value").alias("atm"), F.stddev_samp("value").alias("dispersion"))
    rows = _labelled(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "date")))
    rows = rows.join(market.withColumnRenamed("date", "week"), "week", "left").withColumns({"atm_z": win.shifted_zscore(F.col("atm"), K, T), "dispersion_z": win.shifted_zscore(F.col("dispersion"), K, T), "vix_z": win.shifted_zscore(VIX(), K, T)})
    rows = rows.withColumn("stress", col_fns.skip_null_mean(F.col("atm_z"), F.col("dispersion_z"), F.col("vix_z")))
    return rounded(lift.conditional_lift(rows, {"stress_high": ("stress", "high"), "atm_high": ("atm_z", "high")}, ["label"]))
