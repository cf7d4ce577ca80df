"""Named queries over the driver tables, and the DuckDB SQL that gives the same rows.

The tables have no market data, so prices, facts and members are derived from orders, line items and suppliers:
weekly maxima of line prices per supplier are prices, orders are filings of eight companies.
Computed doubles are rounded in both, since engines differ in the last bits of sums.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cross_section, filings, panel, pit, portfolio, timeseries
from ..sources import members as member_source
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def query(name: str, sql: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# ---------------------------------------------------------------- inputs

PRICE_SQL = """
p AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, l_suppkey::VARCHAR AS ticker, max(l_extendedprice)::DOUBLE AS close,
  CASE WHEN (l_suppkey + datediff('day', DATE '1995-01-02', date_trunc('week', l_shipdate)::DATE) // 7) % 17 = 0 THEN NULL
  ELSE max(l_extendedprice)::DOUBLE END AS adj_close
  FROM lineitem GROUP BY l_suppkey, date_trunc('week', l_shipdate)::DATE)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close, adj_close) by week; every seventeenth adjusted close is missing."""
    week = F.trunc(F.col("l_shipdate").cast("date"), "week")
    rows = _table(spark, sf_dir, "lineitem").select(week.alias("date"), "l_suppkey", "l_extendedprice")
    weekly = rows.groupBy("date", "l_suppkey").agg(F.max("l_extendedprice").cast("double").alias("close"))
    number = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    gone = (F.col("l_suppkey") + number) % 17 == 0
    return weekly.select("date", F.col("l_suppkey").cast("string").alias("ticker"), "close", F.when(~gone, F.col("close")).alias("adj_close"))


FACT_SQL = """
f AS (SELECT 'T' || lpad((o_custkey % 8)::VARCHAR, 2, '0') AS ticker, lpad((o_custkey % 8)::VARCHAR, 10, '0') AS cik,
  CASE WHEN o_orderkey % 2 = 0 THEN 'revenue' ELSE 'net_income' END AS field,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, 3::BIGINT AS period_months,
  o_totalprice::DOUBLE AS value, lpad(o_orderkey::VARCHAR, 10, '0') AS accn, o_orderkey % 5 = 0 AS derived,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE + (o_orderkey % 120)::INT AS filed,
  (date_trunc('quarter', o_orderdate))::DATE AS period_start
  FROM orders)"""
DATE_SQL = "d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE day(o_orderdate) = 15 AND month(o_orderdate) % 3 = 0)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    start = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    end = F.date_sub(F.add_months(start, 3), 1)
    company = (F.col("o_custkey") % 8).cast("string")
    return o.select(
        F.concat(F.lit("T"), F.lpad(company, 2, "0")).alias("ticker"),
        F.lpad(company, 10, "0").alias("cik"),
        F.when(F.col("o_orderkey") % 2 == 0, "revenue").otherwise("net_income").alias("field"),
        F.lit("us-gaap:Revenues").alias("concept"),
        F.lit("USD").alias("unit"),
        start.alias("period_start"),
        end.alias("period_end"),
        F.lit(3).cast("bigint").alias("period_months"),
        F.col("o_totalprice").cast("double").alias("value"),
        F.year(end).alias("fy"),
        F.concat(F.lit("Q"), F.quarter(end).cast("string")).alias("fp"),
        F.lit("10-Q").alias("form"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accn"),
        F.date_add(end, (F.col("o_orderkey") % 120).cast("int")).alias("filed"),
        (F.col("o_orderkey") % 5 == 0).alias("derived"),
    )


def as_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").where((F.dayofmonth(day) == 15) & (F.month(day) % 3 == 0)).select(day.alias("date")).distinct()


# ---------------------------------------------------------------- time series

_LOG = "ln(adj_close) AS l"
_W = "PARTITION BY ticker ORDER BY date"


def _series(name: str, expression: str, inner: str = "*", source: str = "p") -> str:
    return f"""WITH {PRICE_SQL}, x AS (SELECT date, ticker, close, adj_close, {inner} FROM {source})
SELECT date, ticker, round({expression}, {DIGITS}) + 0.0 AS {name} FROM x WINDOW w AS ({_W})"""


@query("historical_return", _series("historical_return_5", "adj_close / lag(adj_close, 5) OVER w - 1", "1 AS one"))
def _historical_return(spark, sf_dir):
    return rounded(timeseries.historical_return(df=prices(spark, sf_dir), n_periods=5), "historical_return_5")


@query("future_returns", _series("forward_return_5_gap_1", "lead(adj_close, 6) OVER w / lead(adj_close, 1) OVER w - 1", "1 AS one"))
def _future_returns(spark, sf_dir):
    return rounded(timeseries.future_returns(df=prices(spark, sf_dir)), "forward_return_5_gap_1")


@query("log_returns", _series("log_return", "l - lag(l, 1) OVER w", _LOG))
def _log_returns(spark, sf_dir):
    return rounded(timeseries.log_returns(df=prices(spark, sf_dir)), "log_return")


def _cumulative(name: str, window: int, skip: int) -> str:
    return f"""WITH {PRICE_SQL}, r AS (SELECT date, ticker, ln(adj_close) - lag(ln(adj_close), 1) OVER ({_W}) AS r FROM p)
SELECT date, ticker, round(CASE WHEN count(r) OVER v = {window} THEN sum(r) OVER v END, {DIGITS}) + 0.0 AS {name} FROM r
WINDOW v AS ({_W} ROWS BETWEEN {window - 1 + skip} PRECEDING AND {skip} PRECEDING)"""


@query("cumulative_log_returns", _cumulative("cumulative_log_return_6_skip_2", 6, 2))
def _cumulative_log_returns(spark, sf_dir):
    found = timeseries.cumulative_log_returns(prices(spark, sf_dir), 6, skip=2)
    return rounded(found, "cumulative_log_return_6_skip_2")


@query("momentum", _cumulative("momentum_8_skip_1", 8, 1))
def _momentum(spark, sf_dir):
    return rounded(timeseries.momentum(prices(spark, sf_dir), 8, skip=1), "momentum_8_skip_1")


def _close_as_adjusted(spark, sf_dir):
    return prices(spark, sf_dir).withColumn("adj_close", F.col("close"))


@query("momentum_12_1", _cumulative("mom_12_1", 44, 4).replace("adj_close)", "close)"))
def _momentum_12_1(spark, sf_dir):
    return rounded(timeseries.momentum_12_1(df=_close_as_adjusted(spark, sf_dir), trading_days_per_month=4), "mom_12_1")


@query("reversal_raw", _cumulative("x", 5, 2).replace("sum(r) OVER v", "-sum(r) OVER v").replace(" AS x ", " AS reversal_5_skip_2 "))
def _reversal_raw(spark, sf_dir):
    return rounded(timeseries.reversal(prices(spark, sf_dir), 5, skip=2, vol_adjust=False), "reversal_5_skip_2")


@query(
    "reversal_vol",
    f"""WITH {PRICE_SQL}, r AS (SELECT date, ticker, ln(adj_close) - lag(ln(adj_close), 1) OVER ({_W}) AS r FROM p),
s AS (SELECT date, ticker, CASE WHEN count(r) OVER v = 6 AND stddev_samp(r) OVER v > 0 THEN -sum(r) OVER v / stddev_samp(r) OVER v END AS s
  FROM r WINDOW v AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(lag(s, 1) OVER ({_W}), {DIGITS}) + 0.0 AS reversal_6_skip_1_vol FROM s""",
)
def _reversal_vol(spark, sf_dir):
    return rounded(timeseries.reversal(prices(spark, sf_dir), 6, skip=1), "reversal_6_skip_1_vol")


def _vol(name: str, window: int, first: str, last: str) -> str:
    return f"""WITH {PRICE_SQL}, r AS (SELECT date, ticker, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM p)
SELECT date, ticker, round(CASE WHEN count(r) OVER v = {window} THEN stddev_samp(r) OVER v END, {DIGITS}) + 0.0 AS {name} FROM r
WINDOW v AS ({_W} ROWS BETWEEN {first} AND {last})"""


@query("history_vol", _vol("volatility_8", 8, "7 PRECEDING", "CURRENT ROW"))
def _history_vol(spark, sf_dir):
    return rounded(timeseries.history_vol(df=prices(spark, sf_dir), window=8), "volatility_8")


@query("forward_volatility", _vol("forward_volatility_8_gap_1", 8, "2 FOLLOWING", "9 FOLLOWING"))
def _forward_volatility(spark, sf_dir):
    return rounded(timeseries.forward_volatility(df=prices(spark, sf_dir), window=8), "forward_volatility_8_gap_1")


@query("to_panel", _series("price_factor", "adj_close", "1 AS one"))
def _to_panel(spark, sf_dir):
    p = panel.to_date_ticker_frame(df=prices(spark, sf_dir).select("ticker", "date", "adj_close"))
    return rounded(panel.to_panel(p, "price_factor", validate=False), "price_factor")


@query("validate_prices", f"WITH {PRICE_SQL} SELECT date, ticker, close FROM p")
def _validate_prices(spark, sf_dir):
    return panel.validate_prices(df=prices(spark, sf_dir).select("date", "ticker", F.col("close").cast("string").alias("close")))


# ---------------------------------------------------------------- cross section


@query(
    "zscore_by_date",
    f"""WITH {PRICE_SQL} SELECT date, ticker,
round(CASE WHEN stddev_samp(close) OVER v <> 0 THEN (close - avg(close) OVER v) / stddev_samp(close) OVER v END, {DIGITS}) + 0.0 AS close,
round(CASE WHEN stddev_samp(adj_close) OVER v <> 0 THEN (adj_close - avg(adj_close) OVER v) / stddev_samp(adj_close) OVER v END, {DIGITS}) + 0.0 AS adj_close
FROM p WINDOW v AS (PARTITION BY date)""",
)
def _zscore(spark, sf_dir):
    return rounded(cross_section.zscore_by_date(prices(spark, sf_dir)), "close", "adj_close")


def _bucket_sql(source: str, by: str, value: str, n: int, least: int, name: str, keep: str) -> str:
    """CTEs ``{name}_e`` and ``{name}_t``: labels by sorted lists and linear interpolation in the same order of steps."""
    edge = []
    for p in cross_section.probabilities(n):
        place = f"({p!r}::DOUBLE * (len(v) - 1))"
        low = f"floor({place})::BIGINT"
        a, b = f"v[{low} + 1]", f"v[least({low} + 1, len(v) - 1) + 1]"
        t = f"({place} - {low})"
        edge.append(f"CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {t}) ELSE {a} + ({b} - {a}) * {t} END")
    on = " AND ".join(f"s.{c} = e.{c}" for c in by.split(", "))
    return f"""{name}_e AS (SELECT {by}, list_distinct([{", ".join(edge)}]) AS e FROM
  (SELECT {by}, list_sort(list({value} + 0.0)) AS v FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}) WHERE len(v) >= {least}),
{name}_t AS (SELECT {keep}, CASE WHEN len(e.e) > 1 AND s.{value} IS NOT NULL
  THEN greatest(len(list_filter(e.e, lambda z: z < s.{value} + 0.0)) - 1, 0)::INT END AS {name}
  FROM {source} s LEFT JOIN {name}_e e ON {on})"""


@query("simple_bucket", f"WITH {PRICE_SQL}, {_bucket_sql('p', 'date', 'adj_close', 5, 5, 'bucket', 's.date, s.ticker')} SELECT * FROM bucket_t")
def _simple_bucket(spark, sf_dir):
    return cross_section.simple_bucket(prices(spark, sf_dir), score_col="adj_close")


_VOL_INPUT = f"""r AS (SELECT date, ticker, adj_close AS score, close, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM p),
v0 AS (SELECT date, ticker, score, round(CASE WHEN count(r) OVER v = 4 THEN stddev_samp(r) OVER v END, 10) AS vol FROM r
  WINDOW v AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
v1 AS (SELECT date, ticker, CASE WHEN vol IS NOT NULL THEN score END AS x, CASE WHEN score IS NOT NULL THEN vol END AS vol FROM v0)"""


@query(
    "vol_bucket",
    f"""WITH {PRICE_SQL}, {_VOL_INPUT}, {_bucket_sql("v1", "date", "vol", 3, 6, "vol_bucket", "s.date, s.ticker, s.x")},
v2 AS (SELECT date, ticker, vol_bucket, CASE WHEN vol_bucket IS NOT NULL THEN x END AS x FROM vol_bucket_t),
{_bucket_sql("v2", "date, vol_bucket", "x", 2, 2, "bucket", "s.date, s.ticker, s.vol_bucket")}
SELECT date, ticker, vol_bucket, bucket FROM bucket_t""",
)
def _vol_bucket(spark, sf_dir):
    p = prices(spark, sf_dir)
    vol = timeseries.history_vol(df=p, window=4)
    rows = p.join(vol.withColumn("vol", F.round("volatility_4", 10)), ["date", "ticker"])
    return cross_section.vol_bucket(rows, score_col="adj_close", vol_col="vol", n_quantiles=2, n_vol_groups=3)


# ---------------------------------------------------------------- calendar and portfolio

_CAL = "c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM p))"


@query("rebalance_dates", f"WITH {PRICE_SQL}, {_CAL} SELECT date FROM c WHERE k % 4 = 0")
def _rebalance_dates(spark, sf_dir):
    return portfolio.rebalance_dates(prices(spark, sf_dir), 4)


@query("rebalance_dates_belong", f"WITH {PRICE_SQL}, {_CAL} SELECT date, first(date) OVER (PARTITION BY k // 4 ORDER BY date) AS rebalance_date FROM c")
def _rebalance_dates_belong(spark, sf_dir):
    return portfolio.rebalance_dates_belong(prices(spark, sf_dir), 4)


@query(
    "buy_and_hold_nav",
    f"""WITH {PRICE_SQL}, b AS (SELECT ticker, close AS base FROM p WHERE date = (SELECT min(date) FROM p)),
g AS (SELECT date, avg(close / base) AS m, count(close) AS n FROM p JOIN b USING (ticker) GROUP BY date)
SELECT date, round(CASE WHEN n = (SELECT count(*) FROM b) THEN 100.0 * m END, {DIGITS}) + 0.0 AS nav
FROM (SELECT DISTINCT date FROM p) LEFT JOIN g USING (date)""",
)
def _buy_and_hold(spark, sf_dir):
    return rounded(portfolio.buy_and_hold_nav(prices(spark, sf_dir), 100.0), "nav")


@query(
    "build_nav",
    f"""WITH {PRICE_SQL}, r AS (SELECT date, close / lag(close, 1) OVER ({_W}) - 1 AS r FROM p),
a AS (SELECT date, CASE WHEN date = (SELECT min(date) FROM p) THEN 0.0 ELSE round(avg(r) / 100, 8) END AS r FROM r GROUP BY date)
SELECT date, round(CASE WHEN count(CASE WHEN r IS NULL THEN 1 END) OVER v = 0 THEN 100.0 * product(1 + r) OVER v END, 6) + 0.0 AS nav FROM a
WINDOW v AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _build_nav(spark, sf_dir):
    returns = timeseries.historical_return(df=prices(spark, sf_dir), n_periods=1, price_col="close")
    daily = returns.groupBy("date").agg(F.round(F.avg("historical_return_1") / 100, 8).alias("r"))
    first = F.col("date") == F.min("date").over(W.partitionBy(F.lit(1)))
    daily = daily.select("date", F.when(first, F.lit(0.0)).otherwise(F.col("r")).alias("r"))
    return rounded(portfolio.build_nav(daily, 100.0), "nav", digits=6)


_QFR = f"""WITH {PRICE_SQL}, {_CAL}, rb AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM c WHERE k % 4 = 0),
l AS (SELECT date, ticker, ln(close) - lag(ln(close), 1) OVER ({_W}) AS r FROM p),
m AS (SELECT date, ticker, round(CASE WHEN count(r) OVER v = 44 THEN sum(r) OVER v END, 8) AS mom FROM l
  WINDOW v AS ({_W} ROWS BETWEEN 47 PRECEDING AND 4 PRECEDING)),
z AS (SELECT date, ticker, round(CASE WHEN stddev_samp(mom) OVER v <> 0 THEN (mom - avg(mom) OVER v) / stddev_samp(mom) OVER v END, 6) + 0.0 AS score
  FROM m JOIN rb USING (date) WINDOW v AS (PARTITION BY date)),
{_bucket_sql("z", "date", "score", 5, 5, "bucket", "s.date, s.ticker")},
f AS (SELECT a.date, a.ticker, b.close / a.close - 1 AS r FROM p a JOIN rb USING (date) LEFT JOIN p b ON b.date = rb.nxt AND b.ticker = a.ticker),
g AS (SELECT date, bucket, avg(r) AS r FROM bucket_t LEFT JOIN f USING (date, ticker) WHERE bucket IS NOT NULL GROUP BY date, bucket)
SELECT d.date, 'QUANTILE_' || d.b AS ticker, round(g.r, {DIGITS}) + 0.0 AS forward_return
FROM (SELECT DISTINCT date, unnest(range(5)) AS b FROM z) d LEFT JOIN g ON g.date = d.date AND g.bucket = d.b"""


@query("quantile_forward_returns", _QFR)
def _quantile_forward_returns(spark, sf_dir):
    """Momentum, z-scored by rebalance date, bucketed, and each bucket's return to the next rebalance date."""
    p = _close_as_adjusted(spark, sf_dir)
    mom = timeseries.momentum_12_1(df=p, trading_days_per_month=4).withColumn("mom_12_1", F.round("mom_12_1", 8))
    days = portfolio.rebalance_dates(p, 4)
    scores = cross_section.zscore_by_date(mom.join(F.broadcast(days), "date", "left_semi"))
    scores = scores.select("date", "ticker", (F.round("mom_12_1", 6) + F.lit(0.0)).alias("score"))
    found = portfolio.quantile_forward_returns(scores, p, freq=4, validate=False)
    return rounded(found, "forward_return")


# ---------------------------------------------------------------- stored tables and fundamentals


@query(
    "load_prices",
    f"WITH {PRICE_SQL} SELECT date, ticker, close, adj_close FROM p WHERE ticker IN ('1', '2', '5', '7') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-02'",
)
def _load_prices(spark, sf_dir):
    return store.select_prices(prices(spark, sf_dir), ["1", "2", " 5", "7"], "1996-01-01", "1997-06-02").orderBy("ticker", "date")


@query("load_constituents", "SELECT s_suppkey::VARCHAR AS ticker, s_name AS name FROM supplier WHERE s_suppkey BETWEEN 1 AND 5")
def _load_constituents(spark, sf_dir):
    found = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"))
    return store.select_prices(found, ["1", "2", "3", "4", "5"]).orderBy("ticker")


@query("load_prices_whole", f"WITH {PRICE_SQL} SELECT date, ticker, close, adj_close FROM p")
def _load_prices_whole(spark, sf_dir):
    return store.select_prices(prices(spark, sf_dir)).orderBy("ticker", "date")


@query("load_constituents_whole", "SELECT s_suppkey::VARCHAR AS ticker, s_name AS name FROM supplier")
def _load_constituents_whole(spark, sf_dir):
    found = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"))
    return store.select_prices(found).orderBy("ticker")


_RAW = "ticker, field, period_end, period_months, filed, accn, value, derived"


@query("fundamentals_raw", f"WITH {FACT_SQL} SELECT {_RAW} FROM f WHERE field = 'revenue' AND period_end BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND filed <= DATE '1996-10-15'")
def _fundamentals_raw(spark, sf_dir):
    found = pit.load_fundamentals(facts(spark, sf_dir), None, "revenue", "1995-01-01", "1996-12-31", filed_until="1996-10-15")
    return found.select(*_RAW.split(", "))


_PIT = "ticker, field, period_months, period_start, period_end, value, accn, filed, derived"
_BEST = "filed DESC, derived ASC, accn DESC"


@query(
    "pit_latest",
    f"""WITH {FACT_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, field, period_months ORDER BY period_end DESC, {_BEST}) AS k
FROM f WHERE filed <= DATE '1996-08-15' AND period_end >= DATE '1996-08-15' - 400) SELECT {_PIT} FROM x WHERE k = 1""",
)
def _pit_latest(spark, sf_dir):
    return pit.load_fundamentals_pit(facts(spark, sf_dir), "1996-08-15", max_staleness_days=400).select(*_PIT.split(", "))


@query(
    "pit_all_periods",
    f"""WITH {FACT_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, field, period_months, period_end ORDER BY {_BEST}) AS k
FROM f WHERE filed <= DATE '1997-02-15') SELECT {_PIT} FROM x WHERE k = 1""",
)
def _pit_all(spark, sf_dir):
    return pit.load_fundamentals_pit(facts(spark, sf_dir), "1997-02-15", latest_only=False).select(*_PIT.split(", "))


_PANEL_SQL = f"""j AS (SELECT d.date, f.*, row_number() OVER (PARTITION BY d.date, ticker, field, period_months ORDER BY period_end DESC, {_BEST}) AS k
FROM d JOIN f ON filed <= d.date AND period_end >= d.date - 550)"""


@query("panel", f"WITH {FACT_SQL}, {DATE_SQL}, {_PANEL_SQL} SELECT date, ticker, field, period_months, period_end, value, filed FROM j WHERE k = 1")
def _panel(spark, sf_dir):
    return pit.load_fundamentals_panel(facts(spark, sf_dir), as_of_dates(spark, sf_dir))


_TTM_SQL = f"""v AS (SELECT d.date, ticker, field, period_end, value, row_number() OVER (PARTITION BY d.date, ticker, field, period_end ORDER BY {_BEST}) AS rn
  FROM d JOIN f ON filed <= d.date AND period_end >= d.date - 500 WHERE period_months = 3),
q AS (SELECT date, ticker, field, period_end, value, row_number() OVER u AS k, lag(period_end) OVER u AS newer FROM v WHERE rn = 1
  WINDOW u AS (PARTITION BY date, ticker, field ORDER BY period_end DESC)),
t AS (SELECT date, ticker, field, max(period_end) AS period_end, min(period_end) AS first_end, count(*) AS n, sum(value) AS value,
  count(*) FILTER (WHERE datediff('day', period_end, newer) BETWEEN 70 AND 125) AS gaps FROM q WHERE k <= 4 GROUP BY ALL),
ttm AS (SELECT date, ticker, field, period_end, round(value, 4) AS value FROM t WHERE n = 4 AND gaps = 3
  AND datediff('day', first_end, period_end) BETWEEN 250 AND 300 AND period_end >= date - 200)"""


def _ttm_frame(spark, sf_dir):
    return rounded(pit.load_fundamentals_ttm(facts(spark, sf_dir), as_of_dates(spark, sf_dir)), "value", digits=4)


@query("ttm", f"WITH {FACT_SQL}, {DATE_SQL}, {_TTM_SQL} SELECT * FROM ttm")
def _ttm(spark, sf_dir):
    return _ttm_frame(spark, sf_dir)


@query("latest_filed", f"WITH {FACT_SQL} SELECT ticker, max(filed) AS last_filed FROM f GROUP BY ticker")
def _latest_filed(spark, sf_dir):
    return pit.load_latest_filed(facts(spark, sf_dir))


@query(
    "feature_pivot",
    f"""WITH {FACT_SQL}, {DATE_SQL}, {_TTM_SQL},
w AS (SELECT date, ticker, max(value) FILTER (WHERE field = 'revenue') AS revenue_ttm, max(value) FILTER (WHERE field = 'net_income') AS net_income_ttm FROM ttm GROUP BY ALL)
SELECT g.date, g.ticker, revenue_ttm, net_income_ttm, round(CASE WHEN revenue_ttm > 0 THEN net_income_ttm / revenue_ttm END, {DIGITS}) + 0.0 AS net_margin_ttm
FROM (SELECT * FROM d CROSS JOIN (SELECT DISTINCT ticker FROM f)) g LEFT JOIN w USING (date, ticker)""",
)
def _feature_pivot(spark, sf_dir):
    days, known = as_of_dates(spark, sf_dir), facts(spark, sf_dir)
    ttm = _ttm_frame(spark, sf_dir)
    empty = pit.load_fundamentals_panel(known.where("false"), days)
    found = pit.feature_table(empty, ttm, known, days, ["total_assets"], ["revenue", "net_income"]).drop("total_assets")
    return rounded(found, "net_margin_ttm")


@query(
    "coverage",
    f"""WITH {FACT_SQL}, {DATE_SQL}, {_TTM_SQL} SELECT d.date, count(value) FILTER (WHERE field = 'revenue') AS revenue_ttm,
count(value) FILTER (WHERE field = 'net_income') AS net_income_ttm FROM d LEFT JOIN ttm USING (date) GROUP BY d.date""",
)
def _coverage(spark, sf_dir):
    return pit.coverage(_feature_pivot(spark, sf_dir).drop("net_margin_ttm"))


# ---------------------------------------------------------------- filings

_BRACKETS = "CASE WHEN days BETWEEN 70 AND 125 THEN 3 WHEN days BETWEEN 150 AND 210 THEN 6 WHEN days BETWEEN 230 AND 300 THEN 9 WHEN days BETWEEN 330 AND 390 THEN 12 WHEN days IS NULL THEN 0 ELSE round_even(days / (365.25 / 12), 0) END::BIGINT"


@query(
    "period_months",
    f"SELECT o_orderkey AS id, {_BRACKETS} AS months FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 450 + 1)::INT END AS days FROM orders)",
)
def _period_months(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    end = F.lit("2020-12-31").cast("date")
    start = F.when(F.col("o_orderkey") % 7 != 0, F.date_sub(end, (F.col("o_orderkey") % 450).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), filings.period_months(start, end).alias("months"))


#: Eight customers are a company, so that companies stay as small as the table grows. Every thirteenth value is over an unusual
#: span (4, 7, 10 or 13 months), which no quarter is derived from.
YTD_SQL = """y AS (SELECT 'T' || lpad((o_custkey // 8)::VARCHAR, 10, '0') AS ticker, lpad((o_custkey // 8)::VARCHAR, 10, '0') AS cik,
  CASE WHEN o_orderkey % 2 = 0 THEN 'revenue' ELSE 'net_income' END AS field, date_trunc('year', o_orderdate)::DATE AS period_start,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
  (quarter(o_orderdate) * 3 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END)::BIGINT AS period_months,
  'c' || (o_orderkey % 3) AS concept, lpad(o_orderkey::VARCHAR, 10, '0') AS accn,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE + (o_orderkey % 120)::INT AS filed, round(o_totalprice::DOUBLE, 2) AS value
  FROM orders)"""


def _year_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    end = F.date_sub(F.add_months(start, 3), 1)
    company = F.lpad(F.expr("o_custkey div 8").cast("string"), 10, "0")
    return o.select(
        F.concat(F.lit("T"), company).alias("ticker"),
        company.alias("cik"),
        F.when(key % 2 == 0, "revenue").otherwise("net_income").alias("field"),
        F.concat(F.lit("c"), (key % 3).cast("string")).alias("concept"),
        F.lit("USD").alias("unit"),
        F.trunc(F.col("o_orderdate").cast("date"), "year").alias("period_start"),
        end.alias("period_end"),
        (F.quarter("o_orderdate") * 3 + F.when(key % 13 == 0, 1).otherwise(0)).cast("bigint").alias("period_months"),
        F.round(F.col("o_totalprice").cast("double"), 2).alias("value"),
        F.year(end).alias("fy"),
        F.concat(F.lit("Q"), F.quarter(end).cast("string")).alias("fp"),
        F.lit("10-Q").alias("form"),
        F.lpad(key.cast("string"), 10, "0").alias("accn"),
        F.date_add(end, (key % 120).cast("int")).alias("filed"),
        F.lit(False).alias("derived"),
    )


_QUARTER = "ticker, field, accn, period_start, period_end, period_months, value, derived"


@query(
    "derive_quarters",
    f"""WITH {YTD_SQL}, m AS (SELECT a.ticker, a.field, a.accn, a.period_end, a.period_months, a.value - b.value AS value, b.period_end + 1 AS period_start,
  row_number() OVER (PARTITION BY a.ticker, a.field, a.accn, a.period_end, a.period_months
  ORDER BY (a.concept = b.concept) DESC, b.filed DESC, b.accn DESC) AS k FROM y a JOIN y b
  ON a.ticker = b.ticker AND a.cik = b.cik AND a.field = b.field AND a.period_start = b.period_start AND b.period_months = a.period_months - 3
  AND b.filed <= a.filed AND datediff('day', b.period_end, a.period_end) BETWEEN 70 AND 125 WHERE a.period_months IN (6, 9, 12))
SELECT ticker, field, accn, period_start, period_end, period_months, round(value, 2) + 0.0 AS value, false AS derived FROM y UNION ALL
SELECT ticker, field, accn, period_start, period_end, 3, round(value, 2) + 0.0, true FROM m WHERE k = 1""",
)
def _derive_quarters(spark, sf_dir):
    return rounded(filings.derive_quarters(_year_to_date(spark, sf_dir)).select(*_QUARTER.split(", ")), "value", digits=2)


@query(
    "standardize_facts",
    """WITH r AS (SELECT 'T' || (o_custkey % 8) AS ticker, lpad((o_custkey % 8)::VARCHAR, 10, '0') AS cik,
  ['Revenues', 'SalesRevenueNet', 'NetIncomeLoss', 'ProfitLoss', 'Other'][(o_orderkey % 5 + 1)::INT] AS concept,
  date_trunc('quarter', o_orderdate)::DATE AS period_start, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
  round(o_totalprice::DOUBLE, 2) AS value, (o_orderkey // 64)::VARCHAR AS accn, o_orderdate::DATE + 30 AS filed,
  CASE WHEN o_orderkey % 11 = 0 THEN '8-K' ELSE '10-Q' END AS form, o_orderkey AS ordinal FROM orders),
x AS (SELECT *, CASE WHEN concept IN ('Revenues', 'SalesRevenueNet') THEN 'revenue' ELSE 'net_income' END AS field,
  CASE concept WHEN 'Revenues' THEN 1 WHEN 'SalesRevenueNet' THEN 4 WHEN 'NetIncomeLoss' THEN 0 ELSE 2 END AS priority FROM r WHERE concept <> 'Other' AND form = '10-Q'),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, cik, field, accn, period_end ORDER BY priority, filed, ordinal) AS k FROM x)
SELECT ticker, field, 'us-gaap:' || concept AS concept, period_start, period_end, 3::BIGINT AS period_months, value, accn, filed FROM k WHERE k = 1""",
)
def _standardize(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    start = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    company = (F.col("o_custkey") % 8).cast("string")
    names = F.array(*[F.lit(n) for n in ("Revenues", "SalesRevenueNet", "NetIncomeLoss", "ProfitLoss", "Other")])
    raw = o.select(
        F.concat(F.lit("T"), company).alias("ticker"),
        F.lpad(company, 10, "0").alias("cik"),
        F.lit("us-gaap").alias("taxonomy"),
        F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("concept"),
        F.lit("USD").alias("unit"),
        start.alias("period_start"),
        F.date_sub(F.add_months(start, 3), 1).alias("period_end"),
        F.round(F.col("o_totalprice").cast("double"), 2).alias("value"),
        F.lit(None).cast("int").alias("fy"),
        F.lit(None).cast("string").alias("fp"),
        F.when(F.col("o_orderkey") % 11 == 0, "8-K").otherwise("10-Q").alias("form"),
        F.floor(F.col("o_orderkey") / 64).cast("string").alias("accn"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("filed"),
        F.col("o_orderkey").alias("ordinal"),
    )
    return filings.standardize_facts(raw).select("ticker", "field", "concept", "period_start", "period_end", "period_months", "value", "accn", "filed")


@query(
    "quarantine",
    f"""WITH {FACT_SQL}, s AS (SELECT ticker, accn, CASE WHEN value > 200000 THEN period_end - 400 ELSE filed END AS filed, period_end FROM f)
SELECT ticker, accn, period_end, filed, period_end > filed AS bad FROM s""",
)
def _quarantine(spark, sf_dir):
    late = facts(spark, sf_dir).withColumn("filed", F.when(F.col("value") > 200000, F.date_sub("period_end", 400)).otherwise(F.col("filed")))
    good, bad = filings.quarantined(late)
    both = good.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True)))
    return both.select("ticker", "accn", "period_end", "filed", "bad")


@query(
    "combine_versions",
    f"""WITH {FACT_SQL}, e AS (SELECT ticker, lpad((accn::BIGINT % 3)::VARCHAR, 10, '0') AS cik, field, period_end, period_months, (accn::BIGINT // 32)::VARCHAR AS accn,
  filed, derived, value FROM f),
x AS (SELECT *, row_number() OVER (PARTITION BY ticker, field, period_end, period_months, accn
  ORDER BY filed DESC, derived ASC, (cik = '0000000001') DESC, cik DESC, value DESC) AS k FROM e)
SELECT ticker, field, period_end, period_months, accn, filed, derived, cik FROM x WHERE k = 1""",
)
def _combine(spark, sf_dir):
    known = facts(spark, sf_dir)
    number = F.col("accn").cast("bigint")
    many = known.withColumns({"cik": F.lpad((number % 3).cast("string"), 10, "0"), "accn": F.floor(number / 32).cast("string")})
    current = known.select("ticker").distinct().withColumn("cik", F.lit("0000000001"))
    return filings.combine_entities(many, current).select("ticker", "field", "period_end", "period_months", "accn", "filed", "derived", "cik")


# ---------------------------------------------------------------- writes and identifiers

_WEEK = "(datediff('day', DATE '1995-01-02', date) // 7)"


@query(
    "price_upsert",
    f"""WITH {PRICE_SQL}, old AS (SELECT ticker, date, close, 'old' AS source FROM p WHERE {_WEEK} % 2 = 0),
new AS (SELECT ticker, date, close + 1 AS close FROM p WHERE ticker::BIGINT % 3 = 0)
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.ticker = old.ticker AND new.date = old.date)
UNION ALL SELECT ticker, date, close, NULL FROM new""",
)
def _price_upsert(spark, sf_dir):
    p = prices(spark, sf_dir).select("ticker", "date", "close")
    week = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    old = p.where(week % 2 == 0).withColumn("source", F.lit("old"))
    new = p.where(F.col("ticker").cast("bigint") % 3 == 0).withColumn("close", F.col("close") + 1)
    return store.upsert(old, new, ["ticker", "date"])


@query(
    "scope_replace",
    f"""WITH {FACT_SQL}, n AS (SELECT ticker, field, accn, value + 1 AS value FROM f WHERE ticker = 'T01' AND field = 'revenue')
SELECT ticker, field, accn, value FROM f WHERE NOT (ticker IN ('T01', 'T02') AND field = 'revenue') UNION ALL SELECT * FROM n""",
)
def _scope_replace(spark, sf_dir):
    old = facts(spark, sf_dir).select("ticker", "field", "accn", "value")
    new = old.where("ticker = 'T01' AND field = 'revenue'").withColumn("value", F.col("value") + 1)
    scope = spark.createDataFrame([("T01", "revenue"), ("T02", "revenue")], "ticker string, field string")
    return store.replace_scope(old, new, scope)


@query(
    "normalize_members",
    """SELECT upper(replace(trim(n), '.', '-')) AS ticker, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS cik
FROM (SELECT *, ' abc.' || s_suppkey || ' ' AS n FROM supplier)""",
)
def _normalize_members(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    rows = s.select(F.concat(F.lit(" abc."), key, F.lit(" ")).alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, key).alias("cik"))
    return member_source.normalize_members(rows)


@query(
    "sec_mapping",
    """SELECT s_suppkey::VARCHAR AS ticker, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 OR s_suppkey % 3 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS cik,
CASE WHEN s_suppkey % 3 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS sec_cik, CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END AS sec_title FROM supplier""",
)
def _sec_mapping(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    s = _table(spark, sf_dir, "supplier").withColumn("cik", F.lpad(key, 10, "0"))
    members = s.select(key.alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("cik")).alias("cik"))
    sec = s.where("s_suppkey % 3 <> 0").select(key.alias("ticker"), F.col("cik").alias("sec_cik"), F.concat(F.lit("S"), key).alias("sec_title"))
    return member_source.with_sec_mapping(member_source.normalize_members(members), sec)


@query(
    "as_of_prices",
    f"""WITH {PRICE_SQL}, {_CAL}, rb AS (SELECT date, first(date) OVER (PARTITION BY k // 4 ORDER BY date) AS rebalance_date FROM c)
SELECT p.ticker, rb.rebalance_date, count(*) AS weeks, max(p.close) AS top FROM p JOIN rb USING (date) GROUP BY ALL""",
)
def _as_of_prices(spark, sf_dir):
    p = prices(spark, sf_dir)
    belongs = portfolio.rebalance_dates_belong(p, 4)
    return p.join(F.broadcast(belongs), "date").groupBy("ticker", "rebalance_date").agg(F.count("*").alias("weeks"), F.max("close").alias("top"))


# ---------------------------------------------------------------- aligned factors, stored tables and files


@query(
    "align_factors",
    f"""WITH {PRICE_SQL}, a AS (SELECT date, ticker, close AS early FROM p WHERE date < DATE '1997-01-06'),
b AS (SELECT date, ticker, adj_close AS late FROM p WHERE date >= DATE '1996-01-01') SELECT date, ticker, early, late FROM a FULL JOIN b USING (date, ticker)""",
)
def _align_factors(spark, sf_dir):
    p = prices(spark, sf_dir)
    early = p.where("date < DATE '1997-01-06'").select("date", "ticker", F.col("close").alias("early"))
    late = p.where("date >= DATE '1996-01-01'").select("date", "ticker", F.col("adj_close").alias("late"))
    return panel.align(early, late)


@query("simple_returns", _series("simple_return", "exp(l - lag(l, 1) OVER w) - 1", _LOG))
def _simple_returns(spark, sf_dir):
    return rounded(timeseries.simple_returns(timeseries.log_returns(df=prices(spark, sf_dir)), "log_return"), "simple_return")


@query(
    "wide_and_long",
    f"""WITH {PRICE_SQL}, t AS (SELECT unnest(['1', '2', '3', '5', '8']) AS ticker)
SELECT d.date, t.ticker, p.close FROM (SELECT DISTINCT date FROM p) d CROSS JOIN t LEFT JOIN p ON p.date = d.date AND p.ticker = t.ticker""",
)
def _wide_and_long(spark, sf_dir):
    return panel.to_long(panel.to_wide(prices(spark, sf_dir), "close", ["1", "2", "3", "5", "8"]), "close")


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a local one where they are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


@query(
    "company_facts",
    """SELECT lpad((o_custkey // 8)::VARCHAR, 10, '0') AS cik, 'E' || (o_custkey // 8) AS entity, 'us-gaap' AS taxonomy,
CASE WHEN o_orderkey % 2 = 0 THEN 'Revenues' ELSE 'NetIncomeLoss' END AS concept, 'USD' AS unit, date_trunc('quarter', o_orderdate)::DATE AS period_start,
o_orderdate::DATE AS period_end, round(o_totalprice::DOUBLE, 2) AS value, lpad(o_orderkey::VARCHAR, 10, '0') AS accn, o_orderdate::DATE + 30 AS filed
FROM orders WHERE o_orderkey % 7 <> 0""",
)
def _company_facts(spark, sf_dir):
    """Orders as one JSON document per company, of which every seventh item lacks its value, and read from that."""
    o, key = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    item = F.struct(
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").cast("string").alias("start"),
        day.cast("string").alias("end"),
        F.when(key % 7 != 0, F.round(F.col("o_totalprice").cast("double"), 2)).alias("val"),
        F.lpad(key.cast("string"), 10, "0").alias("accn"),
        F.date_add(day, 30).cast("string").alias("filed"),
    )
    concept = F.when(key % 2 == 0, "Revenues").otherwise("NetIncomeLoss").alias("concept")
    by_concept = o.groupBy(F.expr("o_custkey div 8").alias("cik"), concept).agg(F.collect_list(item).alias("USD"))
    specs = F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.struct("USD").alias("units")).alias("spec"))))
    documents = by_concept.groupBy("cik").agg(F.struct(specs.alias("us-gaap")).alias("facts"))
    payload = F.to_json(F.struct("cik", F.concat(F.lit("E"), F.col("cik").cast("string")).alias("entityName"), "facts"))
    found = filings.parse_company_facts(documents.select(payload.alias("payload")), ["us-gaap:Revenues", "us-gaap:NetIncomeLoss"])
    return found.select("cik", "entity", "taxonomy", "concept", "unit", "period_start", "period_end", "value", "accn", "filed")


@query(
    "member_files",
    """SELECT s_suppkey::VARCHAR AS ticker, s_name AS name, lpad(s_suppkey::VARCHAR, 10, '0') AS cik,
CASE WHEN s_suppkey % 3 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS sec_cik, CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END AS sec_title FROM supplier""",
)
def _member_files(spark, sf_dir):
    """Suppliers written as a CSV snapshot and a JSON mapping, loaded, saved and read from the store."""
    root, key = _folder(spark), F.col("s_suppkey").cast("string")
    s = _table(spark, sf_dir, "supplier")
    s.select(key.alias("ticker"), F.col("s_name").alias("name"), key.alias("cik")).write.csv(f"{root}/members.csv", header=True)
    entry = F.struct(key.alias("k"), F.struct(key.alias("ticker"), F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("S"), key).alias("title")).alias("v"))
    mapping = s.where("s_suppkey % 3 <> 0").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    mapping.write.text(f"{root}/tickers.json")
    db = store.get_catalog(spark, path=f"{root}/db", read_only=False)
    store.save_members(db, member_source.load_members(spark, f"{root}/members.csv", sec_tickers=f"{root}/tickers.json"))
    return store.load_constituents(db=db).select("ticker", "name", "cik", "sec_cik", "sec_title")


@query(
    "stored_prices",
    f"""WITH {PRICE_SQL} SELECT date, ticker, CASE WHEN ticker::BIGINT % 3 = 0 THEN close + 1 ELSE close END AS close,
CASE WHEN ticker::BIGINT % 3 <> 0 THEN adj_close END AS adj_close FROM p""",
)
def _stored_prices(spark, sf_dir):
    """Prices saved, a third of the tickers saved again with other values, and read from the store."""
    db = store.get_catalog(spark, path=_folder(spark), read_only=False)
    empty = [F.lit(None).cast("double").alias(c) for c in ("open", "high", "low", "volume")]
    p = prices(spark, sf_dir).select("*", *empty)
    store.save_prices(db, p)
    again = p.where(F.col("ticker").cast("bigint") % 3 == 0)
    store.save_prices(db, again.withColumns({"close": F.col("close") + 1, "adj_close": F.lit(None).cast("double")}))
    return store.load_prices(db=db).select("date", "ticker", "close", "adj_close")


@query("release_prices", f"WITH {PRICE_SQL} SELECT date, ticker, close, adj_close FROM p WHERE ticker <> '3'")
def _release_prices(spark, sf_dir):
    """A release saved over an earlier one, and read without its tag."""
    db = store.get_catalog(spark, path=_folder(spark), read_only=False)
    p = prices(spark, sf_dir)
    store.save_qlib_prices(db=db, prices=p.where("ticker = '3'").drop("adj_close"), release_tag="2024-01-01")
    store.save_qlib_prices(db=db, prices=p.where("ticker <> '3'"), release_tag="2024-02-01")
    return store.load_qlib_prices(db=db)


@query(
    "stored_fundamentals",
    f"""WITH {FACT_SQL} SELECT ticker, field, accn, value FROM f WHERE NOT (ticker IN ('T01', 'T02') AND field = 'revenue')
UNION ALL SELECT ticker, field, accn, value + 1 FROM f WHERE ticker = 'T01' AND field = 'revenue'""",
)
def _stored_fundamentals(spark, sf_dir):
    """Facts saved, one scope of them saved again, and read by the point-in-time reader."""
    db = store.get_catalog(spark, path=_folder(spark), read_only=False)
    known = facts(spark, sf_dir)
    bad = known.where("value is null")
    store.save_fundamentals(db, known, bad, [f"T{k:02d}" for k in range(8)], ["revenue", "net_income"])
    again = known.where("ticker = 'T01' AND field = 'revenue'").withColumn("value", F.col("value") + 1)
    store.save_fundamentals(db, again, bad, ["T01", "T02"], ["revenue"])
    return pit.load_fundamentals(db.read("fundamentals")).select("ticker", "field", "accn", "value")
