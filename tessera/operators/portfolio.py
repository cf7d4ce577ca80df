"""Rebalancing calendars, portfolio values and quantile returns.

Windows over a whole calendar see one row per date, however large the panel is.
"""

from __future__ import annotations

import math
from numbers import Real

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checks import columns, number, refuse, whole
from .cross_section import N_QUANTILES, simple_bucket
from .panel import KEYS, priced


def _by_date() -> WindowSpec:
    """The whole calendar in order: one row per date."""
    return W.orderBy("date")


def _calendar(dates: DataFrame) -> DataFrame:
    columns(dates, "date")
    return dates.select(refuse(F.col("date").isNull(), "a date is null", F.col("date")).alias("date")).distinct()


def rebalance_dates_belong(dates: DataFrame, freq: int) -> DataFrame:
    """(date, rebalance_date): each distinct date and the latest rebalance date up to it."""
    n = whole("freq", freq, 1)
    placed = _calendar(dates).withColumn("k", F.floor((F.row_number().over(_by_date()) - 1) / n))
    return placed.select("date", F.first("date").over(W.partitionBy("k").orderBy("date")).alias("rebalance_date"))


def rebalance_dates(dates: DataFrame, freq: int) -> DataFrame:
    """(date): the distinct dates, every freq-th from the first."""
    n = whole("freq", freq, 1)
    placed = _calendar(dates).withColumn("k", F.row_number().over(_by_date()) - 1)
    return placed.where(F.col("k") % n == 0).select("date")


def buy_and_hold_nav(price: DataFrame, initial_capital: float = 1.0, *, price_col: str = "close", validate: bool = True) -> DataFrame:
    """(date, nav): equal money in every ticker priced on the first date, never traded again.

    A date where a member has no price has no value; all dates of the input are there. Without a priced member on the
    first date it is a ValueError (one job, skipped with validate=False).
    """
    if isinstance(initial_capital, bool) or not isinstance(initial_capital, (int, float)):
        raise TypeError("initial_capital must be a number")
    if not math.isfinite(initial_capital) or initial_capital <= 0:
        raise ValueError("initial_capital must be finite and above 0")
    rows = priced(price, price_col)
    rows = rows.withColumn("p", refuse(F.col("p") == float("inf"), "prices must be finite", F.col("p")))
    first = rows.groupBy("date").agg(F.count("p").alias("members")).agg(F.min(F.struct("date", "members")).alias("first")).select("first.*")
    if validate:
        start = first.first()
        if not start["members"]:
            raise ValueError("no ticker has a price on the first date")
        day, members = F.lit(start["date"]).cast(rows.schema["date"].dataType), F.lit(start["members"])
    else:
        rows = rows.crossJoin(F.broadcast(first.toDF("__first", "__members")))  # one row
        day, members = F.col("__first"), F.col("__members")
    base = F.max(F.when(F.col("date") == day, F.col("p"))).over(W.partitionBy("ticker"))
    growth = rows.withColumns({"growth": F.col("p") / base, "members": members}).groupBy("date")
    found = growth.agg(F.avg("growth").alias("mean"), F.count("growth").alias("n"), F.first("members").alias("members"))
    return found.select("date", F.when(F.col("n") == F.col("members"), F.lit(float(initial_capital)) * F.col("mean")).alias("nav"))


def build_nav(daily_returns: DataFrame, initial_capital: float = 1.0, *, return_col: str | None = None) -> DataFrame:
    """(date, nav): capital times the running product of 1 + r, null from the first missing return on."""
    if isinstance(initial_capital, bool) or not isinstance(initial_capital, Real):
        raise TypeError("initial_capital must be a number")
    if not math.isfinite(initial_capital) or initial_capital <= 0:
        raise ValueError("initial_capital must be finite and above 0")
    columns(daily_returns, "date")
    values = [c for c in daily_returns.columns if c != "date"]
    name = return_col or (values[0] if len(values) == 1 else None)
    if name is None or name not in values:
        raise ValueError("one return column is needed")
    r = number(F.col(f"`{name}`"), daily_returns.schema[name].dataType)
    rows = daily_returns.select("date", refuse(F.abs(r) == float("inf"), "returns must be finite", r).alias("r"))
    running = _by_date().rowsBetween(W.unboundedPreceding, 0)
    grown = F.lit(float(initial_capital)) * F.product(1 + F.col("r")).over(running)
    missing = F.count(F.when(F.col("r").isNull(), 1)).over(running)
    again = F.lag("date").over(_by_date()) == F.col("date")
    return rows.select(refuse(again, "a date repeats", F.col("date")).alias("date"), F.when(missing == 0, grown).alias("nav"))


def quantile_forward_returns(
    score: DataFrame,
    price: DataFrame,
    *,
    freq: int,
    n_quantiles: int = N_QUANTILES,
    score_col: str = "score",
    price_col: str = "close",
    validate: bool = True,
) -> DataFrame:
    """(date, ticker, forward_return): each score bucket's mean return to the next rebalance date, as ``QUANTILE_k``.

    Rebalance dates come from the price table's calendar, so all tickers share them. Every date with scores has all
    n_quantiles rows; the last rebalance date has no return. A score date off the rebalance dates is a ValueError.
    """
    n = whole("freq", freq, 1)
    q = whole("n_quantiles", n_quantiles, 2)
    columns(score, *KEYS, score_col)
    prices = priced(price, price_col)
    days = rebalance_dates(prices, n).withColumn("next", F.lead("date").over(_by_date()))
    if validate and score.select("date").distinct().join(days, "date", "left_anti").limit(1).count():
        raise ValueError("a score date is no rebalance date")
    # a ticker's next record on a rebalance date is its next price, if that is on the next one of the calendar
    ahead = W.partitionBy("ticker").orderBy("date")
    known = prices.join(F.broadcast(days), "date")
    later = F.when(F.lead("date").over(ahead) == F.col("next"), F.lead("p").over(ahead))
    returns = known.select("date", "ticker", (later / F.col("p") - 1).alias("r"))
    buckets = simple_bucket(score, score_col=score_col, n_quantiles=q)
    joined = buckets.join(returns, KEYS, "left")
    # one pass over the dates: all of them are there, also those without any bucket
    bucket_mean = [F.avg(F.when(F.col("bucket") == k, F.col("r"))).alias(f"QUANTILE_{k}") for k in range(q)]
    means = joined.groupBy("date").agg(*bucket_mean)
    return means.unpivot("date", [f"QUANTILE_{k}" for k in range(q)], "ticker", "forward_return")


__all__ = ["buy_and_hold_nav", "build_nav", "quantile_forward_returns", "rebalance_dates", "rebalance_dates_belong"]
