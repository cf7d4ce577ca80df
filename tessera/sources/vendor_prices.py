"""Vendor price tables in the common long form. Fetching is the caller's: any function of (tickers, start, end)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import PRICES

# Vendor headers and our columns.
HEADERS = {"Date": "date", "Datetime": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


def clean_vendor_prices(df: DataFrame, ticker: str | None = None, *, auto_adjust: bool = False, intraday: bool = False) -> DataFrame:
    """The eight price columns: numbers read leniently, rows without a close left out, time zones dropped. ``date`` is a
    day, or a time within a day if ``intraday``.

    ``adj_close`` is the close only where the vendor adjusted already; it is never made up from a raw close.
    """
    out = df.withColumnsRenamed({k: v for k, v in HEADERS.items() if k in df.columns})
    if ticker is not None:
        out = out.withColumn("ticker", F.lit(ticker))
    if "adj_close" not in out.columns and auto_adjust:
        out = out.withColumn("adj_close", F.col("close"))
    for f in PRICES.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast("string"))
    kind = out.schema["date"].dataType
    time = F.col("date").cast("timestamp_ntz")
    day = time if intraday else time.cast("date") if isinstance(kind, T.TimestampType) else F.to_date("date")
    numbers = []
    for f in PRICES.fields[2:]:
        value = F.expr(f"try_cast(`{f.name}` AS double)")
        numbers.append(F.when(~F.isnan(value), value).alias(f.name))
    return out.select(day.alias("date"), F.col("ticker").cast("string").alias("ticker"), *numbers).dropna(subset=["close"])


def get_prices(fetch: Callable[..., DataFrame], tickers: str | list[str], start, end=None, *, interval: str = "1d", auto_adjust: bool = False) -> DataFrame:
    """Vendor prices from start up to before ``end``, cleaned; tickers that the vendor lacks are simply absent."""
    names = [tickers] if isinstance(tickers, str) else list(tickers)
    intraday = re.fullmatch(r"\d+[mh]", interval) is not None  # minutes and hours; mo is a month
    found = clean_vendor_prices(fetch(names, start, end, interval=interval, auto_adjust=auto_adjust), auto_adjust=auto_adjust, intraday=intraday)
    at = found.schema["date"].dataType
    found = found.where(F.col("ticker").isin(names) & (F.col("date") >= F.lit(start).cast(at)))
    return (found if end is None else found.where(F.col("date") < F.lit(end).cast(at))).orderBy("ticker", "date")


def missing_tickers(prices: DataFrame, tickers: DataFrame) -> DataFrame:
    return tickers.select("ticker").join(prices.select("ticker").distinct(), "ticker", "left_anti")
