import datetime as dt

import pytest


def day(n, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=n)


def panel(spark, prices, column="adj_close", start=0):
    """{ticker: [prices]} on consecutive days."""
    rows = [(day(start + k), t, None if p is None else float(p)) for t, ps in prices.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, f"date date, ticker string, {column} double")


def values(df, ticker=None, column=None):
    name = column or df.columns[-1]
    rows = sorted(df.collect(), key=lambda r: (r["ticker"], r["date"]))
    return [r[name] for r in rows if ticker is None or r["ticker"] == ticker]


def approx(expected, rel=1e-9):
    return [None if e is None else pytest.approx(e, rel=rel, abs=1e-12) for e in expected]
