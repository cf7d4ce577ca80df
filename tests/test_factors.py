import math
import statistics

import pytest
from helpers import approx, day, panel, values
from pyspark.sql import functions as F

from tessera.operators import cross_section, panel as panels, timeseries as ts

X1 = [100, 105, 99, 108, 95, 112]
Y1 = [50, 51, 52, 49, 55, 54]


def returns(p):
    return [None] + [b / a - 1 if a is not None and b is not None else None for a, b in zip(p, p[1:], strict=False)]


def rolling(xs, n, f):
    return [f(xs[k - n + 1 : k + 1]) if k >= n - 1 and None not in xs[k - n + 1 : k + 1] else None for k in range(len(xs))]


def test_future_returns(spark):
    found = ts.future_returns(df=panel(spark, {"A": X1, "B": Y1}), n_periods=2, gap=1)
    assert found.columns == ["date", "ticker", "forward_return_2_gap_1"]
    for t, p in (("A", X1), ("B", Y1)):
        assert values(found, t) == approx([p[3] / p[1] - 1, p[4] / p[2] - 1, p[5] / p[3] - 1, None, None, None])


def test_historical_return_uses_end_prices_only(spark):
    p = [100, None, 110, 121]
    assert values(ts.historical_return(df=panel(spark, {"A": p}), n_periods=2)) == approx([None, None, 0.1, None])


def test_log_returns_of_a_huge_ratio(spark):
    assert values(ts.log_returns(df=panel(spark, {"A": [1e-300, 1e300]}))) == approx([None, 600 * math.log(10)])


def test_cumulative_and_momentum(spark):
    df = panel(spark, {"A": [1, 2, 4, 8]})
    found = ts.cumulative_log_returns(df, 2, skip=1)
    assert found.columns[-1] == "cumulative_log_return_2_skip_1"
    assert values(found) == approx([None, None, None, 1.3862943611198906])
    assert ts.momentum(df, 2, skip=1).columns[-1] == "momentum_2_skip_1"
    doubling = panel(spark, {"A": [2**k for k in range(13)]})
    assert values(ts.momentum_12_1(df=doubling, trading_days_per_month=1)) == approx([None] * 12 + [11 * math.log(2)])


@pytest.mark.parametrize(("window", "skip"), [(1, 0), (3, 0), (3, 2)])
def test_windows_with_a_missing_price_are_null(spark, window, skip):
    p = [10, 11, 12, None, 14, 15, 13, 12, 16, 18, 17]
    logs = [None if x is None else math.log(x) for x in p]
    want = []
    for k in range(len(p)):
        span = logs[k - skip - window : k - skip + 1] if k - skip - window >= 0 else [None]
        want.append(None if None in span else span[-1] - span[0])
    assert values(ts.cumulative_log_returns(panel(spark, {"A": p}), window, skip=skip)) == approx(want)


def test_reversal(spark):
    df = panel(spark, {"A": [1, 2, 8]})
    assert values(ts.reversal(df, 2, vol_adjust=False))[-1] == pytest.approx(-2.0794415416798357)
    found = ts.reversal(df, 2)
    assert found.columns[-1] == "reversal_2_skip_0_vol" and values(found)[-1] == pytest.approx(-4.242640687119286)
    flat = panel(spark, {"A": [5] * 6})
    assert values(ts.reversal(flat, 3)) == [None] * 6
    assert values(ts.reversal(flat, 3, vol_adjust=False)) == approx([None] * 3 + [0.0] * 3)
    late, now = ts.reversal(panel(spark, {"A": X1}), 2, skip=1), ts.reversal(panel(spark, {"A": X1}), 2)
    assert values(late) == approx([None, *values(now)[:-1]])


def test_volatility(spark):
    p = [*X1, None, 100, 101, 99, 104]
    df = panel(spark, {"A": p, "B": Y1}, "close")
    past = values(ts.history_vol(df=df, window=3), "A")
    assert past == approx(rolling(returns(p), 3, statistics.stdev))
    ahead = values(ts.forward_volatility(df=df, window=3, gap=1), "A")
    assert ahead == approx([past[k + 4] if k + 4 < len(p) else None for k in range(len(p))])
    assert past[-1] is not None


def test_tickers_stay_apart_and_order_does_not_matter(spark):
    both = panel(spark, {"A": X1, "B": Y1}).orderBy(F.rand(7))
    for f in (lambda d: ts.momentum(d, 2), lambda d: ts.reversal(d, 2), lambda d: ts.future_returns(df=d, n_periods=1, gap=0)):
        assert values(f(both), "A") == approx(values(f(panel(spark, {"A": X1}))))
        assert values(f(both), "B") == approx(values(f(panel(spark, {"B": Y1}))))


@pytest.mark.parametrize(
    ("call", "error"),
    [
        (lambda d: ts.historical_return(df=d, n_periods=0), ValueError),
        (lambda d: ts.historical_return(df=d, n_periods=True), TypeError),
        (lambda d: ts.historical_return(df=d, n_periods=1.5), TypeError),
        (lambda d: ts.future_returns(df=d, gap=-1), ValueError),
        (lambda d: ts.reversal(d, 1), ValueError),
        (lambda d: ts.reversal(d, 5, vol_adjust=1), TypeError),
        (lambda d: ts.history_vol(df=d, window=1, price_col="adj_close"), ValueError),
        (lambda d: ts.momentum(d, 2, price_col="nothing"), ValueError),
    ],
)
def test_arguments(spark, call, error):
    with pytest.raises(error):
        call(panel(spark, {"A": [1, 2]}))


def test_wrong_data_stops_the_job(spark):
    with pytest.raises(Exception, match="above 0"):
        ts.log_returns(df=panel(spark, {"A": [1, 0]})).collect()
    twice = panel(spark, {"A": [1, 2]}).unionByName(panel(spark, {"A": [3]}))
    with pytest.raises(Exception, match="repeats"):
        ts.log_returns(df=twice).collect()


def test_empty_panels(spark):
    none = panel(spark, {"A": [1.0]}).limit(0)
    for f in (lambda d: ts.momentum(d, 2), lambda d: ts.reversal(d, 2), lambda d: cross_section.simple_bucket(d, score_col="adj_close")):
        assert f(none).count() == 0


def test_frames(spark):
    rows = [("2024-01-02", "A", 2.0, 1), ("2024-01-01", "A", float("nan"), 2)]
    df = spark.createDataFrame(rows, "date string, ticker string, close double, volume int")
    found = panels.to_date_ticker_frame(df=df)
    assert dict(found.dtypes)["date"] == "date" and found.where("close is null").count() == 1
    assert panels.to_date_ticker_frame(df=found).collect() == found.collect()
    with pytest.raises(ValueError):
        panels.to_date_ticker_frame(df=df.unionByName(df))
    with pytest.raises(ValueError):
        panels.to_date_ticker_frame(df=df.drop("ticker"))
    with pytest.raises(Exception, match="present"):
        panels.validate_prices(df=df).collect()
    assert panels.to_panel(found.select("date", "ticker", "close"), "f").columns == ["date", "ticker", "f"]


def test_zscore(spark):
    rows = [(day(k // 3), "ABC"[k % 3], f1, f2) for k, (f1, f2) in enumerate(zip([1, 2, 3, 100, 200, 300], [3, 2, 1, 3, 3, 3], strict=True))]
    df = spark.createDataFrame(rows, "date date, ticker string, f1 int, f2 int")
    found = cross_section.zscore_by_date(df)
    by_date = sorted(found.collect(), key=lambda r: (r["date"], r["ticker"]))
    assert [r["f1"] for r in by_date] == approx([-1, 0, 1, -1, 0, 1])
    assert [r["f2"] for r in by_date] == approx([1, 0, -1, None, None, None])


def test_buckets(spark):
    rows = [(day(0), t, s) for t, s in zip("ABCDE", [1.0, 2.0, 3.0, 4.0, None], strict=True)] + [(day(1), "A", 100.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, score double")
    found = sorted(cross_section.simple_bucket(df, n_quantiles=2).collect(), key=lambda r: (r["date"], r["ticker"]))
    assert [r["bucket"] for r in found] == [0, 0, 1, 1, None, None]
    rows = [(day(0), t, 6.0 - k, float(k)) for k, t in enumerate("ABCDEF")]
    df = spark.createDataFrame(rows, "date date, ticker string, score double, vol double")
    found = sorted(cross_section.vol_bucket(df, n_quantiles=3, n_vol_groups=2).collect(), key=lambda r: r["ticker"])
    assert [r["vol_bucket"] for r in found] == [0, 0, 0, 1, 1, 1] and [r["bucket"] for r in found] == [2, 1, 0, 2, 1, 0]


@pytest.mark.parametrize("n", [2, 3, 5, 7, 10])
def test_buckets_as_pandas_cuts_them(spark, n):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(n)
    frames = []
    for k in range(25):
        size = int(r.integers(1, 40))
        x = np.round(r.normal(size=size), int(r.integers(0, 4)))
        frames.append(pd.DataFrame({"date": [day(k)] * size, "ticker": [f"t{j:02d}" for j in range(size)], "score": x}))
    data = pd.concat(frames, ignore_index=True)

    def cut(x):
        edges = np.unique(x.quantile(np.linspace(0, 1, n + 1)))
        if len(x) < n or len(edges) < 2:
            return pd.Series(np.nan, x.index)
        return pd.cut(x, edges, labels=False, include_lowest=True).astype(float)

    want = data.groupby("date")["score"].transform(cut)
    found = cross_section.simple_bucket(spark.createDataFrame(data), n_quantiles=n).toPandas()
    merged = data.assign(want=want).merge(found.assign(date=found["date"]), on=["date", "ticker"])
    a, b = merged["want"].to_numpy(float), merged["bucket"].to_numpy(float)
    assert ((a == b) | (np.isnan(a) & np.isnan(b))).all()


def test_panels_are_checked_and_aligned(spark):
    good = panel(spark, {"A": [1, None], "B": [2, 3]}, "x")
    assert panels.to_panel(good, "f").count() == 4
    for wrong, name, error in [(good, 5, TypeError), (good, " ", ValueError), (good.unionByName(good), "f", ValueError), (good.withColumn("ticker", F.nullif("ticker", F.lit("A"))), "f", ValueError)]:
        with pytest.raises(error):
            panels.to_panel(wrong, name)
    other = panel(spark, {"B": [7], "C": [8]}, "y", start=1)
    both = {(r["ticker"], r["date"]): (r["x"], r["y"]) for r in panels.align(good, other).collect()}
    assert both == {("A", day(0)): (1, None), ("A", day(1)): (None, None), ("B", day(0)): (2, None), ("B", day(1)): (3, 7), ("C", day(1)): (None, 8)}
    with pytest.raises(ValueError):
        panels.align(good, good)
    with pytest.raises(Exception, match="repeats"):
        panels.align(good.unionByName(good), other).collect()
    wide = panels.to_wide(good, "x", ["A", "B", "Z"])
    assert {(r["date"], r["ticker"]): r["x"] for r in panels.to_long(wide, "x").collect()}[day(1), "A"] is None and wide.count() == 2
