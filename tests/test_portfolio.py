import pytest
from helpers import approx, day, panel

from tessera.operators import portfolio


def by_date(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["date"])]


def test_buy_and_hold(spark):
    df = panel(spark, {"A": [10, 10, 10], "B": [10, 20, 10]}, "close")
    assert by_date(portfolio.buy_and_hold_nav(df, 10), "nav") == approx([10, 15, 10])
    gaps = panel(spark, {"A": [1, None, 1, 1], "B": [1, 1, None, 2], "C": [None, 5, 5, 5]}, "close")
    assert by_date(portfolio.buy_and_hold_nav(gaps), "nav") == approx([1, None, None, 1.5])
    with pytest.raises(ValueError):
        portfolio.buy_and_hold_nav(panel(spark, {"A": [None, 1]}, "close"))
    with pytest.raises(TypeError):
        portfolio.buy_and_hold_nav(df, True)


def nav(spark, returns, capital=1.0):
    rows = [(day(k), r) for k, r in enumerate(returns)]
    return by_date(portfolio.build_nav(spark.createDataFrame(rows, "date date, r double"), capital), "nav")


def test_build_nav(spark):
    assert nav(spark, [0.0, 0.1, -0.05], 100) == approx([100, 110, 104.5])
    assert nav(spark, [0.0, 0.1, -1.5, None, 0.2], 100) == approx([100, 110, -55, None, None])
    with pytest.raises(ValueError):
        nav(spark, [0.0], 0)


def test_rebalancing(spark):
    days = [day(k) for k in (0, 1, 2, 3, 4, 7, 8, 8)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    assert by_date(portfolio.rebalance_dates(df, 3), "date") == [day(0), day(3), day(8)]
    belongs = {r["date"]: r["rebalance_date"] for r in portfolio.rebalance_dates_belong(df, 3).collect()}
    assert belongs == {day(0): day(0), day(1): day(0), day(2): day(0), day(3): day(3), day(4): day(3), day(7): day(3), day(8): day(8)}
    for wrong in (0, True, 1.5, "3"):
        with pytest.raises(ValueError):
            portfolio.rebalance_dates(df, wrong)


def test_quantile_forward_returns(spark):
    prices = {t: [1.0] * 40 for t in "ABC"} | {"D": [1 + k / 39 for k in range(40)]}
    price = panel(spark, prices, "close")
    score = spark.createDataFrame([(day(0), t, float(k)) for k, t in enumerate("ABCD")], "date date, ticker string, score double")
    found = {r["ticker"]: r["forward_return"] for r in portfolio.quantile_forward_returns(score, price, freq=20, n_quantiles=2).collect()}
    assert found == {"QUANTILE_0": pytest.approx(0), "QUANTILE_1": pytest.approx(10 / 39)}
    off = spark.createDataFrame([(day(1), "A", 1.0)], "date date, ticker string, score double")
    with pytest.raises(ValueError):
        portfolio.quantile_forward_returns(off, price, freq=20)
