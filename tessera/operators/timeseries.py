"""Returns, momentum, reversal and volatility: windows over each ticker's own records.

Periods count a ticker's records, never calendar days. Every function shuffles once, by ticker; several of them on
one panel share that exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import whole
from .panel import by_ticker, priced, result


def _ratio(later: Column, earlier: Column) -> Column:
    return later / earlier - 1


def historical_return(*, df: DataFrame, n_periods: int = 5, price_col: str = "adj_close") -> DataFrame:
    """p[t] / p[t-n] - 1 from the two end prices only -> ``historical_return_{n}``."""
    n = whole("n_periods", n_periods, 1)
    value = _ratio(F.col("p"), F.lag("p", n).over(by_ticker()))
    return result(priced(df, price_col), value, f"historical_return_{n}")


def future_returns(*, df: DataFrame, n_periods: int = 5, gap: int = 1, price_col: str = "adj_close") -> DataFrame:
    """A label that looks ahead: p[t+gap+n] / p[t+gap] - 1 -> ``forward_return_{n}_gap_{gap}``."""
    n, g = whole("n_periods", n_periods, 1), whole("gap", gap, 0)
    start = F.lead("p", g).over(by_ticker()) if g else F.col("p")
    return result(priced(df, price_col), _ratio(F.lead("p", g + n).over(by_ticker()), start), f"forward_return_{n}_gap_{g}")


def _with_logs(df: DataFrame, price_col: str) -> DataFrame:
    return priced(df, price_col).withColumn("l", F.ln("p"))


def log_returns(*, df: DataFrame, price_col: str = "adj_close") -> DataFrame:
    """ln p[t] - ln p[t-1], a difference of logarithms, finite for any two prices -> ``log_return``."""
    return result(_with_logs(df, price_col), F.col("l") - F.lag("l", 1).over(by_ticker()), "log_return")


def _shifted(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_ticker()) if n else F.col(column)


def _log_change(rows: DataFrame, window: int, skip: int) -> tuple[DataFrame, Column]:
    """The change of ln p over ``window`` records, ``skip`` records ago, where all window + 1 prices are there.

    The change is a difference of two lags and the test a difference of running counts, so the cost of a row doesn't
    grow with the window.
    """
    frame = by_ticker().rowsBetween(-(2**63), 0)
    counted = rows.withColumns({"seen": F.count("p").over(frame), "row": F.row_number().over(by_ticker())})
    full = _shifted("seen", skip) - F.coalesce(F.lag("seen", skip + window + 1).over(by_ticker()), F.lit(0)) == window + 1
    change = _shifted("l", skip) - F.lag("l", skip + window).over(by_ticker())
    return counted, F.when((F.col("row") > window + skip) & full, change)


def cumulative_log_returns(df: DataFrame, window: int, *, skip: int = 0, price_col: str = "adj_close") -> DataFrame:
    """The sum of the log returns of ``window`` records that end ``skip`` records ago, null if a price in there is
    missing -> ``cumulative_log_return_{window}_skip_{skip}``."""
    w, s = whole("window", window, 1), whole("skip", skip, 0)
    rows, value = _log_change(_with_logs(df, price_col), w, s)
    return result(rows, value, f"cumulative_log_return_{w}_skip_{s}")


def momentum(df: DataFrame, window: int, *, skip: int = 0, price_col: str = "adj_close") -> DataFrame:
    """``cumulative_log_returns`` as ``momentum_{window}_skip_{skip}``."""
    found = cumulative_log_returns(df, window, skip=skip, price_col=price_col)
    return found.withColumnRenamed(found.columns[-1], f"momentum_{window}_skip_{skip}")


def momentum_12_1(*, df: DataFrame, price_col: str = "adj_close", trading_days_per_month: int = 21) -> DataFrame:
    """Eleven months of log return, a month ago -> ``mom_12_1``; the first value needs 12 months + 1 records."""
    m = whole("trading_days_per_month", trading_days_per_month, 1)
    found = cumulative_log_returns(df, 11 * m, skip=m, price_col=price_col)
    return found.withColumnRenamed(found.columns[-1], "mom_12_1")


def reversal(
    df: DataFrame, window: int = 21, *, skip: int = 0, vol_adjust: bool = True, price_col: str = "adj_close"
) -> DataFrame:
    """Minus the log return of ``window`` records, by default over their sample deviation (null if that is 0), the
    whole signal ``skip`` records late -> ``reversal_{window}_skip_{skip}`` with ``_vol`` if adjusted."""
    if not isinstance(vol_adjust, bool):
        raise TypeError("vol_adjust must be a bool")
    w, s = whole("window", window, 2 if vol_adjust else 1), whole("skip", skip, 0)
    rows, change = _log_change(_with_logs(df, price_col), w, 0)
    name = f"reversal_{w}_skip_{s}"
    if vol_adjust:
        rows = rows.withColumn("r", F.col("l") - F.lag("l", 1).over(by_ticker()))
        spread = F.stddev_samp("r").over(by_ticker().rowsBetween(-(w - 1), 0))
        rows = rows.withColumns({"change": change, "spread": spread})
        signal, name = F.when(F.col("spread") > 0, -F.col("change") / F.col("spread")), f"{name}_vol"
    else:
        rows = rows.withColumn("change", change)
        signal = -F.col("change")
    rows = rows.withColumn("signal", signal)
    return result(rows, _shifted("signal", s), name)


def _rolling_vol(df: DataFrame, window: int, first: int, last: int, price_col: str, name: str) -> DataFrame:
    rows = priced(df, price_col)
    rows = rows.withColumn("r", _ratio(F.col("p"), F.lag("p", 1).over(by_ticker())))
    frame = by_ticker().rowsBetween(first, last)
    value = F.when(F.count("r").over(frame) == window, F.stddev_samp("r").over(frame))
    return result(rows, value, name)


def history_vol(*, df: DataFrame, window: int = 21, price_col: str = "close") -> DataFrame:
    """The sample deviation of the last ``window`` simple returns, all present -> ``volatility_{window}``."""
    w = whole("window", window, 2)
    return _rolling_vol(df, w, -(w - 1), 0, price_col, f"volatility_{w}")


def forward_volatility(*, df: DataFrame, window: int = 21, gap: int = 1, price_col: str = "close") -> DataFrame:
    """A label that looks ahead: the deviation of the ``window`` simple returns after ``gap`` more records ->
    ``forward_volatility_{window}_gap_{gap}``."""
    w, g = whole("window", window, 2), whole("gap", gap, 0)
    return _rolling_vol(df, w, g + 1, g + w, price_col, f"forward_volatility_{w}_gap_{g}")


def simple_returns(df: DataFrame, log_col: str) -> DataFrame:
    """A column of log returns as simple ones, exp(r) - 1 without loss near 0 -> ``simple_return``."""
    return df.select("date", "ticker", F.expm1(F.col(f"`{log_col}`")).alias("simple_return"))


#: Factors by name, each a function of a panel.
MOM_FACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"mom_12_1": lambda df: momentum_12_1(df=df)}
