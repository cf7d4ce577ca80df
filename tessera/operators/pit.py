"""Point-in-time fundamentals: what was known of a filing period at a date.

A fact is visible at a date when it was filed by then. Of several versions the newest period wins, then the latest
filing, then a reported before a derived value, then the greatest accession number.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fields import FIELDS

#: Days between adjacent quarter ends, and from the first to the last of four, that make them consecutive.
QUARTER_GAP, YEAR_SPAN = (70, 125), (250, 300)
#: Days of calendar that one bucket of the range join covers.
BUCKET_DAYS = 64

ADDITIVE = [name for name, spec in FIELDS.items() if spec.additive]
PIT_COLUMNS = ["ticker", "field", "period_months", "period_start", "period_end", "value", "concept", "form", "accn", "filed", "derived"]
PANEL_COLUMNS = ["ticker", "field", "period_months", "period_end", "value", "filed"]


def normalize_sec_ticker(ticker: str) -> str:
    """Trimmed, upper-case, with a dash for a dot."""
    if not isinstance(ticker, str) or not ticker.strip():
        raise ValueError(f"not a ticker: {ticker!r}")
    return ticker.strip().upper().replace(".", "-")


def _listed(values: object) -> list:
    return [values] if isinstance(values, (str, int)) else list(values)  # type: ignore[call-overload]


def check_fields(fields: object) -> list[str] | None:
    """The fields as a list; an unknown one is a KeyError."""
    if fields is None:
        return None
    found = _listed(fields)
    for f in found:
        if f not in FIELDS:
            raise KeyError(f)
    return found


def scope(tickers: object = None, fields: object = None, period_months: object = None) -> Column:
    """The filter of the given tickers, fields and period lengths; None doesn't filter, an empty list finds nothing."""
    found = F.lit(True)
    if tickers is not None:
        blank = isinstance(tickers, str) and not tickers.strip()
        names = [] if blank else [normalize_sec_ticker(t) for t in _listed(tickers)]
        found &= F.col("ticker").isin(names) if names else F.lit(False)
    if (names := check_fields(fields)) is not None:
        found &= F.col("field").isin(names) if names else F.lit(False)
    if period_months is not None:
        months = [int(m) for m in _listed(period_months)]
        found &= F.col("period_months").isin(months) if months else F.lit(False)
    return found


def _day(value: object) -> Column:
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        return F.lit(value)
    if isinstance(value, str) and re.match(r"\d{4}-\d{2}-\d{2}", value):
        return F.lit(dt.date.fromisoformat(value[:10]))
    raise ValueError(f"not a date: {value!r}")


def _dates(dates: DataFrame | Iterable, like: DataFrame) -> DataFrame:
    """Distinct days as a one-column table."""
    if isinstance(dates, DataFrame):
        return dates.select(F.to_date("date").alias("date")).dropna().distinct()
    days = sorted({(d.date() if isinstance(d, dt.datetime) else d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)[:10])) for d in dates})
    return like.sparkSession.createDataFrame([(d,) for d in days], "date date")


def _version() -> Column:
    """Versions of one period by priority, as a struct whose maximum wins."""
    return F.struct("filed", (~F.col("derived")).alias("reported"), "accn")


def load_fundamentals(
    facts: DataFrame, tickers=None, fields=None, start=None, end=None, *, period_months=None, filed_until=None, ordered: bool = True
) -> DataFrame:
    """All versions whose period ends within start..end and which were filed by ``filed_until``, both inclusive."""
    found = facts.where(scope(tickers, fields, period_months))
    if start is not None:
        found = found.where(F.col("period_end") >= _day(start))
    if end is not None:
        found = found.where(F.col("period_end") <= _day(end))
    if filed_until is not None:
        found = found.where(F.col("filed") <= _day(filed_until))
    return found.orderBy("ticker", "field", "period_end", "period_months", "filed", "accn") if ordered else found


def load_fundamentals_pit(
    facts: DataFrame, as_of, tickers=None, fields=None, *, period_months=None, latest_only: bool = True, max_staleness_days: int | None = None
) -> DataFrame:
    """What was known at ``as_of``: the newest period of each ticker, field and length, or the best version of every
    period. Aggregation by maximum combines before the shuffle, so no window holds a key's history."""
    day = _day(as_of)
    found = facts.where(scope(tickers, fields, period_months) & (F.col("filed") <= day))
    if max_staleness_days is not None:
        found = found.where(F.col("period_end") >= F.date_sub(day, max_staleness_days))
    keys = ["ticker", "field", "period_months"] + ([] if latest_only else ["period_end"])
    rank = F.struct("period_end", "filed", (~F.col("derived")).alias("reported"), "accn")
    best = found.groupBy(*keys).agg(F.max_by(F.struct(*PIT_COLUMNS), rank).alias("best"))
    return best.select("best.*").orderBy("ticker", "field", "period_end", "period_months")


def load_fundamentals_panel(facts: DataFrame, dates, tickers=None, fields=None, *, period_months=None, max_staleness_days: int | None = 550) -> DataFrame:
    """One row per date, ticker, field and length: the newest visible period, no older than ``max_staleness_days``.

    An as-of join without a nested loop: dates and filings of a key are put in one order, and the running maximum of
    the filings is read off at the dates. The newest visible period has the greatest end, so testing its age alone
    is enough.
    """
    days = _dates(dates, facts)
    keys = ["ticker", "field", "period_months"]
    known = facts.where(scope(tickers, fields, period_months))
    rank = F.struct("period_end", "filed", (~F.col("derived")).alias("reported"), "accn")
    events = known.select(*keys, F.col("filed").alias("at"), F.lit(0).alias("asks"), F.struct(rank.alias("rank"), F.struct(*PANEL_COLUMNS).alias("fact")).alias("best"))
    asks = known.select(*keys).distinct().crossJoin(F.broadcast(days))
    asks = asks.select(*keys, F.col("date").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(events.schema["best"].dataType).alias("best"))
    order = W.partitionBy(*keys).orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    found = events.unionByName(asks).withColumn("seen", F.max_by("best.fact", "best.rank").over(order))
    found = found.where((F.col("asks") == 1) & F.col("seen").isNotNull())
    out = found.select(F.col("at").alias("date"), "seen.*")
    return out if max_staleness_days is None else out.where(F.col("period_end") >= F.date_sub("date", max_staleness_days))


def range_join(facts: DataFrame, low: Column, high: Column, days: DataFrame) -> DataFrame:
    """facts x days with low <= date <= high as an equi-join on date buckets, so cost follows the matches."""
    number = lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS)
    spans = facts.withColumns({"__low": low, "__high": high}).where(F.col("__low") <= F.col("__high"))
    spans = spans.withColumn("__bucket", F.explode(F.sequence(number(F.col("__low")), number(F.col("__high")))))
    joined = spans.join(days.withColumn("__bucket", number(F.col("date"))), "__bucket")
    return joined.where(F.col("date").between(F.col("__low"), F.col("__high"))).drop("__bucket", "__low", "__high")


def load_fundamentals_ttm(facts: DataFrame, dates, tickers=None, fields=None, *, max_staleness_days: int | None = 200) -> DataFrame:
    """(date, ticker, field, period_end, value): sums of four consecutive quarters.

    Of each quarter the best visible version counts; the latest four must be adjacent (70 to 125 days), span 250 to
    300 days and end within ``max_staleness_days``. There is no falling back to an older complete year. A quarter
    without a value counts as a quarter and adds nothing. Filings aren't multiplied by the dates at which they are visible.
    """
    names = check_fields(fields)
    for f in names or []:
        if f not in ADDITIVE:
            raise ValueError(f"{f} can't be summed")
    days = _dates(dates, facts)
    known = facts.where(scope(tickers, names if names is not None else ADDITIVE) & (F.col("period_months") == 3))
    keys = ["ticker", "field", "period_end"]
    periods = known.groupBy(*keys).agg(F.min("filed").alias("first"))
    if max_staleness_days is None:  # every period stays visible: a nested loop over the few dates asked for
        asked = periods.join(F.broadcast(days), F.col("first") <= F.col("date"))
    else:
        asked = range_join(periods, F.col("first"), F.date_add("period_end", max_staleness_days + YEAR_SPAN[1]), days)
    # the filings of a period and the dates that ask for it in one order: the running maximum is what was known
    events = known.select(*keys, F.col("filed").alias("at"), F.lit(0).alias("asks"), F.struct(_version().alias("version"), "value").alias("seen"))
    none = F.lit(None).cast(events.schema["seen"].dataType)
    asks = asked.select(*keys, F.col("date").alias("at"), F.lit(1).alias("asks"), none.alias("seen"))
    order = W.partitionBy(*keys).orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    quarters = events.unionByName(asks).withColumn("best", F.max_by("seen", "seen.version").over(order))
    quarters = quarters.where((F.col("asks") == 1) & F.col("best").isNotNull()).select(F.col("at").alias("date"), *keys, "best")
    newest = W.partitionBy("date", "ticker", "field").orderBy(F.col("period_end").desc())
    four = quarters.withColumn("k", F.row_number().over(newest)).where("k <= 4")
    four = four.withColumn("gap", F.datediff(F.lag("period_end").over(newest), "period_end"))
    year = four.groupBy("date", "ticker", "field").agg(
        F.max("period_end").alias("period_end"),
        F.min("period_end").alias("first_period_end"),
        F.count("*").alias("n_quarters"),
        F.sum("best.value").alias("value"),
        F.count_if(F.col("gap").between(*QUARTER_GAP)).alias("adjacent"),
    )
    span = F.datediff("period_end", "first_period_end")
    whole = (F.col("n_quarters") == 4) & (F.col("adjacent") == 3) & span.between(*YEAR_SPAN)
    fresh = F.lit(True) if max_staleness_days is None else F.col("period_end") >= F.date_sub("date", max_staleness_days)
    return year.where(whole & fresh).select("date", "ticker", "field", "period_end", "value")


def load_latest_filed(facts: DataFrame, tickers=None) -> DataFrame:
    """(ticker, last_filed): where an incremental load can go on."""
    return facts.where(scope(tickers)).groupBy("ticker").agg(F.max("filed").alias("last_filed")).orderBy("ticker")


def feature_table(panel: DataFrame, ttm: DataFrame, tickers: DataFrame, dates, balances: list[str], flows: list[str]) -> DataFrame:
    """(date, ticker, balances..., flows with ``_ttm``..., net_margin_ttm) over all given dates and tickers.

    Balances are the panel's dated values, flows the trailing sums; a missing combination is a row of nulls. The
    margin is net income over revenue where revenue is above 0.
    """
    days = _dates(dates, panel)
    stock = panel.where(F.col("period_months") == 0).groupBy("date", "ticker").pivot("field", balances).agg(F.first("value"))
    flow = ttm.groupBy("date", "ticker").pivot("field", flows).agg(F.first("value")).withColumnsRenamed({f: f"{f}_ttm" for f in flows})
    grid = tickers.select("ticker").distinct().crossJoin(F.broadcast(days)).select("date", "ticker")
    joined = grid.join(stock, ["date", "ticker"], "left").join(flow, ["date", "ticker"], "left")
    if {"net_income", "revenue"} <= set(flows):
        joined = joined.withColumn("net_margin_ttm", F.when(F.col("revenue_ttm") > 0, F.col("net_income_ttm") / F.col("revenue_ttm")))
    return joined


def coverage(features: DataFrame) -> DataFrame:
    """(date, one count per column): rows with a value."""
    return features.groupBy("date").agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in features.columns if c not in ("date", "ticker")])
