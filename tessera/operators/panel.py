"""The date-ticker panel: the boundary where tables are checked and missing values become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import columns, number, refuse

KEYS = ["date", "ticker"]


def by_ticker() -> WindowSpec:
    """Each ticker's records in date order."""
    return W.partitionBy("ticker").orderBy("date")


def _nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in KEYS]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def assert_unique(df: DataFrame, keys: list[str], what: str = "key") -> None:
    """One job: no null and no repeated key. Counting is partial before the shuffle."""
    nulls = F.coalesce(F.max(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))), F.lit(0))
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), nulls.alias("null")).first()
    if found["null"]:
        raise ValueError(f"a {what} is null")
    if (found["most"] or 0) > 1:
        raise ValueError(f"a {what} repeats")


def to_date_ticker_frame(*, df: DataFrame, validate: bool = True) -> DataFrame:
    """A panel: dates parsed, NaN as null, keys checked to be present and unique (one job unless validate=False).

    All value columns are kept. Calling it on its own result changes nothing.
    """
    columns(df, *KEYS)
    if isinstance(df.schema["date"].dataType, T.StringType):
        text = F.col("date")
        parsed = F.when(F.length(F.trim(text)) <= 10, F.to_date(text).cast("timestamp_ntz")).otherwise(text.cast("timestamp_ntz"))
        whole_days = df.where(F.length(F.trim(text)) > 10).limit(1).count() == 0 if validate else False
        df = df.withColumn("date", F.to_date(text) if whole_days else parsed)
    elif not isinstance(df.schema["date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("date must be a date, a timestamp or text")
    df = _nan_to_null(df).select(*KEYS, *[F.col(f"`{c}`") for c in df.columns if c not in KEYS])
    if validate:
        assert_unique(df, KEYS, "(date, ticker)")
    return df


def validate_prices(*, df: DataFrame, price_col: str = "close") -> DataFrame:
    """The same rows with ``price_col`` as a double that must be present and above 0; a violation stops the job."""
    columns(df, *KEYS, price_col)
    price = number(F.col(f"`{price_col}`"), df.schema[price_col].dataType)
    wrong = price.isNull() | (price <= 0)
    return df.withColumn(price_col, refuse(wrong, "prices must be present and above 0", price))


def priced(df: DataFrame, price_col: str) -> DataFrame:
    """(date, ticker, p): the numeric price with NaN as null, which must be above 0 where it is present."""
    columns(df, *KEYS, price_col)
    price = number(F.col(f"`{price_col}`"), df.schema[price_col].dataType)
    return df.select(
        refuse(F.col("date").isNull(), "a date is null", F.col("date")).alias("date"),
        refuse(F.col("ticker").isNull(), "a ticker is null", F.col("ticker")).alias("ticker"),
        refuse(price <= 0, "prices must be above 0", price).alias("p"),
    )


def result(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(date, ticker, name); a ticker's repeated date stops the job, found in the window that is there anyway."""
    again = F.lag("date").over(by_ticker()) == F.col("date")
    return df.select(refuse(again, "a (date, ticker) repeats", F.col("date")).alias("date"), "ticker", value.alias(name))


def to_panel(factor: DataFrame, name: str, *, validate: bool = True) -> DataFrame:
    """A factor (date, ticker, one value) under another name; nulls stay. A null or repeated key is a ValueError (one
    job unless validate=False)."""
    if not isinstance(name, str):
        raise TypeError("name must be text")
    if not name.strip():
        raise ValueError("name is blank")
    columns(factor, *KEYS)
    values = [c for c in factor.columns if c not in KEYS]
    if len(values) != 1:
        raise ValueError("a factor has one value column")
    if validate:
        assert_unique(factor, KEYS, "(date, ticker)")
    return _nan_to_null(factor).select(*KEYS, F.col(f"`{values[0]}`").alias(name))


def align(*factors: DataFrame) -> DataFrame:
    """Factors (date, ticker, one value) as columns of one table over all their keys; a value that a key lacks is null.

    One shuffle for all of them, where joins in a row would take one each. A repeated key within a factor stops the job.
    """
    names = [c for f in factors for c in f.columns if c not in KEYS]
    if not factors or len(names) != len(factors) or len(set(names)) != len(names):
        raise ValueError("factors have one value column each, under different names")
    rows = factors[0].withColumn("__k", F.lit(0))
    for k, f in enumerate(factors[1:], 1):
        columns(f, *KEYS)
        rows = rows.unionByName(f.withColumn("__k", F.lit(k)), allowMissingColumns=True)
    own = [F.count_if(F.col("__k") == k) for k in range(len(factors))]
    wide = rows.groupBy(*KEYS).agg(*[F.max(F.col(f"`{n}`")).alias(n) for n in names], F.greatest(*own, F.lit(0)).alias("__n"))
    return wide.select(refuse(F.col("__n") > 1, "a (date, ticker) repeats", F.col("date")).alias("date"), "ticker", *[F.col(f"`{n}`") for n in names])


def to_wide(panel: DataFrame, value: str, tickers: list[str]) -> DataFrame:
    """One column per given ticker by date; every date of the panel is there."""
    columns(panel, *KEYS, value)
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first(F.col(f"`{value}`")))


def to_long(wide: DataFrame, value: str) -> DataFrame:
    """(date, ticker, value) of a table with a column per ticker; nulls stay."""
    return wide.unpivot("date", [F.col(f"`{c}`") for c in wide.columns if c != "date"], "ticker", value)
