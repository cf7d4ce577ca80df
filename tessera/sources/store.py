"""A versioned table store on any Hadoop file system.

Every table is a folder of numbered Parquet versions. A write makes new versions of all tables it changes and then
replaces one small pointer file, ``_CURRENT``, by an atomic rename: readers see all of a write or nothing of it, and a
failed one leaves the old tables as they were. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import columns
from ..operators.panel import KEYS, assert_unique
from ..operators.pit import normalize_sec_ticker

_DAY, _TEXT, _NUMBER = T.DateType(), T.StringType(), T.DoubleType()
PRICES = T.StructType(
    [T.StructField("date", _DAY), T.StructField("ticker", _TEXT)]
    + [T.StructField(c, _NUMBER) for c in ("open", "high", "low", "close", "adj_close", "volume")]
)
CONSTITUENTS = T.StructType(
    [T.StructField(c, _DAY if c == "date_added" else _TEXT) for c in ("ticker", "name", "sector", "sub_industry", "date_added", "cik", "sec_cik", "sec_title")]
)


class Catalog:
    """Tables by name under a root folder."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = True):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        if read_only and not self._exists(self._pointer()):
            raise FileNotFoundError(f"no tables at {root}")

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _pointer(self) -> str:
        return f"{self.root}/_CURRENT"

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self._path(path))

    def versions(self) -> dict[str, str]:
        if not self._exists(self._pointer()):
            return {}
        stream = self._files(self._pointer()).open(self._path(self._pointer()))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def has(self, table: str) -> bool:
        return table in self.versions()

    def read(self, table: str) -> DataFrame:
        found = self.versions()
        if table not in found:
            raise KeyError(f"no table {table!r}")
        return self.spark.read.parquet(f"{self.root}/{found[table]}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new versions of all tables, then swap the pointer once."""
        if self.read_only:
            raise PermissionError("the catalog was opened for reading")
        now = self.versions()
        for name, df in tables.items():
            version = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{version}")
            now[name] = version
        own = f"{self.root}/_CURRENT.{uuid.uuid4().hex}"
        stream = self._files(own).create(self._path(own))
        try:
            stream.write(bytearray(json.dumps(now), "utf-8"))
        finally:
            stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._path(own).toUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = rename
        context.rename(self._path(own), self._path(self._pointer()), kinds)


def get_catalog(spark: SparkSession, *, path: str, read_only: bool = True) -> Catalog:
    """The store at a path; opened for reading it must be there, otherwise it is made with its first write."""
    return Catalog(spark, path, read_only)


def _tickers(values) -> list[str]:
    return [normalize_sec_ticker(t) for t in ([values] if isinstance(values, str) else values)]


def load_prices(*, db: Catalog, tickers=None, start=None, end=None) -> DataFrame:
    """Prices by ticker and date, both bounds inclusive; an empty list of tickers finds nothing."""
    return select_prices(db.read("prices"), tickers, start, end).orderBy("ticker", "date")


def select_prices(prices: DataFrame, tickers=None, start=None, end=None) -> DataFrame:
    """The filters of ``load_prices``, which reach the Parquet scan."""
    if tickers is not None:
        names = _tickers(tickers)
        prices = prices.where(F.col("ticker").isin(names) if names else F.lit(False))
    if start is not None:
        prices = prices.where(F.col("date") >= F.lit(start).cast(prices.schema["date"].dataType))
    if end is not None:
        prices = prices.where(F.col("date") <= F.lit(end).cast(prices.schema["date"].dataType))
    return prices


def load_constituents(*, db: Catalog, tickers=None) -> DataFrame:
    """The members by ticker, with whatever columns the table has."""
    return select_prices(db.read("constituents"), tickers).orderBy("ticker")


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """``old`` without the (ticker, field) pairs of ``scope``, and ``new``. The scope alone decides what goes."""
    kept = old.join(F.broadcast(scope.select("ticker", "field").distinct()), ["ticker", "field"], "left_anti")
    return kept.unionByName(new.select(*old.columns)) if set(old.columns) <= set(new.columns) else kept.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key as a whole: columns that only ``old`` has become null."""
    kept = old.join(new.select(*keys), keys, "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True).select(*old.columns)


def save_fundamentals(db: Catalog, facts: DataFrame, quarantine: DataFrame, tickers: list[str], fields: list[str]) -> None:
    """Replace all facts and quarantined rows of tickers x fields in one write; fields that are empty now are cleared."""
    spark = db.spark
    scope = spark.createDataFrame([(t, f) for t in tickers for f in fields], "ticker string, field string")
    tables = {}
    for name, rows in (("fundamentals", facts), ("fundamentals_quarantine", quarantine)):
        tables[name] = replace_scope(db.read(name), rows, scope) if db.has(name) else rows
    db.commit(tables)


def save_members(db: Catalog, members: DataFrame) -> None:
    """Replace the member table: tickers and names present and not blank, tickers unique, at least one row."""
    columns(members, "ticker", "name")
    blank = members.where(F.col("ticker").isNull() | F.col("name").isNull() | (F.trim("ticker") == "") | (F.trim(F.col("name").cast("string")) == ""))
    if members.limit(1).count() == 0 or blank.limit(1).count():
        raise ValueError("members need a ticker and a name each")
    assert_unique(members, ["ticker"], "ticker")
    chosen = [(F.col(f.name) if f.name in members.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONSTITUENTS.fields]
    db.commit({"constituents": members.select(*chosen)})


def save_prices(db: Catalog, prices: DataFrame) -> None:
    """Upsert whole rows by (ticker, date); a repeated key or a missing close in the batch is a ValueError."""
    columns(prices, *PRICES.names)
    batch = prices.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRICES.fields])
    assert_unique(batch, ["ticker", "date"], "(ticker, date)")
    if batch.where(F.col("close").isNull() | F.isnan("close")).limit(1).count():
        raise ValueError("a close is missing")
    db.commit({"prices": upsert(db.read("prices"), batch, ["ticker", "date"]) if db.has("prices") else batch})


def save_qlib_prices(*, db: Catalog, prices: DataFrame, release_tag: str) -> None:
    """Replace the daily table of a release, its schema included; float columns keep their width, NaN becomes null.

    Rows of a DataFrame have no order, so none is asked for: the table is written by ticker and date.
    Empty panels, times within a day, blank tickers, repeated keys, column names that repeat in any case or are
    reserved, columns that aren't real numbers and infinite values are ValueErrors.
    """
    if not isinstance(release_tag, str):
        raise TypeError("release_tag must be text")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", release_tag):
        raise ValueError("release_tag must be YYYY-MM-DD")
    columns(prices, *KEYS)
    values = [f for f in prices.schema.fields if f.name not in KEYS]
    lowered = [f.name.lower() for f in values]
    if len(set(lowered)) != len(lowered) or set(lowered) & {"date", "ticker", "release_tag"}:
        raise ValueError("column names repeat or are reserved")
    for f in values:
        if not isinstance(f.dataType, T.NumericType):
            raise ValueError(f"{f.name} must hold real numbers")
    if isinstance(prices.schema["date"].dataType, T.TimestampType):
        raise ValueError("date must not have a time zone")
    infinite = F.lit(False)
    for f in values:
        infinite |= F.coalesce(F.abs(F.col(f"`{f.name}`").cast("double")) == float("inf"), F.lit(False))
    midnight = F.col("date").cast("timestamp_ntz") == F.date_trunc("day", F.col("date").cast("timestamp_ntz")).cast("timestamp_ntz")
    wrong = ~F.coalesce(midnight, F.lit(False)) | F.coalesce(F.trim("ticker") == "", F.lit(True)) | infinite
    found = prices.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")).first()
    if not values or found["n"] == 0 or found["wrong"]:
        raise ValueError("the panel is empty or has times, blank tickers or infinite values")
    assert_unique(prices, KEYS, "(date, ticker)")
    clean = [F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in values]
    table = prices.select(F.to_date("date").alias("date"), "ticker", *clean, F.lit(release_tag).alias("release_tag"))
    db.commit({"qlib_prices": table.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date")})


def load_qlib_prices(*, db: Catalog, tickers=None, start=None, end=None) -> DataFrame:
    """The stored daily table without its release tag, both bounds inclusive."""
    return select_prices(db.read("qlib_prices").drop("release_tag"), tickers, start, end).orderBy("ticker", "date")


__all__ = ["Catalog", "get_catalog", "load_prices", "load_constituents", "load_qlib_prices", "save_fundamentals", "save_members", "save_prices", "save_qlib_prices"]
