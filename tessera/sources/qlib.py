"""Daily prices from a folder of binary columns: a Spark data source.

Layout: ``calendars/day.txt`` has a date per line; ``features/<ticker>/<field>.day.bin`` has little-endian float32
values, the first being the calendar line of the second; ``instruments/<market>.txt`` has ticker, first and last day
of each membership.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEADING = ["open", "high", "low", "close", "volume", "factor"]
RESERVED = {"date", "ticker", "release_tag"}


def _day(name: str, value: object) -> dt.date:
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError as e:
            raise ValueError(f"{name} must be a day") from e
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None or value.time() != dt.time():
            raise ValueError(f"{name} must be a day without a time zone")
        return value.date()
    if isinstance(value, dt.date):
        return value
    raise TypeError(f"{name} must be a date")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def _field_names(spark: SparkSession, root: str) -> list[str]:
    """All fields of the source: the usual ones first, then by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/features/*/*.day.bin")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    names = {s.getPath().getName().removesuffix(".day.bin") for s in found}
    if not names:
        raise FileNotFoundError("the source has no daily fields")
    if any(not re.fullmatch(r"[a-z_][a-z0-9_]*", n) or n in RESERVED for n in names):
        raise ValueError("a field's name isn't valid or is reserved")
    return [n for n in LEADING if n in names] + sorted(names - set(LEADING))


def read_qlib_prices(
    spark: SparkSession, *, data_dir: str, start, end, tickers: str | Sequence[str] | None = None, market: str | None = None
) -> DataFrame:
    """(date, ticker, every field of the source as float) within start..end, both inclusive and cut to the calendar.

    Either tickers or a market is given; a market's rows are those of its historical members at each date. A field
    that a ticker lacks, and NaN, are null; nothing is filled. The files are read in parallel, one row of bytes each.
    """
    first, last = _day("start", start), _day("end", end)
    if first > last:
        raise ValueError("end must not be before start")
    if (tickers is None) == (market is None):
        raise ValueError("either tickers or market is needed")
    root = data_dir.rstrip("/")
    if not _exists(spark, f"{root}/calendars/day.txt"):
        raise FileNotFoundError(f"no calendar at {root}/calendars/day.txt")
    members = None
    if market is not None:
        if not isinstance(market, str):
            raise TypeError("market must be text")
        if not re.fullmatch(r"[a-z][a-z0-9_]*", market.lower()):
            raise ValueError("not a market's name")
        if not _exists(spark, f"{root}/instruments/{market.lower()}.txt"):
            raise FileNotFoundError(f"no market {market}")
        lines = spark.read.csv(f"{root}/instruments/{market.lower()}.txt", sep="\t", schema="ticker string, first date, last date")
        members = lines.select(F.upper("ticker").alias("ticker"), "first", "last").where((F.col("first") <= last) & (F.col("last") >= first))
        # only the files of members are opened; their list is one small file, as the calendar is
        folders = sorted({r["ticker"].lower() for r in members.select("ticker").collect()})
        pattern = f"{root}/features/{{{','.join(folders)}}}/*.day.bin"
    else:
        if not isinstance(tickers, (str, Sequence)):
            raise TypeError("tickers must be a ticker or a list of them")
        names = [tickers] if isinstance(tickers, str) else list(tickers)
        if not names:
            raise ValueError("no ticker is given")
        if any(not isinstance(n, str) for n in names):
            raise TypeError("a ticker must be text")
        names = [n.upper() for n in names]
        if any(not re.fullmatch(r"[A-Z0-9_]+", n) for n in names) or len(set(names)) != len(names):
            raise ValueError("a ticker isn't valid or repeats")
        for n in names:
            if not _exists(spark, f"{root}/features/{n.lower()}/*.day.bin"):
                raise FileNotFoundError(f"no daily prices of {n}")
        pattern = f"{root}/features/{{{','.join(n.lower() for n in names)}}}/*.day.bin"
    fields = _field_names(spark, root)
    calendar = [r["value"].strip() for r in spark.read.text(f"{root}/calendars/day.txt").collect()]
    days = np.array([d for d in calendar if d], "datetime64[D]")
    low, high = int(np.searchsorted(days, np.datetime64(first))), int(np.searchsorted(days, np.datetime64(last), "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ticker, name = path.rsplit("/", 2)[-2:]
                values = np.frombuffer(content, "<f4")
                if not len(values):
                    continue
                at = int(values[0])
                a, b = max(low, at), min(high, at + len(values) - 1)
                if a < b:
                    found = values[1 + a - at : 1 + b - at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(days[a:b]),
                            pa.array([ticker.upper()] * (b - a)),
                            pa.array([name.removesuffix(".day.bin")] * (b - a)),
                            pa.array(found, pa.float32(), mask=np.isnan(found)),
                        ],
                        names=["date", "ticker", "field", "value"],
                    )

    if market is not None and (not folders or not _exists(spark, pattern)):
        empty = ", ".join(["date date", "ticker string", *[f"`{n}` float" for n in fields]])
        return spark.createDataFrame([], empty)
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    long = files.mapInArrow(run, "date date, ticker string, field string, value float")
    if members is not None:
        long = long.join(F.broadcast(members), "ticker").where(F.col("date").between(F.col("first"), F.col("last")))
    return long.groupBy("date", "ticker").pivot("field", fields).agg(F.first("value"))
