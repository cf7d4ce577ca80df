"""Per-date statistics: z-scores and quantile buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import columns, number, refuse, whole
from .panel import KEYS

N_QUANTILES, N_VOL_GROUPS = 5, 5


def _finite_number(df: DataFrame, name: str) -> Column:
    value = number(F.col(f"`{name}`"), df.schema[name].dataType)
    return refuse(F.abs(value) == float("inf"), f"{name} must be finite", value)


def zscore_by_date(df: DataFrame, *, date_level: str = "date") -> DataFrame:
    """(x - mean) / sample deviation of each value column within its date, in one window over all columns.

    Null stays null; a deviation of 0, or fewer than two values, gives null. Infinite values stop the job.
    """
    columns(df, date_level, *(k for k in KEYS if k != "date"))
    values = [c for c in df.columns if c not in (*KEYS, date_level)]
    if not values:
        raise ValueError("no value column")
    for c in values:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.StringType)):
            raise ValueError(f"{c} must be numeric")
    by_date = W.partitionBy(date_level)
    keys = [c for c in df.columns if c not in values]
    clean = df.select(*keys, *[_finite_number(df, c).alias(c) for c in values])
    wide = clean.withColumns({f"__m{k}": F.avg(F.col(f"`{c}`")).over(by_date) for k, c in enumerate(values)}).withColumns(
        {f"__s{k}": F.stddev_samp(F.col(f"`{c}`")).over(by_date) for k, c in enumerate(values)}
    )
    scores = [F.when(F.col(f"__s{k}") != 0, (F.col(f"`{c}`") - F.col(f"__m{k}")) / F.col(f"__s{k}")).alias(c) for k, c in enumerate(values)]
    return wide.select(*keys, *scores)


def probabilities(n: int) -> list[float]:
    """k / n as percentages divided again by 100, the doubles that quantile labels are defined by."""
    step = 1.0 / n
    return [(k * step if k < n else 1.0) * 100 / 100 for k in range(n + 1)]


def edges(value: Column, place: Column, size: Column, group: WindowSpec, n: int) -> Column:
    """The distinct linear-interpolated quantiles of a group's values, as an array: ``place`` is a value's rank from 0
    and ``size`` the number of values, and the values next to each quantile are picked by their rank."""

    def edge(p: float) -> Column:
        at = F.lit(p) * (size - 1)
        low = F.floor(at).cast("int")
        t = at - low
        a = F.max(F.when(place == low, value)).over(group)
        b = F.max(F.when(place == F.least(low + 1, size - 1), value)).over(group)
        gap = b - a
        return F.when(t >= 0.5, b - gap * (1 - t)).otherwise(a + gap * t)

    return F.array_distinct(F.array(*[edge(p) for p in probabilities(n)]))


def bucketed(df: DataFrame, by: list[str], value: str, n: int, least: int, name: str) -> DataFrame:
    """``df`` with the quantile label 0..n-1 of ``value`` within ``by``; null where fewer than ``least`` rows have a
    value or all are equal. One exchange by the group: ranks, edges and labels are windows over it, which spill, and
    nothing is collected or joined back."""
    group = W.partitionBy(*by)
    ranked = df.withColumns(
        {
            "__v": F.col(value) + F.lit(0.0),
            "__n": F.count(value).over(group).cast("int"),
            "__place": F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1,
        }
    )
    cut = ranked.withColumn("__e", edges(F.col("__v"), F.col("__place"), F.col("__n"), group, n))
    label = F.greatest(F.size(F.filter("__e", lambda e: e < F.col("__v"))) - 1, F.lit(0))
    known = (F.col("__n") >= least) & (F.size("__e") > 1) & F.col("__v").isNotNull()
    return cut.withColumn(name, F.when(known, label)).drop("__v", "__n", "__place", "__e")


def simple_bucket(df: DataFrame, *, score_col: str = "score", n_quantiles: int = N_QUANTILES) -> DataFrame:
    """(date, ticker, bucket): the date's quantile of the score, higher scores in higher buckets."""
    n = whole("n_quantiles", n_quantiles, 2)
    columns(df, *KEYS, score_col)
    rows = df.select(*KEYS, _finite_number(df, score_col).alias("__x"))
    return bucketed(rows, ["date"], "__x", n, n, "bucket").select(*KEYS, "bucket")


def vol_bucket(
    df: DataFrame, *, score_col: str = "score", vol_col: str = "vol", n_quantiles: int = N_QUANTILES, n_vol_groups: int = N_VOL_GROUPS
) -> DataFrame:
    """(date, ticker, vol_bucket, bucket): quantiles of volatility, then of the score within each of these.

    Only rows with both values count; a date with fewer than n_vol_groups * n_quantiles of them has no labels, and a
    volatility group with fewer than n_quantiles rows has no score labels.
    """
    n, m = whole("n_quantiles", n_quantiles, 2), whole("n_vol_groups", n_vol_groups, 2)
    columns(df, *KEYS, score_col, vol_col)
    x, v = _finite_number(df, score_col), _finite_number(df, vol_col)
    rows = df.select(*KEYS, F.when(v.isNotNull(), x).alias("__x"), F.when(x.isNotNull(), v).alias("__vol"))
    first = bucketed(rows, ["date"], "__vol", m, m * n, "vol_bucket")
    ready = first.withColumn("__x", F.when(F.col("vol_bucket").isNotNull(), F.col("__x")))
    return bucketed(ready, ["date", "vol_bucket"], "__x", n, n, "bucket").select(*KEYS, "vol_bucket", "bucket")
