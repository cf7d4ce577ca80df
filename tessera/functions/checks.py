"""Argument checks and data assertions shared by the operators.

Data assertions are expressions inside the plan (``raise_error``), so a violation stops the job that meets it and a
valid input costs no extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)


def whole(name: str, value: object, least: int, kind: type[Exception] = ValueError) -> int:
    """An int of at least ``least``; bool isn't one."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise kind(f"{name} must be an int") if kind is ValueError and name == "freq" else TypeError(f"{name} must be an int")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def columns(df: DataFrame, *names: str) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names repeat")
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")


def refuse(when: Column, message: str, value: Column) -> Column:
    """``value``, or an error for rows where ``when`` holds."""
    return F.when(when, F.raise_error(F.lit(message))).otherwise(value)


def number(column: Column, kind: T.DataType) -> Column:
    """A double with NaN as null; text that is no number is an error."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType, T.StringType)) else value


def finite(column: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(column) & (F.abs(column) != float("inf")), F.lit(False))
