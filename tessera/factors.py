"""Price factors, and ``python -m tessera.factors --db PATH`` to print one of a stored price table."""

from __future__ import annotations

import argparse

from .operators.panel import to_date_ticker_frame, to_panel
from .operators.timeseries import MOM_FACTORS, cumulative_log_returns, momentum, momentum_12_1, reversal

__all__ = ["MOM_FACTORS", "cumulative_log_returns", "momentum", "momentum_12_1", "reversal", "to_panel"]


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .sources.store import get_catalog, load_prices

    parser = argparse.ArgumentParser(description="Print the last rows of a factor.")
    parser.add_argument("--db", required=True, help="the folder of the table store")
    parser.add_argument("--factor", default="mom_12_1", choices=sorted(MOM_FACTORS))
    parser.add_argument("--rows", type=int, default=20)
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    prices = to_date_ticker_frame(df=load_prices(db=get_catalog(spark, path=chosen.db)))
    found = to_panel(MOM_FACTORS[chosen.factor](prices), chosen.factor)
    found.orderBy("date", "ticker", ascending=[False, True]).show(chosen.rows, truncate=False)


if __name__ == "__main__":
    main()
