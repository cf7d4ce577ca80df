"""tessera: a PySpark-native factor-research engine (DataFrame in, DataFrame out).

The names below and those of ``data``, ``factors``, ``indicators``, ``portfolio``, ``performance``, ``returns``,
``rebalance`` and ``volatility`` are the public interface; they are imported when they are asked for.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"
__all__ = ["forward_volatility", "future_returns", "historical_return", "history_vol", "log_returns"]


def __getattr__(name: str):
    if name in __all__:
        return getattr(importlib.import_module(".operators.timeseries", __name__), name)
    raise AttributeError(name)
