from .operators.timeseries import forward_volatility, history_vol

__all__ = ["forward_volatility", "history_vol"]
