from .operators.portfolio import build_nav
from .operators.timeseries import future_returns, historical_return, log_returns

__all__ = ["build_nav", "future_returns", "historical_return", "log_returns"]
