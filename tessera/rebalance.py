from .operators.portfolio import rebalance_dates, rebalance_dates_belong

__all__ = ["rebalance_dates", "rebalance_dates_belong"]
