from .operators.portfolio import buy_and_hold_nav

__all__ = ["buy_and_hold_nav"]
