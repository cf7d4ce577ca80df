from .operators.cross_section import zscore_by_date

__all__ = ["zscore_by_date"]
