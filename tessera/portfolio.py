from .operators.cross_section import N_QUANTILES, N_VOL_GROUPS, simple_bucket, vol_bucket
from .operators.portfolio import quantile_forward_returns

__all__ = ["N_QUANTILES", "N_VOL_GROUPS", "quantile_forward_returns", "simple_bucket", "vol_bucket"]
