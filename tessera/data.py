"""Reading, checking and storing of prices, members and fundamentals."""

from .operators.panel import to_date_ticker_frame, validate_prices
from .operators import pit
from .operators.pit import coverage, feature_table
from .plans.ingest import SP500Data
from .sources.html_tables import parse_changes, parse_constituents
from .sources.members import load_members, normalize_members, read_sec_tickers, with_sec_mapping
from .sources.qlib import read_qlib_prices
from .sources.store import (
    Catalog,
    get_catalog,
    load_constituents,
    load_prices,
    load_qlib_prices,
    save_fundamentals,
    save_members,
    save_prices,
    save_qlib_prices,
)
from .sources.vendor_prices import clean_vendor_prices, get_prices


def prepare_members(spark, html: str, *, sec_tickers: str | None = None):
    """The current members of a page, normalised and, where a mapping file is given, with their filing companies."""
    found = normalize_members(parse_constituents(spark, html))
    return with_sec_mapping(found, read_sec_tickers(spark, sec_tickers) if sec_tickers else None)


def load_fundamentals(tickers=None, fields=None, start=None, end=None, *, period_months=None, filed_until=None, db: Catalog):
    """All stored versions whose period ends within start..end, filed by ``filed_until``."""
    facts = db.read("fundamentals")
    return pit.load_fundamentals(facts, tickers, fields, start, end, period_months=period_months, filed_until=filed_until)


def load_fundamentals_pit(as_of, tickers=None, fields=None, *, period_months=None, latest_only=True, max_staleness_days=None, db: Catalog):
    """What the stored filings said at ``as_of``."""
    options = {"period_months": period_months, "latest_only": latest_only, "max_staleness_days": max_staleness_days}
    return pit.load_fundamentals_pit(db.read("fundamentals"), as_of, tickers, fields, **options)


def load_fundamentals_panel(dates, tickers=None, fields=None, *, period_months=None, max_staleness_days=550, db: Catalog):
    """One row per date, ticker, field and length, in order."""
    options = {"period_months": period_months, "max_staleness_days": max_staleness_days}
    found = pit.load_fundamentals_panel(db.read("fundamentals"), dates, tickers, fields, **options)
    return found.orderBy("date", "ticker", "field", "period_months")


def load_fundamentals_ttm(dates, tickers=None, fields=None, *, max_staleness_days=200, db: Catalog):
    """Sums of four consecutive quarters at each date, in order."""
    found = pit.load_fundamentals_ttm(db.read("fundamentals"), dates, tickers, fields, max_staleness_days=max_staleness_days)
    return found.orderBy("date", "ticker", "field")


def load_latest_filed(tickers=None, *, db: Catalog):
    """(ticker, last_filed)."""
    return pit.load_latest_filed(db.read("fundamentals"), tickers)


__all__ = [
    "Catalog",
    "SP500Data",
    "clean_vendor_prices",
    "coverage",
    "feature_table",
    "get_catalog",
    "get_prices",
    "load_constituents",
    "load_fundamentals",
    "load_fundamentals_panel",
    "load_fundamentals_pit",
    "load_fundamentals_ttm",
    "load_latest_filed",
    "load_members",
    "load_prices",
    "load_qlib_prices",
    "normalize_members",
    "parse_changes",
    "parse_constituents",
    "prepare_members",
    "read_qlib_prices",
    "save_fundamentals",
    "save_members",
    "save_prices",
    "save_qlib_prices",
    "to_date_ticker_frame",
    "validate_prices",
]
