"""Ingestion of a fixed universe: members, filings from a ZIP of company documents, and vendor prices."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fields import FIELDS
from ..operators.filings import combine_entities, derive_quarters, fact_schema, parse_company_facts, quarantined, standardize_facts
from ..sources.members import PREDECESSOR_CIKS, format_cik, normalize_members
from ..sources.store import Catalog, save_fundamentals, save_members, save_prices
from ..sources.vendor_prices import get_prices, missing_tickers


@contextmanager
def _archive(place: str) -> Iterator[zipfile.ZipFile]:
    """A ZIP in any store that pyarrow knows (a URI such as hdfs://, s3:// or file://), or at a local path; only the parts that
    are asked for are read. Executors open it too, so a local path must be there on all of them."""
    files, path = pafs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (pafs.LocalFileSystem(), place)
    with files.open_input_file(path) as stream, zipfile.ZipFile(stream) as found:
        yield found


def _payloads(entities: DataFrame, archive: str) -> DataFrame:
    """(ticker, entity) -> (ticker, payload): each document read from the ZIP and checked where it is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        with _archive(archive) as found:
            for batch in batches:
                for ticker, entity in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name = f"CIK{entity}.json"
                    text = found.read(name)
                    document = json.loads(text)
                    if not isinstance(document, dict) or "cik" not in document or not isinstance(document.get("facts"), dict):
                        raise ValueError(f"no company facts in {name}")
                    if format_cik(document["cik"]) != entity:
                        raise ValueError(f"{name} is of another company")
                    yield pa.RecordBatch.from_arrays([pa.array([ticker]), pa.array([text.decode()])], names=["ticker", "payload"])

    return entities.mapInArrow(run, "ticker string, payload string")


def standard_facts(payloads: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, payload) documents -> (facts with derived quarters, quarantined facts), combined over companies.

    Quarters are derived within one company only, after its bad facts were set apart.
    """
    concepts = sorted({c for spec in FIELDS.values() for c in spec.concepts})
    standard = standardize_facts(parse_company_facts(payloads, concepts))
    good, bad = quarantined(standard)
    return combine_entities(derive_quarters(good), members), combine_entities(bad, members)


class SP500Data:
    """A universe of members and its data sources.

    ``report`` holds figures of the last call; ``quarantine`` the facts set apart by the last ``fundamentals()``.
    """

    def __init__(
        self,
        *,
        universe: DataFrame,
        companyfacts: str | None = None,
        db: Catalog | None = None,
        write: bool = False,
        fetch: Callable[..., DataFrame] | None = None,
    ):
        if write and db is None:
            raise ValueError("write=True needs db")
        self.spark: SparkSession = universe.sparkSession
        rows = normalize_members(universe)
        # a universe is a few hundred rows: a copy here keeps both sources on the same members whatever happens outside
        self._universe = self.spark.createDataFrame(rows.collect(), rows.schema)
        self.companyfacts, self.db, self.write, self.fetch = companyfacts, db, write, fetch
        self.report: dict = {}
        self.quarantine = self.spark.createDataFrame([], fact_schema())
        self._cached: list[DataFrame] = []

    def _cache(self, *frames: DataFrame) -> list[DataFrame]:
        """Caches the last call's results only."""
        for old in self._cached:
            old.unpersist()
        self._cached = [frame.cache() for frame in frames]
        return self._cached

    def _writes(self, write: bool | None) -> bool:
        wanted = self.write if write is None else write
        if wanted and self.db is None:
            raise ValueError("write=True needs db")
        return wanted

    def members(self, *, write: bool | None = None) -> DataFrame:
        """The members as they were given; optionally stored, replacing the table."""
        if self._writes(write):
            save_members(self.db, self._universe)
        return self._universe

    def fundamentals(self, *, write: bool | None = None, allow_partial: bool = False) -> DataFrame:
        """All standard facts and versions of the universe.

        A ticker without a CIK, or with a company whose document is missing, is skipped whole; without
        ``allow_partial`` any such gap is a ValueError and nothing is written.
        """
        wanted = self._writes(write)
        if self.companyfacts is None:
            raise ValueError("fundamentals() needs companyfacts")
        with _archive(self.companyfacts) as archive:
            names = set(archive.namelist())
        self.report = {"kind": "fundamentals", "missing_mappings": [], "missing_files": [], "written": False}
        entities, done = [], []
        for r in self._universe.select("ticker", "cik").orderBy("ticker").collect():
            if r["cik"] is None:
                self.report["missing_mappings"].append(r["ticker"])
                continue
            own = list(dict.fromkeys([*PREDECESSOR_CIKS.get(r["ticker"], ()), r["cik"]]))
            gone = [c for c in own if f"CIK{c}.json" not in names]
            self.report["missing_files"] += [{"ticker": r["ticker"], "cik": c} for c in gone]
            if not gone:
                entities += [(r["ticker"], c) for c in own]
                done.append(r["ticker"])
        if (self.report["missing_mappings"] or self.report["missing_files"]) and not allow_partial:
            raise ValueError(f"the sources are incomplete: {self.report}")
        listed = self.spark.createDataFrame(entities, "ticker string, entity string")
        spread = listed.repartition(max(1, min(len(entities), 2 * self.spark.sparkContext.defaultParallelism)))
        facts, bad = standard_facts(_payloads(spread, self.companyfacts), self._universe.select("ticker", "cik"))
        facts, self.quarantine = self._cache(facts, bad)
        found = facts.groupBy("ticker", "field").agg(F.count("*").alias("n"), F.count_if("derived").alias("derived")).collect()
        present = {(r["ticker"], r["field"]) for r in found}
        self.report |= {
            "missing_fields": [{"ticker": t, "field": f} for t in done for f in FIELDS if (t, f) not in present],
            "rows": sum(r["n"] for r in found),
            "tickers": len({t for t, _ in present}),
            "quarantined_rows": self.quarantine.count(),
            "derived_rows": sum(r["derived"] for r in found),
        }
        if wanted and done:
            save_fundamentals(self.db, facts, self.quarantine, done, list(FIELDS))
            self.report["written"] = True
        return facts.orderBy("ticker", "field", "period_end", "period_months", "accn")

    def prices(self, start, end=None, *, write: bool | None = None) -> DataFrame:
        """Vendor prices of the universe from ``start`` up to before ``end``; optionally upserted."""
        wanted = self._writes(write)
        if self.fetch is None:
            raise ValueError("prices() needs fetch")
        if end is not None and str(end) <= str(start):
            raise ValueError("end must be after start")
        tickers = [r["ticker"] for r in self._universe.select("ticker").collect()]
        (found,) = self._cache(get_prices(self.fetch, tickers, start, end))
        n = found.count()
        gone = [r["ticker"] for r in missing_tickers(found, self._universe).orderBy("ticker").collect()]
        self.report = {"kind": "prices", "written": False, "rows": n, "missing_tickers": gone}
        if wanted and n:
            save_prices(self.db, found)
            self.report["written"] = True
        return found
