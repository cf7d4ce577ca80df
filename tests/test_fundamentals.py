import datetime as dt
import json
import random
import zipfile

import pytest

from tessera.operators import filings, pit
from tessera.operators.fields import FIELDS, get_field_concepts
from tessera.plans.ingest import SP500Data
from tessera.sources import store

D = dt.date.fromisoformat


def item(start, end, val, accn, filed, form="10-Q"):
    return {"start": start, "end": end, "val": val, "accn": accn, "fy": 2024, "fp": "Q1", "form": form, "filed": filed} if start else {
        "end": end, "val": val, "accn": accn, "fy": 2024, "fp": "FY", "form": form, "filed": filed
    }


def company(cik, flows):
    return {"cik": cik, "entityName": "X", "facts": {"us-gaap": {"NetIncomeLoss": {"units": {"USD": flows}}, "Assets": {"units": {"USD": [item(None, "2024-12-31", 5, "a9", "2024-06-01")]}}}}}


FLOWS = [
    item("2024-01-01", "2024-03-31", 100, "a1", "2024-04-20"),
    item("2024-01-01", "2024-06-30", 250, "a2", "2024-07-20"),
    item("2024-01-01", "2024-09-30", 400, "a3", "2024-10-20"),
    item("2024-01-01", "2024-12-31", 600, "a4", "2025-01-20", "10-K"),
    item("2024-01-01", "2024-03-31", 110, "a5", "2025-03-01"),
    item("2024-01-01", "2024-03-31", None, "a6", "2025-03-01"),
]


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("facts")
    with zipfile.ZipFile(root / "facts.zip", "w") as z:
        for cik in (1, 2):
            z.writestr(f"CIK{cik:010d}.json", json.dumps(company(cik, FLOWS)))
    members = spark.createDataFrame([("aa", "A", "1"), ("b.b", "B", "2")], "ticker string, name string, cik string")
    db = store.get_catalog(spark, path=str(root / "db"), read_only=False)
    data = SP500Data(universe=members, companyfacts=str(root / "facts.zip"), db=db, write=True)
    facts = data.fundamentals()
    return root, members, db, data, facts


def test_ingest(ingested):
    root, members, db, data, facts = ingested
    rows = [r for r in facts.collect() if r["ticker"] == "AA" and r["field"] == "net_income"]
    derived = sorted((r["period_end"], r["value"], r["period_start"], r["accn"]) for r in rows if r["derived"])
    assert [(e, v) for e, v, *_ in derived] == [(D("2024-06-30"), 150), (D("2024-09-30"), 150), (D("2024-12-31"), 200)]
    assert derived[0][2] == D("2024-04-01") and derived[0][3] == "a2"
    assert data.report["quarantined_rows"] == 2 and data.report["written"] and data.report["derived_rows"] == 6
    assert data.report["tickers"] == 2 and {"ticker": "AA", "field": "revenue"} in data.report["missing_fields"]
    stored = store.Catalog(db.spark, db.root)
    assert stored.read("fundamentals").count() == facts.count() and stored.read("fundamentals_quarantine").count() == 2
    as_of = pit.load_fundamentals_pit(stored.read("fundamentals"), "2024-08-01", "aa", "net_income", period_months=3).collect()
    assert [r["value"] for r in as_of] == [150]
    ttm = pit.load_fundamentals_ttm(stored.read("fundamentals"), ["2025-02-01"], ["AA"], "net_income").collect()
    assert [r["value"] for r in ttm] == [600]
    assert data.members().count() == 2 and pit.load_latest_filed(facts, "AA").first()["last_filed"] == D("2025-03-01")


def test_stored_facts_by_the_public_readers(ingested):
    from tessera import data

    db = ingested[2]
    assert data.load_fundamentals("AA", "net_income", period_months=3, db=db).count() == 5
    assert data.load_fundamentals_pit("2024-08-01", "AA", "net_income", period_months=3, db=db).first()["value"] == 150
    assert data.load_fundamentals_panel(["2024-08-01"], ["aa", "b-b"], "net_income", period_months=3, db=db).count() == 2
    assert [r["value"] for r in data.load_fundamentals_ttm(["2025-02-01"], fields="net_income", db=db).collect()] == [600, 600]
    assert data.load_latest_filed(db=db).count() == 2


def test_gaps_in_the_sources(spark, ingested):
    root, _, _, _, _ = ingested
    members = spark.createDataFrame([("AA", "A", "1"), ("CC", "C", "3"), ("DD", "D", None)], "ticker string, name string, cik string")
    data = SP500Data(universe=members, companyfacts=(root / "facts.zip").as_uri())
    with pytest.raises(ValueError):
        data.fundamentals()
    assert {r["ticker"] for r in data.fundamentals(allow_partial=True).collect()} == {"AA"}
    assert data.report["missing_mappings"] == ["DD"] and data.report["missing_files"] == [{"ticker": "CC", "cik": "0000000003"}]
    with pytest.raises(ValueError):
        SP500Data(universe=members, write=True)


def fact(ticker, end, value, filed, accn="a", months=3, field="revenue", derived=False):
    return (ticker, "1", field, "c", "USD", None, D(end), months, value, 2024, "Q1", "10-Q", accn, D(filed), derived)


def table(spark, rows):
    return spark.createDataFrame(rows, filings.fact_schema())


QUARTERS = ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31"]


def test_ttm_needs_four_quarters_in_a_row(spark):
    good = [fact("A", e, 10.0 * (k + 1), "2024-01-15") for k, e in enumerate(QUARTERS)]
    gap = [fact("B", e, 1.0, "2024-01-15") for e in ("2023-03-31", "2023-04-30", "2023-09-30", "2023-12-31")]
    null = [fact("C", e, None if k == 1 else 1.0, "2024-01-15") for k, e in enumerate(QUARTERS)]
    better = [fact("A", "2023-12-31", 50.0, "2024-02-01", "b"), fact("A", "2023-12-31", 7.0, "2024-02-01", "z", derived=True)]
    facts = table(spark, good + gap + null + better)
    for staleness in (200, None):
        found = {(r["date"], r["ticker"]): r["value"] for r in pit.load_fundamentals_ttm(facts, ["2024-01-20", "2024-03-01"], max_staleness_days=staleness).collect()}
        assert found == {(D("2024-01-20"), "A"): 100, (D("2024-03-01"), "A"): 110, (D("2024-01-20"), "C"): 3, (D("2024-03-01"), "C"): 3}
    assert pit.load_fundamentals_ttm(facts, ["2025-01-20"]).count() == 0
    assert pit.load_fundamentals_ttm(facts, []).count() == 0
    with pytest.raises(ValueError):
        pit.load_fundamentals_ttm(facts, ["2024-01-20"], fields="eps_basic")
    with pytest.raises(KeyError):
        pit.load_fundamentals_ttm(facts, ["2024-01-20"], fields="nothing")


def test_panel_and_filters(spark):
    facts = table(spark, [fact("A", "2023-12-31", 1.0, "2024-02-01"), fact("A", "2023-12-31", 2.0, "2024-03-01", "b"), fact("A", "2023-09-30", 9.0, "2024-04-01")])
    found = {r["date"]: r["value"] for r in pit.load_fundamentals_panel(facts, ["2024-01-31", "2024-02-01", "2024-03-15", "2024-05-01", "2030-01-01"]).collect()}
    assert found == {D("2024-02-01"): 1.0, D("2024-03-15"): 2.0, D("2024-05-01"): 2.0}
    assert pit.load_fundamentals(facts, "", None).count() == 0 and pit.load_fundamentals(facts, [], None).count() == 0
    assert pit.load_fundamentals(facts, "a", ["revenue"], period_months=3, filed_until="2024-02-15").count() == 1
    assert pit.load_fundamentals_pit(facts, "2024-05-01", latest_only=False).count() == 2
    assert pit.load_fundamentals_pit(facts, "2024-05-01", max_staleness_days=30).count() == 0


def test_features(spark):
    facts = table(
        spark,
        [fact("A", e, 100.0, "2024-01-15") for e in QUARTERS]
        + [fact("A", e, 25.0, "2024-01-15", field="net_income") for e in QUARTERS]
        + [fact("B", "2023-12-31", 7.0, "2024-01-15", months=0, field="total_assets")],
    )
    days = ["2024-02-01"]
    panel = pit.load_fundamentals_panel(facts, days, fields=["total_assets"], period_months=0)
    ttm = pit.load_fundamentals_ttm(facts, days)
    found = pit.feature_table(panel, ttm, facts, days, ["total_assets"], ["revenue", "net_income"])
    got = {r["ticker"]: (r["total_assets"], r["revenue_ttm"], r["net_margin_ttm"]) for r in found.collect()}
    assert got == {"A": (None, 400.0, 0.25), "B": (7.0, None, None)}
    assert pit.coverage(found).first()["revenue_ttm"] == 1


def test_fields():
    assert len(FIELDS) == 25 and sum(s.additive for s in FIELDS.values()) == 14
    assert get_field_concepts("gross_profit") == ("us-gaap:GrossProfit",)
    with pytest.raises(KeyError):
        get_field_concepts("nothing")


def test_period_months(spark):
    spans = [(None, 0), (70, 3), (112, 3), (125, 3), (126, 4), (150, 6), (252, 9), (300, 9), (330, 12), (390, 12), (30, 1), (60, 2), (500, 16)]
    end = D("2024-12-31")
    rows = [(k, None if n is None else end - dt.timedelta(days=n - 1), end) for k, (n, _) in enumerate(spans)]
    df = spark.createDataFrame(rows, "k int, s date, e date")
    found = {r["k"]: r["m"] for r in df.select("k", filings.period_months(df["s"], df["e"]).alias("m")).collect()}
    assert [found[k] for k in range(len(spans))] == [m for _, m in spans]


def test_quarters_as_by_all_pairs(spark):
    """Unusual spans, several versions, other concepts, two starts in one filing and reported quarters."""
    r = random.Random(4)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = []
    for k in range(300):
        months = r.choice([3, 3, 6, 6, 9, 12, 4, 7])
        end = day(months * 30 + r.choice([0, 0, 1, 25]))
        rows.append(("A", r.choice("12"), r.choice(["revenue", "eps_basic", "net_income"]), r.choice(["c", "d"]), "USD", day(r.choice([0, 0, 1])), end, months,
                     float(r.randrange(1000)), 2024, "Q", "10-Q", f"a{r.randrange(40):02d}", end + dt.timedelta(days=r.randrange(200)), False))
    seen, facts = set(), []
    for x in rows:  # one value per version, as the sources give it
        if (x[1], x[2], x[12], x[6], x[7]) not in seen:
            seen.add((x[1], x[2], x[12], x[6], x[7]))
            facts.append(x)
    best = {}
    for a in facts:
        if a[2] in ("revenue", "net_income") and a[7] in (6, 9, 12):
            for b in facts:
                gap = (a[6] - b[6]).days
                if b[1:3] == a[1:3] and b[5] == a[5] and b[7] == a[7] - 3 and b[13] <= a[13] and 70 <= gap <= 125:
                    choice = (a[3] == b[3], b[13], b[12], b[6], b[8])
                    version = (a[1], a[2], a[12], a[6], a[7])
                    if version not in best or choice > best[version][0]:
                        best[version] = (choice, a, b)
    want = {(x[1], x[2], x[12], x[6], x[7]): (x[5], x[8], False) for x in facts}
    for (cik, field, accn, end, _), (_, a, b) in sorted(best.items(), key=lambda x: x[1][0]):
        want.setdefault((cik, field, accn, end, 3), (b[6] + dt.timedelta(days=1), a[8] - b[8], True))
    found = filings.derive_quarters(table(spark, facts).repartition(3)).collect()
    got = {(x["cik"], x["field"], x["accn"], x["period_end"], x["period_months"]): (x["period_start"], x["value"], x["derived"]) for x in found}
    assert len(found) == len(got) and got == want and sum(x["derived"] for x in found) > 20
