import datetime as dt
import json

import numpy as np
import pytest
from helpers import day, panel
from pyspark.sql import functions as F

from tessera.sources import html_tables, members, qlib, store, vendor_prices

D = dt.date.fromisoformat


@pytest.fixture
def db(spark, tmp_path):
    return store.get_catalog(spark, path=str(tmp_path / "db"), read_only=False)


def prices(spark, rows):
    data = [(day(k), t, None, None, None, c, None, None) for k, t, c in rows]
    return spark.createDataFrame(data, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")


def test_price_upsert(spark, db, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.get_catalog(spark, path=str(tmp_path / "none"))
    store.save_prices(db, prices(spark, [(0, "A", 1.0), (1, "A", 2.0), (0, "B", 3.0)]))
    db.commit({"prices": db.read("prices").withColumn("source", F.lit("old"))})
    store.save_prices(db, prices(spark, [(1, "A", 20.0), (2, "A", 30.0)]))
    found = {(r["ticker"], r["date"]): (r["close"], r["source"]) for r in db.read("prices").collect()}
    assert found == {("A", day(0)): (1.0, "old"), ("A", day(1)): (20.0, None), ("A", day(2)): (30.0, None), ("B", day(0)): (3.0, "old")}
    for wrong in ([(0, "A", None)], [(0, "A", 1.0), (0, "A", 2.0)]):
        with pytest.raises(ValueError):
            store.save_prices(db, prices(spark, wrong))
    reader = store.get_catalog(spark, path=db.root)
    assert [r["close"] for r in store.load_prices(db=reader, tickers="a", start=day(1), end=day(2)).collect()] == [20.0, 30.0]
    assert store.load_prices(db=reader, tickers=[]).count() == 0
    with pytest.raises(PermissionError):
        reader.commit({})


def test_a_failed_write_leaves_all_tables(spark, db):
    store.save_prices(db, prices(spark, [(0, "A", 1.0)]))
    before = db.versions()
    bad = prices(spark, [(0, "A", 1.0)]).withColumn("close", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        db.commit({"first": prices(spark, [(0, "B", 1.0)]), "second": bad})
    assert db.versions() == before and not db.has("first")


def test_scope_replace_clears_what_is_empty_now(spark, db):
    schema = "ticker string, field string, value int"
    old = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "x", 3)], schema)
    store.save_fundamentals(db, old, old.limit(0), ["A", "B"], ["x", "y"])
    store.save_fundamentals(db, spark.createDataFrame([("A", "x", 9)], schema), old.limit(0), ["A"], ["x", "y"])
    assert sorted(tuple(r) for r in db.read("fundamentals").collect()) == [("A", "x", 9), ("B", "x", 3)]


def test_members(spark, db, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,name,cik,extra\nNA,National,12,q\n brk.b ,Berkshire,,q\n")
    (tmp_path / "sec.json").write_text(json.dumps({"0": {"ticker": "BRK-B", "cik_str": 1067983, "title": "BERKSHIRE"}}))
    found = members.load_members(spark, str(tmp_path / "m.csv"), sec_tickers=str(tmp_path / "sec.json"))
    got = {r["ticker"]: (r["cik"], r["sec_title"]) for r in found.collect()}
    assert got == {"NA": ("0000000012", None), "BRK-B": ("0001067983", "BERKSHIRE")}
    store.save_members(db, found)
    assert db.read("constituents").columns == store.CONSTITUENTS.names
    assert [r["ticker"] for r in store.load_constituents(db=db, tickers=["na"]).collect()] == ["NA"]
    (tmp_path / "other.json").write_text(json.dumps({"0": {"ticker": "NA", "cik_str": 13, "title": "X"}}))
    with pytest.raises(ValueError):
        members.load_members(spark, str(tmp_path / "m.csv"), sec_tickers=str(tmp_path / "other.json"))
    for rows in ([("A", "x", "1"), ("a", "y", "2")], [("A", " ", "1")], [(" ", "x", "1")], [("A", "x", "12345678901")], []):
        with pytest.raises(ValueError):
            members.normalize_members(spark.createDataFrame(rows, "ticker string, name string, cik string"))
    with pytest.raises(ValueError):
        members.load_members(spark, "members.txt")
    assert members.format_cik(320193.0) == "0000320193" and members.format_cik("12 ") == "0000000012"
    for wrong in ("1" * 11, "x", 1.5, "١٢"):
        with pytest.raises(ValueError):
            members.format_cik(wrong)


HTML = """<table><tr><td>unrelated</td></tr></table>
<table><tr><th>Symbol</th><th>Security[1]</th><th>GICS Sector</th><th>GICS Sub-Industry</th><th>Date added</th><th>CIK</th></tr>
<tr><td>MMM[a]</td><td>3M</td><td>Industrials</td><td>—</td><td>1957-03-04</td><td>66740</td></tr>
<tr><td>BRK.B</td><td>Berkshire</td><td>Financials</td><td>Multi</td><td>February 16, 2010[2]</td><td>1067983</td></tr>
<tr><td>NA</td><td>National</td><td>N/A</td><td>x</td><td>soon</td><td></td></tr><tr><td>-</td><td>none</td></tr><tr><td>MMM</td><td>again</td></tr></table>
<table><tr><th rowspan=2>Effective Date</th><th colspan=2>Added</th><th colspan=2>Removed</th><th rowspan=2>Reason</th></tr>
<tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>
<tr><td>January 22, 2024</td><td>A.B</td><td>Ab</td><td></td><td></td><td>why</td></tr>
<tr><td>2024-03-01</td><td></td><td></td><td>X</td><td>Ex</td><td></td></tr>
<tr><td>unknown</td><td>Y</td><td></td><td></td><td></td><td></td></tr><tr><td>2024-01-01</td><td>-</td><td></td><td></td><td></td><td>rename</td></tr></table>"""


def test_html_tables(spark):
    found = [tuple(r) for r in html_tables.parse_constituents(spark, HTML).collect()]
    assert found == [
        ("BRK-B", "Berkshire", "Financials", "Multi", D("2010-02-16"), "1067983"),
        ("MMM", "3M", "Industrials", "", D("1957-03-04"), "66740"),
        ("NA", "National", "", "x", None, ""),
    ]
    changes = [tuple(r) for r in html_tables.parse_changes(spark, HTML).collect()]
    assert changes == [(D("2024-03-01"), "", "", "X", "Ex", ""), (D("2024-01-22"), "A-B", "Ab", "", "", "why")]
    assert html_tables.plain("a [1] b [open") == "a b [open" and html_tables.header_name(["GICS[3] Sub-Industry", "GICS Sub-Industry", ""]) == "gics_sub_industry"
    assert html_tables.day_of("on Sep 5, 2001") == D("2001-09-05") and html_tables.day_of("Smarch 5, 2001") is None
    for wrong in ("<p>no table</p>", "<table><tr><th>a</th></tr></table>"):
        with pytest.raises(ValueError):
            html_tables.parse_constituents(spark, wrong)


def test_vendor_prices(spark):
    rows = [("2024-01-01", "1", "2", "0.5", "1.5", "1.4", "10"), ("2024-01-02", "x", None, None, "2.5", None, "11"), ("2024-01-03", "1", "1", "1", None, "1", "1")]
    wide = spark.createDataFrame(rows, ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"])
    found = [tuple(r) for r in vendor_prices.clean_vendor_prices(wide, "A").collect()]
    assert found == [(D("2024-01-01"), "A", 1.0, 2.0, 0.5, 1.5, 1.4, 10.0), (D("2024-01-02"), "A", None, None, None, 2.5, None, 11.0)]
    raw = wide.drop("Adj Close")
    assert {r["adj_close"] for r in vendor_prices.clean_vendor_prices(raw, "A").collect()} == {None}
    assert [r["adj_close"] for r in vendor_prices.clean_vendor_prices(raw, "A", auto_adjust=True).collect()] == [1.5, 2.5]
    fetch = lambda names, start, end, **_: wide.withColumn("ticker", F.lit("A"))
    assert vendor_prices.get_prices(fetch, ["A", "B"], "2024-01-01", "2024-01-02").count() == 1


def test_vendor_prices_within_a_day(spark):
    rows = [(f"2024-01-0{d} {h}:30:00", float(d), "A") for d in (1, 2) for h in (10, 11)]
    wide = spark.createDataFrame(rows, ["Datetime", "Close", "ticker"]).withColumn("Datetime", F.to_timestamp("Datetime"))
    fetch = lambda names, start, end, **_: wide
    found = vendor_prices.get_prices(fetch, "A", "2024-01-01", "2024-01-02", interval="1h")
    assert [str(r["date"]) for r in found.collect()] == ["2024-01-01 10:30:00", "2024-01-01 11:30:00"]
    assert dict(vendor_prices.get_prices(fetch, "A", "2024-01-01", interval="1mo").dtypes)["date"] == "date"


@pytest.fixture
def provider(tmp_path):
    for d in ("calendars", "instruments", "features/sh600000", "features/sz000001"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "calendars/day.txt").write_text("2024-01-02\n2024-01-03\n2024-01-04\n")
    (tmp_path / "instruments/csi300.txt").write_text("SH600000\t2024-01-02\t2024-01-03\nSZ000001\t2024-01-04\t2024-12-31\n")
    for t, m in (("sh600000", 1.0), ("sz000001", 2.0)):
        for name in ("close", "open", "zeta", "amount"):
            if (t, name) != ("sz000001", "zeta"):
                np.array([0, m, np.nan, 3 * m], "<f4").tofile(tmp_path / f"features/{t}/{name}.day.bin")
    np.array([1, 7.5], "<f4").tofile(tmp_path / "features/sz000001/volume.day.bin")
    return str(tmp_path)


def test_binary_prices(spark, provider, db):
    found = qlib.read_qlib_prices(spark, data_dir=provider, start="2023-01-01", end="2024-12-31", tickers=["sh600000", "SZ000001"])
    assert found.columns == ["date", "ticker", "open", "close", "volume", "amount", "zeta"] and dict(found.dtypes)["close"] == "float"
    got = {(r["ticker"], str(r["date"])): r for r in found.collect()}
    assert len(got) == 6 and got["SH600000", "2024-01-04"]["close"] == 3.0 and got["SZ000001", "2024-01-03"]["volume"] == 7.5
    assert got["SH600000", "2024-01-03"]["close"] is None and got["SZ000001", "2024-01-04"]["zeta"] is None
    market = qlib.read_qlib_prices(spark, data_dir=provider, start="2024-01-02", end="2024-01-04", market="CSI300")
    assert sorted((r["ticker"], str(r["date"])) for r in market.collect()) == [("SH600000", "2024-01-02"), ("SH600000", "2024-01-03"), ("SZ000001", "2024-01-04")]
    none = qlib.read_qlib_prices(spark, data_dir=provider, start="2023-01-01", end="2023-12-31", market="csi300")
    assert none.columns == market.columns and none.count() == 0
    open(f"{provider}/features/other.day.bin", "w").close()
    store.save_qlib_prices(db=db, prices=found, release_tag="2024-10-07")
    assert store.load_qlib_prices(db=db, tickers="sz000001").columns == found.columns
    stored = db.read("qlib_prices")
    assert stored.where("release_tag = '2024-10-07'").count() == 6 and dict(stored.dtypes)["close"] == "float"


@pytest.mark.parametrize(
    ("options", "error"),
    [
        ({"tickers": "SH600000", "market": "csi300"}, ValueError),
        ({}, ValueError),
        ({"tickers": []}, ValueError),
        ({"tickers": ["A", "a"]}, ValueError),
        ({"tickers": "A.B"}, ValueError),
        ({"tickers": [1]}, TypeError),
        ({"tickers": "XX"}, FileNotFoundError),
        ({"market": "none"}, FileNotFoundError),
        ({"market": "../x"}, ValueError),
        ({"tickers": "SH600000", "end": "2020-01-01"}, ValueError),
        ({"tickers": "SH600000", "start": "2024-01-02 10:00"}, ValueError),
        ({"tickers": "SH600000", "start": 5}, TypeError),
    ],
)
def test_binary_arguments(spark, provider, options, error):
    with pytest.raises(error):
        qlib.read_qlib_prices(spark, data_dir=provider, **{"start": "2024-01-01", "end": "2024-01-05", **options})


def test_release_tables_are_checked(spark, db):
    good = panel(spark, {"A": [1.0]}, "close")
    wrong = [
        (good.limit(0), "2024-01-01"),
        (good, "latest"),
        (good.withColumn("Close", F.lit(1)).withColumnRenamed("close", "x").withColumnRenamed("x", "RELEASE_TAG"), "2024-01-01"),
        (good.withColumn("close", F.lit("x")), "2024-01-01"),
        (good.withColumn("close", F.lit(float("inf"))), "2024-01-01"),
        (good.withColumn("ticker", F.lit(" ")), "2024-01-01"),
        (good.withColumn("date", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")), "2024-01-01"),
        (good.unionByName(good), "2024-01-01"),
    ]
    for prices_, tag in wrong:
        with pytest.raises(ValueError):
            store.save_qlib_prices(db=db, prices=prices_, release_tag=tag)
    with pytest.raises(TypeError):
        store.save_qlib_prices(db=db, prices=good, release_tag=20240101)
