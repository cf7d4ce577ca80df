import importlib
import re
import sys

import pytest
from helpers import day

import __spark_entry__ as entry
from tessera.plans import catalogue

NAMES = ["data", "factors", "indicators", "portfolio", "performance", "returns", "rebalance", "volatility"]


def test_public_names():
    import tessera

    assert all(callable(getattr(tessera, n)) for n in tessera.__all__)
    for name in NAMES:
        module = importlib.import_module(f"tessera.{name}")
        assert all(hasattr(module, n) for n in module.__all__)
    with pytest.raises(AttributeError):
        tessera.nothing  # noqa: B018


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) >= 40
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_needs_the_subpackage():
    for name in list(sys.modules):
        if name.startswith("tessera.llm"):
            continue
        module = sys.modules[name]
        if name.startswith("tessera") and getattr(module, "__file__", None):
            assert not re.search(r"\bllm\b", open(module.__file__).read()), name


def test_the_command_prints_a_factor(spark, tmp_path, capsys):
    from tessera import factors
    from tessera.sources import store

    db = store.get_catalog(spark, path=str(tmp_path / "db"), read_only=False)
    rows = [(day(k), "A", None, None, None, 1.0 + k, 1.0 + k, None) for k in range(3)]
    schema = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"
    store.save_prices(db, spark.createDataFrame(rows, schema))
    factors.main(["--db", db.root, "--rows", "2"])
    assert "mom_12_1" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["momentum_12_1", "quantile_forward_returns", "ttm", "derive_quarters"])
def test_queries_match_their_oracles(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    import datetime as dt
    import random

    r = random.Random(1)
    start = dt.date(1995, 1, 2)
    lines = [(k, k % 5 + 1, float(r.randrange(90_000, 110_000)) / 100, start + dt.timedelta(days=r.randrange(700))) for k in range(3000)]
    orders = [(k, k % 400, float(r.randrange(90_000, 110_000)) / 100, start + dt.timedelta(days=r.randrange(1400))) for k in range(4000)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    got = sorted((tuple(x[c] for c in columns) for x in found.collect()), key=str)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall(), key=str)
    assert len(got) > 50 and [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_quarters_are_derived_from_every_order(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import datetime as dt

    start = dt.date(1995, 1, 2)
    orders = [(k, k * 7 % 400, 900.0 + k % 1000, start + dt.timedelta(days=k * 11 % 1400)) for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    found = catalogue.QUERIES["derive_quarters"](spark, str(tmp_path))
    columns = sorted(found.columns)
    rows = found.collect()
    assert {r["accn"] for r in rows if not r["derived"]} == {f"{k:010d}" for k in range(4000)}
    got = sorted((tuple(map(str, (r[c] for c in columns))) for r in rows))
    want = sorted(tuple(map(str, x)) for x in con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES['derive_quarters']})").fetchall())
    assert sum(r["derived"] for r in rows) > 50 and got == want


@pytest.mark.parametrize("name", ["load_prices_whole", "load_constituents_whole"])
def test_reads_without_a_filter_return_every_row(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    import datetime as dt

    lines = [(k, k % 40 + 1, 900.0 + k % 777, dt.date(1995, 1, 2) + dt.timedelta(days=k % 700)) for k in range(2000)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"S{k}") for k in range(1, 41)], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    got = sorted(tuple(str(x[c]) for c in columns) for x in found.collect())
    want = sorted(tuple(map(str, x)) for x in con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want and {x["ticker"] for x in found.collect()} == {str(k) for k in range(1, 41)}
