"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or x != x:
            return "None"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm(spark):
    """With the subpackage gone the rest still imports."""
    import importlib
    import sys

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("quern.llm")}
    sys.modules["quern.llm"] = sys.modules["corpus_pipeline"] = None
    try:
        fresh = importlib.reload(entry)
        assert set(fresh.queries()) == set(catalogue.QUERIES)
    finally:
        for k in ("quern.llm", "corpus_pipeline"):
            del sys.modules[k]
        sys.modules.update(kept)
        importlib.reload(entry)
