"""Every query with SQL against DuckDB on the smallest tables; eight queries run at a time, since each is many small jobs."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__  # noqa: F401  all modules with queries
from covey import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pearson_pairs_emb"}
NAMES = sorted(set(catalogue.QUERIES) - SLOW)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def outcomes(spark, small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")

    def run(name):
        df = catalogue.QUERIES[name](spark, small)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
        if name not in catalogue.SQL:
            return columns, got, columns, got
        result = con.cursor().execute(catalogue.SQL[name])
        names = [d[0] for d in result.description]
        return columns, got, sorted(names), sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)

    with ThreadPoolExecutor(8) as pool:
        yield {name: pool.submit(run, name) for name in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_query(outcomes, name):
    columns, got, names, want = outcomes[name].result()
    assert columns == names and got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
