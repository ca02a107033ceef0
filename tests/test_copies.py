"""Queries over triples of suppliers against their SQL where every supplier has copies, and the tiles are used."""

import duckdb
import pytest

import __spark_entry__ as entry

COPIES = 4  # 400 suppliers
NAMES = [
    "pc_1_2_irreducible",
    "pc_1_2_minjump",
    "climb_1_2",
    "pc_1_2_sum_weights",
    "tiled_pc_1_2",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("copies")
    rows = "/root/testdata/sf0.01/lineitem.parquet"
    duckdb.execute(f"copy (select l.* replace (l_suppkey + c * (select max(l_suppkey) + 1 from '{rows}') as l_suppkey) from range({COPIES}) r(c), '{rows}' l) to '{to}/lineitem.parquet'")
    return str(to)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_over_copies(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    with duckdb.connect() as db:
        db.execute("set timezone = 'UTC'")
        db.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
        db.execute(f"create table want as {entry.oracle_sql()[name]}")
        got = found.toArrow()
        db.register("got", got)
        count = lambda text: db.execute(f"select count(*) from ({text})").fetchall()[0][0]
        assert count("from got") == count("from want") > 0
        assert count("select lhs, rhs, sim from got except all select lhs, rhs, sim from want") == 0
