import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.operators import pairs as P
from covey.operators import series as S
from covey.plans import tiled
from covey.plans.query import run_on_pairs
from covey.spec import QuerySpec, QueryType, Strategy, Weights


def tasks(df):
    """Tasks that the tiles are spread over: vectors are sent that often by the square, or cube, root of it."""
    return int(re.search(r"RepartitionByExpression \[.*?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())[1])


@pytest.fixture(scope="module")
def many(spark):
    """20,000 different vectors."""
    return spark.range(20_000).select(F.col("id").cast("int").alias("id"), F.array(F.cos("id"), F.sin("id")).alias("x")).persist()


@pytest.fixture(scope="module")
def copied(spark):
    """Unit vectors, a third of them copies; ids in no order of the groups."""
    x = np.random.default_rng(4).normal(size=(60, 30))
    x[40:56], x[56:] = x[:16], x[0]
    x -= x.mean(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i * 7 % 60, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").persist()


def test_pairs_are_sent_to_few_tasks(many):
    m = P.cores(many)
    assert tasks(P.correlations(many, "block")) <= 8 * m


def test_small_tiles_hold_every_pair(monkeypatch, copied):
    monkeypatch.setattr(P, "BLOCK", 8)
    of = lambda df: {(r["i"], r["j"]): r["rho"] for r in df.collect()}
    want, got = of(P.correlations(copied, "hof")), of(P.correlations(copied, "block"))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    high = of(P._block_correlations(copied, 0.4))
    assert high.keys() == {k for k, r in got.items() if r >= 0.4}
    best = sorted(of(P._block_correlations(copied, k=30)).items(), key=lambda v: (-v[1], v[0]))[:30]
    assert best == sorted(got.items(), key=lambda v: (-v[1], v[0]))[:30]


SPECS = {
    "pc_1_2": QuerySpec(left=1, right=2, tau=0.4, max_only=True),
    "pc_1_2_irreducible": QuerySpec(left=1, right=2, tau=0.36, irreducible=True, max_only=True),
    "pc_1_2_minjump": QuerySpec(left=1, right=2, tau=0.35, min_jump=0.05, max_only=True),
    "climb_1_2": QuerySpec(left=1, right=2, tau=0.38),
    "pc_1_2_sum_weights": QuerySpec(left=1, right=2, tau=0.4, weights=Weights("sum"), max_only=True),
    "tiled_pc_1_2": QuerySpec(left=1, right=2, tau=0.4, strategy=Strategy.TILED),
}


@pytest.mark.parametrize("name", SPECS)
def test_triples_are_sent_to_few_tasks(many, name):
    m = P.cores(many)
    assert tasks(tiled.run(many, SPECS[name])) <= 40 * m


@pytest.mark.parametrize("name", SPECS)
def test_copies_are_expanded(monkeypatch, copied, name):
    """Small tiles, batches and groups of copies, against joins over every series."""
    monkeypatch.setattr(tiled, "BLOCK", 8)
    monkeypatch.setattr(tiled, "ROWS", 500)
    monkeypatch.setattr(tiled, "COPIES", 3)
    of = lambda df: {(tuple(r["lhs"]), tuple(r["rhs"])): r["sim"] for r in df.collect()}
    rows, got = of(run_on_pairs(P.correlations(copied, "hof"), SPECS[name])), of(tiled.run(copied, SPECS[name]))
    assert rows.keys() == got.keys() and all(abs(rows[k] - got[k]) < 1e-9 for k in rows)


@pytest.mark.parametrize("k", [20, 2000])
def test_topk_seeded_by_tiles(monkeypatch, copied, k):
    from covey.plans import query

    monkeypatch.setattr(query, "TILED_FROM", 30)
    spec = QuerySpec(left=1, right=2, query=QueryType.TOPK, k=k)
    found = query.run_query(S.to_series(copied), spec)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [round(r["sim"], 9) for r in query.run_on_pairs(P.correlations(copied, "hof"), spec).collect()]
    assert [round(r["sim"], 9) for r in found.collect()] == want and len(want) == k
