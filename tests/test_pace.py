"""Triples of many copied suppliers: results are spread over many even tasks and made ready in generated code."""

import re

import pytest
from pyspark.sql import functions as F

from covey import catalogue
from covey.operators import pairs as P
from covey.plans import tiled
from test_tiles import SPECS, tasks

NAMES = [
    "climb_1_2",
    "pc_1_2_irreducible",
    "pc_1_2_sum_weights",
    "tiled_pc_1_2",
    "pc_1_2",
    "pc_1_2_minjump",
]


@pytest.fixture(scope="module")
def thousand(spark):
    x = F.array(F.cos("id"), F.sin("id"), *[F.lit(0.0)] * 81)
    return spark.range(1000).select(F.col("id").cast("int").alias("id"), x.alias("x")).persist()


@pytest.mark.parametrize("name", NAMES)
def test_results_are_spread(thousand, name):
    plan = catalogue.shown(tiled.run(thousand, SPECS[name]))._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan)) >= 10 * P.cores(thousand)
    assert "lambda" not in plan.split("FlatMapGroupsInArrow")[0]


def test_many_vectors_are_sent_no_more_often(spark):
    wide = spark.range(20_000).select("id", F.array(F.col("id").cast("double"), *[F.lit(0.0)] * 82).alias("x"))
    assert tasks(tiled.run(wide, SPECS["pc_1_2"])) <= 5 * P.cores(wide)


def test_shown_digits(spark):
    rows = [([1], [2, 30], v) for v in (0.40625, -0.40625, -0.00004, 0.99996, 0.12344999, 1.0, float("nan"))]
    got = catalogue.shown(spark.createDataFrame(rows, "lhs array<int>, rhs array<int>, sim double")).collect()
    assert {(r["lhs"], r["rhs"]) for r in got} == {("1", "2-30")}
    assert [str(r["sim"]) for r in got] == ["0.4063", "-0.4063", "0.0", "1.0", "0.1234", "1.0", "nan"]
