"""The k best by total correlation where sets are tied: by ids, as in exact arithmetic and whatever order sums are taken in."""

import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np

from covey.plans.query import run_query
from covey.spec import Measure, QuerySpec, QueryType

POINTS = 83


def test_tied_sets_are_taken_by_ids(spark):
    rng = np.random.default_rng(5)
    # most values in two bins, as monthly sums of very many orders are: few different counts
    bins = np.where(rng.random((12, POINTS)) < 0.12, 8, 9)
    bins[:, 0] = 0
    rows = [(i, t, float(b)) for i, r in enumerate(np.where(bins == 9, 10, bins)) for t, b in enumerate(r)]

    def power(ids):
        """The product of n ** n over the counts of cells: its logarithm is what an entropy adds up."""
        return math.prod(n**n for n in Counter(zip(*(bins[i].tolist() for i in ids))).values())

    exact = {s: Fraction(power(s), math.prod(power([i]) for i in s)) for s in itertools.combinations(range(12), 3)}
    order = sorted(exact, key=lambda s: (-exact[s], s))
    series = spark.createDataFrame(rows, "id int, t int, v double").persist()
    several = [k for k in range(5, 200) if exact[order[k - 1]] == exact[order[k]]]
    assert len(several) > 12
    for k in (several[len(several) // 2], several[-1]):
        found = run_query(series, QuerySpec(Measure.TOTAL_CORRELATION, 3, 0, query=QueryType.TOPK, k=k, max_only=True)).collect()
        assert [tuple(r["lhs"]) for r in found] == order[:k]
