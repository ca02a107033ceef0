"""An index of cluster combinations for streaming queries: which sets must be looked at again after some series changed.

A combination names a cluster for each slot of a pattern and stands for the sets of its members.  The extreme
correlations between its clusters bound the similarity of all of them.  As long as a combination's upper bound doesn't
pass the threshold, none of its sets can be a result, whatever changed inside; once it does (a violation), or if it
passed before, its sets that hold a changed series are evaluated again.  Sets without a changed series keep their value.

Scale: clusters are few (MOST_CLUSTERS at most); extrema are one aggregation of the pairs; members join their
combinations only where those pass.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.operators import clustering as C
from covey.operators import measures as M
from covey.operators.candidates import ordering
from covey.operators.lineage import cut
from covey.operators.pairs import symmetric
from covey.plans.pruned import set_bounds
from covey.spec import QuerySpec

MARGIN = 1e-9


class ViolationIndex:
    """Clusters of the series, and for each pattern the combinations that passed at the last epoch."""

    def __init__(self, vectors: DataFrame, spec: QuerySpec, length_squared: float = 1.0):
        self.spec, self.length_squared = spec, length_squared
        tree = C.hierarchy(vectors, levels=1).where("level = 1")
        # a series that the first level leaves out is the only one
        members = vectors.select("id").join(tree.select("id", F.col("medoid").alias("cluster")), "id", "left")
        self.members = cut(members.select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")
        self.alive: dict[tuple[int, int], DataFrame] = {}
        self.stats: dict[str, float] = {}

    def _bounded(self, both: DataFrame, extrema: DataFrame, left: int, right: int, least: float) -> DataFrame:
        """(slots...: clusters, sets): the combinations whose upper bound passes."""
        names = M.slots(left, right)
        sizes = self.members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        out = extrema.select(F.col("c1").alias(names[0]), F.col("c2").alias(names[1]), F.col("lo").alias(f"lo_{names[0]}_{names[1]}"), F.col("hi").alias(f"hi_{names[0]}_{names[1]}"))
        for k, y in enumerate(names[2:], 2):
            for x in names[:k]:
                bound = extrema.select(F.col("c1").alias(x), F.col("c2").alias(y), F.col("lo").alias(f"lo_{x}_{y}"), F.col("hi").alias(f"hi_{x}_{y}"))
                out = out.join(bound, [c for c in (x, y) if c in out.columns])
        of = lambda tag: lambda x, y: F.col(f"{tag}_{x}_{y}" if names.index(x) < names.index(y) else f"{tag}_{y}_{x}")
        upper = set_bounds(self.spec, left, right, of("lo"), of("hi"), self.length_squared)[1]
        out = out.where(upper >= least - MARGIN).select(*names)
        sets = F.lit(1.0)
        for s in names:
            out = out.join(sizes.select(F.col("cluster").alias(s), F.col("n").cast("double").alias(f"n_{s}")), s)
            sets = sets * F.col(f"n_{s}")
        return cut(out.select(*names, sets.alias("sets")), "combinations")

    def evaluate(self, pairs: DataFrame, changed: DataFrame | None, least: float) -> list[tuple[int, int, DataFrame]]:
        """For each pattern, the candidate sets that hold a changed series (None: all) in combinations that pass.

        Columns are the slots and p_x_y, the correlations of pairs; the caller applies the query's constraints.
        """
        both = symmetric(pairs)
        extrema = cut(C.extrema(both, self.members, self.members).select("c1", "c2", "lo", "hi"), "extrema")
        violations, indexed, represented = 0, 0, 0.0
        out = []
        for left, right in self.spec.patterns():
            names = M.slots(left, right)
            now = self._bounded(both, extrema, left, right, least)
            before = self.alive.get((left, right))
            if before is not None:
                violations += now.join(before, names, "left_anti").count()
            row = now.agg(F.count(F.lit(1)).alias("n"), F.sum("sets").alias("s")).first()
            indexed, represented = indexed + row["n"], represented + (row["s"] or 0.0)
            self.alive[left, right] = now
            out.append((left, right, self._sets(now.drop("sets"), both, changed, left, right)))
        self.stats = {"nViolations": violations, "nIndexedDCCs": indexed, "avgIndexedDCCSize": represented / indexed if indexed else 0.0}
        return out

    def _sets(self, combinations: DataFrame, both: DataFrame, changed: DataFrame | None, left: int, right: int) -> DataFrame:
        names = M.slots(left, right)
        whole = self.members
        if changed is None:
            parts = [[whole] * len(names)]
        else:  # the first changed slot: those ahead of it hold unchanged series
            new, old = whole.join(changed, "id", "left_semi"), whole.join(changed, "id", "left_anti")
            parts = [[*[old] * k, new, *[whole] * (len(names) - k - 1)] for k in range(len(names))]
        found = None
        rules = ordering(self.spec, left, right)
        for part in parts:
            sets, have = combinations, []
            # the side that is restricted first, so that the others only meet what is left
            for s, members in sorted(zip(names, part), key=lambda x: x[1] is whole):
                sets = sets.join(members.select(F.col("cluster").alias(s), F.col("id").alias(f"_{s}")), s).drop(s).withColumnRenamed(f"_{s}", f"id_{s}")
                have.append(s)
                for x, y in rules:
                    if s in (x, y) and x in have and y in have:
                        sets = sets.where(F.col(f"id_{x}") < F.col(f"id_{y}"))
            sets = sets.select(*[F.col(f"id_{s}").alias(s) for s in names])
            found = sets if found is None else found.unionByName(sets)
        for x, y in itertools.combinations(names, 2):
            found = found.join(both.select(F.col("i").alias(x), F.col("j").alias(y), F.col("rho").alias(M.pair_name(x, y))), [x, y])
        return found

