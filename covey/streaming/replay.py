"""Epoch-by-epoch evaluation: the result of an epoch is the static result over the sliding window at its end.

``epoch_results`` computes all epochs in one plan.  ``Replay`` walks through them one at a time, as a stream would,
with the strategies: recompute everything; update pairs, index and sets that a changed series touches; or choose by
predicted run time.
"""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.operators import measures as M
from covey.operators.candidates import candidates, pack
from covey.operators.lineage import cut
from covey.plans.query import constrained, finished, run_on_pairs, union_all
from covey.spec import QuerySpec, QueryType
from covey.streaming import windows as W
from covey.streaming.violations import ViolationIndex


def checked(spec: QuerySpec) -> QuerySpec:
    spec = spec.normalised()
    if not spec.measure.streams:
        raise ValueError(f"{spec.measure.value} can't stream")
    return spec


def epoch_results(epoch_pairs: DataFrame, spec: QuerySpec, length_squared: float = 1.0) -> DataFrame:
    """(epoch, lhs, rhs, sim) for epoch_pairs(epoch, i, j, rho): every join also matches the epoch."""
    from pyspark.sql import Window

    spec = checked(spec)
    out = []
    for left, right in spec.patterns():
        names = M.slots(left, right)
        found = _epoch_candidates(epoch_pairs, spec, left, right).withColumn("sim", M.similarity(spec, names[:left], names[left:], M.pair_column, length_squared))
        sub = M.subset_max(spec, left, right, M.pair_column, length_squared) if spec.irreducible or spec.min_jump > 0 else None
        out.append(pack(constrained(found, spec, left, right, sub), left, right, "epoch", "sim"))
    results = union_all(out).select("epoch", "lhs", "rhs", "sim")
    if spec.query is QueryType.THRESHOLD:
        return results
    order = Window.partitionBy("epoch").orderBy(F.col("sim").desc(), (F.size("lhs") + F.size("rhs")), "lhs", "rhs")
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= spec.k).drop("_n")


def _epoch_candidates(epoch_pairs: DataFrame, spec: QuerySpec, left: int, right: int) -> DataFrame:
    """Like ``candidates`` within each epoch: ids carry their epoch, so equal ids of two epochs never meet."""
    tag = lambda c: F.struct(F.col("epoch"), F.col(c).alias("id"))
    tagged = epoch_pairs.select(tag("i").alias("i"), tag("j").alias("j"), "rho")
    found = candidates(tagged, spec, left, right)
    names = M.slots(left, right)
    return found.withColumn("epoch", F.col("l1.epoch")).withColumns({s: F.col(f"{s}.id") for s in names})


@dataclass
class RunTimes:
    """Running regression of an epoch's run time on its number of changes."""

    n: int = 0
    sx: float = 0.0
    sy: float = 0.0
    sxx: float = 0.0
    sxy: float = 0.0

    def add(self, x: float, y: float) -> None:
        self.n, self.sx, self.sy, self.sxx, self.sxy = self.n + 1, self.sx + x, self.sy + y, self.sxx + x * x, self.sxy + x * y

    def predict(self, x: float) -> float:
        if not self.n:
            return 0.0
        spread = self.n * self.sxx - self.sx * self.sx
        slope = (self.n * self.sxy - self.sx * self.sy) / spread if abs(spread) > 1e-9 else 0.0
        return (self.sy - slope * self.sx) / self.n + slope * x


@dataclass
class HybridPolicy:
    """Half of the warm-up with each strategy, then the one of the smaller predicted run time, with a cool-down."""

    warm_up: int = 40
    cool_down: int = 10
    epochs: int = 0
    since: int = 0
    now: str = "incremental"
    times: dict = field(default_factory=lambda: {"incremental": RunTimes(), "oneshot": RunTimes()})

    def choose(self, changes: int) -> str:
        if self.epochs < self.warm_up:
            self.now = "incremental" if self.epochs < self.warm_up // 2 else "oneshot"
        elif self.since >= self.cool_down:
            best = min(self.times, key=lambda k: self.times[k].predict(changes))
            if best != self.now:
                self.now, self.since = best, 0
        return self.now

    def done(self, changes: int, seconds: float) -> None:
        self.times[self.now].add(changes, seconds)
        self.epochs += 1
        self.since += 1


class Replay:
    """State of a query over windows(id, bw, v): pairs, results and the index of the current epoch.

    An incremental step computes the pairs that have a changed side, and evaluates the sets that hold a changed series
    where the index of cluster combinations lets them pass; all else is kept.  A top-k query first scores its last
    answer again: the k-th best of that bounds the new answer from below.
    boost: (epoch, factor) multiplies the time of an epoch from that epoch on, to simulate a wave of arrivals.
    """

    def __init__(self, windows: DataFrame, spec: QuerySpec, width: int, strategy: str = "oneshot", policy: HybridPolicy | None = None, boost: tuple[int, float] | None = None):
        if strategy not in ("oneshot", "incremental", "hybrid"):
            raise ValueError(f"unknown strategy: {strategy}")
        spec = checked(spec)
        if spec.query is QueryType.PROGRESSIVE:  # a stream has no end at which any k would do
            spec = replace(spec, query=QueryType.TOPK)
        self.windows, self.spec, self.width, self.strategy, self.boost = windows, spec, width, strategy, boost
        self.policy = policy or HybridPolicy()
        self.pairs: DataFrame | None = None
        self.results: DataFrame | None = None
        self.index: ViolationIndex | None = None
        self.last: int | None = None
        self.reports: list[dict] = []
        self.length_squared = float(width) if spec.scale == "znorm" else 1.0

    def _now(self, bw: int) -> DataFrame:
        now = self.windows.where((F.col("bw") > bw - self.width) & (F.col("bw") <= bw))
        return now.select("id", F.col("bw").alias("t"), "v")

    def pairs_at(self, bw: int) -> DataFrame:
        from covey.operators.pairs import long_correlations

        return long_correlations(self._now(bw))

    def changed(self, bw: int) -> DataFrame:
        """Series whose window differs from the last epoch's by more than a zero for a zero."""
        new = (F.col("bw") > self.last) & (F.col("bw") <= bw)
        gone = (F.col("bw") > self.last - self.width) & (F.col("bw") <= bw - self.width)
        return self.windows.where(new | gone).where("v <> 0").select("id").distinct()

    def updated_pairs(self, bw: int, changed: DataFrame) -> DataFrame:
        """The last pairs, with those that have a changed side computed again: as much work as there are such pairs."""
        from covey.functions.vectors import pearson_from_sums

        now = self._now(bw)
        mine = now.join(changed, "id", "left_semi").select("t", F.col("id").alias("a"), F.col("v").alias("x"))
        every = now.join(changed.withColumn("new", F.lit(True)), "id", "left").select("t", F.col("id").alias("b"), F.col("v").alias("y"), F.coalesce("new", F.lit(False)).alias("new"))
        once = (F.col("a") != F.col("b")) & (~F.col("new") | (F.col("a") < F.col("b")))
        x, y = F.col("x"), F.col("y")
        sums = mine.join(every, "t").where(once).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
        rho = pearson_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
        fresh = sums.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), rho.alias("rho")).where("rho is not null")
        kept = self.pairs
        for side in ("i", "j"):
            kept = kept.join(changed.withColumnRenamed("id", side), side, "left_anti")
        return kept.select("i", "j", "rho").unionByName(fresh)

    def step(self, epoch: int, bw: int) -> DataFrame:
        began = time.time()
        if self.boost and epoch >= self.boost[0]:
            bw = int(bw * self.boost[1])
        changes, number, active = None, -1, "oneshot"
        if self.results is not None and self.strategy != "oneshot":
            changes = cut(self.changed(bw), "changed")
            number = changes.count()
            active = self.strategy if self.strategy != "hybrid" else self.policy.choose(number)
        arrivals = self.windows.where((F.col("bw") > (self.last if self.last is not None else bw - self.width)) & (F.col("bw") <= bw) & (F.col("v") != 0)).count()
        stats = {"nViolations": 0, "nIndexedDCCs": 0, "avgIndexedDCCSize": 0.0}
        if active == "incremental":
            self.pairs = cut(self.updated_pairs(bw, changes), "pairs")
            results = self._incremental(bw, changes)
            stats = self.index.stats
        else:
            self.pairs = cut(self.pairs_at(bw), "pairs")
            results = run_on_pairs(self.pairs, self.spec, self.length_squared)
        results = cut(results, "epoch")
        self.results, self.last = results, bw
        seconds = time.time() - began
        if changes is not None and self.strategy == "hybrid":
            self.policy.done(number, seconds)
        self.reports.append({"epoch": epoch, "simulatedTime": bw, "activeAlgorithm": active, "duration": seconds, "nResults": results.count(), "nArrivals": arrivals, "nChanged": number, **stats})
        return results

    def _incremental(self, bw: int, changes: DataFrame) -> DataFrame:
        if self.index is None:
            from covey.operators.series import normalise, to_vectors, variance_filter

            self.index = ViolationIndex(cut(normalise(to_vectors(variance_filter(self._now(bw)))), "vectors"), self.spec, self.length_squared)
        if self.spec.query is QueryType.THRESHOLD:
            found = self._constrained(self.index.evaluate(self.pairs, changes, self.spec.tau), self.spec)
            # results of unchanged series alone stay as they are
            hit = self.results.select("lhs", "rhs", F.explode(F.concat("lhs", "rhs")).alias("id")).join(changes, "id", "left_semi").select("lhs", "rhs").distinct()
            return self.results.join(hit, ["lhs", "rhs"], "left_anti").unionByName(found)
        least = self._rescored()
        spec = replace(self.spec, tau=max(self.spec.tau, least - 1e-9)) if least is not None else self.spec
        return finished(self._constrained(self.index.evaluate(self.pairs, None, spec.tau), spec), self.spec)

    def _constrained(self, patterns: list, spec: QuerySpec) -> DataFrame:
        out = []
        for left, right, sets in patterns:
            names = M.slots(left, right)
            found = sets.withColumn("sim", M.similarity(spec, names[:left], names[left:], M.pair_column, self.length_squared))
            sub = M.subset_max(spec, left, right, M.pair_column, self.length_squared) if spec.irreducible or spec.min_jump > 0 else None
            out.append(pack(constrained(found, spec, left, right, sub), left, right, "sim"))
        return union_all(out)

    def _rescored(self) -> float | None:
        """The k-th best similarity of the last answer's sets by the new pairs; None where there are fewer than k."""
        from covey.operators.pairs import symmetric

        ids = self.results.select(F.explode(F.concat("lhs", "rhs")).alias("id")).distinct()
        few = self.pairs.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi")
        both, sims = symmetric(few), []
        for left, right in self.spec.patterns():
            names = M.slots(left, right)
            sets = self.results.where((F.size("lhs") == left) & (F.size("rhs") == right)).select(*[F.get("lhs", k).alias(s) for k, s in enumerate(names[:left])], *[F.get("rhs", k).alias(s) for k, s in enumerate(names[left:])])
            for x, y in itertools.combinations(names, 2):
                sets = sets.join(both.select(F.col("i").alias(x), F.col("j").alias(y), F.col("rho").alias(M.pair_name(x, y))), [x, y])
            sims.append(sets.select(M.similarity(self.spec, names[:left], names[left:], M.pair_column, self.length_squared).alias("sim")))
        row = union_all(sims).where(F.col("sim") > self.spec.tau).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("s")).first()
        return row["s"] if row["n"] >= self.spec.k else None


def run_averages(reports: DataFrame, warm_up: int) -> DataFrame:
    """Averages of a run's reports over the epochs behind the warm-up."""
    return reports.where(F.col("epoch") > warm_up).agg(F.avg("duration").alias("avg_duration"), F.avg("nResults").alias("avg_results"), F.count(F.lit(1)).alias("epochs"))


__all__ = ["HybridPolicy", "Replay", "RunTimes", "W", "epoch_results", "finished", "run_averages"]
