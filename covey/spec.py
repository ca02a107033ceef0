"""What a query asks for: measure, pattern, query type, constraints and weights, checked and normalised.

A query looks for pairs of small series sets (left | right), or for single sets with a one-sided measure, whose
similarity passes a threshold, is among the k largest, or is among any k that pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

DENOMINATOR_FLOOR = 1e-7
BINS = 10
LEAST_STD = 1e-3


class Measure(str, Enum):
    PEARSON = "pearson_correlation"
    EUCLIDEAN = "euclidean_similarity"
    MULTIPOLE = "multipole"
    TOTAL_CORRELATION = "total_correlation"
    SPEARMAN = "spearman_correlation"
    MANHATTAN = "manhattan_similarity"
    CHEBYSHEV = "chebyshev_similarity"

    @property
    def one_sided(self) -> bool:
        return self in (Measure.MULTIPOLE, Measure.TOTAL_CORRELATION)

    @property
    def streams(self) -> bool:
        return self in (Measure.PEARSON, Measure.EUCLIDEAN)

    @property
    def from_pairs(self) -> bool:
        """Similarity of sets is a function of pair correlations."""
        return self in (Measure.PEARSON, Measure.EUCLIDEAN, Measure.SPEARMAN, Measure.MULTIPOLE)


class QueryType(str, Enum):
    THRESHOLD = "threshold"
    TOPK = "topk"
    PROGRESSIVE = "progressive"


class Strategy(str, Enum):
    """How candidates are found; results don't depend on it."""

    AUTO = "auto"  # tiled for pattern (1, 2) over many series, else exhaustive
    EXHAUSTIVE = "exhaustive"  # joins on the pair table, closed forms
    PRUNED = "pruned"  # clusters and bounds first
    TILED = "tiled"  # numpy tiles over blocks of series, pattern (1, 2)
    VECTOR = "vector"  # aggregates the series themselves


def average_weights(size: int) -> tuple[float, ...]:
    return (1.0 / size,) * size


def sum_weights(size: int) -> tuple[float, ...]:
    return (1.0,) * size


@dataclass(frozen=True)
class Weights:
    """Weights of a side by its size: averages, sums, or a prefix of the numbers given for the side."""

    kind: str = "avg"
    left: tuple[float, ...] = ()
    right: tuple[float, ...] = ()

    def __post_init__(self):
        if self.kind not in ("avg", "sum", "custom"):
            raise ValueError(f"unknown weights: {self.kind}")
        if any(w < 0 for w in (*self.left, *self.right)):
            raise ValueError("weights can't be negative")

    @classmethod
    def parse(cls, text: str) -> Weights:
        """"avg", "sum" or "custom(u1-u2-...)(w1-w2-...)"."""
        text = text.strip().lower()
        if text in ("avg", "sum"):
            return cls(text)
        if not (text.startswith("custom(") and text.endswith(")") and ")(" in text):
            raise ValueError(f"unknown weights: {text}")
        left, right = text[len("custom(") : -1].split(")(")
        numbers = lambda s: tuple(float(x) for x in s.replace(",", "-").split("-") if x)
        return cls("custom", numbers(left), numbers(right))

    def of(self, side: str, size: int) -> tuple[float, ...]:
        if self.kind == "avg":
            return average_weights(size) if size else ()
        if self.kind == "sum":
            return sum_weights(size)
        given = self.left if side == "left" else self.right
        if size > len(given):
            raise ValueError(f"{len(given)} weights for a {side} side of {size}")
        return given[:size]


def climb(left: int, right: int, custom: bool = False) -> list[tuple[int, int]]:
    """The patterns a query evaluates, small ones first.

    The left side grows when the right one is full or both are equal; custom weights go straight to the full pattern.
    """
    at = (1, 1) if right else (min(2, left), 0)
    out = [at]
    if custom:
        return out if at == (left, right) else [at, (left, right)]
    while at != (left, right):
        grow_left = at[1] == right or (at[0] == at[1] and at[0] < left)
        at = (at[0] + 1, at[1]) if grow_left else (at[0], at[1] + 1)
        out.append(at)
    return out


@dataclass(frozen=True)
class QuerySpec:
    measure: Measure = Measure.PEARSON
    left: int = 1
    right: int = 2
    query: QueryType = QueryType.THRESHOLD
    tau: float = 0.0
    min_jump: float = 0.0
    irreducible: bool = False
    k: int = 0
    weights: Weights = field(default_factory=Weights)
    scale: str = "unit"  # of the Euclidean measure: unit vectors, or "znorm" (length sqrt(points))
    subset_scope: str = "cross"  # or "all_pairs": pairs within a side count as subsets too
    strategy: Strategy = Strategy.AUTO
    max_only: bool = False  # the full pattern alone, without the climb
    shrink: float = 1.0  # of a progressive query with pruning: part of a bound's width that the first pass counts

    def normalised(self) -> QuerySpec:
        """The query as it runs: sides of one-sided measures joined, defaults and exclusions applied."""
        q = self
        if q.left < 1 or q.right < 0:
            raise ValueError("the left side needs a series")
        if q.measure.one_sided:
            q = replace(q, left=q.left + q.right, right=0)
            if q.left < 2:
                raise ValueError("a one-sided measure needs two series")
        elif q.right < 1:
            raise ValueError("a two-sided measure needs a right side")
        if q.min_jump < 0:
            q = replace(q, irreducible=True, min_jump=0.0)
        if not 0 < q.shrink <= 1:
            raise ValueError("shrink lies above 0, up to 1")
        if q.query is not QueryType.PROGRESSIVE:
            q = replace(q, shrink=1.0)
        if q.query is QueryType.THRESHOLD:
            q = replace(q, k=0)
        if q.query is QueryType.TOPK:
            q = replace(q, k=q.k if q.k > 0 else 100, min_jump=0.0, irreducible=False, tau=min(q.tau, 0.0))
        if q.query is QueryType.PROGRESSIVE and q.k <= 0:
            raise ValueError("a progressive query needs k")
        if q.weights.kind == "custom":
            q = replace(q, min_jump=0.0)
        if q.measure is Measure.TOTAL_CORRELATION and q.query is not QueryType.TOPK and not q.min_jump:
            q = replace(q, irreducible=True)
        if q.scale not in ("unit", "znorm") or q.subset_scope not in ("cross", "all_pairs"):
            raise ValueError("unknown scale or subset scope")
        return q

    def patterns(self) -> list[tuple[int, int]]:
        return [(self.left, self.right)] if self.max_only else climb(self.left, self.right, self.weights.kind == "custom")
