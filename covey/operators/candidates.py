"""Candidate sets as equi-joins on the symmetric pair table, each set once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covey.operators.measures import pair_name, slots
from covey.operators.pairs import symmetric
from covey.spec import QuerySpec


def ordering(spec: QuerySpec, left: int, right: int) -> list[tuple[str, str]]:
    """(x, y) with id(x) < id(y): positions of equal weight on a side, and the mirror of equal sides."""
    out = []
    for side, size, tag in (("left", left, "l"), ("right", right, "r")):
        w = spec.weights.of(side, size)
        last: dict[float, int] = {}
        for k in range(size):
            if w[k] in last:
                out.append((f"{tag}{last[w[k]]}", f"{tag}{k + 1}"))
            last[w[k]] = k + 1
    if right and spec.weights.of("left", left) == spec.weights.of("right", right):
        out.append(("l1", "r1"))
    return out


def candidates(pairs: DataFrame, spec: QuerySpec, left: int, right: int, crossing: Column | None = None) -> DataFrame:
    """(slots..., p_x_y...) of every set of the pattern.

    crossing: a condition on ``rho`` that pairs across the sides (one-sided: all pairs) must meet; it is applied before
    the joins, so that a selective one keeps them small.
    """
    both = symmetric(pairs)
    narrow = both if crossing is None else both.where(crossing)
    names, rules = slots(left, right), ordering(spec, left, right)

    def across(x: str, y: str) -> bool:
        return not right or x[0] != y[0]

    def of(x: str, y: str) -> DataFrame:
        return (narrow if across(x, y) else both).select(F.col("i").alias(x), F.col("j").alias(y), F.col("rho").alias(pair_name(x, y)))

    # left and right slots in turn, so that conditions across the sides apply as early as they can
    turn = sorted(names, key=lambda s: (int(s[1:]), s[0]))
    out = of(turn[0], turn[1])
    have = turn[:2]
    for x, y in rules:
        if {x, y} == set(have):
            out = out.where(F.col(x) < F.col(y))
    for new in turn[2:]:
        first, *rest = sorted(have, key=lambda s: not across(s, new))
        out = out.join(of(first, new), first)
        have = [*have, new]
        for x, y in rules:
            if new in (x, y) and x in have and y in have:
                out = out.where(F.col(x) < F.col(y))
        for old in rest:
            out = out.join(of(old, new), [old, new])
    return out


def pack(df: DataFrame, left: int, right: int, *columns: str) -> DataFrame:
    """(lhs, rhs, ...): sides as arrays in ascending order."""
    names = slots(left, right)
    kind = df.schema[names[0]].dataType.simpleString()
    side = lambda cols: F.array_sort(F.array(*cols)) if cols else F.array().cast(f"array<{kind}>")
    return df.select(side(names[:left]).alias("lhs"), side(names[left:]).alias("rhs"), *columns)


def expand(cc: Column, element) -> Column:
    return F.array_append(cc, F.lit(element) if not isinstance(element, Column) else element)


def reduce(cc: Column, element) -> Column:
    return F.array_remove(cc, element)


def mirror(df: DataFrame) -> DataFrame:
    return df.withColumns({"lhs": F.col("rhs"), "rhs": F.col("lhs")})


def canonical(df: DataFrame) -> DataFrame:
    """Sides sorted; of sides of equal size the one with the smaller first element stands left."""
    l, r = F.array_sort("lhs"), F.array_sort("rhs")
    swap = (F.size(l) == F.size(r)) & (F.size(l) > 0) & (F.get(r, 0) < F.get(l, 0))
    return df.withColumns({"lhs": F.when(swap, r).otherwise(l), "rhs": F.when(swap, l).otherwise(r)})


def subsets(side: Column) -> Column:
    """The arrays that drop one element of a side of more than one."""
    drop = F.transform(F.sequence(F.lit(0), F.size(side) - 1), lambda k: F.filter(side, lambda _, i: i != k))
    return F.when(F.size(side) > 1, drop).otherwise(F.array().cast("array<array<int>>"))
