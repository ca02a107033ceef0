"""The same set queries as SQL text over a symmetric pair table p(i, j, r), for engines that check results."""

from __future__ import annotations

import itertools

from covey.operators.candidates import ordering
from covey.operators.measures import proper_subsets, slots
from covey.spec import DENOMINATOR_FLOOR, Measure, QuerySpec


def _r(x: str, y: str) -> str:
    a, b = sorted((x, y))
    return f"p_{a}_{b}.r"


def _square(side: list[str], w) -> str:
    terms = [repr(float(sum(x * x for x in w)))] + [f"{2 * w[a] * w[b]!r}*{_r(side[a], side[b])}" for a, b in itertools.combinations(range(len(side)), 2)]
    return "(" + "+".join(terms) + ")"


def _cross(left, wl, right, wr) -> str:
    return "(" + "+".join(f"{u * w!r}*{_r(x, y)}" for x, u in zip(left, wl) for y, w in zip(right, wr)) + ")"


def _least_of_four(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    """Minus the least root of the characteristic polynomial of a 4 x 4 matrix of zeros and these: Newton's steps from the left."""
    square = "+".join(f"{x}*{x}" for x in (a, b, c, d, e, f))
    triple = f"2*({a}*{b}*{d}+{a}*{c}*{e}+{b}*{c}*{f}+{d}*{e}*{f})"
    whole = f"{a}*{a}*{f}*{f}+{b}*{b}*{e}*{e}+{c}*{c}*{d}*{d}-2*({a}*{b}*{e}*{f}+{a}*{c}*{d}*{f}+{b}*{c}*{d}*{e})"
    step = f"x-(x*x*x*x-({square})*x*x-({triple})*x+({whole}))/least(4*x*x*x-2*({square})*x-({triple}),-1e-300)"
    return f"least(greatest(-list_reduce(list_concat([-3.0::double],list_transform(range(60),lambda z: 0.0::double)),lambda x, y: {step}),-1),1)"


def similarity(spec: QuerySpec, left: list[str], right: list[str]) -> str:
    if spec.measure is Measure.MULTIPOLE:
        names = [*left, *right]
        if len(names) == 2:
            return f"abs({_r(*names)})"
        if len(names) == 4:
            return _least_of_four(*(_r(x, y) for x, y in itertools.combinations(names, 2)))
        a, b, c = (_r(x, y) for x, y in itertools.combinations(names, 2))
        q = f"({a}*{a}+{b}*{b}+{c}*{c})"
        return f"(case when {q} = 0 then 0 else -2*sqrt({q}/3)*cos(acos(least(greatest({a}*{b}*{c}/pow({q}/3,1.5),-1),1))/3+2*pi()/3) end)"
    wl, wr = spec.weights.of("left", len(left)), spec.weights.of("right", len(right))
    n, dl, dr = _cross(left, wl, right, wr), _square(left, wl), _square(right, wr)
    if spec.measure is Measure.EUCLIDEAN:
        return f"(1/(1+sqrt(greatest({dl}+{dr}-2*{n},0))))"
    f = DENOMINATOR_FLOOR
    return f"least(greatest({n}/sqrt(greatest({dl},{f!r})*greatest({dr},{f!r})),-1),1)"


def pattern(spec: QuerySpec, left: int, right: int) -> str:
    """select lhs, rhs, s (not rounded) of one pattern; ids joined by '-'."""
    names = slots(left, right)
    ids: dict[str, str] = {}
    parts = []
    for y_at in range(1, len(names)):
        for x in names[:y_at]:
            y = names[y_at]
            a, b = sorted((x, y))
            alias = f"p_{a}_{b}"
            conditions = [f"{ids[n]} = {alias}.{'i' if n == a else 'j'}" for n in (a, b) if n in ids]
            for n in (a, b):
                ids.setdefault(n, f"{alias}.{'i' if n == a else 'j'}")
            parts.append(f"p {alias}" if not parts else f"join p {alias} on {' and '.join(conditions)}")
    where = [f"{ids[x]} < {ids[y]}" for x, y in ordering(spec, left, right)]
    sim = similarity(spec, names[:left], names[left:])
    where.append(f"{sim} > {spec.tau!r}")
    if left + right > 2 and (spec.irreducible or spec.min_jump > 0):
        subs = [similarity(spec, x, y) for x, y in proper_subsets(spec, left, right)]
        if spec.subset_scope == "all_pairs" and right:
            one = lambda x, y: similarity(spec, [x, y], []) if spec.measure is Measure.MULTIPOLE else f"({_r(x, y)})"
            subs += [one(x, y) for side in (names[:left], names[left:]) for x, y in itertools.combinations(side, 2)]
        most = f"greatest({', '.join(subs)})" if len(subs) > 1 else subs[0]
        if spec.min_jump > 0:
            where.append(f"{sim} > {most} + {spec.min_jump!r}")
        if spec.irreducible:
            where.append(f"{most} <= {spec.tau!r}")

    def side(part: list[str]) -> str:
        # equal weights keep ids in ascending order already; others are sorted for the output
        return "''" if not part else f"array_to_string(list_sort([{', '.join(ids[n] for n in part)}]), '-')"

    return f"select {side(names[:left])} lhs, {side(names[left:])} rhs, {sim} s, {left + right} z, list_sort([{', '.join(ids[n] for n in names[:left])}]) a, " + (f"list_sort([{', '.join(ids[n] for n in names[left:])}])" if right else "[]") + f" b from {' '.join(parts)} where {' and '.join(where)}"


def query(spec: QuerySpec, ctes: str, digits: int = 4) -> str:
    """The whole query; ``ctes`` define p."""
    spec = spec.normalised()
    text = " union all ".join(pattern(spec, a, b) for a, b in spec.patterns())
    order = f" order by s desc, z, a, b limit {spec.k}" if spec.k else ""
    return f"with {ctes}, q as ({text}{order}) select lhs, rhs, round(s, {digits}) + 0.0 sim from q"
