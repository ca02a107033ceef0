import pytest

from covey.spec import Measure, QuerySpec, QueryType, Weights, climb


@pytest.mark.parametrize(
    "full, chain",
    [((1, 2), [(1, 1), (1, 2)]), ((2, 2), [(1, 1), (2, 1), (2, 2)]), ((2, 3), [(1, 1), (2, 1), (2, 2), (2, 3)]), ((3, 2), [(1, 1), (2, 1), (2, 2), (3, 2)]), ((3, 0), [(2, 0), (3, 0)])],
)
def test_climb(full, chain):
    assert climb(*full) == chain


def test_custom_weights_jump_to_the_full_pattern():
    assert climb(2, 3, custom=True) == [(1, 1), (2, 3)]
    w = Weights.parse("custom(2)(1-3)")
    assert w.of("left", 1) == (2.0,) and w.of("right", 1) == (1.0,) and w.of("right", 2) == (1.0, 3.0)
    with pytest.raises(ValueError):
        w.of("left", 2)
    with pytest.raises(ValueError):
        Weights.parse("median")
    with pytest.raises(ValueError):
        Weights("custom", (-1.0,), (1.0,))


def test_normalisation():
    q = QuerySpec(query=QueryType.TOPK, tau=0.5, k=0, min_jump=0.1, irreducible=True).normalised()
    assert (q.k, q.tau, q.min_jump, q.irreducible) == (100, 0.0, 0.0, False)
    assert QuerySpec(query=QueryType.TOPK, tau=-0.5).normalised().tau == -0.5
    assert QuerySpec(min_jump=-1).normalised().irreducible
    assert QuerySpec(k=7).normalised().k == 0
    m = QuerySpec(Measure.MULTIPOLE, 2, 1).normalised()
    assert (m.left, m.right) == (3, 0)
    assert QuerySpec(Measure.TOTAL_CORRELATION, 3, 0).normalised().irreducible
    for bad in (QuerySpec(right=0), QuerySpec(Measure.MULTIPOLE, 1, 0), QuerySpec(query=QueryType.PROGRESSIVE), QuerySpec(scale="other")):
        with pytest.raises(ValueError):
            bad.normalised()
