import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import dfscode as d


@st.composite
def graphs(draw):
    n = draw(st.integers(2, 6))
    labels = [draw(st.integers(0, 2)) for _ in range(n)]
    edges = {(draw(st.integers(0, v - 1)), v): draw(st.integers(0, 1)) for v in range(1, n)}
    for u, v in itertools.combinations(range(n), 2):
        if (u, v) not in edges and draw(st.integers(0, 3)) == 0:
            edges[u, v] = draw(st.integers(0, 1))
    return labels, [(u, v, e) for (u, v), e in edges.items()]


@settings(max_examples=150, deadline=None)
@given(graphs(), st.randoms())
def test_least_code_ignores_numbering(g, rng):
    labels, edges = g
    code = d.min_dfs_code(labels, edges)
    order = list(range(len(labels)))
    rng.shuffle(order)
    turned = [0] * len(labels)
    for v, w in enumerate(order):
        turned[w] = labels[v]
    moved = [(order[u], order[v], e) if rng.random() < 0.5 else (order[v], order[u], e) for u, v, e in edges]
    rng.shuffle(moved)
    assert d.min_dfs_code(turned, moved) == code and d.is_min(code)
    assert d.min_dfs_code(*d.to_graph(code)) == code
    assert d.node_count(code) == len(labels) and len(code) == len(edges)


@settings(max_examples=100, deadline=None)
@given(graphs())
def test_text_round_trip(g):
    code = d.min_dfs_code(*g)
    for kinds in (False, True):
        for placeholders in (False, True):
            assert d.parse_code(d.format_code(code, placeholders, kinds)) == code


@settings(max_examples=60, deadline=None)
@given(graphs())
def test_every_least_code_is_reached_by_growth(g):
    """Each prefix of a least code is least, and its next edge is among the candidates."""
    code = d.min_dfs_code(*g)
    triples = {(e[2], e[3], e[4]) for e in code} | {(e[4], e[3], e[2]) for e in code}
    for k in range(1, len(code)):
        assert code[k] in d.candidates(code[:k], triples)


def test_rightmost_path_and_order():
    code = ((0, 1, 0, 0, 1), (1, 2, 1, 0, 2), (2, 0, 2, 0, 0), (1, 3, 1, 0, 1))
    assert d.rightmost_path(code) == [3, 0] and d.rightmost_vertices(code) == [3, 1, 0]
    assert sorted(code[1:], key=d.growth_key)[0] == (2, 0, 2, 0, 0)
    assert d.format_compact(code) == "(0) 0 (0f1) 0 (1f2) 0 (b0) 0 (1f1)"
    assert sorted([code, code[:1]], key=d.code_key)[0] == code[:1]
    assert not d.is_min(((0, 1, 1, 0, 0),))
    for bad in ("(0 1 2)", "B(0 1 0 0 1)", "x"):
        with pytest.raises(ValueError):
            d.parse_code(bad)


@settings(max_examples=60, deadline=None)
@given(graphs(), st.randoms())
def test_growth_reaches_codes_with_parallel_edges(g, rng):
    labels, edges = g
    u, v, e = rng.choice(edges)
    code = d.min_dfs_code(labels, [*edges, (u, v, 1 - e)])
    triples = {(e[2], e[3], e[4]) for e in code} | {(e[4], e[3], e[2]) for e in code}
    for k in range(1, len(code)):
        assert code[k] in d.candidates(code[:k], triples, simple=False)


def test_partial_equality():
    a = (0, 1, 2, 3, 4)
    assert all(d.partial_equal(a, b) and d.partial_equal(b, a) for b in (a, (0, 1, -1, 3, 4), (0, 1, 2, 3, -1), (0, 1, -1, 3, -1)))
    assert not any(d.partial_equal(a, b) for b in ((0, 2, 2, 3, 4), (0, 1, 2, -1, 4), (0, 1, 1, 3, 4), (0, 1, -1, 3, 5)))
    assert sorted([(0, 1, 1, 0, 0), (0, 1, 0, 9, 9)], key=d.edge_key)[0] == (0, 1, 0, 9, 9)
