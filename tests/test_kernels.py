"""Kernels against hand-made cases, brute force and invariants."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.functions import frechet as fr
from wayloom.functions import solve as sv
from wayloom.functions.graph import Net

LINE = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=6).map(lambda p: np.array(p, float))


def grid(n=4):
    rows, e = [], 0
    for v in range(n * n):
        for to in [v + 1] * (v % n < n - 1) + [v + n] * (v < n * (n - 1)):
            rows += [(e, v, to, 1.0), (e + 1, to, v, 1.0)]
            e += 2
    return Net(rows, [(v, v % n, v // n) for v in range(n * n)])


def discrete(p, q):
    d = np.full((len(p), len(q)), math.inf)
    for i, j in itertools.product(range(len(p)), range(len(q))):
        best = min((d[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0), default=0.0 if i == j == 0 else math.inf)
        d[i, j] = max(best, math.dist(p[i], q[j]))
    return d[-1, -1]


def dense(p, step=0.02):
    out = [p[0]]
    for a, b in itertools.pairwise(p):
        n = max(1, int(math.dist(a, b) / step))
        out += [a + (b - a) * k / n for k in range(1, n + 1)]
    return np.array(out)


def test_parallel_segments():
    p, q = np.array([[0, 0], [4, 0]], float), np.array([[0, 1], [4, 1]], float)
    assert fr.distance(p, q, 1e-6) == pytest.approx(1.0, abs=1e-5)


@settings(max_examples=40, deadline=None)
@given(LINE, LINE)
def test_frechet_invariants(p, q):
    d = fr.distance(p, q, 1e-4)
    assert d == pytest.approx(fr.distance(q, p, 1e-4), abs=1e-3)
    assert fr.distance(p, p, 1e-4) <= 1e-3
    assert fr.lower_bound(p, q) - 1e-6 <= d <= discrete(p, q) + 1e-3
    assert d <= fr.equal_time_distance(p, q) + 1e-3
    assert fr.within(p, q, d + 1e-3)
    assert not fr.within(p, q, d - 2e-3) or d <= fr.lower_bound(p, q) + 2e-3


def test_frechet_equals_the_limit_of_the_discrete_one():
    rng = np.random.default_rng(1)
    for _ in range(6):
        p, q = rng.random((4, 2)) * 2, rng.random((3, 2)) * 2
        assert fr.distance(p, q, 1e-4) == pytest.approx(discrete(dense(p), dense(q)), abs=0.03)


def test_distance_bound():
    p, q = np.array([[0, 0], [4, 0]], float), np.array([[0, 3], [4, 3]], float)
    assert fr.distance(p, q, 1e-4, 2.0) is None


def test_graph_path_is_within_and_connected():
    net = grid()
    line = np.array([[0.1, 0.1], [1.9, 0.2], [2.1, 2.2]])
    radius, path = fr.best_graph_path(net, line, 0.1, 0.01)
    assert all(net.dst[a] == net.src[b] for a, b in itertools.pairwise(path))
    assert fr.within(line, fr.path_points(net, path), radius + 1e-6)
    every = [p for p in simple_paths(net, 5)]
    best = min(fr.distance(line, fr.path_points(net, p), 1e-3) for p in every)
    assert radius <= best + 0.02
    assert fr.graph_path(net, line, best - 0.05) is None


def simple_paths(net, most):
    stack = [[i] for i in range(len(net.e))]
    while stack:
        p = stack.pop()
        yield p
        if len(p) < most:
            seen = {net.src[p[0]], *(net.dst[i] for i in p)}
            stack += [[*p, i] for i in net.out.get(net.dst[p[-1]], ()) if net.dst[i] not in seen]


def test_hitting_path_takes_the_edge_and_stays_within():
    net, line = grid(), np.array([[0, 0], [2, 0]], float)
    hit = fr.HittingPaths(net, line, 1.2)
    found = 0
    for i in range(len(net.e)):
        path = hit.through(i)
        brute = any(i in p and fr.within(line, fr.path_points(net, p), 1.2) for p in simple_paths(net, 4))
        if path is not None:
            found += 1
            assert i in path and fr.within(line, fr.path_points(net, path), 1.2 + 1e-6)
        assert path is not None or not brute
    assert found


def test_weighted_path_prefers_heavy_edges():
    net, line = grid(), np.array([[0, 0], [2, 0]], float)
    heavy = next(i for i in range(len(net.e)) if (net.src[i], net.dst[i]) == (4, 5))
    weight = [10.0 if i == heavy else 1.0 for i in range(len(net.e))]
    path = fr.weighted_path(net, line, 1.2, weight)
    assert heavy in path and fr.within(line, fr.path_points(net, path), 1.2 + 1e-6)


def test_shortest_path_bound_is_strict():
    net = grid()
    assert net.shortest(0, 2, 2.0) is None
    assert net.shortest(0, 2, 2.1)[0] == 2.0
    assert net.shortest(5, 5, 0.0) == (0.0, [])


def test_searches_agree():
    rng = np.random.default_rng(4)
    net = grid()
    net.length = [1.0 + float(x) for x in rng.random(len(net.e))]
    for t in range(1, 16):
        d = net.shortest(0, t)[0]
        assert net.shortest(0, t, guess=net.straight(t))[0] == pytest.approx(d)
        found = net.shortest(0, t)[0]
        if t:  # a route as long as the bound: A* keeps it, the plain search does not
            assert net.shortest(0, t, bound=found, guess=lambda v: 0.0)[0] == found
            assert net.shortest(0, t, bound=found) is None
        assert net.bellman_ford(0, net.length)[0][t] == pytest.approx(d)
        width = net.widest(0, t, net.length)
        assert width[0] == pytest.approx(max(min(net.length[i] for i in p) for p in simple_paths(grid_view(net), 9) if net.src[p[0]] == 0 and net.dst[p[-1]] == t))


def grid_view(net):
    return net


def test_bellman_ford_reports_negative_cycles():
    net = Net([(0, 0, 1, 1.0), (1, 1, 0, -2.0)])
    with pytest.raises(ValueError):
        net.bellman_ford(0, net.length)


def test_max_flow_equals_the_smallest_cut():
    net = Net([(0, 0, 1, 3.0), (1, 0, 2, 2.0), (2, 1, 2, 5.0), (3, 1, 3, 2.0), (4, 2, 3, 3.0)])
    value, flow = net.max_flow(0, 3, net.length)
    assert value == 5.0
    for v in (1, 2):
        assert sum(flow[i] for i in net.out[v]) == pytest.approx(sum(flow[i] for i in net.into[v]))


def test_flow_falls_apart_into_paths_and_cycles():
    net = Net([(0, 0, 1, 0), (1, 1, 2, 0), (2, 2, 3, 0), (3, 2, 1, 0)])
    paths, cycles = net.decompose([2.0, 3.0, 2.0, 1.0], 0, 3)
    total = [0.0] * 4
    for p, w in paths + cycles:
        for i in p:
            total[i] += w
    assert total == pytest.approx([2.0, 3.0, 2.0, 1.0])
    whole = net.attach_cycles(paths, cycles)
    assert all(net.dst[a] == net.src[b] for p, _ in whole for a, b in itertools.pairwise(p))


def test_hitting_simple_path():
    net = grid()
    i = next(k for k in range(len(net.e)) if (net.src[k], net.dst[k]) == (9, 10))
    path = net.hitting_path(0, 15, i)
    assert i in path and net.src[path[0]] == 0 and net.dst[path[-1]] == 15
    assert all(net.dst[a] == net.src[b] for a, b in itertools.pairwise(path))


def test_nnls_hand_case_and_optimality():
    a = np.array([[1.0, 1.0], [0.0, 1.0]])
    f = np.array([1.0, 2.0])
    c = sv.nnls_gram(a.T @ a, a.T @ f)
    assert c == pytest.approx([0.0, 1.5], abs=1e-6)
    assert sv.objective(a.T @ a, a.T @ f, float(f @ f), c) == pytest.approx(0.5)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_nnls_conditions(seed):
    rng = np.random.default_rng(seed)
    a, f = rng.integers(0, 2, (12, 6)).astype(float), rng.integers(0, 9, 12).astype(float)
    g, r = a.T @ a, a.T @ f
    for c in (sv.nnls_gram(g, r), sv.nnls_batched(g, r, 2)):
        grad = g @ c - r
        live = np.diag(g) > 0
        assert (c >= 0).all() and (grad[live] >= -1e-5).all() and (np.abs(grad * c) <= 1e-4).all()
    start = np.abs(rng.random(6))
    assert sv.objective(g, r, 0, sv.greedy_refine(g, r, start)) <= sv.objective(g, r, 0, start) + 1e-9
    assert (sv.nnls_incremental(g, r, 2, retain=2) >= 0).all()


def test_min_cost_flow_conserves():
    net = grid(3)
    from wayloom.operators.decompose import incidence

    a, place = incidence(net)
    free = np.zeros(9, bool)
    free[[place[0], place[8]]] = True
    x = sv.min_cost_flow(a, free, np.arange(len(net.e), dtype=float) % 4)
    assert (x >= 0).all() and np.abs(a[~free] @ x).max() < 1e-4


def test_set_cover_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = {k: set(rng.choice(8, rng.integers(1, 5), replace=False).tolist()) for k in range(7)}
        universe = set().union(*sets.values())
        best = next(n for n in range(1, 8) for c in itertools.combinations(sets, n) if set().union(*(sets[k] for k in c)) == universe)
        assert len(sv.set_cover(sets, universe)) == best
    assert sv.set_cover({1: {1}}, {1, 2}) is None


def test_many_pairs_are_decided_and_measured_as_single_ones():
    rng = np.random.default_rng(5)

    def lines(n):
        size = rng.integers(1, 7, n)
        return fr.Lines(*rng.integers(0, 6, (2, size.sum())).astype(float), size)

    for _ in range(5):
        p, q = lines(12), lines(12)
        i, j = np.divmod(np.arange(144), 12)
        radius = rng.integers(0, 8, 144).astype(float)
        assert fr.within_many(p, i, q, j, radius).tolist() == [fr.within(p.one(a), q.one(b), r) for a, b, r in zip(i, j, radius, strict=True)]
        d = np.array([fr.distance(p.one(a), q.one(b), 1e-2) for a, b in zip(i, j, strict=True)])
        assert fr.distance_many(p, i, q, j, 1e-2).tolist() == d.tolist()
        assert (fr.end_bounds(p, q)[i, j] <= d + 1e-9).all() and (fr.step_bounds(p, q)[i, j] >= d - 1e-2).all()
        least = fr.distance_many(p, i, q, j, 1e-2, group=i)
        assert [np.nanmin(least[i == k]) for k in range(12)] == [d[i == k].min() for k in range(12)]


def test_cover_of_many_sets_takes_no_pairs_of_them():
    import time

    sets = {k: {k, k + 1} for k in range(0, 20_000, 2)} | {k: {k} for k in range(1, 20_000, 2)}
    began = time.process_time()
    assert sv.set_cover(sets, set(range(20_000))) == list(range(0, 20_000, 2))
    assert time.process_time() - began < 5


def test_radii_below_the_least_one_are_not_searched(monkeypatch):
    net, rng, tried = grid(), np.random.default_rng(6), []
    search = fr.graph_path
    monkeypatch.setattr(fr, "graph_path", lambda n, p, r: tried.append(r) or search(n, p, r))
    for _ in range(20):
        line = rng.random((5, 2)) * 4 - 0.5
        got, least = fr.best_graph_path(net, line, 0.01, 0.01), fr.least_radius(net, line)
        assert tried and min(tried) >= least
        tried.clear()
        with monkeypatch.context() as m:
            m.setattr(fr, "least_radius", lambda n, p: 0.0)
            assert fr.best_graph_path(net, line, 0.01, 0.01) == got
        assert tried[0] == 0.01
        tried.clear()


def test_edges_left_out_of_the_first_block_are_searched_as_well(monkeypatch):
    net, line = grid(), np.array([[0.1, 0.1], [1.9, 0.2], [2.1, 2.2]])
    want = fr.best_graph_path(net, line, 0.1, 0.01)
    monkeypatch.setattr(fr, "CELLS", 1)
    assert fr.best_graph_path(net, line, 0.1, 0.01) == want


def test_a_matcher_serves_one_line_after_the_other():
    from wayloom.operators import matching as mt

    net = grid()
    one = mt.Matcher(net, math.inf)
    first = one.way(0, 10)
    net.shortest = None
    assert one.way(0, 10) == first and len(first) == 4
