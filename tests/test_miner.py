import os
import random
from collections import Counter

import pytest

from graphloom.functions import dfscode
from graphloom.operators import extend, graph, support
from graphloom.plans.miner import Miner, mine
from graphloom.sources.writers import CountSink

LABELS = [0, 1, 0, 1, 1, 0, 0, 1]
EDGES = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 6), (3, 4), (3, 5), (4, 5), (4, 7), (5, 6), (5, 7), (6, 7)]


def frames(spark, labels, edges):
    return spark.createDataFrame(list(enumerate(labels)), "vid long, label int"), spark.createDataFrame(edges, "src long, dst long, elabel int")


def embeddings(labels, edges, code):
    near = {}
    for u, v, e in {(min(u, v), max(u, v), e) for u, v, e in edges if u != v}:
        near.setdefault(u, []).append((v, e))
        near.setdefault(v, []).append((u, e))
    out = [(u, v) for u in near for v, e in near[u] if (labels[u], e, labels[v]) == code[0][2:]]
    for i, j, _, e, b in code[1:]:
        if i < j:
            out = [(*m, w) for m in out for w, x in near[m[i]] if x == e and labels[w] == b and w not in m]
        else:
            out = [m for m in out if (m[j], e) in near[m[i]]]
    return out


def brute(labels, edges, minsup, max_edges, simple=True):
    """Codes grown from every edge, counted by plain loops."""
    triples = {(labels[a], e, labels[b]) for u, v, e in edges if u != v for a, b in ((u, v), (v, u))}
    out, level = {}, [((0, 1, *t),) for t in triples if t[0] <= t[2]]
    while level:
        kept = []
        for c in level:
            found = embeddings(labels, edges, c)
            n = min((len(set(col)) for col in zip(*found)), default=0)
            if n >= minsup:
                out[c] = n
                kept.append(c)
        level = [(*c, e) for c in kept if len(c) < max_edges for e in dfscode.candidates(c, triples, simple)]
    return out


@pytest.mark.parametrize("minsup,want", [(1, [3, 6, 16]), (2, [3, 5, 11, 18, 20]), (3, [3, 3, 4, 1]), (4, [2, 1, 1])])
def test_small_graph(spark, minsup, want):
    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    got = mine(spark, v, e, minsup, max_edges=len(want) + (minsup > 2)).patterns
    n = Counter(len(c) for c, _ in got)
    assert [n[k + 1] for k in range(len(want))] == want and sum(n.values()) == sum(want)
    assert all(dfscode.is_min(c) for c, _ in got)


def test_small_graph_supports(spark):
    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    got = {tuple(sorted([dfscode.labels(c)[0], dfscode.labels(c)[1]])): n for c, n in mine(spark, v, e, 1, max_edges=1).patterns}
    assert got == {(0, 0): 4, (0, 1): 4, (1, 1): 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    labels = [rng.randint(0, 2) for _ in range(9)]
    edges = [(rng.randrange(9), rng.randrange(9), rng.randint(0, 1)) for _ in range(18)]
    edges = list({(min(a, b), max(a, b)): (a, b, e) for a, b, e in edges}.values())
    noisy = edges + [(4, 4, 0)] + [(b, a, e) for a, b, e in edges[:5]]  # self loops and repeats go
    v, e = frames(spark, labels, noisy)
    got = dict(mine(spark, v, e, 2, max_edges=4).patterns)
    assert got == brute(labels, edges, 2, 4)
    code = max(got, key=len)
    assert sorted(tuple(r) for r in extend.match(graph.arcs(v, e), code).collect()) == sorted(embeddings(labels, edges, code))
    assert extend.contains(graph.arcs(v, e), code) and not extend.contains(graph.arcs(v, e), ((0, 1, 7, 0, 7),))


def test_parallel_edges(spark):
    rng = random.Random(8)
    labels = [rng.randint(0, 1) for _ in range(8)]
    edges = sorted({(min(a, b), max(a, b), rng.randint(0, 1)) for a, b in ((rng.randrange(8), rng.randrange(8)) for _ in range(30)) if a != b})
    assert len({e[:2] for e in edges}) < len(edges)
    got = dict(mine(spark, *frames(spark, labels, edges), 2, max_edges=3, simple=False).patterns)
    assert got == brute(labels, edges, 2, 3, simple=False)
    assert set(dict(mine(spark, *frames(spark, labels, edges), 2, max_edges=3).patterns)) < set(got)


def test_growth_plan_does_not_shuffle_the_arcs_again(spark):
    from graphloom.operators import graph as graph_ops

    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    arcs = graph_ops.arcs(v, e)
    useful = extend.by_src(arcs, 4).persist()
    useful.count()
    roots = extend.forward_roots(arcs).selectExpr("0 AS pattern", "src AS v0", "dst AS v1")
    positions, steps = spark.createDataFrame([(0, 1, 2)], "pattern int, i int, nodes int"), spark.createDataFrame([(0, 0, 1, 2, 0, 0)], "pattern int, child int, i int, j int, edge_label int, to_label int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from pyspark.sql import functions as F

        plan = extend.grow(roots, useful, F.broadcast(positions), F.broadcast(steps))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        useful.unpersist()
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    at = next(k for k, x in enumerate(lines) if "InMemoryTableScan" in x)
    above, now = [], depth(lines[at])
    for x in reversed(lines[:at]):  # up to the join that the cached arcs enter
        if depth(x) < now:
            now = depth(x)
            above.append(x.lstrip(" :+-*"))
            if "Join" in x:
                break
    assert "Join" in above[-1] and not any(x.startswith("Exchange") for x in above)


def test_metamorphic(spark):
    rng = random.Random(5)
    labels = [rng.randint(0, 1) for _ in range(12)]
    edges = list({(a, b): (a, b, 0) for a, b in ((rng.randrange(6), 6 + rng.randrange(6)) for _ in range(20))}.values())
    low = dict(mine(spark, *frames(spark, labels, edges), 2, max_edges=3).patterns)
    high = dict(mine(spark, *frames(spark, labels, edges), 3, max_edges=3).patterns)
    assert high == {c: n for c, n in low.items() if n >= 3}
    for c, n in low.items():
        assert len(c) == 1 or low[c[:-1]] >= n
    order = list(range(12))
    rng.shuffle(order)
    moved = [0] * 12
    for a, b in enumerate(order):
        moved[b] = labels[a]
    assert dict(mine(spark, *frames(spark, moved, [(order[a], order[b], e) for a, b, e in edges]), 2, max_edges=3).patterns) == low


def test_bounds_hold(spark):
    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    v = v.selectExpr("*", "CAST(vid % 3 AS INT) AS part_id")
    m = extend.match(graph.arcs(v, e), ((0, 1, 0, 0, 1), (1, 2, 1, 0, 0)))
    r = support.decide(m, v, 3).first()
    assert r.lower <= r.support <= r.upper


def test_miner_object_and_limits(spark):
    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    sink = CountSink()
    m = Miner(spark, max_edges=2).set_graph(v, e).set_min_support(2).set_output(sink)
    m.run()
    assert sink.count() == 8 == m.report()["total_frequent_graphs"]
    with pytest.raises(ValueError):
        mine(spark, v, e, 0)
    with pytest.raises(MemoryError):
        mine(spark, v, e, 1, max_edges=2, embedding_budget=3)
    assert mine(spark, v, e.where("1 = 0"), 1).patterns == []
    assert mine(spark, v, e, 100).patterns == []


def test_stream(spark, tmp_path):
    from graphloom.streaming.incremental import mine_stream

    v, e = frames(spark, LABELS, [(a, b, 0) for a, b in EDGES])
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {}
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    mine_stream(stream, v, f"{tmp_path}/store", f"{tmp_path}/cp", 2, 2, lambda k, m: got.update({k: len(m.patterns)})).awaitTermination(120)
    assert list(got.values())[-1] == 8


@pytest.mark.skipif(not os.path.isdir(os.environ.get("LADJP_GOLDEN", "")), reason="LADJP_GOLDEN names no folder of local partition files")
def test_golden_counts(spark):
    """20,226 vertices, 83,356 edges; patterns of one, two and three edges at minsup 200."""
    from graphloom.plans.miner import single_edge_codes
    from graphloom.sources.readers import read_ladjp

    v, e = read_ladjp(spark, os.environ["LADJP_GOLDEN"])
    assert (v.count(), e.count()) == (20226, 83356)
    assert single_edge_codes(graph.arcs(v, e)).count() == 227
    n = Counter(len(c) for c, _ in mine(spark, v, e, 200, max_edges=3).patterns)
    assert [n[1], n[2], n[3]] == [142, 345, 335]
