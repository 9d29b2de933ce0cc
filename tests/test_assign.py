"""Optimal assignment against all assignments tried, and against the greedy choice."""

import math
import random
from itertools import permutations

from pyspark.sql import functions as F

from markgrid.operators import assign as A
from markgrid.operators import match as M
from markgrid.operators import kernels as KN

SCHEMA = "doc_id long, l long, r long, cost double"


def best(edges):
    """Most pairs, then least total, over every assignment of left rows to right rows or to nothing."""
    cost = {}
    for le, ri, x in edges:
        cost[le, ri] = min(x, cost.get((le, ri), x))
    ls, rs = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    if len(ls) > len(rs):
        cost, ls, rs = {(b, a): x for (a, b), x in cost.items()}, rs, ls
    found = (0, 0.0)
    for chosen in permutations(rs, len(ls)):
        got = [cost[le, ri] for le, ri in zip(ls, chosen) if (le, ri) in cost]
        found = max(found, (len(got), -sum(got)))
    return found[0], -found[1]


def some_graphs(n):
    """Graphs with many ties, and surplus on either side."""
    rnd = random.Random(11)
    out = {}
    for g in range(n):
        nl, nr, share = rnd.randint(1, 7), rnd.randint(1, 7), rnd.choice([0.3, 0.6, 1.0])
        out[g] = [(le, ri, rnd.choice([rnd.randint(0, 4), rnd.randint(0, 400) / 8])) for le in range(nl) for ri in range(nr) if rnd.random() < share]
    return {g: e for g, e in out.items() if e}


def check(groups, rows):
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for g, e in groups.items():
        own = got.get(g, [])
        assert len({r.l for r in own}) == len({r.r for r in own}) == len(own)
        assert all((r.l, r.r, r.cost) in {(a, b, float(x)) for a, b, x in e} for r in own)
        n, total = best(e)
        assert len(own) == n and math.isclose(sum(r.cost for r in own), total, abs_tol=1e-9), (g, e, own)


def frame(spark, groups):
    return spark.createDataFrame([(g, le, ri, float(x)) for g, e in groups.items() for le, ri, x in e], SCHEMA)


def test_paths_equal_brute_force():
    for e in some_graphs(400).values():
        taken = [x for x, t in zip(e, A.shortest_paths([x[0] for x in e], [x[1] for x in e], [int(x[2] * 8) for x in e])) if t]
        assert len({x[0] for x in taken}) == len({x[1] for x in taken}) == len(taken)
        assert (len(taken), sum(x[2] for x in taken)) == best(e)


def test_components_equal_brute_force(spark):
    groups = some_graphs(60)
    check(groups, A.optimal_pairs(frame(spark, groups), ["doc_id"]).collect())


def test_large_components_choose_greedily(spark):
    df = frame(spark, some_graphs(30))
    low = df.groupBy("doc_id", "l").agg(F.min("cost").alias("turn"))
    want = {(r.doc_id, r.l, r.r) for r in KN.serial_choice(df.join(low, ["doc_id", "l"]), ["doc_id"], ["turn"], ["cost", "r"]).collect()}
    got = A.optimal_pairs(df, ["doc_id"], most=0).collect()
    assert {(r.doc_id, r.l, r.r) for r in got} == want and {r.method for r in got} <= {"optimal", "greedy"}


def test_optimal_beats_greedy_where_a_near_mark_steals(spark):
    """Two marks beside one size: the greedy choice takes the closest pair and leaves a mark without a size."""
    marks = spark.createDataFrame([(1, 1, 1, 0.0, 0.0), (1, 1, 2, 30.0, 0.0)], "doc_id long, page_no long, mark_id long, cx double, cy double")
    sizes = spark.createDataFrame([(1, 1, 11, 16.0, 0.0), (1, 1, 12, 125.0, 0.0)], "doc_id long, page_no long, size_id long, cx double, cy double")
    edges = M.size_edges(marks, sizes)
    greedy = {(r.l, r.r) for r in M.pair_sizes_greedy(edges).collect()}
    optimal = {(r.l, r.r) for r in A.optimal_pairs(edges, ["doc_id", "page_no"]).collect()}
    assert greedy == {(2, 11)} and optimal == {(1, 11), (2, 12)}


def test_edges_without_use(spark):
    """Null and non-finite costs, null ids, repeated pairs, no pairs."""
    rows = [(1, 1, 1, None), (1, 1, 2, float("nan")), (1, 2, 1, float("inf")), (1, None, 3, 1.0), (None, 1, 1, 1.0), (2, 1, 1, 5.0), (2, 1, 1, 3.0), (2, 2, 1, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in A.optimal_pairs(df, ["doc_id"]).collect()] == [(2, 1, 1, 3.0, "optimal")]
    assert A.optimal_pairs(df.limit(0), ["doc_id"]).collect() == []


def test_never_worse_than_greedy():
    """One large component: 400 marks and 380 sizes in a strip."""
    rnd = random.Random(5)
    left, right = [(i, rnd.random() * 4000) for i in range(400)], [(i, rnd.random() * 4000) for i in range(380)]
    rows = [(a, b, round(abs(x - y) * 4096)) for a, x in left for b, y in right if abs(x - y) <= 60]
    taken = [x for x, t in zip(rows, A.shortest_paths(*map(list, zip(*rows)))) if t]
    assert len({x[0] for x in taken}) == len({x[1] for x in taken}) == len(taken)
    used, greedy = [set(), set()], []
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b), greedy.append(w)
    assert len(taken) > len(greedy) or sum(x[2] for x in taken) <= sum(greedy)
