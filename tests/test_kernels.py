"""Join kernels against the sequential loops they stand for, on many random small graphs at once."""

import random

import pytest
from pyspark.sql import functions as F

from markgrid.operators import kernels as KN
from markgrid.operators import match as M
from markgrid.operators import spatial as SP
from markgrid.operators import suppress as S

N = 150


@pytest.fixture(autouse=True, params=["walked", "rounds"])
def way(request, monkeypatch):
    """Every kernel as a walk over groups, and as rounds of joins."""
    if request.param == "rounds":
        monkeypatch.setattr(KN, "WALKED", 0)
    return request.param


def graphs(seed):
    r = random.Random(seed)
    for g in range(N):
        nl, nr = r.randint(1, 7), r.randint(1, 7)
        yield g, [(le, ri, r.randint(0, 3)) for le in range(nl) for ri in range(nr) if r.random() < 0.45], r


def test_mutual_best(spark):
    rows, want = [], set()
    for g, es, _ in graphs(1):
        rows += [(g, le, ri, d) for le, ri, d in es]
        ul, ur = set(), set()
        for d, le, ri in sorted((d, le, ri) for le, ri, d in es):
            if le not in ul and ri not in ur:
                ul.add(le), ur.add(ri)
                want.add((g, le, ri))
    df = spark.createDataFrame(rows, "doc_id long, l long, r long, dist long")
    got = [(x.doc_id, x.l, x.r) for x in KN.mutual_best(df, ["doc_id"], ["dist"]).collect()]
    assert sorted(got) == sorted(want)


def test_serial_choice(spark):
    rows, want = [], set()
    for g, es, r in graphs(2):
        takes = {(le, ri): r.random() < 0.7 for le, ri, _ in es}
        rows += [(g, le, ri, d, takes[le, ri]) for le, ri, d in es]
        used = set()
        for le in sorted({e[0] for e in es}):
            free = sorted((d, ri) for a, ri, d in es if a == le and ri not in used)
            if free:
                ri = free[0][1]
                want.add((g, le, ri))
                if takes[le, ri]:
                    used.add(ri)
    df = spark.createDataFrame(rows, "doc_id long, l long, r long, dist long, takes boolean").withColumn("turn", F.col("l"))
    got = {(x.doc_id, x.l, x.r) for x in KN.serial_choice(df, ["doc_id"], ["turn"], ["dist", "r"], "takes").collect()}
    assert got == want


def test_suppressed(spark):
    rows, want = [], set()
    for g, es, _ in graphs(3):
        pairs = {(min(a, b), max(a, b)) for a, b, _ in es if a != b}
        rows += [(g, a, b) for a, b in pairs]
        kept = []
        for n in range(8):
            if any((k, n) in pairs for k in kept):
                want.add((g, n))
            else:
                kept.append(n)
    df = spark.createDataFrame(rows, "doc_id long, hi long, lo long")
    assert {(x.doc_id, x.id) for x in KN.suppressed(df, ["doc_id"]).collect()} == want


def test_components(spark):
    rows, want = [], set()
    for g, es, _ in graphs(4):
        pairs = {(a, b + 4) for a, b, _ in es if a != b + 4}
        rows += [(g, a, b) for a, b in pairs]
        parent = {n: n for p in pairs for n in p}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
        want |= {(g, n, find(n)) for n in parent}
    df = spark.createDataFrame(rows, "doc_id long, a long, b long")
    got = {tuple(x) for x in KN.components(df, ["doc_id"]).select("doc_id", "id", "root").collect()}
    assert got == want


def test_long_chain_component(spark):
    df = spark.range(200).selectExpr("1 as doc_id", "id as a", "id + 1 as b")
    assert KN.components(df, ["doc_id"]).agg(F.max("root"), F.count("*")).first() == (0, 201)


def test_first_disjoint(spark):
    r, rows, want = random.Random(5), [], set()
    for g in range(N):
        sets = sorted({tuple(sorted(r.sample(range(9), 3))) for _ in range(r.randint(1, 8))})
        rows += [(g, list(s), m) for s in sets for m in s]
        used = set()
        for s in sets:
            if not used & set(s):
                used |= set(s)
                want.add((g, s))
    df = spark.createDataFrame(rows, "doc_id long, s array<long>, m long").select("doc_id", F.struct(F.col("s")[0], F.col("s")[1], F.col("s")[2]).alias("sid"), "m")
    got = {(x.doc_id, tuple(x.sid)) for x in KN.first_disjoint(df, ["doc_id"], 3).collect()}
    assert got == want


def boxes(seed, n, pages=3, span=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice([6, 20, 60, 200])
        x, y = r.randint(-50, span), r.randint(-50, span)
        out.append((1, r.randrange(pages), i, r.choice("ab"), r.randint(1, 5), x, y, x + s + r.randint(0, s), y + s + r.randint(0, s)))
    return out


SCHEMA = "doc_id long, page_no long, det_id long, cls string, conf_pct long, x1 long, y1 long, x2 long, y2 long"


def iou(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    i = max(w, 0) * max(h, 0)
    return i / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - i)


def test_overlap_pairs_of_mixed_sizes(spark):
    a, b = boxes(1, 160), boxes(2, 160)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for t in (0.1, 0.45, 0.7):
        want = sorted((x[2], y[2]) for x in a for y in b if x[1] == y[1] and iou(x, y) >= t)
        got = sorted((r.a_det_id, r.b_det_id) for r in SP.overlap_pairs(da, db, ["doc_id", "page_no"], t).collect())
        assert got == want and (want or t > 0.6)


def nms(rows, thr, within):
    kept = []
    for x in sorted(rows, key=lambda v: (-v[4], v[2])):
        if not any(k[1] == x[1] and (not within or k[3] == x[3]) and iou(k, x) >= thr for k in kept):
            kept.append(x)
    return {k[2] for k in kept}


def test_suppression_of_mixed_sizes_and_copies(spark):
    rows = boxes(3, 200, span=120)
    rows += [(*x[:2], 1000 + i, *x[3:]) for i, x in enumerate(rows[:80])]  # exact copies
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.det_id for r in S.suppress_iou(df, 0.4).collect()} == nms(rows, 0.4, False)
    once = S.suppress_iou(df, 0.3, within="cls")
    assert {r.det_id for r in once.collect()} == nms(rows, 0.3, True)
    assert {r.det_id for r in S.suppress_iou(once, 0.3, within="cls").collect()} == nms(rows, 0.3, True)


def test_result_does_not_depend_on_order_or_partitions(spark):
    rows = boxes(4, 150, span=120)
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    assert {r.det_id for r in S.suppress_two_pass(a).collect()} == {r.det_id for r in S.suppress_two_pass(b).collect()}


def test_one_place_holding_all_copies(spark):
    """A heap of identical boxes never becomes pairs."""
    heap = spark.range(20000).selectExpr("1 as doc_id", "1 as page_no", "id as det_id", "'a' as cls", "id % 100 as conf_pct", "10 as x1", "10 as y1", "60 as x2", "60 as y2")
    assert [r.det_id for r in S.suppress_iou(heap, 0.5).collect()] == [99]


def test_nearest_far_away(spark):
    r = random.Random(6)
    left = [(1, i, float(r.randint(0, 5000)), float(r.randint(0, 5000))) for i in range(60)]
    right = [(1, i, float(r.randint(0, 5000)), float(r.randint(0, 5000))) for i in range(9)]
    dl, dr = spark.createDataFrame(left, "k long, l_id long, l_cx double, l_cy double"), spark.createDataFrame(right, "k long, r_id long, r_cx double, r_cy double")
    got = {x.l_id: x.r_id for x in SP.nearest(dl, dr, ["k"], "l_id", "r_id", start=64).collect()}
    assert got == {a[1]: min(right, key=lambda b: (((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), b[1]))[1] for a in left}


def test_diff_is_one_to_one(spark):
    a, b = spark.createDataFrame(boxes(7, 120), SCHEMA), spark.createDataFrame(boxes(8, 120), SCHEMA)
    m = M.match_in_order(a, b, 0.2)
    n = m.count()
    assert n == m.select("doc_id", "page_no", "l").distinct().count() == m.select("doc_id", "page_no", "r").distinct().count()
    d = M.revision_diff(a, b)
    assert d.where("det_id is not null").count() == 120


def test_long_chain_in_few_jobs(spark, way):
    """Each row's choice depends on the one before: 5,000 of them take one walk."""
    n = 5000 if way == "walked" else 6
    rows = [(1, i, r) for i in range(n) for r in ((i - 1, i) if i else (0,))]
    df = spark.createDataFrame(rows, "doc_id long, l long, r long").withColumn("turn", F.col("l")).withColumn("pick", F.col("r"))
    got = {(x.l, x.r) for x in KN.serial_choice(df, ["doc_id"], ["turn"], ["pick", "r"]).collect()}
    assert got == {(i, i) for i in range(n)}
    pairs = df.where("l <> r or l = 0").select("doc_id", F.col("r").alias("hi"), F.col("l").alias("lo")).where("hi <> lo")
    gone = {x.id for x in KN.suppressed(pairs, ["doc_id"]).collect()}
    assert gone == set(range(1, n, 2))
