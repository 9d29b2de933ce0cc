"""Crowded places of spatial joins against plain loops."""

import numpy as np
import pandas as pd
import pytest

from markgrid.operators import spatial as SP


def brute(left, right, cap):
    out = set()
    for doc, i, x, y in left.itertuples(index=False):
        r = right[right.doc_id == doc]
        if not len(r):
            continue
        d = np.sqrt((r.r_cx - x) ** 2 + (r.r_cy - y) ** 2)
        best = min(zip(d, r.rid))
        if cap is None or best[0] <= cap:
            out.add((doc, i, best[1], round(float(best[0]), 9)))
    return out


def frames(n, seed=3):
    """One third of either side in one spot, a third of that on one point, the rest over two pages."""
    g = np.random.default_rng(seed)

    def side(n, names):
        xy = g.uniform(0, 3000, (n, 2))
        xy[: n // 3] = 1500 + g.uniform(-1, 1, (n // 3, 2))
        xy[: n // 9] = 1500.25
        doc = (np.arange(n) % 7 == 0).astype(int)
        return pd.DataFrame({"doc_id": doc, names[0]: np.arange(n), names[1]: xy[:, 0], names[2]: xy[:, 1]})

    left, right = side(n, ("lid", "l_cx", "l_cy")), side(n, ("rid", "r_cx", "r_cy"))
    alone = pd.DataFrame({"doc_id": [0, 1, 2], "lid": [n, n + 1, n + 2], "l_cx": [9000.0, 1501.9, 1.0], "l_cy": [9000.0, 1500.0, 1.0]})
    return pd.concat([left, alone], ignore_index=True), right


@pytest.mark.parametrize("cap", [None, 150.0])
@pytest.mark.parametrize("crowded", [8, 10**6])
def test_nearest_in_crowds(spark, cap, crowded):
    left, right = frames(600)
    got = SP.nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["doc_id"], "lid", "rid", cap=cap, crowded=crowded)
    assert {(r.doc_id, r.lid, r.rid, round(r.dist, 9)) for r in got.collect()} == brute(left, right, cap)
    assert got.columns == ["doc_id", "lid", "rid", "dist"]


def test_crowds_are_split_to_the_end(spark):
    """The finest cells of the tree hold no crowd: 3,000 points of one spot stand in cells of few rows."""
    _, right = frames(9000)
    right = right.drop_duplicates(["doc_id", "r_cx", "r_cy"])
    levels = SP._crowds(spark.createDataFrame(right), ["doc_id"], ("r_cx", "r_cy"), 128.0, 64)
    assert len(levels) >= 4
    finest = levels[-1][0] / 4
    cells = SP._celled(spark.createDataFrame(right), ("r_cx", "r_cy"), finest).groupBy("doc_id", "_gx", "_gy").count()
    assert cells.agg({"count": "max"}).first()[0] <= 64


def test_nearest_of_repeated_ids_and_empty_sides(spark):
    left = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 1, 5.0, 0.0)], "doc_id int, lid int, l_cx double, l_cy double")
    right = spark.createDataFrame([(0, k, float(k), 0.0) for k in range(5, 40)], "doc_id int, rid int, r_cx double, r_cy double")
    for crowded in (2, 10**6):
        assert SP.nearest(left, right, ["doc_id"], "lid", "rid", crowded=crowded).collect() == [(0, 1, 5, 0.0)]
        assert SP.nearest(left, right.limit(0), ["doc_id"], "lid", "rid", crowded=crowded).collect() == []
