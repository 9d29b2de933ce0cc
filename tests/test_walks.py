"""Groups are settled in one pass, and what is read more than once is written first."""

import pytest

from markgrid.catalog.tables import Tables
from markgrid.operators import kernels as KN
from markgrid.operators import suppress as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cuts(monkeypatch):
    made = []
    monkeypatch.setattr(KN, "cut", lambda df, cut=KN.cut: made.append(1) or cut(df))
    return made


def test_a_chain_of_links_takes_no_rounds(spark, cuts):
    edges = spark.range(300).selectExpr("id div 100 as doc_id", "id as a", "id + 1 as b").where("a % 100 < 99")
    got = {(r.doc_id, r.id, r.root) for r in KN.components(edges, ["doc_id"]).collect()}
    assert got == {(d, 100 * d + k, 100 * d) for d in range(3) for k in range(100)}
    assert len(cuts) == 2


def test_a_chain_of_sets_takes_no_rounds(spark, cuts):
    sets = spark.range(60).selectExpr("1 as doc_id", "struct(id, id + 1) as sid", "explode(array(id, id + 1)) as m")
    got = sorted(tuple(r.sid) for r in KN.first_disjoint(sets, ["doc_id"], 2).collect())
    assert got == [(k, k + 1) for k in range(0, 60, 2)]
    assert len(cuts) == 2


def test_links_without_keys_are_not_walked_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(KN, "_grouped", None)
    edges = spark.range(5).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in KN.components(edges, []).collect()} == {0}


def test_runs_and_context_read_written_boxes(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" not in plan(S.merge_runs(t.strips))
    assert "l_extendedprice" not in plan(S.closed_rectangles(t.strips))
