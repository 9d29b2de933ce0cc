"""Boxes meet in cells that few of them cross, and are derived once."""

from pyspark.sql import functions as F

from markgrid.catalog.tables import Tables
from markgrid.operators import spatial as SP
from markgrid.operators import suppress as S


def test_few_boxes_are_copied(spark):
    boxes = spark.range(1000).selectExpr("id as det_id", "id * 37 % 2000 as x1", "id * 53 % 1500 as y1").selectExpr("*", "x1 + 50 as x2", "y1 + 35 as y2")
    assert SP._in_cells(SP.prefixed(boxes, "a_", []), "a_", "_la", None).count() < 1300


def test_pairs_do_not_depend_on_the_cells(spark, monkeypatch):
    boxes = spark.range(300).selectExpr("1 as doc_id", "id as det_id", "id * 37 % 200 - 100 as x1", "id * 53 % 150 as y1").selectExpr("*", "x1 + 5 + det_id % 40 as x2", "y1 + 9 + det_id % 30 as y2")
    pairs = lambda: sorted(tuple(r) for r in SP.self_overlap_pairs(boxes, ["doc_id"], "det_id", 0.3).select("a_det_id", "b_det_id").collect())
    wide = pairs()
    monkeypatch.setattr(SP, "WIDE", 1.0)
    assert wide and wide == pairs() and len(set(wide)) == len(wide)


def test_suppression_reads_written_boxes(spark):
    boxes = Tables(spark, "/root/testdata/sf0.001").boxes
    out = S.suppress_two_pass(boxes)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.count("*")).first()[0] > 0
