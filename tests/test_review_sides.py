"""Both sides of a review are written once."""

from pyspark.sql import functions as F

from markgrid.catalog.tables import Tables
from markgrid.operators import match as M


def test_review_reads_written_sides(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    reviewed = t.boxes.groupBy("doc_id", "page_no").agg(F.count("*").alias("n")).where("n >= 130")
    out = M.review_diff(t.boxes, t.revision, reviewed)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
