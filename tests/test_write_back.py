"""Stored results: backfills that run twice, and curves refitted batch by batch that are replayed."""

import os
import shutil

from pyspark.sql import functions as F

from markgrid.plans import cascades as C
from markgrid.streaming import streams as ST

c = F.col


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def inputs(spark, note="TYP OF 3"):
    boxes = spark.createDataFrame([(d, 1, k, "AD", f"T{k}", 100.0 * k, 0.0, 100.0 * k + 10, 10.0, 1) for d in (1, 2, 3) for k in range(4)],
                                  "doc_id long, page_no long, det_id long, cls string, tag string, x1 double, y1 double, x2 double, y2 double, units int")
    words = [(1, 1, 0, "NIC", 0.0), (2, 1, 0, note, 100.0), (3, 1, 0, "NIC", 0.0)]
    words = spark.createDataFrame([(d, p, w, x, at, 0.0, at + 10, 10.0) for d, p, w, x, at in words],
                                  "doc_id long, page_no long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    jobs = spark.createDataFrame([(1, "done"), (2, "done"), (3, "running")], "doc_id long, status string")

    def tables(marked):
        none = spark.createDataFrame([], "doc_id long, tag string, neck string, qty long, cfm_missing long")
        return none, marked.selectExpr("doc_id", "cls", "tag", "'8' as neck", "units", "90 as conf"), none.select("doc_id", "tag", "neck")

    return jobs, boxes, words, tables


def test_backfill_is_stored_once(spark, tmp_path):
    folder = str(tmp_path)
    first = {r.doc_id: (r.n_rows, r.n_nic, r.extra_units) for r in C.write_back(*inputs(spark), folder).collect()}
    assert first == {1: (4, 1, 0), 2: (4, 0, 2)}
    table = spark.read.parquet(f"{folder}/tag_table")
    assert sorted(r.tag for r in table.where("doc_id = 1").collect()) == ["T1", "T2", "T3"]
    before = files(folder)
    assert C.write_back(*inputs(spark), folder).count() == 0
    assert files(folder) == before
    # one document changes: its partitions alone are written again
    assert [r.doc_id for r in C.write_back(*inputs(spark, "TYP OF 4"), folder).collect()] == [2]
    after = files(folder)
    assert {k: v for k, v in before.items() if "doc_id=1" in k} == {k: v for k, v in after.items() if "doc_id=1" in k}
    assert [r.units for r in spark.read.parquet(f"{folder}/boxes").where("doc_id = 2 and units > 1").collect()] == [4]


def test_backfill_without_finished_jobs(spark, tmp_path):
    jobs, *rest = inputs(spark)
    assert C.write_back(jobs.withColumn("status", F.lit("running")), *rest, str(tmp_path)).count() == 0
    assert files(str(tmp_path)) == {}


def test_lost_commit_is_made_again(spark, tmp_path):
    """A run that wrote boxes and tables but no commit leaves nothing that a second run does not repair."""
    C.write_back(*inputs(spark), str(tmp_path / "whole"))
    folder = str(tmp_path / "lost")
    for part in ("boxes", "tag_table", "commits/doc_id=1"):
        shutil.copytree(tmp_path / "whole" / part, f"{folder}/{part}")
    assert [r.doc_id for r in C.write_back(*inputs(spark), folder).collect()] == [2]
    assert spark.read.parquet(f"{folder}/boxes").count() == 8
    assert C.write_back(*inputs(spark), folder).count() == 0


def test_rows_are_calibrated_by_earlier_batches_only(spark, tmp_path):
    base = str(tmp_path)
    seen = spark.createDataFrame([(i, "a", 40 + i % 20, i % 4 == 0) for i in range(100)], "event_id long, source string, pp long, ok boolean")
    late = spark.createDataFrame([(200, "a", 45, True), (201, "b", 45, True), (202, None, 45, None)], seen.schema)
    for k, df in enumerate((seen, late)):
        df.coalesce(1).write.mode("append").parquet(base + "/in")
        ST.refit_live(ST.source(spark, base + "/in", seen.schema), base + "/out", base + "/ck", c("pp"), c("ok"), ["event_id"])
    got = {r.event_id: r.calibrated for r in spark.read.parquet(base + "/out/scored").collect()}
    assert all(got[i] == (40 + i % 20) / 100 for i in range(100))
    # points (0.445, 0.3) and (0.545, 0.2) of the first batch
    assert abs(got[200] - 0.295) < 1e-9 and got[201] == 0.45 and got[202] == 0.45
    sums = spark.read.parquet(base + "/out/sums/version=1").where("source = 'a'").agg(F.sum("n"), F.sum("n_correct")).first()
    assert tuple(sums) == (101, 26)


def test_commits_are_written_by_many_tasks(spark, tmp_path):
    """A commit is one small row and one file a document, so their number and not their size decides on the tasks."""
    boxes = spark.range(40).selectExpr("id as doc_id", "1L as page_no", "0L as det_id", "'AD' as cls", "'T' as tag", "0.0D as x1", "0.0D as y1", "9.0D as x2", "9.0D as y2", "1 as units")
    words = spark.createDataFrame([(1, 1, 0, "NIC", 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_no long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    C.write_back(boxes.selectExpr("doc_id", "'done' as status"), boxes, words, inputs(spark)[3], str(tmp_path))
    written = files(str(tmp_path / "commits"))
    assert len(written) == 40 and len({os.path.basename(f).split("-")[1] for f in written}) > 1
