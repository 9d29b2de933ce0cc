"""What a job leaves on disk: shuffle files go with the job, and results are not behind a chain of shuffles."""

import re
import time

import pytest

from markgrid.catalog.registry import load, runner
from markgrid.operators import layout as L
from markgrid.operators import match as M
from markgrid.operators import reconcile as R
from markgrid.plans import cascades as C
from markgrid.session import TIDY, cut, is_empty

PAGE = ["doc_id", "page_no"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def left_behind(spark, do):
    before = shuffle_files(spark)
    do()
    for _ in range(50):
        if not (more := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return more


def test_a_cut_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).selectExpr("id % 50 as k", "id").groupBy("k").count()
    assert not left_behind(spark, lambda: cut(rows))
    assert not left_behind(spark, lambda: is_empty(rows.where("count > 0")))
    assert spark.conf.get(TIDY) == "false"
    assert sorted(r["count"] for r in cut(rows).collect()) == [100] * 50


def test_stored_results_leave_no_shuffle_files(spark, tmp_path):
    box = [(d, 1, i, "A", f"P-{i}", 100.0 * i, 0.0, 100.0 * i + 40, 40.0) for d in (1, 2) for i in range(4)]
    boxes = spark.createDataFrame(box, "doc_id long, page_no long, det_id long, cls string, tag string, x1 double, y1 double, x2 double, y2 double")
    words = spark.createDataFrame([(1, 1, 1, "NIC", 110.0, 10.0, 120.0, 20.0)], "doc_id long, page_no long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    jobs = spark.createDataFrame([(1, "done"), (2, "done")], "doc_id long, status string")

    def tables(marked):
        bom = marked.selectExpr("doc_id", "tag", "'' as neck", "1 as qty", "0 as cfm_missing")
        return bom, marked.selectExpr("doc_id", "cls", "tag", "'' as neck", "units", "50 as conf"), marked.selectExpr("doc_id", "tag", "'' as neck")

    made = []
    assert not left_behind(spark, lambda: made.append(C.write_back(jobs, boxes, words, tables, str(tmp_path / "out"))))
    assert sorted((r["doc_id"], r["n_nic"]) for r in made[0].collect()) == [(1, 1), (2, 0)]


@pytest.fixture(scope="module")
def items(spark):
    head = [(d, 1, k, 100.0 + 200 * k, 100.0, t) for d in (1, 2) for k, t in enumerate(("MARK", "CFM", "MODEL", "NECK SIZE"))]
    body = [(d, 1, 10 * r + k, 100.0 + 200 * k + r, 100.0 + 30 * r, t) for d in (1, 2) for r in (1, 2) for k, t in enumerate((f"EF-{r}", "300", "M1", '8"'))]
    rows = [(d, p, i, x, y, x - 30, y - 6, x + 30, y + 6, t) for d, p, i, x, y, t in head + body]
    return spark.createDataFrame(rows, "doc_id long, page_no long, item_id long, cx double, cy double, x1 double, y1 double, x2 double, y2 double, text string")


def test_legend_rows_take_one_shuffle_at_a_time(items):
    out = L.legend_rows(L.row_clusters(items, 12), [("EF", "FAN")])
    assert len(exchanges(out)) == 1
    assert sorted((r["doc_id"], r["row_no"], r["cls"], r["label"]) for r in out.collect() if r["cls"]) == [(d, n, "FAN", f'EF-{n} 300 M1 8"') for d in (1, 2) for n in (1, 2)]


def test_snapped_cells_take_one_shuffle_at_a_time(items):
    out = L.snap(L.row_clusters(items, 12), L.column_anchors(items, 50), 80)
    assert len(exchanges(out)) == 1
    assert out.count() == 24 and {r["text"] for r in out.where("row_no = 1 and col_no = 0").collect()} == {"EF-1"}


def test_read_tables_take_one_shuffle_at_a_time(items):
    out = L.read_tables(L.row_clusters(items, 12))
    assert len(exchanges(out)) == 1
    want = [("CFM", "300"), ("MODEL", "M1"), ("NECK SIZE", '8"')]
    assert sorted((r["doc_id"], r["row_no"], r["tag"]) for r in out.collect()) == [(d, n, f"EF-{n}") for d in (1, 2) for n in (1, 2)]
    assert all([(p["k"], p["v"]) for p in r["props"]] == want for r in out.collect())


def test_schedule_rows_join_what_is_written(spark):
    grid = [["FAN SCHEDULE 1", None, None], ["MARK", "SERVICE", "CFM"], ["EF-1", "EXHAUST FAN", "300"], ["EF-2", "PUMP", "20"]]
    cells = [(d, 0, r, k, t) for d in (1, 2) for r, row in enumerate(grid) for k, t in enumerate(row) if t]
    out = L.schedule_rows(spark.createDataFrame(cells, "doc_id long, table_no int, row_no int, col_no int, text string"), ["doc_id", "table_no"])
    assert len(exchanges(out)) <= 4
    assert sorted((r["doc_id"], r["tag"], r["schedule_name"]) for r in out.collect()) == [(d, f"EF-{n}", "FAN SCHEDULE 1") for d in (1, 2) for n in (1, 2)]


def test_text_near_point_meets_behind_one_shuffle_of_a_page(spark, monkeypatch):
    words = [(1, 1, n, 0, n, t, 100.0 * n, 0.0) for n, t in enumerate(("FAN", "COIL", "UNIT", "FAN"))]
    words = spark.createDataFrame(words, "doc_id long, page_no long, word_id long, line_no long, word_no long, text string, x0 double, y0 double")
    points = spark.createDataFrame([(1, 1, 7, "COILUNIT", 130.0, 20.0), (1, 1, 8, "FAN", 280.0, 0.0), (1, 1, 9, "FAN", 700.0, 0.0)], "doc_id long, page_no long, det_id long, want string, cx double, cy double")
    dealt = []
    monkeypatch.setattr(M, "cut", lambda df: dealt.extend(exchanges(df)) or cut(df))
    got = M.text_near_point(points, words, 120)
    assert len(dealt) == 2 and all(re.fullmatch(r"doc_id#\d+L, page_no#\d+L, \d+", d) for d in dealt)
    assert sorted((r["det_id"], r["word_id"], r["n_words"]) for r in got.collect()) == [(7, 1, 2), (8, 3, 1)]


def test_open_boxes_are_not_joined_again_at_every_level(spark):
    boxes = spark.createDataFrame([(1, 1, i) for i in range(5)], "doc_id long, page_no long, det_id long")
    left = C._left_open(C._left_open(boxes, boxes.where("det_id = 1")), boxes.where("det_id = 2"))
    assert "Join" not in plan(left) and sorted(r["det_id"] for r in left.collect()) == [0, 3, 4]


def test_quality_checks_look_up_quantities_once(spark):
    expected = spark.createDataFrame([(1, "P-1", 4), (1, "P-2", 1)], "doc_id long, tag string, exp_qty long")
    observed = spark.createDataFrame([(1, "P-1"), (1, None)], "doc_id long, tag string")
    out = R.quality_checks(expected, observed, ["doc_id"])
    assert "Join" not in plan(out)
    assert sorted((r["kind"], r["n"]) for r in out.collect()) == [("quantity_missing", 1), ("quantity_off", -3), ("tag_in_schedule_not_on_plan", 0), ("untagged_detections", 1)]


def test_longest_tag_near_box_reads_what_is_written(spark):
    out = runner(load()["longest_tag_near_box"])(spark, "/root/testdata/sf0.001")
    # the boxes' own order, both sides of the cells and the result; words and matches are read
    assert len(exchanges(out)) <= 4
