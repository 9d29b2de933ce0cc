"""Registered queries at sf0.001 against their SQL, and properties of plans and entry points."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from markgrid.catalog.registry import load, runner
from markgrid.catalog.tables import BASE, Tables
from tools.check import rows

SF = "/root/testdata/sf0.001"
# one or more of every group; tools/check.py runs all of them
CHOSEN = """
document_trust keyed_table_diff tag_table match_cascade agreement_gate page_classification tag_cell_expansion size_and_flow class_alias
nearest_label distance_greedy_pairs revision_diff review_diff mark_size_pairs callouts_to_boxes band_fill labels_in_box text_near_point
nms_two_pass run_merge closed_rectangles takeoff_rows three_way_quantities headline_statistics per_class_scores threshold_sweep calibrated_confidence
row_clusters column_anchors grid_schedules read_tables phrase_windows sheet_index forward_fill tile_assignment thin_preserving_sample group_split every_kth_row
read_detections event_log_round_trip takeoff_sheet_reader reviewed_annotations page_truth tag_inference_cascade size_waterfall context_statistics
label_instances document_verification stream_reliability stream_latest_records stream_threshold_trigger reap_stale_jobs
bare_marks note_write_back stream_live_calibration
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    q = load()[name]
    df = runner(q)(spark, SF)
    res = duck.execute(q.sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    assert rows(df.columns, df.collect()) == want


def test_entry_and_registry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_golden_suppression_counts(spark):
    """Known counts of the sequential loop at sf0.01."""
    from markgrid.operators.suppress import suppress_iou

    b = Tables(spark, "/root/testdata/sf0.01").boxes
    first = suppress_iou(b, 0.45, within="cls")
    assert first.count() == 58637
    assert suppress_iou(first, 0.70).count() == 56230


@pytest.mark.parametrize("name", ["document_trust", "nearest_words", "labels_in_box", "attribute_lookup", "band_fill", "tile_assignment", "class_tag_counts", "agreement_gate"])
def test_no_all_pairs_plan(spark, name):
    plan = runner(load()[name])(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_needed(spark):
    plan = runner(load()["promotion_verdict"])(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_discount" not in plan


def test_diff_is_symmetric(spark):
    from markgrid.operators.reconcile import keyed_diff

    t = Tables(spark, SF)
    n = lambda a, b: {r["status"]: r["count"] for r in keyed_diff(a, b, ["tag", "neck", "product"], ["qty"], []).groupBy("status").count().collect()}
    x, y = n(t.team, t.ours), n(t.ours, t.team)
    assert x["MISSING"] == y["EXTRA"] and x["EXTRA"] == y["MISSING"] and x["MATCH"] == y["MATCH"]


def test_totals_add_up(spark):
    from markgrid.catalog.registry import QUERIES

    t = Tables(spark, SF)
    d = QUERIES["class_totals"].run(t)
    assert d.where("is_total").agg({"total": "sum"}).first()[0] == t.boxes.count()
