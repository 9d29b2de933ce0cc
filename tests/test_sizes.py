"""Joins are planned by what files hold, not by their compressed size."""

import pytest

from markgrid.catalog.tables import Tables
from markgrid.session import cut

FACTOR = "spark.sql.sources.fileCompressionFactor"


@pytest.fixture
def factor(spark):
    before = spark.conf.get(FACTOR)
    spark.conf.set(FACTOR, "1.0")
    yield
    spark.conf.set(FACTOR, before)


def test_a_small_file_of_many_keys_is_not_broadcast(spark, factor):
    Tables(spark, "nowhere")
    keys = cut(spark.range(1_000_000).selectExpr("id div 4 as doc_id", "id % 4 as page_no", "id % 7 as v"))
    rows = cut(spark.range(1_000_000).selectExpr("id div 4 as doc_id", "id % 4 as page_no", "id % 5 as w"))
    joined = rows.join(keys, ["doc_id", "page_no"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_factor_of_the_session_is_kept(spark, factor):
    spark.conf.set(FACTOR, "2.0")
    Tables(spark, "nowhere")
    assert spark.conf.get(FACTOR) == "2.0"


def test_rules_over_distinct_texts_are_not_worked_out_on_every_row(spark):
    from pyspark.sql import functions as F

    from markgrid.operators.layout import by_distinct

    rows = cut(spark.createDataFrame([(i, t) for i, t in enumerate(["A,B", "A,B", "", None, "C"])], "id int, text string"))
    out = by_distinct(rows, "text", "parts", lambda t: F.filter(F.split(t, ","), lambda p: p != "")).select("id", F.explode("parts").alias("part"))
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(0, "A"), (0, "B"), (1, "A"), (1, "B"), (4, "C")]


def test_classes_are_read_as_what_stands_for_them(spark):
    from pyspark.sql import functions as F

    from markgrid.functions import vocab as V
    from markgrid.functions.keys import alias_set, read_as

    names = sorted({*V.CLASS_ALIASES, *(y for v in V.CLASS_ALIASES.values() for y in (v if isinstance(v, list) else [v])), "FAN"})
    rows = spark.createDataFrame([(n,) for n in names], "cls string").select("cls", alias_set(F.col("cls")).alias("a"), read_as(F.col("cls")).alias("r")).collect()
    assert sorted((r["cls"], x) for r in rows for x in r["a"]) == sorted((x, r["cls"]) for r in rows for x in r["r"])


def test_boxes_are_not_copied_where_words_with_tags_are_the_few(spark):
    from markgrid.operators.match import longest_near_tag

    boxes = spark.createDataFrame([(1, 1, i, "AD-GRD", 10 * i, 0, 10 * i + 4, 4) for i in range(50)], "doc_id int, page_no int, det_id int, cls string, x1 int, y1 int, x2 int, y2 int")
    words = spark.createDataFrame([(1, 1, 7, 20.0, 2.0, "T-1", "AD-SURF SUPPLY", 2), (1, 1, 8, 20.0, 2.0, "T-2", "FAN", 9)], "doc_id int, page_no int, word_id int, cx double, cy double, tag string, tag_cls string, matched_len int")
    out = longest_near_tag(boxes, words, 100.0)
    got = {r["det_id"]: (r["tag"], r["new_cls"]) for r in out.collect()}
    assert got == {i: ("T-1", "AD-SURF SUPPLY") for i in range(12)}
    spread = [ln for ln in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in ln]
    assert len(spread) == 3 and not any("det_id" in ln or "l_c" in ln for ln in spread)


def test_items_stay_one_row_where_they_meet_columns(spark):
    from markgrid.operators.layout import snap

    items = spark.createDataFrame([(1, 1, 0, 1, 100.0, "a"), (1, 1, 0, 2, 129.0, "b"), (1, 1, 0, 3, 170.0, "c"), (1, 1, 0, 4, 999.0, "d")], "doc_id int, page_no int, row_no int, item_id int, cx double, text string")
    anchors = spark.createDataFrame([(1, 1, 0, 100.0), (1, 1, 1, 160.0)], "doc_id int, page_no int, col_no int, anchor double")
    out = snap(items, anchors, 80)
    assert sorted((r["col_no"], r["text"]) for r in out.collect()) == [(0, "a b"), (1, "c")]
    grouped = [ln for ln in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in ln]
    assert grouped and not any("item_id#" in ln.split("]", 1)[0] for ln in grouped)
