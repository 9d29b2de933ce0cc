"""Cases beyond what the derived tables hold: long tags, tall callouts, exact figures, null points, unit squares."""

import random

from pyspark.sql import functions as F

from markgrid.operators import aggregate, evaluate, filters, match, reconcile, spatial


def test_a_long_tag_is_found_inside_a_text(spark):
    tag = "VERYLONGEQUIPMENTDESIGNATION-NORTHWING-42"
    tags = spark.createDataFrame([(1, tag), (1, "EF-1")], "doc_id long, tag string")
    texts = spark.createDataFrame([(1, 7, f"SEE {tag} ABOVE"), (1, 8, "XEF1Y"), (1, 9, None)], "doc_id long, word_id long, text string")
    got = {r["word_id"]: (r["match"], r["strength"]) for r in reconcile.match_cascade(texts, tags, ["doc_id"], "word_id").collect()}
    assert got == {7: (tag, "fuzzy"), 8: ("EF-1", "fuzzy")}


def test_rows_of_two_pages_with_one_number_stay_apart(spark):
    tags = spark.createDataFrame([(1, "A-1")], "doc_id long, tag string")
    texts = spark.createDataFrame([(1, 1, 10**10, "A1"), (1, 11, 0, "A-1")], "doc_id long, page_no long, word_id long, text string")
    assert reconcile.match_cascade(texts, tags, ["doc_id"], ["page_no", "word_id"]).count() == 2


def test_a_tall_callout_keeps_its_number(spark):
    words = [(1, 1, 1, "EF", 100.0, 0.0, 130.0, 60.0), (1, 1, 2, "3", 108.0, 85.0, 122.0, 140.0), (1, 1, 3, "SF", 500.0, 0.0, 530.0, 10.0), (1, 1, 4, "4", 508.0, 12.0, 522.0, 22.0)]
    w = spark.createDataFrame(words, "doc_id long, page_no long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    tags = spark.createDataFrame([(1, "EF-3"), (1, "SF-4")], "doc_id long, tag string")
    assert sorted(r["tag"] for r in match.stacked_callouts(w, ["EF", "SF"], tags).collect()) == ["EF-3", "SF-4"]


def test_headline_counts_exact_values(spark):
    values = [0.49996, 0.5, 0.9, 0.1, 0.49994]
    r = aggregate.headline(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    assert (r["total"], r["max"], r["at_least_half"], r["upper_median"]) == (5, 0.9, 2, 0.49996)


def test_headline_against_sorting(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.25, 1.0, 0.0]) for _ in range(500)]
    r = aggregate.headline(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert r["upper_median"] == sorted(values)[len(values) // 2] and r["at_least_half"] == sum(v >= 0.5 for v in values)


def test_nearest_ends_on_rows_without_a_point(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 5.0), (1, 3, float("nan"), 5.0)], "d long, l_id long, l_cx double, l_cy double")
    right = spark.createDataFrame([(1, 9, 1e6, 0.0), (1, 8, None, None)], "d long, r_id long, r_cx double, r_cy double")
    assert [tuple(r) for r in spatial.nearest(left, right, ["d"], "l_id", "r_id").collect()] == [(1, 1, 9, 1e6)]


def meetings(df, scale):
    b = df.select("d", "id", *[(F.col(x) * scale).alias(x) for x in ("x1", "y1", "x2", "y2")])
    a, o = spatial.prefixed(b, "a_", ["d"]), spatial.prefixed(b, "b_", ["d"])
    levels = spatial.size_levels(b)
    left, right = spatial._in_cells(a, "a_", "_la", None), spatial._in_cells(o, "b_", "_lb", levels, 2)
    return left.join(right, ["d", "_lv", "_cx", "_cy"]).count(), spatial.self_overlap_pairs(b, ["d"], "id", 0.3).count()


def test_boxes_of_a_unit_square_spread_like_pixels(spark):
    rng = random.Random(1)
    rows = [(1, i, x, y, x + 0.03, y + 0.03) for i in range(300) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "d long, id long, x1 double, y1 double, x2 double, y2 double")
    small, pixels = meetings(df, 1.0), meetings(df, 1024.0)
    assert small == pixels and small[0] < 10_000


def test_refinement_never_degrades(spark):
    boxes = [(1, "A", "AD-GRD"), (1, "A", "EXHAUST FAN"), (1, "B", "AD-T-BAR SUPPLY"), (1, "C", "AD-T-BAR SUPPLY"), (1, "D", "AD-GRD"), (1, None, "AD-GRD")]
    schedule = [(1, "A", "AD-SURF SUPPLY"), (1, "B", "AD-GRD"), (1, "C", "AD-SURF SUPPLY"), (1, "D", "EXHAUST FAN")]
    out = reconcile.refine_by_mode(spark.createDataFrame(boxes, "doc_id long, tag string, cls string"), spark.createDataFrame(schedule, "doc_id long, tag string, subtype string"), ["doc_id"])
    got = sorted((r["tag"] or "", r["cls"], r["original_cls"] or "") for r in out.collect())
    assert got == [("", "AD-GRD", ""), ("A", "AD-SURF SUPPLY", "AD-GRD"), ("A", "EXHAUST FAN", ""), ("B", "AD-T-BAR SUPPLY", ""), ("C", "AD-SURF SUPPLY", "AD-T-BAR SUPPLY"), ("D", "AD-GRD", "")]


def test_brier_does_not_depend_on_order(spark):
    rows = [(i % 97 / 97, i % 3 == 0) for i in range(3000)]
    a, b = (evaluate.brier(spark.createDataFrame(r, "p double, y boolean").repartition(n), [], F.col("p"), F.col("y").cast("int")).first()["brier"] for r, n in ((rows, 7), (rows[::-1], 3)))
    assert a == b


def test_leakage_guard_finds_words_of_any_length(spark):
    long = "abcdefghijklmnopqrstuvwxyzabcd"
    bench = spark.createDataFrame([(f"Some WORD and {long}",), (None,)], "text string")
    names = ["x/someone", "x/wo/rd", "SWORDS", f"x{long}y", long[:-1], None, "", "x"]
    rows = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    assert sorted(r["page_id"] for r in filters.leakage_guard(rows, F.col("url"), bench, "text").collect()) == [1, 4, 5, 6, 7]
    assert filters.leakage_guard(rows, F.col("url"), bench.limit(0), "text").count() == len(names)


def test_leakage_guard_against_sql(spark):
    import duckdb

    from markgrid.catalog.registry import load, runner
    from markgrid.catalog.tables import BASE
    from tools.check import rows

    sf, con, q = "/root/testdata/sf0.001", duckdb.connect(), load()["leakage_guard"]
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, res = runner(q)(spark, sf), con.execute(q.sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in res.description], res.fetchall())
