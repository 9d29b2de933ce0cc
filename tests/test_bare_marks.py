"""Marks that stand alone: whitelist, letters, equipment, sizes with flows, nulls."""

from markgrid.operators import match as M
from markgrid.plans import cascades as C


def test_bare_marks(spark):
    at = [
        (1, 1, "SG-1", 0.0, 0.0), (1, 2, "8x8/170", 40.0, 0.0), (1, 3, "SG-2", 0.0, 300.0), (1, 4, "cd", 0.2, 600.0), (1, 5, "CD", 0.4, 900.0),
        (1, 6, "CD", 500.0, 600.0), (1, 7, '12"', 510.0, 640.0), (1, 8, "AC", 800.0, 0.0), (1, 9, None, 900.0, 0.0),
        (2, 1, "S1", 0.0, 0.0), (2, 2, "EF-1", 200.0, 0.0), (2, 3, "SG-1-RETURN AIR", 400.0, 0.0), (2, 4, "6/100", 440.0, 0.0), (2, 5, "CD", 600.0, 0.0),
        (2, 6, '90"', 20.0, 0.0), (2, 7, "SG-1234", 700.0, 0.0),
    ]
    words = spark.createDataFrame([(d, 1, w, x, a, b, a + 20, b + 10) for d, w, x, a, b in at],
                                  "doc_id long, page_no long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    listed = spark.createDataFrame([(1, "SG-1"), (1, "SG-1"), (1, "CD"), (1, "AC"), (1, None)], "doc_id long, mark string")
    got = sorted((r.doc_id, r.word_id, r.mark, r.size, r.cfm, r.method, r.confidence) for r in C.bare_marks(M.word_points(words), listed).collect())
    assert [g[:4] + g[4:5] for g in got] == [
        (1, 1, "SG-1", "rect:8x8", 170), (1, 4, "CD", None, None), (1, 6, "CD", "round:12", None),
        (2, 1, "S1", None, None), (2, 3, "SG-1", "round:6", 100)]
    assert [(g[5], g[6]) for g in got] == [("bare_mark", 0.75), ("letter_only_mark_no_size", 0.55), ("letter_only_mark", 0.70), ("bare_mark_no_size", 0.30), ("bare_mark", 0.75)]
    assert C.bare_marks(M.word_points(words.limit(0)), listed).collect() == []
    assert {r.mark for r in C.bare_marks(M.word_points(words.where("doc_id = 1")), listed.limit(0)).collect()} == {"SG-1", "SG-2"}
