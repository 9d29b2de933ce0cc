"""Literal inputs with literal answers."""

import math

from pyspark.sql import functions as F

from markgrid.functions import geom as G
from markgrid.functions import keys as K
from markgrid.functions import text as X
from markgrid.functions import vocab as V
from markgrid.operators.suppress import closed_rectangles

c = F.col


def run(spark, fn, values, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.select("i", fn(c("v")).alias("o")).orderBy("i").select("o").collect()]


def check(spark, fn, cases):
    got = run(spark, fn, [k for k, _ in cases])
    assert got == [v for _, v in cases]


def test_canonical_size(spark):
    check(spark, X.canonical_size, [
        ('12"', "round:12"), ('6"', "round:6"), (' 8" ', "round:8"), ('10.5"', "round:10.5"), ("10/10", "rect:10x10"), ("22X10", "rect:22x10"),
        ("22x10", "rect:22x10"), (" 14 / 12", "rect:14x12"), ("10.5/8", "rect:10.5x8"), ("", None), (None, None), ("12", None), ('24"X24"', None),
        ("abc", None), ("10/10/8", None), ('10.50"', "round:10.5"), ('10.0"', "round:10"), ('100"', "round:100")])


def test_display_size(spark):
    check(spark, X.display_size, [("round:12", '12"'), ("round:10.5", '10.5"'), ("rect:10x10", "10/10"), ("rect:22x10", "22/10"), ("", "")])


def test_size_and_flow(spark):
    check(spark, lambda v: F.concat_ws("|", X.size_and_flow(v)["size"], X.size_and_flow(v)["cfm"].cast("string")), [
        ("8x8/170", "rect:8x8|170"), ("8X8/200", "rect:8x8|200"), ("6/100", "round:6|100"), ("6/6", "rect:6x6"), ("10x10", "rect:10x10"),
        ('12"', "round:12"), ('6"x6"', "rect:6x6"), ("24x48", ""), ("1/900", ""), ("", "")])


def test_class_names(spark):
    check(spark, K.normalise_class, [
        ("FANS", "FAN"), ("Fan", "FAN"), ("LOUVERS", "LOUVER"), ("AD-LINEAR PLENUM", "AD-LINEAR PLENUM"), ('AD-LINEAR PLENUM 1" SLOT', "AD-LINEAR PLENUM"),
        ('AD-LINEAR SLOT DIFFUSER 1.5" SLOT', "AD-LINEAR SLOT DIFFUSER"), ("COMBINATION FIRE/SMOKE DAMPER", "FIRE SMOKE DAMPER"), ("ROOF CAP", "RAIN CAP"),
        ("AD-GRD", "AD-GRD"), ("DEHUMIDIFIER", "OTHER MECHANICAL"), (None, "")])


def test_thresholds(spark):
    check(spark, K.class_threshold, [("AD-GRD", 0.55), ("FAN", 0.30), ("FANS", 0.30), ("FIRE DAMPER", 0.25), ('AD-LINEAR PLENUM 1" SLOT', 0.40),
                                     ("SOMETHING NEW", 0.40), ("vav", 0.30)])


def test_tags(spark):
    check(spark, K.normalise_tag, [
        ("A-1", "A-1"), ("(E) EF-1", "EF-1"), ("VAV\n2", "VAV-2"), ("24 VAV", None), ("M101", None), ("M501-9", None), ("FP001", None),
        ("AC101", "AC101"), ("R-410A", None), ("RKF12AXVJU", None), ("NOTES: 1", None), ("VAV-N", "VAV-N"), ("USE-NT", None), ("TYP", None),
        ("1-2-3", None), ("P501-P502", None), ("A", "A"), ("", None), (None, None)])


def test_tag_cells(spark):
    check(spark, lambda v: F.array_join(K.expand_tag_cell(v), ","), [
        ("A-1", "A-1"), ("A, B, C", "A,B,C"), ("CU-1 thru CU-3", "CU-1,CU-2,CU-3"), ("24\nVAV\n27", "VAV-24,VAV-27"), ("CU-1\nCU-2", "CU-1,CU-2"),
        ("EF-2\nOACU-1", "EF-2,OACU-1"), ("AC-1,2", "AC-1,AC-2"), ("EF-10", "EF-10"), ("CU-9 TO CU-2", "CU-9-TO"), ("", "")])


def test_base_tags(spark):
    check(spark, K.base_tag, [("LD-1-PLENUM", "LD-1"), ("LD-1-SLOT DIFFUSER", "LD-1"), ("VAV-1A", "VAV-1A"), ("SG-1", "SG-1"), ("F-PLENUM", "F"), ("CD-1 (901-1000)", "CD-1")])


def test_class_of_tag(spark):
    check(spark, K.class_of_tag, [("EF-1", "EXHAUST FAN"), ("EUH-2", "HEATER"), ("S-1", "AD-T-BAR SUPPLY"), ("ZZ-1", None), ("OACU-1", "CONDENSING UNIT")])


def test_close_tags(spark):
    rows = [("A1", "A1", True), ("EF10", "EFIO", True), ("EF10", "EF2O", True), ("EF10", "EF22", False), ("EF1", "EF12", True), ("EF1", "EF123", False), ("ABC", "XBD", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(K.close_tags(c("a"), c("b")) != c("want")).count() == 0


def test_sheet_numbers(spark):
    check(spark, X.plan_by_sheet_number, [("M101", True), ("M1.1", True), ("M501", False), ("M5.2", False), ("M0.01", False), ("M-201", True), ("M-01", None), (None, None)])


def test_scale_and_dates(spark):
    check(spark, lambda v: X.parse_scale(v)["kind"], [('1/4" = 1\'-0"', "imperial"), ("SCALE 1:50", "metric"), ("NTS", "no_scale"), ("x", None)])
    check(spark, lambda v: X.parse_date(v).cast("string"), [("04/28/26", "2026-04-28"), ("04.28.1999", "1999-04-28"), ("01/02/85", "1985-01-02"), ("13/45/99", None), ("x", None)])


def test_arc(spark):
    df = spark.createDataFrame([(200.0, 100.0), (100.0, 0.0)], "ch double, ri double")
    got = df.select(*[v.alias(k) for k, v in G.arc(c("ch"), c("ri")).items()]).collect()
    assert abs(got[0]["radius"] - 100) < 1e-9 and abs(got[0]["arc_length"] - 100 * math.pi) < 1e-9
    assert got[1]["arc_length"] == 100.0 and got[1]["radius"] is None


def test_rectangle(spark):
    rows = [(1, 1, 0, 0, 0, 400, 20), (1, 1, 1, 0, 300, 400, 320), (1, 1, 2, 0, 0, 20, 320), (1, 1, 3, 380, 0, 400, 320)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, det_id long, x1 long, y1 long, x2 long, y2 long")
    assert [tuple(r) for r in closed_rectangles(df).collect()] == [(1, 1, 0, 1, 2, 3)]


def test_vocabulary_is_closed():
    assert set(V.CLASS_THRESHOLDS) >= {"FAN", "LOUVER"}
    assert all(isinstance(p, str) and t for p, t in V.CLASS_PATTERNS)
