"""Steps that must not grow faster than their input: how tables meet, and what is computed or written how often."""

from markgrid.operators import match as M
from markgrid.operators import spatial as SP
from markgrid.session import cut


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_never_broadcast(spark):
    """A file of points is small for what it holds, so its size must not decide on a broadcast."""
    side = lambda p: cut(spark.range(50).selectExpr("id % 3 as doc_id", f"id as {p}id", f"id * 1.0D as {p}_cx", f"id * 2.0D as {p}_cy"))
    left, right = side("l"), side("r")
    assert "BroadcastHashJoin" not in plan(SP.near(left, right, ["doc_id"], 10.0))
    boxes = cut(spark.range(50).selectExpr("id % 3 as doc_id", "1 as page_no", "id as det_id", "id as x1", "id as y1", "id + 4 as x2", "id + 4 as y2"))
    labels = cut(spark.range(50).selectExpr("id % 3 as doc_id", "1 as page_no", "id as label_id", "id * 1.0D as cx", "id * 1.0D as cy"))
    assert "BroadcastHashJoin" not in plan(M.assign_nearest(boxes, labels))


def test_one_label_file_an_image(spark, tmp_path):
    """The number of files follows the images, not the tasks that hold their lines."""
    from markgrid.sources import readers as R
    from markgrid.sources import writers as W

    n = spark.range(0, 400, 1, 8).selectExpr("'d' || (id % 5) as stem", "cast(id % 3 as int) as cid", "0.5D as ncx", "0.5D as ncy", "0.01D as nw", "0.02D as nh")
    W.label_lines(n, str(tmp_path / "labels"))
    assert len(list((tmp_path / "labels").glob("stem=*/*.txt"))) == 5
    assert R.label_files(spark, str(tmp_path / "labels")).count() == 400


def test_shared_inputs_are_written_once(spark):
    """Boxes and words that several steps read are not derived again for each of them."""
    from markgrid.catalog.tables import Tables
    from markgrid.plans import cascades as C

    t = Tables(spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" in plan(t.boxes)
    assert "l_extendedprice" not in plan(C.mark_notes(t.boxes, M.word_points(t.tokens)))


def test_runs_of_words_are_shuffled_once(spark):
    """Runs meet the points that ask for them in one join, without a semi-join that shuffles every run before."""
    points = cut(spark.createDataFrame([(0, 1, 7, "AB", 1.0, 1.0)], "doc_id int, page_no int, det_id int, want string, cx double, cy double"))
    words = cut(spark.createDataFrame([(0, 1, 1, 0, 0, "a", 0.0, 0.0), (0, 1, 2, 0, 1, "b", 9.0, 0.0)],
                                      "doc_id int, page_no int, word_id int, line_no int, word_no int, text string, x0 double, y0 double"))
    got = M.text_near_point(points, words, 50)
    assert "LeftSemi" not in plan(got)
    assert [(r.det_id, r.want, r.word_id, r.n_words) for r in got.collect()] == [(7, "AB", 1, 2)]


def test_index_is_grouped_once(spark):
    """Entries and sheets meet in one grouping by sheet, not in two anti-joins over both; nulls are never the same sheet."""
    from markgrid.operators import reconcile as RC

    index = spark.createDataFrame([(1, "M1", "Mechanical"), (1, "M1", "Electrical"), (1, "E2", "Electrical"), (1, "P3", "Plumbing"), (1, None, "Mechanical"), (2, "M1", "Mechanical"), (None, "M9", "Mechanical")],
                                  "doc_id long, sheet string, discipline string")
    present = spark.createDataFrame([(1, "M2", "Mechanical"), (1, None, "Electrical"), (1, "P3", "Unknown"), (1, "M2", "Unknown"), (2, "M1", "Unknown"), (None, "M9", "Mechanical")],
                                    "doc_id long, sheet string, discipline string")
    got = RC.index_completeness(index, present, ["doc_id"])
    assert "LeftAnti" not in plan(got)
    want = [(None, "M9", "unlisted"), (1, None, "missing"), (1, None, "unlisted"), (1, "E2", "missing"), (1, "M1", "missing"), (1, "M2", "unlisted")]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_texts_are_matched_once(spark, monkeypatch):
    """A cascade matches different texts, however many rows carry them, and rows learn the match by one join."""
    from markgrid.operators import inside as I
    from markgrid.operators import reconcile as RC

    sizes = []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(RC, "cut", counted)
    monkeypatch.setattr(I, "cut", counted)
    texts = spark.range(400).selectExpr("1L as doc_id", "id as word_id", "array('P-1', 'P-1/x', 'xP1y', 'TYP', '-', null)[cast(id % 6 as int)] as text")
    tags = spark.createDataFrame([(1, "P-1"), (1, "P1"), (2, "TYP")], "doc_id long, tag string")
    got = RC.match_cascade(texts, tags, ["doc_id"], "word_id").collect()
    assert max(sizes) <= 5
    want = {0: "exact", 1: "prefix", 2: "fuzzy"}
    assert {(r.word_id, r.match, r.strength) for r in got} == {(i, "P-1", want[i % 6]) for i in range(400) if i % 6 in want} and len(got) == 201


def test_nearest_scheduled_word_is_aggregated(spark):
    """The nearest tag word of a box is a minimum over pairs, which tasks reduce before the shuffle, not a rank of all pairs."""
    from markgrid.plans import cascades as C

    boxes = cut(spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_no long, det_id long, x1 double, y1 double, x2 double, y2 double"))
    words = cut(spark.createDataFrame([(1, 1, k, x, 5.0 + 10 * k, 5.0, 90) for k, x in enumerate(("TYP", "P-2", "P-1"))], "doc_id long, page_no long, word_id long, text string, cx double, cy double, ocr_pct int"))
    schedule = cut(spark.createDataFrame([(1, "P-1", '8"'), (1, "P-2", '6"')], "doc_id long, tag string, size string"))
    got = C.schedule_size(boxes, words, schedule)
    assert "Window" not in plan(got)
    assert [(r.det_id, r.tag, r.size) for r in got.collect()] == [(7, "P-2", '6"')]


def test_tag_table_meets_in_one_shuffle(spark):
    """The branches of the tag table are windows over rows of one shuffle, not joins of each with each; nulls meet nothing."""
    from markgrid.operators import reconcile as RC

    bom = cut(spark.createDataFrame([(1, "p1", "8", 2, 1), (1, "P2", "", 1, 0), (None, "P9", "8", 1, 0), (1, None, "8", 1, 0)], "doc_id long, tag string, neck string, qty long, cfm_missing long"))
    boxes = cut(spark.createDataFrame([(1, "B", "P1", "8", 1, 90), (1, "A", "P1", "6", 1, 80), (1, "B", "P1", "6", 1, 70), (1, "A", "P2", "", 2, 60), (1, "A", None, "", 1, 50), (1, "C", "P3", None, 1, 40), (1, "C", "P4", "5", 0, 40)],
                                      "doc_id long, cls string, tag string, neck string, units int, conf int"))
    sched = cut(spark.createDataFrame([(1, "P1", "8"), (1, "P5", "4"), (1, "P4", None), (1, None, "3")], "doc_id long, tag string, neck string"))
    got = RC.tag_table(bom, boxes, sched, ["doc_id"])
    assert plan(got).count("Exchange") <= 4
    rows = sorted(((r.doc_id, r.tag, r.cls, r.neck, r.plan_qty, r.box_qty, r.source, r.discrepancy, r.conf) for r in got.collect()), key=str)
    want = [(1, "P1", "", "8", 2, 1, "plan", "plan=2 vs boxes=3; 1 without flow", 90), (1, "P2", "", "", 1, 2, "plan", "plan=1 vs boxes=2; tag not in schedule", 0),
            (None, "P9", "", "8", 1, 0, "plan", "tag not in schedule", 0), (1, None, "", "8", 1, 0, "plan", "", 0), (1, "P1", "A", "6", 0, 1, "bucket", "", 80),
            (1, "P3", "C", "", 0, 1, "boxes", "no neck size found", 0), (1, "", "A", "", 0, 1, "untagged", "untagged", 0),
            (1, "P5", "", "4", 0, 0, "schedule-only", "scheduled but no detection", 0), (1, "P4", "", "", 0, 0, "schedule-only", "scheduled but no detection", 0), (1, None, "", "3", 0, 0, "schedule-only", "scheduled but no detection", 0)]
    assert rows == sorted(want, key=str)


def test_words_are_read_once(spark):
    """Marks, sizes and flows are read from a word when it is written, not by each step that asks for them."""
    from markgrid.plans import cascades as C

    words = spark.createDataFrame([(1, 1, 1, "P-12", 0.0, 5.0, 5.0, 0.0, 10.0), (1, 1, 2, '8"', 20.0, 25.0, 5.0, 0.0, 10.0)], "doc_id long, page_no long, word_id long, text string, x0 double, cx double, cy double, y0 double, y1 double")
    got = C.label_instances(words)
    assert "[A-Z]{1,3}" not in plan(got)
    assert [(r.mark, r.size, r.method) for r in got.collect()] == [("P-12", "round:8", "bare_mark")]


def test_sizes_are_looked_for_behind_a_digit(spark, monkeypatch):
    """Words that begin with no digit are no size; bare marks read each word once, when it is written."""
    from markgrid.functions import text as X
    from markgrid.functions import vocab as V
    from markgrid.plans import cascades as C

    words = spark.createDataFrame([(1, 1, k, x, 10.0 * k, 10.0 * k, 5.0) for k, x in enumerate(("SG-1", '"8x6', "\t6/100", "TYP", None, "EF-1", '10"'))], "doc_id long, page_no long, word_id long, text string, x0 double, cx double, cy double")
    read = {r.word_id: r._s and tuple(r._s) for r in words.select("word_id", X.size_and_flow(words.text).alias("_s")).collect()}
    assert read == {0: None, 1: ("rect:8x6", None), 2: None, 3: None, 4: None, 5: None, 6: ("round:10", None)}
    listed = spark.createDataFrame([(1, "SG-1")], "doc_id long, mark string")
    written = []
    monkeypatch.setattr(C, "cut", lambda df: written.append(plan(df)) or cut(df))
    got = C.bare_marks(words, listed)
    assert V.BARE_MARK in written[0] and not any(V.BARE_MARK in p for p in written[1:])
    assert [(r.mark, r.size) for r in got.collect()] == [("SG-1", "rect:8x6")]
