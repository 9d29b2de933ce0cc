"""Matching of positioned rows: boxes with labels, boxes with boxes, values with bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions.geom import distance, with_center
from markgrid.functions.keys import alias_set, read_as, scalar_alias
from markgrid.operators.kernels import mutual_best, serial_choice
from markgrid.operators.spatial import near, near_radius, nearest, overlap_pairs, prefixed
from markgrid.session import cut, settings

c = F.col
PAGE = ["doc_id", "page_no"]


def word_points(words: DataFrame) -> DataFrame:
    """Centres of words given x0, y0, x1, y1."""
    return words.withColumns({"cx": (c("x0") + c("x1")) / 2, "cy": (c("y0") + c("y1")) / 2})


def _points(df: DataFrame, p: str, keys: list[str], keep: list[str]) -> DataFrame:
    return prefixed(df.select(*keys, *dict.fromkeys([*keep, "cx", "cy"])), p, keys)


def assign_nearest(boxes: DataFrame, labels: DataFrame, keys=PAGE, cap: float | None = None) -> DataFrame:
    """Nearest label of every box; UNASSIGNED beyond ``cap``, null where the page has no label."""
    lp, rp = _points(with_center(boxes), "l_", keys, ["det_id"]), _points(labels, "r_", keys, ["label_id"])
    hit = nearest(lp, rp, keys, "l_det_id", "r_label_id", cap=cap)
    out = boxes.join(hit.withColumnRenamed("l_det_id", "det_id").hint("merge"), [*keys, "det_id"], "left").withColumnRenamed("r_label_id", "label_id")
    if cap is None:
        return out
    has = labels.select(*keys).distinct().withColumn("_has", F.lit(True))
    state = F.when(c("label_id").isNotNull(), "ASSIGNED").when(c("_has"), "UNASSIGNED")
    return out.join(has, keys, "left").withColumn("state", state).drop("_has")


def note_to_box(notes: DataFrame, boxes: DataFrame, radius: float, keys=PAGE) -> DataFrame:
    """Each note marks its nearest box within the radius; of several notes on a box the first counts.

    ``notes``: keys, note_id, cx, cy.
    """
    lp, rp = _points(notes, "l_", keys, ["note_id"]), _points(with_center(boxes), "r_", keys, ["det_id"])
    hit = nearest(lp, rp, keys, "l_note_id", "r_det_id", cap=radius)
    return hit.groupBy(*keys, c("r_det_id").alias("det_id")).agg(F.min("l_note_id").alias("note_id"))


def near_any(boxes: DataFrame, points: DataFrame, window: float, keys=PAGE) -> DataFrame:
    """Flag of boxes with any point closer than ``window`` on both axes."""
    lp, rp = _points(points.distinct(), "l_", keys, []), _points(with_center(boxes), "r_", keys, ["det_id"])
    p = near(lp, rp, keys, window, cell=4).where((F.abs(c("l_cx") - c("r_cx")) < window) & (F.abs(c("l_cy") - c("r_cy")) < window))
    hit = p.select(*keys, c("r_det_id").alias("det_id")).distinct().withColumn("flag", F.lit(True))
    return boxes.join(hit, [*keys, "det_id"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def with_context(targets: DataFrame, others: DataFrame, min_iou: float, closer: float, keys=PAGE) -> DataFrame:
    """Flag of targets that overlap some other box (IoU above) or lie nearer than ``closer`` to one."""
    from markgrid.operators.spatial import touching_pairs

    lp = _points(with_center(targets), "l_", keys, ["det_id"])
    rp = _points(with_center(others), "r_", keys, ["det_id"])
    by_dist = near_radius(lp, rp, keys, closer, cell=4).where(c("dist") < closer).select(*keys, c("l_det_id").alias("det_id"))
    a = targets.select(*keys, "det_id", "x1", "y1", "x2", "y2")
    b = others.select(*keys, "det_id", "x1", "y1", "x2", "y2")
    from markgrid.functions.geom import iou

    by_iou = touching_pairs(a, b, keys, 0, 512).where(iou("a_", "b_") > min_iou).select(*keys, c("a_det_id").alias("det_id"))
    hit = by_dist.unionByName(by_iou).distinct().withColumn("flag", F.lit(True))
    return targets.join(hit, [*keys, "det_id"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def nearby_words(boxes: DataFrame, words: DataFrame, radius: float, keys=PAGE, keep: list[str] | None = None) -> DataFrame:
    """All words within the radius of a box centre: keys, det_id, word_id, text, dist, confidence."""
    cols = ["word_id", "text", *(keep or [])]
    lp = _points(with_center(boxes), "l_", keys, ["det_id"])
    p = near_radius(lp, _points(words, "r_", keys, cols), keys, radius, cell=4)
    return p.select(*keys, c("l_det_id").alias("det_id"), *[c("r_" + x).alias(x) for x in cols], "dist").withColumn(
        "confidence", 1 - c("dist") / radius)


def nearest_words(pairs: DataFrame, k: int | None = None, keys=PAGE) -> DataFrame:
    """The words of each box ranked by distance; the k closest if k is given."""
    w = Window.partitionBy(*keys, "det_id").orderBy("dist", "word_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(c("rank") <= k)


def nearest_word(boxes: DataFrame, words: DataFrame, radius: float, keep: list[str], keys=PAGE) -> DataFrame:
    """The closest word within the radius of each box centre (ties to the lower id): keys, det_id, word_id, text, dist and ``keep``.

    The words are copied over cells, so they should be the fewer.
    """
    cols = ["word_id", "text", *keep]
    p = near_radius(_points(words, "r_", keys, cols), _points(with_center(boxes), "l_", keys, ["det_id"]), keys, radius, ("r_cx", "r_cy"), ("l_cx", "l_cy"), cell=4)
    g = p.groupBy(*keys, c("l_det_id").alias("det_id")).agg(F.min(F.struct("dist", *["r_" + x for x in cols])).alias("_hit"))
    return g.select(*keys, "det_id", *[c("_hit.r_" + x).alias(x) for x in cols], "_hit.dist")


def best_and_alternatives(pairs: DataFrame, k: int = 3, keys=PAGE) -> DataFrame:
    """Best word of each box with up to ``k`` runners-up, in order."""
    top = nearest_words(pairs, k + 1, keys)
    return top.groupBy(*keys, "det_id").agg(
        F.min(F.when(c("rank") == 1, c("text"))).alias("text"), F.min("dist").alias("dist"), F.max("confidence").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.when(c("rank") > 1, F.struct("rank", "text")))), lambda s: s["text"]).alias("alternatives"))


def closest_valid_tag(boxes: DataFrame, tagged: DataFrame, schedule: DataFrame, radius: float, keys=PAGE, doc=("doc_id",)) -> DataFrame:
    """Closest word that names a tag of the box's class, or of its single alias where the schedule lacks the class.

    Classes of one tag are left to direct assignment. ``boxes``: cls; ``tagged``: word_id, tag, cx, cy; ``schedule``: cls, tag.
    """
    tags = schedule.select(*doc, "cls", "tag").distinct()
    per = tags.groupBy(*doc, "cls").agg(F.count("*").alias("_n"))
    want = boxes.select(*doc, "cls").distinct().withColumn("_alias", scalar_alias(c("cls")))
    own, other = per.select(*doc, "cls", c("_n").alias("_own")), per.select(*doc, c("cls").alias("_alias"), c("_n").alias("_other"))
    as_ = want.join(own, [*doc, "cls"], "left").join(other, [*doc, "_alias"], "left").where(F.coalesce("_own", "_other") >= 2)
    as_ = as_.select(*doc, "cls", F.when(c("_own").isNotNull(), c("cls")).otherwise(c("_alias")).alias("_as"))
    on = [*keys, "_as"]
    lp = _points(with_center(boxes).join(as_, [*doc, "cls"]), "l_", on, ["det_id"])
    rp = _points(tagged.join(tags.withColumnRenamed("cls", "_as"), [*doc, "tag"]), "r_", on, ["word_id", "tag"])
    hit = near_radius(lp, rp, on, radius, cell=4).groupBy(*keys, c("l_det_id").alias("det_id")).agg(F.min(F.struct("dist", "r_word_id", "r_tag")).alias("_hit"))
    return hit.select(*keys, "det_id", c("_hit.r_tag").alias("tag"), (1 - c("_hit.dist") / radius).alias("confidence"))


def closest_pairs(left: DataFrame, right: DataFrame, radius: float, lid: str, rid: str, keys=PAGE) -> DataFrame:
    """1:1 pairs, closest first, within the radius."""
    p = near_radius(_points(left, "l_", keys, [lid]), _points(right, "r_", keys, [rid]), keys, radius)
    e = p.select(*keys, c("l_" + lid).alias("l"), c("r_" + rid).alias("r"), "dist")
    return mutual_best(e, keys, ["dist"]).withColumnRenamed("l", lid).withColumnRenamed("r", rid)


def tokens_of(text: Column) -> Column:
    """Digit-bearing tokens of a value, upper case, edges trimmed."""
    clean = F.regexp_replace(F.upper(F.trim(text)), "[\"']", "")
    parts = F.transform(F.split(clean, r"[\s/,]+"), lambda p: F.regexp_replace(p, r"^[.()]+|[.()]+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & p.rlike(r"\d")))


def fingerprints(values: DataFrame, keys: list[str], at_most: int = 2) -> DataFrame:
    """Tokens of schedule values that at most ``at_most`` tags of a document share."""
    from markgrid.functions import vocab as V

    clean = F.upper(F.trim(F.regexp_replace("value", "[\"']", "")))
    t = cut(values.where(~clean.isin(V.GENERIC_VALUES)).select(*keys, "cls", "tag", F.explode(tokens_of(c("value"))).alias("token")).distinct())
    n = t.groupBy(*keys, "token").agg(F.countDistinct("tag").alias("n_tags")).where(c("n_tags") <= at_most)
    return t.join(n, [*keys, "token"], "left_semi")


def fingerprint_match(boxes: DataFrame, words: DataFrame, prints: DataFrame, radius: float, doc=("doc_id",), keys=PAGE) -> DataFrame:
    """1:1 per page, box to tag of its class, most shared tokens first (ties to lower box, then tag)."""
    # tokens and classes meet by equality before points do; words that hold a print are the few, so they are copied
    on = [*keys, "cls"]
    held = words.select(*keys, "cx", "cy", F.explode(tokens_of(c("text"))).alias("token")).join(prints.select(*doc, "cls", "tag", "token"), [*doc, "token"])
    near_tok = near_radius(_points(held, "l_", on, ["tag", "token"]), _points(with_center(boxes), "r_", on, ["det_id"]), on, radius, cell=8)
    j = near_tok.select(*keys, c("r_det_id").alias("det_id"), c("l_tag").alias("tag"), c("l_token").alias("token")).distinct()
    s = j.groupBy(*keys, "det_id", "tag").agg(F.count("*").alias("score"))
    e = s.select(*keys, c("det_id").alias("l"), c("tag").alias("r"), (-c("score")).alias("neg"))
    return mutual_best(e, keys, ["neg"]).select(*keys, c("l").alias("det_id"), c("r").alias("tag"), (-c("neg")).alias("score"))


def revision_diff(old: DataFrame, new: DataFrame, same: float = 0.5, moved: float = 0.1, keys=PAGE) -> DataFrame:
    """Old boxes in id order each take the free new box of best IoU.

    unchanged or moved above ``same`` (by class: else relabeled), moved between the bounds; a class
    change at marginal overlap is a removal and leaves the new box free. Unclaimed new boxes are added.
    """
    cols = ["det_id", "cls", "x1", "y1", "x2", "y2"]
    p = overlap_pairs(old.select(*keys, *cols), new.select(*keys, *cols), keys, moved)
    alike, strong = c("a_cls") == c("b_cls"), c("iou") >= same
    e = p.select(*keys, c("a_det_id").alias("l"), c("b_det_id").alias("r"), c("a_det_id").alias("turn"), (-c("iou")).alias("neg"),
                 (alike | strong).alias("takes"), alike.alias("alike"), strong.alias("strong"))
    return _label_diff(serial_choice(e, keys, ["turn"], ["neg", "r", "alike", "strong"], "takes"), old, new, keys)


def _label_diff(won: DataFrame, old: DataFrame, new: DataFrame, keys) -> DataFrame:
    status = F.when(~c("takes"), "removed").when(c("strong") & c("alike"), "unchanged").when(c("strong"), "relabeled").otherwise("moved")
    hit = won.select(*keys, c("l").alias("det_id"), F.when(c("takes"), c("r")).alias("new_id"), status.alias("status"))
    olds = old.select(*keys, "det_id").join(hit, [*keys, "det_id"], "left").withColumn("status", F.coalesce("status", F.lit("removed")))
    used = hit.where("new_id is not null").select(*keys, c("new_id").alias("det_id"))
    added = new.select(*keys, "det_id").join(used, [*keys, "det_id"], "left_anti").select(
        *keys, F.lit(None).cast("bigint").alias("det_id"), c("det_id").alias("new_id"), F.lit("added").alias("status"))
    return olds.unionByName(added)


def match_in_order(left: DataFrame, right: DataFrame, min_iou: float, keys=PAGE, same_class: bool = False) -> DataFrame:
    """Left boxes in id order each take the free right box of best IoU: keys, l, r, l_cls, r_cls, iou."""
    cols = ["det_id", "cls", "x1", "y1", "x2", "y2"]
    p = overlap_pairs(left.select(*keys, *cols), right.select(*keys, *cols), keys, min_iou)
    if same_class:
        p = p.where("a_cls = b_cls")
    e = p.select(*keys, c("a_det_id").alias("l"), c("b_det_id").alias("r"), c("a_det_id").alias("turn"), (-c("iou")).alias("neg"),
                 c("a_cls").alias("l_cls"), c("b_cls").alias("r_cls"))
    won = serial_choice(e, keys, ["turn"], ["neg", "r", "l_cls", "r_cls"])
    return won.select(*keys, "l", "r", "l_cls", "r_cls", (-c("neg")).alias("iou"))


def outcomes(truth: DataFrame, pred: DataFrame, matches: DataFrame, keys=PAGE) -> DataFrame:
    """One row per truth box and per unmatched prediction: truth_cls, pred_cls (null where absent).

    ``matches`` has truth on the left.
    """
    hit = matches.select(*keys, c("l").alias("det_id"), c("r").alias("pred_id"), c("r_cls").alias("pred_cls"))
    t = truth.select(*keys, "det_id", c("cls").alias("truth_cls")).join(hit, [*keys, "det_id"], "left").select(*keys, "truth_cls", "pred_cls")
    free = pred.select(*keys, "det_id", "cls").join(matches.select(*keys, c("r").alias("det_id")), [*keys, "det_id"], "left_anti")
    return t.unionByName(free.select(*keys, F.lit(None).cast("string").alias("truth_cls"), c("cls").alias("pred_cls")))


def review_diff(pred: DataFrame, truth: DataFrame, reviewed: DataFrame, min_iou: float = 0.4, keys=PAGE) -> DataFrame:
    """Predictions on reviewed pages: accepted, relabeled or deleted; unclaimed truth is added."""
    cols = [*keys, "det_id", "cls", "x1", "y1", "x2", "y2"]
    reviewed = cut(reviewed.select(*keys).distinct())
    # written once: each side is read for its size levels, for the pairs and for what stays alone
    pred, truth = (cut(d.select(*cols).join(reviewed, keys, "left_semi")) for d in (pred, truth))
    m = match_in_order(pred, truth, min_iou, keys)
    hit = m.select(*keys, c("l").alias("det_id"), "r_cls", "l_cls", "r")
    p = pred.select(*keys, "det_id").join(hit, [*keys, "det_id"], "left")
    status = F.when(c("r").isNull(), "deleted").when(c("l_cls") == c("r_cls"), "accepted").otherwise("relabeled")
    added = truth.select(*keys, "det_id").join(m.select(*keys, c("r").alias("det_id")), [*keys, "det_id"], "left_anti")
    return p.select(*keys, "det_id", status.alias("status")).unionByName(added.select(*keys, "det_id", F.lit("added").alias("status")))


def first_within(left: DataFrame, right: DataFrame, radius: float, lid: str, rid: str, keys=PAGE) -> DataFrame:
    """Left rows in id order each take the free right row with the lowest id within the radius."""
    p = near_radius(_points(left, "l_", keys, [lid]), _points(right, "r_", keys, [rid]), keys, radius)
    e = p.select(*keys, c("l_" + lid).alias("l"), c("r_" + rid).alias("r"), c("l_" + lid).alias("turn"), "dist")
    return serial_choice(e, keys, ["turn"], ["r", "dist"]).select(*keys, c("l").alias(lid), c("r").alias(rid), "dist")


def size_edges(marks: DataFrame, sizes: DataFrame, keys=PAGE, line_dy=15.0, line_dx=120.0, below_dy=50.0, below_dx=40.0) -> DataFrame:
    """Feasible mark-size pairs: wide on the same line, narrow below; cost is the distance."""
    p = near(_points(marks, "l_", keys, ["mark_id"]), _points(sizes, "r_", keys, ["size_id"]), keys, max(line_dx, below_dx), max(line_dy, below_dy), cell=4)
    dx, dy = F.abs(c("l_cx") - c("r_cx")), F.abs(c("l_cy") - c("r_cy"))
    ok = F.when(dy <= line_dy, dx <= line_dx).otherwise((dy <= below_dy) & (dx <= below_dx))
    cost = distance(c("l_cx"), c("l_cy"), c("r_cx"), c("r_cy"))
    return p.where(ok).select(*keys, c("l_mark_id").alias("l"), c("r_size_id").alias("r"), cost.alias("cost"))


def pair_sizes_greedy(edges: DataFrame, keys=PAGE) -> DataFrame:
    """Marks choose in order of their cheapest pair, each the cheapest free size."""
    low = edges.groupBy(*keys, "l").agg(F.min("cost").alias("turn"))
    return serial_choice(edges.join(low, [*keys, "l"]), keys, ["turn"], ["cost", "r"])


def flow_below(anchors: DataFrame, numbers: DataFrame, drop: float = 40.0, dx: float = 30.0, keys=PAGE) -> DataFrame:
    """Anchors in id order each take the nearest free number starting just below them.

    ``anchors``: keys, anchor_id, cx, bottom; ``numbers``: keys, word_id, cx, top.
    """
    a = prefixed(anchors.select(*keys, "anchor_id", "cx", (c("bottom") + drop / 2).alias("cy"), "bottom"), "l_", keys)
    n = prefixed(numbers.select(*keys, "word_id", "cx", c("top").alias("cy")), "r_", keys)
    p = near(a, n, keys, dx, drop / 2)
    d2 = (c("r_cx") - c("l_cx")) * (c("r_cx") - c("l_cx")) + (c("r_cy") - c("l_bottom")) * (c("r_cy") - c("l_bottom"))
    e = p.select(*keys, c("l_anchor_id").alias("l"), c("r_word_id").alias("r"), c("l_anchor_id").alias("turn"), d2.alias("d2"))
    return serial_choice(e, keys, ["turn"], ["d2", "r"]).select(*keys, c("l").alias("anchor_id"), c("r").alias("word_id"), "d2")


def stacked_callouts(words: DataFrame, prefixes: list[str], tags: DataFrame, dx: float = 12.0, doc=("doc_id",), keys=PAGE) -> DataFrame:
    """A prefix word with a number right below it is a tag, if the schedule lists it.

    Of several numbers under a prefix the first in word order counts. ``words`` carry x0..y1.
    """
    w = word_points(words).select(*keys, "word_id", "text", "cx", "y0", "y1")
    u = F.regexp_replace(F.upper(F.trim("text")), "[-,]", "")
    # prefixes and numbers are written once: they are read for the levels and on both sides of the join
    w = cut(w.where(u.isin(prefixes) | F.trim("text").rlike(r"^\d{1,3}$")))
    heads = w.withColumn("text", u).where(c("text").isin(prefixes)).withColumn("h", F.greatest(c("y1") - c("y0"), F.lit(6.0)))
    nums = w.withColumn("text", F.trim("text")).where(c("text").rlike(r"^\d{1,3}$"))
    # the number is at most one and a half heights below, so words meet in cells of the prefix's own height level
    level = F.ceil(F.log2(c("h").cast("double"))).cast("int")
    heads = heads.withColumn("_lv", level)
    levels = sorted(r[0] for r in heads.select("_lv").distinct().collect() if r[0] is not None)
    side = F.pow(F.lit(2.0), c("_lv")) * 1.5
    nums = nums.withColumn("_lv", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    heads = heads.withColumn("_cy", F.explode(F.array(F.floor(c("y0") / side), F.floor(c("y0") / side) + 1)))
    nums = nums.withColumn("_cy", F.floor(c("y0") / side))
    cell = [*keys, "_lv", "_cy"]
    heads = heads.withColumn("_cx", F.explode(F.sequence(F.floor((c("cx") - dx) / (2 * dx)), F.floor((c("cx") + dx) / (2 * dx)))))
    nums = nums.withColumn("_cx", F.floor(c("cx") / (2 * dx)))
    cell.append("_cx")
    p = prefixed(heads, "l_", cell).join(prefixed(nums, "r_", cell), cell)
    dy = c("r_y0") - c("l_y0")
    p = p.where((F.abs(c("l_cx") - c("r_cx")) < dx) & (dy > c("l_h") * 0.3) & (dy < c("l_h") * 1.5))
    p = p.withColumn("tag", F.concat("l_text", F.lit("-"), "r_text")).join(tags.select(*doc, "tag").distinct(), [*doc, "tag"], "left_semi")
    row = F.min_by(F.struct("tag", ((c("l_y0") + c("r_y1")) / 2).alias("cy")), "r_word_id").alias("_hit")
    return p.groupBy(*keys, c("l_word_id").alias("word_id"), c("l_cx").alias("cx")).agg(row).select(*keys, "word_id", "cx", "_hit.tag", "_hit.cy")


def callouts_to_boxes(callouts: DataFrame, boxes: DataFrame, radius: float, keys=PAGE, half: float = 20.0) -> DataFrame:
    """Callouts in order each tag the nearest free untagged box of a compatible class; the rest become
    boxes of their own. ``callouts``: word_id, tag, cls, cx, cy; result rows say ``synthetic``."""
    co = prefixed(callouts.select(*keys, "word_id", "tag", "cls", "cx", "cy"), "l_", keys)
    bx = prefixed(with_center(boxes.where("tag is null")).select(*keys, "det_id", "cls", "cx", "cy"), "r_", keys)
    fits = F.array_contains(alias_set(c("r_cls")), c("l_cls"))
    p = near_radius(co, bx, keys, radius).where(fits)
    e = p.select(*keys, c("l_word_id").alias("l"), c("r_det_id").alias("r"), c("l_word_id").alias("turn"), "dist")
    won = serial_choice(e, keys, ["turn"], ["dist", "r"])
    real = won.select(*keys, c("l").alias("word_id"), c("r").alias("det_id")).join(callouts.select(*keys, "word_id", "tag"), [*keys, "word_id"])
    real = real.select(*keys, "word_id", "tag", "det_id", F.lit(False).alias("synthetic"),
                       *[F.lit(None).cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")])
    lone = callouts.join(won.select(*keys, c("l").alias("word_id")), [*keys, "word_id"], "left_anti")
    made = lone.select(*keys, "word_id", "tag", F.lit(None).cast("bigint").alias("det_id"), F.lit(True).alias("synthetic"),
                       (c("cx") - half).cast("double").alias("x1"), (c("cy") - half).cast("double").alias("y1"),
                       (c("cx") + half).cast("double").alias("x2"), (c("cy") + half).cast("double").alias("y2"))
    return real.unionByName(made)


def merged_pairs(words: DataFrame, longest: int, dx: float, dy: float, keys=PAGE) -> DataFrame:
    """Short neighbouring texts joined both ways (a-b and b-a), placed halfway between them."""
    short = words.where(F.length("text") <= longest).select(*keys, "word_id", "text", "cx", "cy")
    p = near(prefixed(short, "l_", keys), prefixed(short, "r_", keys), keys, dx, dy).where("l_word_id < r_word_id")
    both = F.array(F.struct(F.lit(0).alias("ord"), F.concat("l_text", F.lit("-"), "r_text").alias("text")),
                   F.struct(F.lit(1).alias("ord"), F.concat("r_text", F.lit("-"), "l_text").alias("text")))
    return p.select(*keys, c("l_word_id").alias("first_id"), c("r_word_id").alias("second_id"), F.explode(both).alias("m"),
                    ((c("l_cx") + c("r_cx")) / 2).alias("cx"), ((c("l_cy") + c("r_cy")) / 2).alias("cy")).select("*", "m.ord", "m.text").drop("m")


def longest_near_tag(boxes: DataFrame, matched: DataFrame, reach: float, bonus: float = 80.0, keys=PAGE) -> DataFrame:
    """Tag by distance less a bonus per matched character; the tag's class replaces the box class.

    ``matched``: keys, word_id, cx, cy, tag, tag_cls, matched_len.
    """
    # classes meet by equality before points do; words that name a tag are the few, so they are copied and not the boxes
    on = [*keys, "_as"]
    lp = _points(with_center(boxes).withColumn("_as", c("cls")), "l_", on, ["det_id", "cls"])
    rp = _points(matched.withColumn("_as", F.explode(read_as(c("tag_cls")))), "r_", on, ["word_id", "tag", "tag_cls", "matched_len"])
    p = near_radius(rp, lp, on, reach, lxy=("r_cx", "r_cy"), rxy=("l_cx", "l_cy"), cell=4)
    score = c("dist") - bonus * c("r_matched_len")
    row = F.min(F.struct(score.alias("score"), "r_word_id", "r_tag", "r_tag_cls", "dist")).alias("_hit")
    g = p.groupBy(*keys, c("l_det_id").alias("det_id"), c("l_cls").alias("cls")).agg(row)
    return g.select(*keys, "det_id", "cls", c("_hit.r_tag").alias("tag"), c("_hit.r_tag_cls").alias("new_cls"),
                    (1 - F.least(c("_hit.dist") / reach, F.lit(1.0))).alias("confidence"))


def shape_guided(boxes: DataFrame, sizes: DataFrame, reach: float, keys=PAGE, high: float = 70.0, med: float = 130.0) -> DataFrame:
    """Nearest size, unless a size of the expected shape is within 1.6 of that distance plus 25.

    ``boxes`` carry want (rect, round or null); ``sizes``: word_id, size, shape, cx, cy.
    """
    lp = _points(with_center(boxes), "l_", keys, ["det_id", "want"])
    p = near_radius(lp, _points(sizes, "r_", keys, ["word_id", "size", "shape"]), keys, reach)
    pick = F.struct("dist", "r_word_id", "r_size", "r_shape")
    g = p.groupBy(*keys, c("l_det_id").alias("det_id"), c("l_want").alias("want")).agg(
        F.min(pick).alias("any"), F.min(F.when(c("r_shape") == c("l_want"), pick)).alias("fit"))
    use = c("fit").isNotNull() & (c("fit.dist") <= c("any.dist") * 1.6 + 25)
    g = g.withColumn("hit", F.when(use, c("fit")).otherwise(c("any")))
    fits = c("want").isNull() | (c("hit.r_shape") == c("want"))
    tier = F.when(fits & (c("hit.dist") <= high), "HIGH").when(c("hit.dist") <= med, "MEDIUM").otherwise("LOW")
    return g.select(*keys, "det_id", c("hit.r_size").alias("size"), c("hit.dist").alias("dist"), tier.alias("tier"))


def value_of_label(labels: DataFrame, words: DataFrame, up: float, align: float, right: float, base: float, keys=PAGE) -> DataFrame:
    """Value of a printed label: the nearest word above and aligned with it, else right of it on its line.

    ``labels`` and ``words``: keys, word_id, x0, y0, text.
    """
    cols = ["word_id", "text", "x0", "y0"]
    lp, rp = prefixed(labels.select(*keys, *cols), "l_", keys), prefixed(words.select(*keys, *cols), "r_", keys)
    xy = dict(lxy=("l_x0", "l_y0"), rxy=("r_x0", "r_y0"))
    above = near(lp, rp, keys, align, up, **xy).where((c("r_y0") < c("l_y0")) & (c("r_word_id") != c("l_word_id")))
    beside = near(lp, rp, keys, right, base, **xy).where((c("r_x0") > c("l_x0")) & (c("r_word_id") != c("l_word_id")))
    one = lambda d, key, name: d.groupBy(*keys, "l_word_id").agg(F.min_by("r_text", F.struct(key, c("r_word_id"))).alias(name))
    a, b = one(above, c("l_y0") - c("r_y0"), "above"), one(beside, c("r_x0") - c("l_x0"), "beside")
    j = lp.join(a, [*keys, "l_word_id"], "left").join(b, [*keys, "l_word_id"], "left")
    via = F.when(c("above").isNotNull(), "above").when(c("beside").isNotNull(), "right")
    return j.select(*keys, c("l_word_id").alias("word_id"), c("l_text").alias("label"), F.coalesce("above", "beside").alias("value"), via.alias("via"))


def band_join(rows: DataFrame, bands: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """First band (lowest ``lo``) that holds the value, ends included.

    Bands spread over buckets of ``width`` and meet values by equality, so no side has to be small.
    """
    b = bands.withColumn("_w", F.explode(F.sequence(F.floor(c("lo") / width), F.floor(c("hi") / width))))
    r = rows.withColumn("_w", F.floor(c(value) / width))
    rid = [x for x in rows.columns if x not in keys]
    j = r.join(b, [*keys, "_w"]).where((c("lo") <= c(value)) & (c(value) <= c("hi")))
    best = j.groupBy(*keys, *rid).agg(F.min(F.struct("lo", "hi", "band")).alias("_hit"))
    return best.select(*keys, *rid, "_hit.lo", "_hit.hi", "_hit.band")


def fill_from_band(rows: DataFrame, bands: DataFrame, keys: list[str], value: str, target: str, width: float) -> DataFrame:
    """Missing targets from the band of their value, with the origin of every value."""
    need = rows.where(c(target).isNull() & c(value).isNotNull()).select(*keys, value).distinct()
    hit = band_join(need, bands, keys, value, width).select(*keys, value, c("band").alias("_band"))
    j = rows.join(hit, [*keys, value], "left")
    origin = F.when(c(target).isNotNull(), "own").when(c("_band").isNotNull(), "band").otherwise("none")
    return j.withColumn("origin", origin).withColumn(target, F.coalesce(target, "_band")).drop("_band")


def without_same_nearby(new: DataFrame, kept: DataFrame, mark: str, d: float, keys=PAGE) -> DataFrame:
    """New rows with no kept row of the same mark closer than ``d`` on both axes."""
    on = [*keys, mark]
    p = near(_points(kept.distinct(), "l_", on, []), _points(new, "r_", on, ["word_id"]), on, d, cell=8)
    p = p.where((F.abs(c("l_cx") - c("r_cx")) < d) & (F.abs(c("l_cy") - c("r_cy")) < d))
    return new.join(p.select(*on, c("r_word_id").alias("word_id")).distinct(), [*on, "word_id"], "left_anti")


def text_near_point(points: DataFrame, words: DataFrame, radius: float, run: int = 4, keys=PAGE) -> DataFrame:
    """Nearest run of one to ``run`` consecutive words of a line that spells the wanted text.

    ``points``: keys, det_id, want (alphanumeric key), cx, cy; ``words``: line_no, word_no, text, x0, y0.
    Words and points are dealt by page, unless they come so, and meet there: runs and cells are formed behind that
    shuffle, so neither is shuffled. A page is read by one task.
    """
    lines = [*keys, "line_no"]
    w = Window.partitionBy(*lines).orderBy("word_no")
    dealt = words.select(*lines, "word_no", "word_id", "text", "x0", "y0").repartition(*keys)
    runs = dealt.withColumns({f"_t{i}": F.lead("text", i).over(w) for i in range(1, run)})
    spell, arr = c("text"), []
    for i in range(run):
        if i:
            spell = F.concat(spell, c(f"_t{i}"))
        arr.append(F.when(spell.isNotNull(), F.struct(F.lit(i + 1).alias("n"), F.regexp_replace(F.upper(spell), "[^A-Z0-9]", "").alias("want"))))
    runs = runs.select(*keys, "word_id", c("x0").alias("cx"), c("y0").alias("cy"), F.explode(F.array_compact(F.array(*arr))).alias("s"))
    # texts meet by equality in the join itself: runs that nobody asks for meet nothing
    runs = runs.select(*keys, "word_id", "cx", "cy", "s.n", "s.want").where("want <> ''")
    p = near_radius(_points(points, "l_", [*keys, "want"], ["det_id"]), _points(runs, "r_", [*keys, "want"], ["word_id", "n"]), [*keys, "want"], radius, cell=8)
    row = F.min(F.struct("dist", "r_word_id", "r_n")).alias("_hit")
    hit = p.groupBy(*keys, c("l_det_id").alias("det_id"), "want").agg(row).select(*keys, "det_id", "want", c("_hit.r_word_id").alias("word_id"), c("_hit.r_n").alias("n_words"), "_hit.dist")
    # sides that are dealt by page are not dealt again by text and cell
    with settings(words.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return cut(hit)


def weighted_nearest(boxes: DataFrame, tokens: DataFrame, reach: float, floor: float = 0.20, fade: float = 600.0, keys=PAGE) -> DataFrame:
    """Best token by confidence times nearness; dropped below the floor after its pattern factor.

    ``tokens``: word_id, size, strength, ocr_conf (0..1), cx, cy.
    """
    from markgrid.functions.text import conf_ocr

    lp = _points(with_center(boxes), "l_", keys, ["det_id"])
    p = near_radius(lp, _points(tokens, "r_", keys, ["word_id", "size", "strength", "ocr_conf"]), keys, reach, cell=4)
    rank = -c("r_ocr_conf") * (1 - F.least(c("dist") / fade, F.lit(0.8)))
    row = F.min(F.struct(rank.alias("rank"), "r_word_id", "r_size", "r_strength", "r_ocr_conf", "dist")).alias("_hit")
    g = p.groupBy(*keys, c("l_det_id").alias("det_id")).agg(row)
    conf = conf_ocr(c("_hit.r_ocr_conf"), c("_hit.dist"), c("_hit.r_strength"))
    return g.select(*keys, "det_id", c("_hit.r_word_id").alias("word_id"), c("_hit.r_size").alias("size"), conf.alias("confidence")).where(c("confidence") >= floor)


def tokens_in_box(boxes: DataFrame, tokens: DataFrame, pad: float, keys=PAGE, cell: float = 128.0) -> DataFrame:
    """Tokens whose centre lies in a box grown by ``pad`` (bounds included)."""
    b = prefixed(boxes.select(*keys, "det_id", "x1", "y1", "x2", "y2"), "l_", keys)
    for ax in ("x", "y"):
        b = b.withColumn("_g" + ax, F.explode(F.sequence(F.floor((c(f"l_{ax}1") - pad) / cell), F.floor((c(f"l_{ax}2") + pad) / cell))))
    tk = tokens.withColumns({"_gx": F.floor(c("cx") / cell), "_gy": F.floor(c("cy") / cell)})
    j = b.join(tk, [*keys, "_gx", "_gy"])
    inside = c("cx").between(c("l_x1") - pad, c("l_x2") + pad) & c("cy").between(c("l_y1") - pad, c("l_y2") + pad)
    return j.where(inside).withColumnRenamed("l_det_id", "det_id").drop("_gx", "_gy", "l_x1", "l_y1", "l_x2", "l_y2")


def label_of_tokens(inside: DataFrame, keys=PAGE, order: str = "word_id") -> DataFrame:
    """First mark, first size and first plausible flow among a box's tokens, each token read once."""
    from markgrid.functions.common import first_match
    from markgrid.functions.text import canonical_size

    size = canonical_size(c("text"))
    num = F.when(c("text").rlike(r"^\d{2,4}$"), c("text").cast("int"))
    kind = first_match([(c("text").rlike(r"^[A-Z]{1,3}-?\d{1,3}[A-Z]?$"), "mark"), (size.isNotNull(), "size"), (num.between(30, 9999), "cfm")])
    r = inside.withColumns({"_kind": kind, "_size": size, "_num": num})
    first = lambda k, v: F.min_by(F.when(c("_kind") == k, v), F.when(c("_kind") == k, c(order)))
    return r.groupBy(*keys, "det_id").agg(
        first("mark", F.upper("text")).alias("mark"), first("size", c("_size")).alias("size"), first("cfm", c("_num")).alias("cfm"),
        F.avg("ocr_pct").alias("mean_conf"), F.count("*").alias("n_tokens"))
