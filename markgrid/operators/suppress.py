"""Duplicate suppression and run merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markgrid.functions.geom import center_x, center_y
from markgrid.operators.kernels import components, first_disjoint, suppressed
from markgrid.operators.spatial import near, prefixed, self_overlap_pairs, touching_pairs
from markgrid.session import cut

PAGE = ["doc_id", "page_no"]


def _ranked_edges(pairs: DataFrame, keys, score: str, id_col: str) -> DataFrame:
    a_first = F.struct(-F.col("a_" + score), F.col("a_" + id_col)) < F.struct(-F.col("b_" + score), F.col("b_" + id_col))
    hi = F.when(a_first, F.col("a_" + id_col)).otherwise(F.col("b_" + id_col))
    lo = F.when(a_first, F.col("b_" + id_col)).otherwise(F.col("a_" + id_col))
    return pairs.select(*keys, hi.alias("hi"), lo.alias("lo"))


def best_of_copies(boxes: DataFrame, same: list[str], score: str, id_col: str) -> DataFrame:
    """Of rows alike in ``same`` the best one: ``same``, id, score and the number of copies.

    Greedy suppression would remove the other copies anyway (their IoU with it is 1 and they share
    all its neighbours), so heaps of copies never become pairs.
    """
    best = F.min(F.struct((-F.col(score)).alias("neg"), F.col(id_col).alias("id"))).alias("_best")
    g = boxes.groupBy(*same).agg(best, F.count("*").alias("n_copies"))
    return g.select(*same, F.col("_best.id").alias(id_col), (-F.col("_best.neg")).alias(score), "n_copies")


def _keep(boxes: DataFrame, solo: DataFrame, gone: DataFrame, same: list[str], keys: list[str], id_col: str) -> DataFrame:
    """Boxes that are neither suppressed nor a lesser copy. Both lists are short next to the boxes, so
    they are broadcast where their written size allows."""
    heaps = solo.where("n_copies > 1").select(*same, F.col(id_col).alias("_keep_id"))
    left = boxes.join(heaps, same, "left").where(F.col("_keep_id").isNull() | (F.col("_keep_id") == F.col(id_col)))
    return left.join(gone.withColumnRenamed("id", id_col), [*keys, id_col], "left_anti")


def suppress_iou(
    boxes: DataFrame,
    min_iou: float,
    keys: list[str] = PAGE,
    within: str | None = None,
    score: str = "conf_pct",
    id_col: str = "det_id",
    strict: bool = False,
) -> DataFrame:
    """Greedy IoU suppression by descending ``score``, ties to the lower id.

    ``within`` restricts it to boxes of one class; ``strict`` suppresses above the threshold
    only, not at it.
    """
    part = [*keys, within] if within else list(keys)
    same = [*part, "x1", "y1", "x2", "y2"]
    boxes = cut(boxes)  # read for the copies and again for what is kept
    solo = cut(best_of_copies(boxes, same, score, id_col))
    pairs = self_overlap_pairs(solo.drop("n_copies"), part, id_col, min_iou, strict)
    gone = suppressed(_ranked_edges(pairs, keys, score, id_col), keys)
    return _keep(boxes, solo, gone, same, keys, id_col).select(*boxes.columns)


def suppress_two_pass(boxes: DataFrame, same_class: float = 0.45, cross_class: float = 0.70, **kw) -> DataFrame:
    """Suppression inside each class, then across classes."""
    first = suppress_iou(boxes, same_class, within="cls", **kw)
    return suppress_iou(first, cross_class, **kw)


def suppress_window(
    boxes: DataFrame, d: float, keys: list[str] = PAGE, score: str = "conf_pct", id_col: str = "det_id"
) -> DataFrame:
    """Suppression of boxes whose centres lie closer than ``d`` on both axes."""
    pts = boxes.withColumns({"cx": center_x(), "cy": center_y()})
    same = [*keys, "cx", "cy"]
    solo = cut(best_of_copies(pts, same, score, id_col))
    slim = solo.drop("n_copies")
    pairs = near(prefixed(slim, "a_", keys), prefixed(slim, "b_", keys), keys, d, lxy=("a_cx", "a_cy"), rxy=("b_cx", "b_cy"))
    closer = (F.abs(F.col("a_cx") - F.col("b_cx")) < d) & (F.abs(F.col("a_cy") - F.col("b_cy")) < d)
    pairs = pairs.where(closer & (F.col("a_" + id_col) < F.col("b_" + id_col)))
    gone = suppressed(_ranked_edges(pairs, keys, score, id_col), keys)
    return _keep(pts, solo, gone, same, keys, id_col).select(*boxes.columns)


def _run_edge(lo: str, hi: str, q: str, r: str, frac: float, gap: tuple[float, float]) -> Column:
    """Colinear along one axis: sides q,r aligned within a share of the first box, end gap in range."""
    c = F.col
    tol = (c("a_" + r) - c("a_" + q)) * frac
    aligned = (F.abs(c("a_" + q) - c("b_" + q)) <= tol) & (F.abs(c("a_" + r) - c("b_" + r)) <= tol)
    end = F.greatest(c("b_" + lo) - c("a_" + hi), c("a_" + lo) - c("b_" + hi))
    return aligned & end.between(*gap)


def run_edges(boxes: DataFrame, keys=PAGE, id_col="det_id", frac=0.3, gap=(-10.0, 80.0)) -> DataFrame:
    """Neighbouring colinear boxes of one class (the lower id is the measuring box)."""
    part = [*keys, "cls"]
    slim = boxes.select(*part, id_col, "x1", "y1", "x2", "y2")
    pairs = touching_pairs(slim, slim, part, gap[1], 8 * gap[1]).where(F.col("a_" + id_col) < F.col("b_" + id_col))
    linked = _run_edge("x1", "x2", "y1", "y2", frac, gap) | _run_edge("y1", "y2", "x1", "x2", frac, gap)
    return pairs.where(linked).select(*keys, F.col("a_" + id_col).alias("a"), F.col("b_" + id_col).alias("b"))


def merge_runs(boxes: DataFrame, keys=PAGE, id_col="det_id", score="conf_pct") -> DataFrame:
    """Chains of colinear boxes become one box with mean score, member count and face length."""
    boxes = cut(boxes.select(*keys, id_col, "cls", "x1", "y1", "x2", "y2", score))
    comp = components(run_edges(boxes, keys, id_col), keys).withColumnRenamed("id", id_col)
    tagged = boxes.join(comp, [*keys, id_col], "left").withColumn("root", F.coalesce("root", id_col))
    merged = tagged.groupBy(*keys, "cls", "root").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.sum(score).alias("score_sum"), F.count("*").alias("merged_count"),
    )
    face = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return merged.withColumns({
        "face_length": F.when(F.col("merged_count") > 1, face),
        "mean_score": F.col("score_sum") / F.col("merged_count"),
    }).drop("score_sum")


def closed_rectangles(boxes: DataFrame, keys=PAGE, id_col="det_id", tol: float = 80.0) -> DataFrame:
    """Two horizontal and two vertical boxes closing a rectangle, each box in one rectangle only.

    Sides meet in grid joins on their corners; of quadruples that share a box, the earliest in
    (top, bottom, left, right) id order wins.
    """
    from markgrid.functions.geom import orientation

    c = F.col
    slim = cut(boxes.select(*keys, c(id_col).alias("id"), "x1", "y1", "x2", "y2").withColumn("o", orientation()))
    h, v = slim.where("o = 'H'").drop("o"), slim.where("o = 'V'").drop("o")
    t, b = prefixed(h, "t_", keys), prefixed(h, "b_", keys)
    lt, rt = prefixed(v, "l_", keys), prefixed(v, "r_", keys)

    def close(x, y):
        return F.abs(c(x) - c(y)) < tol

    # left and right sides hang on the top's upper corners; the bottom must fit below both
    q = near(t, lt, keys, tol, lxy=("t_x1", "t_y1"), rxy=("l_x1", "l_y1"), cell=8)
    q = q.where(close("l_x1", "t_x1") & close("l_y1", "t_y1"))
    q = near(q, b, keys, 2 * tol, tol, lxy=("t_x1", "l_y2"), rxy=("b_x1", "b_y2"), cell=8)
    q = q.where((c("t_id") != c("b_id")) & close("t_x1", "b_x1") & close("t_x2", "b_x2")
                & (c("t_y1") < c("b_y1")) & close("l_y2", "b_y2"))
    q = near(q, rt, keys, tol, tol, lxy=("t_x2", "t_y1"), rxy=("r_x2", "r_y1"), cell=8)
    q = q.where((c("l_id") != c("r_id")) & close("r_x2", "t_x2") & close("r_y1", "t_y1") & close("r_y2", "b_y2"))
    quad = q.select(*keys, "t_id", "b_id", "l_id", "r_id")
    member = quad.select(
        *keys, F.struct("t_id", "b_id", "l_id", "r_id").alias("sid"),
        F.explode(F.array("t_id", "b_id", "l_id", "r_id")).alias("m"))
    return first_disjoint(member, keys, 4).select(*keys, "sid.*")
