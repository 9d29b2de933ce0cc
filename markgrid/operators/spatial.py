"""Spatial candidate joins. None of them pairs a page with itself: rows meet only in grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markgrid.functions.geom import distance, iou, overlap_area
from markgrid.session import cut, is_empty


def prefixed(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys])


def near(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    reach_x: float,
    reach_y: float | None = None,
    lxy: tuple[str, str] = ("l_cx", "l_cy"),
    rxy: tuple[str, str] = ("r_cx", "r_cy"),
    cell: float = 2.0,
) -> DataFrame:
    """Pairs whose points differ by at most the reach on each axis.

    Cells are ``cell`` (2 or more) times the reach wide, so a left row is copied to the one or two cells per axis that
    its window touches; pass the smaller side as ``left``. Wider cells copy fewer rows (four at 2, 2.25 at 4, 1.6 at 8) and
    compare more; they pay where pages are sparse or the keys tell most rows apart. Columns must already carry distinct names.

    Points grow with the input and compress well, so a file's size says little of them: the join is a merge, never a broadcast.
    """
    reach_y = reach_x if reach_y is None else reach_y
    lc, rc = left, right
    for g, reach, lx, rx in (("_gx", reach_x, lxy[0], rxy[0]), ("_gy", reach_y, lxy[1], rxy[1])):
        side = F.lit(cell * reach)
        first, last = F.floor((F.col(lx) - reach) / side), F.floor((F.col(lx) + reach) / side)
        lc = lc.withColumn(g, F.explode(F.sequence(first, last)))
        rc = rc.withColumn(g, F.floor(F.col(rx) / side))
    inside = (F.abs(F.col(lxy[0]) - F.col(rxy[0])) <= reach_x) & (F.abs(F.col(lxy[1]) - F.col(rxy[1])) <= reach_y)
    return lc.join(rc.hint("merge"), [*keys, "_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def near_radius(left, right, keys, radius, lxy=("l_cx", "l_cy"), rxy=("r_cx", "r_cy"), cell: float = 2.0) -> DataFrame:
    """As :func:`near`, with Euclidean ``dist`` no greater than ``radius``."""
    c = F.col
    d = distance(c(lxy[0]), c(lxy[1]), c(rxy[0]), c(rxy[1]))
    return near(left, right, keys, radius, lxy=lxy, rxy=rxy, cell=cell).withColumn("dist", d).where(c("dist") <= radius)


#: right rows of one cell from which on a search starts with finer cells
CROWDED = 2048
#: a crowd is quartered at most this often, to a reach of start / 4 ** DEEPEST
DEEPEST = 12


def _celled(df: DataFrame, at: tuple[str, str], reach: float) -> DataFrame:
    side = F.lit(2.0 * reach)
    return df.withColumns({g: F.floor(F.col(a) / side) for g, a in zip(("_gx", "_gy"), at)})


def _crowds(right: DataFrame, keys: list[str], rxy, reach: float, crowded: int, deepest: int = DEEPEST) -> list[tuple[float, DataFrame]]:
    """Quad-tree of the crowded cells: per level its reach and its cells of more than ``crowded`` rows, each with its
    eight neighbours. Only rows of crowded cells go on to the next level."""
    on = [*keys, "_gx", "_gy"]
    levels: list[tuple[float, DataFrame]] = []
    rows = right
    while len(levels) < deepest:
        celled = _celled(rows, rxy, reach)
        cells = cut(celled.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select(*on))
        if is_empty(cells):
            break
        shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
        around = cells.withColumn("_dx", F.explode(shift)).withColumn("_dy", F.explode(shift))
        around = around.select(*keys, (F.col("_gx") + F.col("_dx")).alias("_gx"), (F.col("_gy") + F.col("_dy")).alias("_gy"))
        levels.append((reach, around.distinct()))
        rows = cut(celled.join(cells, on, "left_semi").drop("_gx", "_gy")) if len(levels) < deepest else rows
        reach /= 4
    return levels


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    lid: str,
    rid: str,
    lxy=("l_cx", "l_cy"),
    rxy=("r_cx", "r_cy"),
    cap: float | None = None,
    start: float = 128.0,
    crowded: int = CROWDED,
) -> DataFrame:
    """The closest right row of every left row: ``keys, lid, rid, dist`` (ties to the lowest rid).

    With ``cap`` one grid join is enough. Without it the reach grows fourfold per round, and only
    rows still unserved go on, so the wide rounds are small; rows of a key that has no right row
    are left out from the start, which bounds the number of rounds by the page size. Rows without a
    point on either side match nothing.

    Where a cell holds more than ``crowded`` right rows, rows of one point are first reduced to one
    on either side, crowded cells are split as a quad-tree, and left rows in or beside one search
    from its finest level outwards, so that no row inside a crowd meets the whole crowd. A row beside
    a crowd still meets what its first successful reach holds. A found partner within a reach is the
    closest at any reach, so the rows do not depend on ``crowded``.
    """
    there = lambda df, at: df.where(reduce(lambda x, y: x & y, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf")) for a in at]))
    left, right = there(left, lxy), there(right, rxy)

    def best(pairs: DataFrame) -> DataFrame:
        b = F.min(F.struct("dist", rid)).alias("_best")
        return pairs.groupBy(*keys, lid).agg(b).select(*keys, lid, F.col("_best." + rid).alias(rid), F.col("_best.dist").alias("dist"))

    first = start if cap is None else cap
    lcols = left.select(*keys, lid, *lxy)
    rcols = cut(right.select(*keys, rid, *rxy))
    levels = _crowds(rcols, keys, rxy, first, crowded, deepest=1)
    if cap is not None and not levels:
        return best(near_radius(lcols, rcols, keys, cap, lxy, rxy))
    todo = cut(lcols.join(rcols.select(*keys).distinct(), keys, "left_semi"))
    everyone = todo
    if levels:
        rcols = cut(rcols.groupBy(*keys, *rxy).agg(F.min(rid).alias(rid)))
        levels = _crowds(rcols, keys, rxy, first, crowded)
        todo = cut(todo.select(*keys, *lxy, F.struct(*lxy).alias(lid)).distinct())  # a point is its own id
    points = todo
    parts = []

    def serve(rows: DataFrame, reach: float) -> None:
        nonlocal todo
        got = cut(best(near_radius(rows, rcols, keys, reach, lxy, rxy)))
        parts.append(got)
        todo = cut(todo.join(got.select(*keys, lid).hint("merge"), [*keys, lid], "left_anti"))

    for reach, cells in reversed(levels):
        inside = _celled(todo, lxy, reach).join(cells, [*keys, "_gx", "_gy"], "left_semi").drop("_gx", "_gy")
        serve(inside, reach / 4)
    reach = first
    while not is_empty(todo):
        serve(todo, reach)
        if cap is not None:
            break
        reach *= 4
    out = parts[0] if parts else best(near_radius(lcols, rcols, keys, first, lxy, rxy))
    for p in parts[1:]:
        out = out.unionByName(p)
    if points is everyone:
        return out
    at = points.join(out.hint("merge"), [*keys, lid]).select(*keys, *lxy, rid, "dist")
    return best(everyone.join(at.hint("merge"), [*keys, *lxy]))


def _level(p: str) -> Column:
    side = F.greatest(F.col(p + "x2") - F.col(p + "x1"), F.col(p + "y2") - F.col(p + "y1")).cast("double")
    return F.ceil(F.log2(F.greatest(side, F.lit(2.0**-40)))).cast("int") + 1


def size_levels(df: DataFrame) -> list[int]:
    """The size levels that occur: at most some dozens of whole numbers, read to prune the join."""
    return sorted(r[0] for r in df.select(_level("").alias("l")).distinct().collect() if r[0] is not None)


#: sides of a grid cell as a multiple of 2^level: wider cells copy fewer boxes and compare more
WIDE = 4.0


def _in_cells(df: DataFrame, p: str, lvl: str, levels: list[int] | None, up: int = 0) -> DataFrame:
    """One row per grid cell a box touches (cell side = ``WIDE`` * 2^level): on its own level, or on those of
    ``levels`` from its own to ``up`` above."""
    c = F.col
    df = df.withColumn(lvl, _level(p))
    if levels is None:
        df = df.withColumn("_lv", c(lvl))
    else:
        arr = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
        df = df.withColumn("_lv", F.explode(F.filter(arr, lambda x: x.between(c(lvl), c(lvl) + up))))
    side = F.pow(F.lit(2.0), c("_lv")) * WIDE
    for axis in ("x", "y"):
        lo = F.floor(c(p + axis + "1") / side)
        hi = F.floor(c(p + axis + "2") / side)
        df = df.withColumn("_c" + axis, F.explode(F.sequence(lo, hi)))
    return df


def _owns_cell(a: str, b: str) -> Column:
    # a pair may share several cells; it counts in the one holding the corner of its overlap
    side = F.pow(F.lit(2.0), F.col("_lv")) * WIDE
    at_x = F.floor(F.greatest(F.col(a + "x1"), F.col(b + "x1")) / side) == F.col("_cx")
    at_y = F.floor(F.greatest(F.col(a + "y1"), F.col(b + "y1")) / side) == F.col("_cy")
    return at_x & at_y


def _reach_up(min_iou: float) -> int:
    return int(math.ceil(math.log2(1.0 / min_iou) - 1e-12))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], min_iou: float) -> DataFrame:
    """Pairs of boxes ``a_*`` x ``b_*`` with positive overlap and ``iou`` >= ``min_iou`` (> 0).

    Boxes live on the grid level that fits their size, touching at most four cells. IoU bounds the
    ratio of sizes, so the smaller box looks only a few levels up, and only on levels that the other
    side has; a pair is met once, on the level of the larger box. No cell size has to be chosen and
    large boxes do not spread over many cells.
    """
    up = _reach_up(min_iou)
    on = [*keys, "_lv", "_cx", "_cy"]
    left_levels, right_levels = size_levels(left), size_levels(right)
    a, b = prefixed(left, "a_", keys), prefixed(right, "b_", keys)
    pairs = _in_cells(a, "a_", "_la", None).join(_in_cells(b, "b_", "_lb", left_levels, up), on)
    if left_levels and any(x > left_levels[0] for x in right_levels):
        smaller_a = _in_cells(a, "a_", "_la", right_levels, up).where("_lv > _la")
        pairs = pairs.unionByName(smaller_a.join(_in_cells(b, "b_", "_lb", None), on))
    pairs = pairs.where(_owns_cell("a_", "b_")).withColumn("iou", iou("a_", "b_")).where(F.col("iou") >= min_iou)
    return pairs.drop("_lv", "_cx", "_cy", "_la", "_lb")


def self_overlap_pairs(df: DataFrame, keys: list[str], id_col: str, min_iou: float, strict: bool = False) -> DataFrame:
    """Unordered overlap pairs within one set of boxes, each pair once."""
    on = [*keys, "_lv", "_cx", "_cy"]
    levels = size_levels(df)
    a = _in_cells(prefixed(df, "a_", keys), "a_", "_la", None)
    b = _in_cells(prefixed(df, "b_", keys), "b_", "_lb", levels, _reach_up(min_iou))
    once = (F.col("_lb") < F.col("_la")) | (F.col("a_" + id_col) < F.col("b_" + id_col))
    pairs = a.join(b, on).where(once & _owns_cell("a_", "b_")).withColumn("iou", iou("a_", "b_"))
    pairs = pairs.where(F.col("iou") > min_iou if strict else F.col("iou") >= min_iou)
    return pairs.drop("_lv", "_cx", "_cy", "_la", "_lb")


def touching_pairs(left: DataFrame, right: DataFrame, keys: list[str], pad: float, cell: float) -> DataFrame:
    """Pairs of boxes whose gap is at most ``pad`` on both axes (cells of side ``cell``)."""
    c = F.col
    a, b = prefixed(left, "a_", keys), prefixed(right, "b_", keys)

    def spread(df, p, grow):
        for axis in ("x", "y"):
            lo = F.floor((c(p + axis + "1") - grow) / F.lit(float(cell)))
            hi = F.floor((c(p + axis + "2") + grow) / F.lit(float(cell)))
            df = df.withColumn("_c" + axis, F.explode(F.sequence(lo, hi)))
        return df

    j = spread(a, "a_", pad).join(spread(b, "b_", 0), [*keys, "_cx", "_cy"])
    for axis in ("x", "y"):
        at = F.floor(F.greatest(c("a_" + axis + "1") - pad, c("b_" + axis + "1")) / F.lit(float(cell)))
        j = j.where(at == c("_c" + axis))
        j = j.where((c("a_" + axis + "1") - pad <= c("b_" + axis + "2")) & (c("b_" + axis + "1") <= c("a_" + axis + "2") + pad))
    return j.drop("_cx", "_cy").withColumn("inter", overlap_area("a_", "b_"))
