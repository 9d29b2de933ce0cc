"""Box and point geometry as column expressions (x1, y1, x2, y2 in one coordinate space)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    c = F.col
    return (c(p + "x2") - c(p + "x1")) * (c(p + "y2") - c(p + "y1"))


def center_x(p: str = "") -> Column:
    return (F.col(p + "x1") + F.col(p + "x2")) / 2


def center_y(p: str = "") -> Column:
    return (F.col(p + "y1") + F.col(p + "y2")) / 2


def with_center(df: DataFrame, p: str = "") -> DataFrame:
    return df.withColumns({"cx": center_x(p), "cy": center_y(p)})


def overlap_area(a: str, b: str) -> Column:
    c = F.col
    w = F.least(c(a + "x2"), c(b + "x2")) - F.greatest(c(a + "x1"), c(b + "x1"))
    h = F.least(c(a + "y2"), c(b + "y2")) - F.greatest(c(a + "y1"), c(b + "y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str, b: str) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def center_distance(a: str, b: str) -> Column:
    return distance(center_x(a), center_y(a), center_x(b), center_y(b))


def orientation(p: str = "") -> Column:
    """H for a box at least as wide as it is high, else V."""
    wide = F.col(p + "x2") - F.col(p + "x1") >= F.col(p + "y2") - F.col(p + "y1")
    return F.when(wide, "H").otherwise("V")


def arc(chord: Column, rise: Column) -> dict[str, Column]:
    """Radius, length and half-angle of the circle arc with a given chord and rise."""
    flat = rise <= 0
    radius = (chord * chord / 4 + rise * rise) / (2 * rise)
    theta = F.asin(F.least(F.lit(1.0), chord / (2 * radius)))
    return {
        "radius": F.when(flat, F.lit(None).cast("double")).otherwise(radius),
        "arc_length": F.when(flat, chord.cast("double")).otherwise(2 * radius * theta),
        "theta_deg": F.when(flat, F.lit(0.0)).otherwise(F.degrees(theta)),
    }


def curve_angle(p: str = "") -> Column:
    w = F.col(p + "x2") - F.col(p + "x1")
    h = F.col(p + "y2") - F.col(p + "y1")
    return F.degrees(F.atan2(h.cast("double"), w.cast("double")))


def curve_differs(a: str, b: str, tol_deg: float = 30.0) -> Column:
    """True where two curved boxes run in different directions and must stay apart."""
    return F.abs(curve_angle(a) - curve_angle(b)) > tol_deg


def px_to_pt(v: Column, dpi: float) -> Column:
    return v * (72.0 / dpi)


def pt_to_px(v: Column, dpi: float) -> Column:
    return v * (dpi / 72.0)


def percent_to_px(v: Column, size: Column) -> Column:
    return v / 100.0 * size


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def normalised(page_w: Column, page_h: Column, p: str = "") -> dict[str, Column]:
    """Centre and size of a box as clamped fractions of its page."""
    c = F.col
    return {
        "ncx": clamp01((c(p + "x1") + c(p + "x2")) / 2.0 / page_w),
        "ncy": clamp01((c(p + "y1") + c(p + "y2")) / 2.0 / page_h),
        "nw": clamp01((c(p + "x2") - c(p + "x1")) / page_w.cast("double")),
        "nh": clamp01((c(p + "y2") - c(p + "y1")) / page_h.cast("double")),
    }
