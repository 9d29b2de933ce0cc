"""Training-set curation: splits, sampling, tiling, merging, class indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions.common import rate
from markgrid.functions.keys import canonical_tag
from markgrid.operators.reconcile import last_wins, stacked

c = F.col


def set_scores(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision of canonical tag sets, with missed and extra counts."""
    t, f = (d.where("tag is not null").select(*keys, canonical_tag(c("tag")).alias("k")) for d in (truth, found))
    j = stacked(t, f, [*keys, "k"], {"t": ("l", "1"), "f": ("r", "1")})
    n = lambda cond: F.sum(cond.cast("bigint"))
    g = j.groupBy(*keys).agg(n(c("t") > 0).alias("n_true"), n(c("f") > 0).alias("n_found"), n((c("t") > 0) & (c("f") > 0)).alias("both"),
                             n((c("t") > 0) & (c("f") == 0)).alias("missed"), n((c("t") == 0) & (c("f") > 0)).alias("extra"))
    return g.withColumns({"recall": rate(c("both"), c("n_true")), "precision": rate(c("both"), c("n_found"))})


def merged_corrections(base: DataFrame, corrections: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Base rows and corrected rows in one set: of a corrected key the last correction counts and
    replaces the base."""
    last = last_wins(corrections, keys, order).drop(order)
    kept = base.join(last.select(*keys).distinct(), keys, "left_anti")
    return kept.withColumn("origin", F.lit("base")).unionByName(last.withColumn("origin", F.lit("correction")))


def oversampled(base: DataFrame, extra: DataFrame, times: int) -> DataFrame:
    """Extra rows of the train split repeated ``times``; other splits once. ``rep`` numbers the copies."""
    reps = F.when(c("split") == "train", F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("rep", F.lit(0)).unionByName(extra.withColumn("rep", F.explode(reps)))


def next_version(names: DataFrame, name: str, pattern: str, floor: int) -> DataFrame:
    """Highest version number in use plus one."""
    v = F.regexp_extract(c(name), pattern, 1).try_cast("int")
    return names.agg((F.coalesce(F.max(v), F.lit(floor)) + 1).alias("next_version"))


def hash_of(seed: int, *cols: str) -> Column:
    """Hexadecimal rank key: the same order on every cluster and in every engine that knows MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c(x).cast("string") for x in cols]))


def take_by_hash(rows: DataFrame, n: int, rank: Column) -> DataFrame:
    """The ``n`` rows of lowest rank key, exactly, without sorting them in one place.

    Rows are counted by the first three hex digits (4,096 counts); all rows below the boundary
    prefix are in, and only the boundary's own rows are sorted.
    """
    r = rows.withColumn("_h", rank)
    if n <= 0:
        return r.limit(0).drop("_h")
    per = r.groupBy(F.substring("_h", 1, 3).alias("_p")).agg(F.count("*").alias("_n"))
    cum = per.withColumn("_cum", F.sum("_n").over(Window.orderBy("_p")))
    edge = cum.where(c("_cum") >= n).orderBy("_p").limit(1).collect()
    if not edge:
        return r.drop("_h")
    p, rest = edge[0]["_p"], n - (edge[0]["_cum"] - edge[0]["_n"])
    whole = r.where(F.substring("_h", 1, 3) < p)
    part = r.where(F.substring("_h", 1, 3) == p).orderBy("_h").limit(rest)
    return whole.unionByName(part).drop("_h")


def group_split(rows: DataFrame, group: str, fraction: float, seed: int, named: list[str] | None = None) -> DataFrame:
    """Rows with ``split``: whole groups go to val, named ones or a seeded fraction (at least one)."""
    groups = rows.select(group).distinct()
    if named:
        val = groups.where(c(group).isin(named))
    else:
        n = groups.count()
        val = take_by_hash(groups, max(1, int(n * fraction + 0.5)), hash_of(seed, group))
    j = rows.join(val.withColumn("_v", F.lit(True)), group, "left")
    return j.withColumn("split", F.when(c("_v"), "val").otherwise("train")).drop("_v")


def thin_preserving(rows: DataFrame, item: str, cls: str, thin_below: int, target: int, seed: int) -> DataFrame:
    """Items kept: every one holding a class with fewer than ``thin_below`` rows, the rest filled up to
    ``target`` by hash. Result: item, why."""
    thin = rows.groupBy(cls).agg(F.count("*").alias("_n")).where(c("_n") < thin_below).select(cls)
    must = rows.join(thin, cls, "left_semi").select(item).distinct()
    rest = rows.select(item).distinct().join(must, item, "left_anti")
    fill = take_by_hash(rest, max(0, target - must.count()), hash_of(seed, item))
    return must.withColumn("why", F.lit("thin")).unionByName(fill.withColumn("why", F.lit("fill")))


def row_index(rows: DataFrame, order: str, block: int = 100_000) -> DataFrame:
    """Zero-based position of each row in ``order`` (a number, unique), numbered block by block."""
    d = rows.withColumn("_blk", F.floor(c(order) / block))
    n = d.groupBy("_blk").agg(F.count("*").alias("_n"))
    before = n.withColumn("_off", F.sum("_n").over(Window.orderBy("_blk")) - c("_n")).drop("_n")
    w = Window.partitionBy("_blk").orderBy(order)
    return d.withColumn("_k", F.row_number().over(w)).join(before, "_blk").withColumn("idx", c("_off") + c("_k") - 1).drop("_blk", "_k", "_off")


def every_kth(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Systematic sample: rows at positions 0, k, 2k, ..."""
    return row_index(rows, order).where(c("idx") % k == 0)


def tiles(boxes: DataFrame, width: Column, height: Column, tile: int = 640, overlap: int = 160) -> DataFrame:
    """Boxes on every overlapping tile that holds their centre, clipped to it and normalised.

    Tiles start every ``tile - overlap`` pixels; the last are pushed back to the page edge. Each box
    computes its own first and last start, so a large page costs no more.
    """
    step = tile - overlap
    d = boxes.withColumns({"_cx": (c("x1") + c("x2")) / 2, "_cy": (c("y1") + c("y2")) / 2,
                           "_bw": F.greatest(F.lit(1), c("x2") - c("x1")), "_bh": F.greatest(F.lit(1), c("y2") - c("y1"))})
    for a, size, at in (("x", width, "_cx"), ("y", height, "_cy")):
        first = F.greatest(F.lit(0), F.floor((c(at) - tile) / step) * step)
        # all tiles pushed back to the edge start at the same pixel
        last = F.when(c(at) >= size - tile, F.floor((size - 1) / step) * step).otherwise(F.floor(c(at) / step) * step)
        start = F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"), F.lit(step)))
        d = d.withColumn(f"t{a}", start).withColumn(f"_o{a}", F.greatest(F.lit(0), F.least(c(f"t{a}") + tile, size) - tile))
        d = d.withColumn(f"_t{a}", c(at) - c(f"_o{a}")).where((c(f"_t{a}") >= 0) & (c(f"_t{a}") < tile))
    lo = lambda a, b: F.greatest(F.lit(0.0), c(f"_t{a}") - c(b) / 2)
    hi = lambda a, b: F.least(F.lit(float(tile)), c(f"_t{a}") + c(b) / 2)
    d = d.withColumns({"_x1": lo("x", "_bw"), "_x2": hi("x", "_bw"), "_y1": lo("y", "_bh"), "_y2": hi("y", "_bh")}).where("_x2 > _x1 and _y2 > _y1")
    return d.select(*boxes.columns, "tx", "ty", ((c("_x1") + c("_x2")) / 2 / tile).alias("ncx"), ((c("_y1") + c("_y2")) / 2 / tile).alias("ncy"),
                    ((c("_x2") - c("_x1")) / tile).alias("nw"), ((c("_y2") - c("_y1")) / tile).alias("nh"))


def empty_tiles(boxes: DataFrame, pages: DataFrame, keys: list[str], width: int, height: int, keep_every: int, tile: int = 640, overlap: int = 160) -> DataFrame:
    """Tiles without any box, every ``keep_every``-th of them in page and tile order of each page."""
    step = tile - overlap
    grid = pages.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))).alias("ty")).select(
        *keys, "ty", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step))).alias("tx"))
    used = tiles(boxes, F.lit(width), F.lit(height), tile, overlap).select(*keys, "tx", "ty").distinct()
    w = Window.partitionBy(*keys).orderBy("ty", "tx")
    return grid.join(used, [*keys, "tx", "ty"], "left_anti").withColumn("_k", F.row_number().over(w)).where((c("_k") - 1) % keep_every == 0).drop("_k")


def retiled(labels: DataFrame, width: Column, height: Column, tile: int, overlap: int) -> DataFrame:
    """Normalised labels back to pixels and onto a new grid, keeping their split."""
    px = labels.withColumns({
        "x1": (c("ncx") - c("nw") / 2) * width, "x2": (c("ncx") + c("nw") / 2) * width,
        "y1": (c("ncy") - c("nh") / 2) * height, "y2": (c("ncy") + c("nh") / 2) * height}).drop("ncx", "ncy", "nw", "nh")
    return tiles(px, width, height, tile, overlap)


def without_held_out(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    held = manifest.where("split = 'held-out'").select(key).distinct()
    return rows.join(held, key, "left_anti")


def canonical_rows(annotations: DataFrame, cls: Column) -> DataFrame:
    """Annotations with their class; a null class is a drop."""
    return annotations.withColumn("cls", cls)


def drop_report(rows: DataFrame, subject: str) -> DataFrame:
    return rows.where("cls is null").groupBy(subject).agg(F.count("*").alias("n_dropped"))


def stable_index(existing: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Existing class numbers stay; new names follow in name order. Class lists are short."""
    top = existing.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0]
    new = names.select(name).distinct().join(existing, name, "left_anti")
    numbered = new.withColumn("_k", F.row_number().over(Window.orderBy(name)))
    return existing.select(name, "idx").unionByName(numbered.select(name, (F.lit(top) + c("_k")).cast("bigint").alias("idx")))


def append_truth(base: DataFrame, truth: DataFrame, classes: DataFrame, dpi: int) -> tuple[DataFrame, DataFrame]:
    """Base plus reviewed truth of known classes at the same resolution; and counts of what was skipped."""
    j = truth.join(classes.select("cls").distinct().withColumn("_ok", F.lit(True)), "cls", "left")
    why = F.when(c("dpi") != dpi, "dpi").when(c("_ok").isNull(), "unknown_class")
    j = j.withColumn("_why", why)
    added = j.where("_why is null").select(*base.columns)
    return base.unionByName(added), j.where("_why is not null").groupBy(c("_why").alias("why"), "cls").agg(F.count("*").alias("n"))


def split_card(rows: DataFrame, cls: str, splits: list[str], image: str) -> DataFrame:
    """Boxes and images per class and split, flagging classes without val samples."""
    is_split = lambda s: c("split") == s
    per_image = rows.groupBy(cls, "split", image).agg(F.count("*").alias("_n"))
    aggs = [F.sum(F.when(is_split(s), c("_n")).otherwise(0)).alias(f"boxes_{s}") for s in splits]
    aggs += [F.sum(is_split(s).cast("bigint")).alias(f"images_{s}") for s in splits]
    g = per_image.groupBy(cls).agg(*aggs)
    return g.withColumn("no_val", c(f"boxes_{splits[-1]}") == 0)
