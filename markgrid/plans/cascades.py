"""Multi-stage plans: tag inference, size waterfall, context, instances, verification, post-processing.

A cascade sends to each later level only what the earlier ones left open (an anti-join between
levels), so expensive levels see few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markgrid.functions import keys as K
from markgrid.functions import text as X
from markgrid.functions import vocab as V
from markgrid.operators import match as M
from markgrid.operators import reconcile as R
from markgrid.operators.layout import tag_then_size
from markgrid.operators.suppress import closed_rectangles
from markgrid.session import TIDY, cut, is_empty, settings

c = F.col
DOC, PAGE = ["doc_id"], ["doc_id", "page_no"]
ID = [*PAGE, "det_id"]


def _left_open(boxes: DataFrame, *found: DataFrame) -> DataFrame:
    """The boxes that no level found, written, so that a later level does not go through the earlier ones' joins again."""
    return cut(reduce(lambda d, f: d.join(f.select(*ID).hint("merge"), ID, "left_anti"), found, boxes))


def infer_tags(boxes: DataFrame, words: DataFrame, schedule: DataFrame, values: DataFrame, callouts: DataFrame, radius: float = 100.0) -> DataFrame:
    """Tag, method and confidence of every box, level by level on what is still untagged.

    1 direct (one scheduled tag for the class); 1b callouts; 2a fingerprints; 2b' tag text with a
    length bonus, which may also correct the class; 2b closest valid tag; 2c property values; 3 none.
    ``boxes``: no tag yet; ``callouts``: word_id, tag, cls, cx, cy. Callouts no box answers to join
    the result as boxes of their own (``synthetic``).
    """
    base = cut(boxes.select(*ID, "cls", "x1", "y1", "x2", "y2"))
    words = cut(words.select(*PAGE, "word_id", "text", "cx", "cy"))
    callouts = cut(callouts.select(*PAGE, "word_id", "tag", "cls", "cx", "cy"))
    sched = schedule.select(*DOC, "cls", "tag").distinct()

    def level(df: DataFrame, method: str, conf: Column, cls: Column | None = None) -> DataFrame:
        return cut(df.select(*ID, "tag", F.lit(method).alias("method"), conf.cast("double").alias("confidence"), (cls if cls is not None else F.lit(None).cast("string")).alias("new_cls")))

    direct = R.direct_assignment(base, sched, DOC, K.scalar_alias(c("cls"))).where("direct_tag is not null").withColumn("tag", c("direct_tag"))
    l1 = level(direct, "direct", F.lit(1.0))
    open1 = _left_open(base, l1).withColumn("tag", F.lit(None).cast("string"))
    co = cut(M.callouts_to_boxes(callouts, open1, radius))
    l1b = level(co.where("not synthetic"), "text_layer_callout", F.lit(1.0))
    open2 = _left_open(open1, l1b)
    fp = M.fingerprint_match(open2, words, M.fingerprints(values, DOC), radius)
    l2a = level(fp, "fingerprint", F.least(0.5 + 0.15 * c("score"), F.lit(0.95)))
    open3 = _left_open(open2, l2a)
    hit = R.match_cascade(words, sched, DOC, ["page_no", "word_id"]).where("strength <> 'fuzzy'")
    cls_of = sched.groupBy(*DOC, "tag").agg(F.min("cls").alias("tag_cls"))
    matched = words.join(hit, [*PAGE, "word_id"]).join(cls_of.withColumnRenamed("tag", "match"), [*DOC, "match"]).select(
        *PAGE, "word_id", "cx", "cy", c("match").alias("tag"), "tag_cls", F.length(K.alnum_key(c("match"))).alias("matched_len"))
    matched = cut(matched)
    l2b1 = level(M.longest_near_tag(open3, matched, 6 * radius), "bubble_detect", c("confidence"), c("new_cls"))
    open4 = _left_open(open3, l2b1)
    l2b = level(M.closest_valid_tag(open4, matched, sched, 1.4 * radius), "bubble_ocr", c("confidence"))
    open5 = _left_open(open4, l2b)
    near = M.nearby_words(open5, words, 0.8 * radius).withColumn("value", F.coalesce(X.word_reading(c("text"))["cfm"], X.word_reading(c("text"))["size"]))
    near = near.where("value is not null").select(*PAGE, "det_id", c("word_id").alias("ord"), "value")
    hit2 = R.tag_by_value(near, values.select(*DOC, "tag", "row_no", "value"), DOC, ("page_no", "det_id"))
    l2c = level(hit2, "size_cfm", F.lit(0.7))
    tagged = reduce(DataFrame.unionByName, [l1, l1b, l2a, l2b1, l2b, l2c])
    real = base.join(tagged.hint("merge"), ID, "left").select(
        *ID, F.coalesce("new_cls", "cls").alias("cls"), "tag", F.coalesce("method", F.lit("none")).alias("method"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(False).alias("synthetic"))
    made = co.where("synthetic").join(callouts.select(*PAGE, "word_id", "cls"), [*PAGE, "word_id"]).select(
        *PAGE, F.lit(None).cast("bigint").alias("det_id"), "cls", "tag", F.lit("text_layer_callout").alias("method"), F.lit(1.0).alias("confidence"), F.lit(True).alias("synthetic"))
    return real.unionByName(made)


def near_text_size(boxes: DataFrame, words: DataFrame, reach: float = 72.0) -> DataFrame:
    """Level 1: a combined label such as S1-8" next to the box, else a tag followed by a size."""
    combined = r'^([A-Z]{1,3}-?\d{1,6})-(\d+(?:\.\d+)?"|\d+[xX/]\d+)$'
    near = M.nearest_words(M.nearby_words(boxes, words, reach))
    t = F.upper(F.trim("text"))
    near = near.withColumns({"ctag": F.nullif(F.regexp_extract(t, combined, 1), F.lit("")), "csize": F.nullif(F.regexp_extract(t, combined, 2), F.lit("")),
                             "tag": F.when(t.rlike(r"^[A-Z]{1,3}-?\d{1,6}$"), t), "size": X.read_size(c("text"))})
    # ranked among all words, written once: only words that are read as something go on
    near = cut(near.where("csize is not null or tag is not null or size is not null").select(*ID, "word_id", "rank", "dist", "ctag", "csize", "tag", "size"))
    both = near.where("csize is not null").groupBy(*ID).agg(F.min(F.struct("rank", "ctag", "csize", "dist")).alias("_h")).select(*ID, c("_h.ctag").alias("tag"), c("_h.csize").alias("size"), c("_h.dist").alias("dist"), F.lit("exact_combined").alias("strength"))
    rest = near.join(both.select(*ID).hint("merge"), ID, "left_anti")
    pair = tag_then_size(rest).withColumn("strength", F.lit("separated"))
    u = both.unionByName(pair)
    return u.withColumn("conf", X.conf_near_text(c("dist"), c("strength"), F.lit(True), reach))


def schedule_size(boxes: DataFrame, words: DataFrame, schedule: DataFrame, reach: float = 200.0) -> DataFrame:
    """Level 2: nearest word that names a scheduled tag; the size is the schedule's. Where the schedule
    says the size varies, the tag is kept at low confidence without a size."""
    words = cut(words.select(*PAGE, "word_id", "text", "cx", "cy", "ocr_pct"))
    m = R.match_cascade(words, schedule, DOC, ["page_no", "word_id", "cx", "cy", "ocr_pct"])
    # words that name a tag are the few, so they are copied and not the boxes
    n = M.nearest_word(boxes, m.withColumnRenamed("match", "text"), reach, ["strength", "ocr_pct"])
    s = schedule.groupBy(*DOC, c("tag").alias("text")).agg(F.min("size").alias("size")).where("size <> ''")
    j = n.join(s, [*DOC, "text"])
    varies = F.upper("size").contains("VARIES") | c("size").contains("<") | F.upper("size").contains("SEE PLAN")
    conf = F.when(varies, 0.30).otherwise(X.conf_schedule(c("ocr_pct") / 100, c("strength")))
    return j.select(*ID, c("text").alias("tag"), F.when(~varies, c("size")).alias("size"), conf.alias("conf"),
                    F.when(varies, "level2-schedule-varies").otherwise("level2-schedule-via-bubble").alias("source"))


def size_waterfall(boxes: DataFrame, words: DataFrame, schedule: DataFrame, bands: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """Size of every box by the first level that finds one, with source, calibrated confidence and tier.

    1 label text; 2 schedule through a nearby tag; 3 weighted nearest size token; 4 flow band of the
    tag's flow; 5 unknown. ``boxes``: tag may be null; ``schedule``: tag, size, cfm; ``bands``: lo, hi, band.
    """
    base = cut(boxes.select(*ID, "tag", "x1", "y1", "x2", "y2"))
    words = cut(words.select(*PAGE, "word_id", "text", "cx", "cy", "ocr_pct"))
    l1 = near_text_size(base, words).select(*ID, "tag", "size", "conf", F.concat(F.lit("level1-"), "strength").alias("source"))
    l1 = cut(l1)
    open2 = _left_open(base, l1)
    l2 = cut(schedule_size(open2, words, schedule))
    open3 = _left_open(open2, l2)
    sized = words.withColumn("size", X.read_size(c("text"))).where("size is not null").withColumns({
        "strength": F.when(c("size").contains("X"), "standard_rect").otherwise("standard_round"), "ocr_conf": c("ocr_pct") / 100})
    l3 = M.weighted_nearest(open3, sized, 300).select(*ID, F.lit(None).cast("string").alias("tag"), "size", c("confidence").alias("conf"), F.lit("level3-ocr-near-detection").alias("source"))
    l3 = cut(l3)
    open4 = _left_open(open3, l3).where("tag is not null").join(schedule.where("cfm is not null").groupBy(*DOC, "tag").agg(F.min("cfm").alias("cfm")), [*DOC, "tag"])
    n_bands = bands.groupBy(*DOC).agg(F.count("*").alias("n_bands"))
    hit = M.band_join(open4.select(*ID, "tag", "cfm"), bands, DOC, "cfm", 32.0).join(n_bands, DOC)
    l4 = hit.select(*ID, "tag", c("band").alias("size"), X.conf_band(c("cfm"), c("lo"), c("hi"), c("n_bands")).alias("conf"), F.lit("level4-cfm-range-lookup").alias("source"))
    found = reduce(DataFrame.unionByName, [x.select(*ID, c("tag").alias("read_tag"), "size", "conf", "source") for x in (l1, l2, l3, l4)])
    j = base.join(found.hint("merge"), ID, "left").withColumns({
        "source": F.coalesce("source", F.lit("level5-unknown")), "conf": F.coalesce("conf", F.lit(0.0)), "tag": F.coalesce("tag", "read_tag"),
        "promoted": c("tag").isNull() & c("read_tag").isNotNull()})
    if curves is not None:
        from markgrid.operators.evaluate import calibrate

        j = calibrate(j, curves, "source", c("conf")).withColumn("conf", c("calibrated")).drop("calibrated")
    return j.select(*ID, "tag", "size", "source", "conf", X.size_tier(c("conf")).alias("tier"), "promoted")


def waterfall_stats(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source", "tier").agg(F.count("*").alias("n"), F.count("size").alias("n_sized"), F.sum(c("promoted").cast("bigint")).alias("n_promoted"))


def enrich_context(boxes: DataFrame, words: DataFrame, dampers: list[str], grilles: list[str]) -> DataFrame:
    """Context flags in fixed order: damper beside a grille, CRD marker, typical marker, rectangle
    member. Runs are merged apart by :func:`markgrid.operators.suppress.merge_runs`."""
    cols = boxes.columns
    boxes = cut(boxes)
    u = F.replace(F.upper("text"), F.lit("."), F.lit(""))
    words = cut(words.select(*PAGE, u.alias("_u"), "cx", "cy").where(c("_u").isin("CRD", "TYP", "TYPICAL")))
    damper = M.with_context(boxes.where(c("cls").isin(dampers)), boxes.where(c("cls").isin(grilles)), 0.05, 100.0).where("flag").select(*ID, F.lit(True).alias("with_grille"))
    crd = M.near_any(boxes.where(c("cls").isin(grilles)), words.where("_u = 'CRD'"), 200.0).where("flag").select(*ID, F.lit("CRD").alias("damper_type"))
    typ = M.near_any(boxes, words.where("_u <> 'CRD'"), 200.0).where("flag").select(*ID, F.lit(True).alias("typical"))
    rect = closed_rectangles(boxes).select(*PAGE, F.explode(F.array("t_id", "b_id", "l_id", "r_id")).alias("det_id"), F.lit(4).alias("corners"))
    out = boxes
    for part in (damper, crd, typ, rect):
        out = out.join(part, ID, "left")
    return out.select(*cols, F.coalesce("with_grille", F.lit(False)).alias("with_grille"), "damper_type", F.coalesce("typical", F.lit(False)).alias("typical"), "corners")


def context_stats(enriched: DataFrame, runs: DataFrame) -> DataFrame:
    f = enriched.groupBy("doc_id").agg(F.sum(c("with_grille").cast("bigint")).alias("with_grille"), F.count("damper_type").alias("crd"), F.sum(c("typical").cast("bigint")).alias("typical"), (F.count("corners") / 4).cast("bigint").alias("rectangles"))
    r = runs.where("merged_count > 1").groupBy("doc_id").agg(F.count("*").alias("runs"))
    return f.join(r, DOC, "left").na.fill(0, ["runs"])


def fill_missing(rows: DataFrame, bands: DataFrame, keys: list[str], width: float = 32.0) -> DataFrame:
    """Schedule rows with neck from flow bands and slot width from the model name, with both origins."""
    f = M.fill_from_band(rows, bands, keys, "cfm", "neck", width).withColumnRenamed("origin", "neck_origin")
    implied = X.slot_width(c("cls"), c("tag"), c("model"))
    return f.withColumn("slot_origin", F.when(c("slot").isNotNull(), "own").when(implied.isNotNull(), "model").otherwise("none")).withColumn("slot", F.coalesce("slot", implied))


def fill_counts(filled: DataFrame, keys: list[str]) -> DataFrame:
    return filled.groupBy(*keys).agg(F.sum((c("neck_origin") == "band").cast("bigint")).alias("neck_filled"), F.sum((c("slot_origin") == "model").cast("bigint")).alias("slot_filled"))


def label_instances(words: DataFrame, min_gap: float = 15.0) -> DataFrame:
    """Plan-label instances: combined labels (1.0), bare marks paired with a size (0.75), bare marks
    alone (0.3); flows below combined labels; bare marks next to a combined one of the same mark drop."""
    t = F.upper(F.trim("text"))
    lab = r'^([A-Z]{1,3}-?\d{1,6})-(\d+(?:\.\d+)?"?|\d+[xX/]\d+)$'
    part = lambda i: F.nullif(F.regexp_extract(t, lab, i), F.lit(""))
    # every reading of a word is written with it, so that no step matches patterns again
    words = cut(words.select(
        *PAGE, "word_id", "cx", "cy", "y0", "y1", part(1).alias("mark_c"), part(2).alias("size_c"), F.when(t.rlike(r"^[A-Z]{1,3}-?\d{1,6}$") & part(1).isNull(), t).alias("mark"),
        F.when(c("text").rlike(r"^\d{2,4}$"), c("text").cast("int")).alias("cfm"), X.canonical_size(c("text")).alias("size")))
    comb = words.where("mark_c is not null").select(*PAGE, "word_id", "cx", "cy", "y1", c("mark_c").alias("mark"), c("size_c").alias("size"))
    num = words.where("cfm is not null").select(*PAGE, "word_id", "cx", c("y0").alias("top"), "cfm")
    flow = M.flow_below(comb.select(*PAGE, c("word_id").alias("anchor_id"), "cx", c("y1").alias("bottom")), num)
    flow = flow.join(num.select(*PAGE, "word_id", "cfm"), [*PAGE, "word_id"]).select(*PAGE, c("anchor_id").alias("word_id"), "cfm")
    comb = comb.join(flow, [*PAGE, "word_id"], "left")
    bare = words.where("mark is not null").select(*PAGE, "word_id", "cx", "cy", "mark")
    bare = M.without_same_nearby(bare, comb.select(*PAGE, "mark", "cx", "cy"), "mark", min_gap)
    size = words.where("size is not null").select(*PAGE, "word_id", "cx", "cy", "size")
    e = M.size_edges(bare.withColumnRenamed("word_id", "mark_id"), size.withColumnRenamed("word_id", "size_id"))
    pair = M.pair_sizes_greedy(e).select(*PAGE, c("l").alias("word_id"), c("r").alias("size_id"))
    sized = bare.join(pair, [*PAGE, "word_id"], "left").join(size.select(*PAGE, c("word_id").alias("size_id"), "size"), [*PAGE, "size_id"], "left")
    none = F.lit(None).cast("int")
    a = comb.select(*PAGE, "word_id", "mark", F.coalesce(X.canonical_size(F.when(c("size").rlike(r'^[\d.]+$'), F.concat("size", F.lit('"'))).otherwise(c("size"))), c("size")).alias("size"), "cfm", F.lit("combined_label").alias("method"), F.lit(1.0).alias("confidence"))
    b = sized.select(*PAGE, "word_id", "mark", "size", none.alias("cfm"), F.when(c("size").isNotNull(), "bare_mark").otherwise("bare_mark_no_size").alias("method"),
                     F.when(c("size").isNotNull(), 0.75).otherwise(0.3).alias("confidence"))
    return a.unionByName(b)


def bare_marks(words: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Marks that stand alone on a plan, each with the size token that it chooses and that token's flow.

    ``words``: doc_id, page_no, word_id, text, x0, cx, cy; ``whitelist``: doc_id, mark. Numbered marks must be listed
    where their document lists any; marks of two to four letters count only if listed, and once per rounded x0 (the
    first in word order). Equipment prefixes are no marks. Marks choose in order of their cheapest size; ties go to
    the lower word. Returns ``doc_id, page_no, word_id, mark, size, cfm, method, confidence``; a mark without a size
    is kept with a low confidence, null texts and null marks match nothing.
    """
    listed = whitelist.select("doc_id", "mark").where("mark is not null").distinct()
    lists = listed.select("doc_id").distinct().withColumn("_lists", F.lit(True))
    trimmed = F.trim("text")
    # every reading of a word is written with it, so that no step matches patterns again
    words = cut(words.select(*PAGE, "word_id", "x0", "cx", "cy", trimmed.alias("_t"), F.regexp_extract(trimmed, V.BARE_MARK, 1).alias("mark"), X.size_and_flow(c("text")).alias("_s")))
    numbered = words.where("mark <> ''").select(*PAGE, "word_id", "x0", "cx", "cy", "mark")
    numbered = numbered.where(~F.regexp_extract("mark", "^([A-Z]+)", 1).isin(V.EQUIPMENT_PREFIXES))
    numbered = numbered.join(lists, "doc_id", "left").join(listed.withColumn("_ok", F.lit(True)), ["doc_id", "mark"], "left")
    numbered = numbered.where("_lists is null or _ok").select(*PAGE, "word_id", "cx", "cy", "mark", F.lit(False).alias("lettered"))
    short = listed.where(c("mark").rlike(V.LETTER_MARK) & ~c("mark").isin(V.EQUIPMENT_PREFIXES))
    lettered = words.drop("_s").withColumn("mark", F.upper("_t")).join(short, ["doc_id", "mark"])
    lettered = lettered.groupBy(*PAGE, "mark", F.bround("x0").alias("_at")).agg(F.min(F.struct("word_id", "cx", "cy")).alias("_w"))
    marks = cut(numbered.unionByName(lettered.select(*PAGE, "_w.*", "mark", F.lit(True).alias("lettered"))))
    sizes = words.where("_s is not null").select(*PAGE, c("word_id").alias("size_id"), "cx", "cy", "_s.size", "_s.cfm")
    edges = M.size_edges(marks.withColumnRenamed("word_id", "mark_id"), sizes)
    pair = M.pair_sizes_greedy(edges).select(*PAGE, c("l").alias("word_id"), c("r").alias("size_id"))
    pair = pair.join(sizes.select(*PAGE, "size_id", "size", "cfm"), [*PAGE, "size_id"])
    out = marks.join(pair, [*PAGE, "word_id"], "left")
    sized = c("size").isNotNull()
    return out.select(
        *PAGE, "word_id", "mark", "size", "cfm",
        F.concat(F.when(c("lettered"), "letter_only_mark").otherwise("bare_mark"), F.when(sized, "").otherwise("_no_size")).alias("method"),
        F.when(c("lettered"), F.when(sized, 0.70).otherwise(0.55)).otherwise(F.when(sized, 0.75).otherwise(0.30)).alias("confidence"))


def verify_document(pages: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Red flags per document: watermark, missing or unlisted sheets, no legend, no issue type.

    ``pages``: keys, page_no, sheet, discipline, text; ``index``: keys, sheet, discipline.
    """
    ph = X.document_phrases(c("text"))
    p = pages.select(*keys, "sheet", "discipline", ph["watermark"].alias("watermark"), ph["issue_type"].alias("issue_type"), F.array_contains(ph["blocks"], "legend").alias("legend"))
    d = p.groupBy(*keys).agg(F.min("watermark").alias("watermark"), F.min("issue_type").alias("issue_type"), F.max("legend").alias("legend"), F.count("*").alias("n_pages"))
    gaps = R.index_completeness(index, p.where("sheet is not null").select(*keys, "sheet", "discipline"), keys)
    g = gaps.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))
    flag = lambda code, level, n: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("bigint").alias("n"))
    own = d.select(*keys, F.explode(F.array_compact(F.array(
        F.when(c("watermark").isNotNull(), flag("watermark", "error", F.lit(1))),
        F.when(c("issue_type").isNull(), flag("no_issue_type", "info", F.lit(1))),
        F.when(~c("legend"), flag("no_legend", "warning", F.lit(1)))))).alias("f")).select(*keys, "f.*")
    idx = g.select(*keys, F.when(c("verdict") == "missing", "error").otherwise("warning").alias("level"), F.concat(c("verdict"), F.lit("_sheets")).alias("code"), "n")
    return own.unionByName(idx)


def document_digest(types: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """Per document: pages by type, scheduled tags, notes."""
    t = types.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    t = t.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("pages_by_type"))
    g = tags.groupBy("doc_id").agg(F.countDistinct("tag").alias("n_tags"), F.count("*").alias("n_rows"))
    n = notes.groupBy("doc_id").agg(F.count("*").alias("n_notes"))
    return t.join(g, DOC, "full_outer").join(n, DOC, "full_outer").na.fill(0, ["n_tags", "n_rows", "n_notes"])


def mark_notes(boxes: DataFrame, words: DataFrame, radius: float = 200.0) -> DataFrame:
    """Not-in-contract and typical-of-n marks on the boxes nearest to those notes, and billable units."""
    from markgrid.operators.layout import phrases, typical_counts

    boxes = cut(boxes)
    words = words if "cx" in words.columns else M.word_points(words)
    words = cut(words.select(*PAGE, "word_id", "text", "x0", "y0", "x1", "y1", "cx", "cy"))
    nic = phrases(words, V.NIC_PHRASES).select(*PAGE, c("word_id").alias("note_id"), ((c("bx0") + c("bx1")) / 2).alias("cx"), ((c("by0") + c("by1")) / 2).alias("cy"))
    typ = typical_counts(words)
    n = M.note_to_box(nic, boxes, radius).select(*ID, F.lit(True).alias("nic"))
    k = M.note_to_box(typ.withColumnRenamed("word_id", "note_id"), boxes, radius).join(typ.select(*PAGE, c("word_id").alias("note_id"), "n"), [*PAGE, "note_id"]).select(*ID, c("n").alias("typ_of"))
    j = boxes.join(n, ID, "left").join(k, ID, "left").withColumn("nic", F.coalesce("nic", F.lit(False)))
    return j.withColumn("units", X.units_of(c("nic"), c("typ_of")))


def backfill(jobs: DataFrame, boxes: DataFrame, words: DataFrame, dry_run: bool = True) -> DataFrame:
    """Notes re-applied to finished jobs: the rows that would change (dry run) or all their rows."""
    done = jobs.where("status = 'done'").select("doc_id").distinct()
    b = boxes.join(done, DOC, "left_semi")
    m = mark_notes(b.drop("units"), words.join(done, DOC, "left_semi"))
    if not dry_run:
        return m
    old = b.select(*ID, c("units").alias("old_units"))
    return m.join(old, ID).where(~c("units").eqNullSafe(c("old_units"))).select(*ID, "old_units", "units")


def _stored(spark, path: str) -> DataFrame | None:
    """What a folder of partitioned rows holds, or nothing if it was never written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_back(jobs: DataFrame, boxes: DataFrame, words: DataFrame, tables, folder: str) -> DataFrame:
    """Backfill of finished jobs, stored: marked boxes and the rebuilt tag table of every document whose result changed.

    ``tables``: marked boxes to the three inputs of ``tag_table``. ``folder`` holds ``boxes``, ``tag_table`` and
    ``commits``, one partition a document; only partitions of changed documents are overwritten, and a document's
    commit (``digest`` of its marked rows and tag table, counts) is written last. A run that was lost half way is
    repaired by the next one; a run on the same inputs writes nothing. Returns the commits that this run made:
    ``doc_id, digest, n_rows, n_nic, extra_units``. Without finished jobs nothing is written.
    """
    spark = boxes.sparkSession
    marked = cut(backfill(jobs, boxes, words, dry_run=False))
    done = marked.select("doc_id").distinct()
    table = cut(R.tag_table(*[d.join(done, DOC, "left_semi") for d in tables(marked)], DOC))
    # sums of hashes do not depend on the order of rows, and are exact in any grouping
    part = lambda df: df.select("doc_id", F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("_h"))
    rows = part(marked).unionByName(part(table))
    counts = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), F.sum(c("nic").cast("bigint")).alias("n_nic"),
        F.sum(F.greatest(c("units") - 1, F.lit(0)).cast("bigint")).alias("extra_units"))
    commits = rows.groupBy("doc_id").agg(F.sum("_h").cast("string").alias("digest")).join(counts, "doc_id")
    before = _stored(spark, f"{folder}/commits")
    if before is not None:
        same = before.select(c("doc_id").cast(boxes.schema["doc_id"].dataType).alias("doc_id"), c("digest").cast("string").alias("digest"))
        commits = commits.join(same, ["doc_id", "digest"], "left_anti")
    commits = cut(commits.select("doc_id", "digest", "n_rows", "n_nic", "extra_units"))
    if is_empty(commits):
        return commits
    for name, df in (("boxes", marked), ("tag_table", table), ("commits", commits)):
        df = df.join(commits.select("doc_id"), DOC, "left_semi")
        # a file a document costs time, not bytes: commits are a row each, so by their size one task would write them all
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if name == "commits" else df.hint("rebalance", "doc_id")
        with settings(spark, {TIDY: "true"}):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{folder}/{name}")
    return commits


def plan_boxes(boxes: DataFrame, page_types: DataFrame) -> DataFrame:
    """Boxes on pages that may be plans."""
    from markgrid.operators.filters import without_pages

    return without_pages(boxes, page_types, PAGE, V.NON_PLAN_TYPES)


def plan_checks(boxes: DataFrame, schedule: DataFrame, page_types: DataFrame) -> DataFrame:
    """Scheduled tags and quantities (``exp_qty``) against the boxes on plan pages."""
    return R.quality_checks(schedule, plan_boxes(boxes, page_types), DOC)


def post_process(boxes: DataFrame, words: DataFrame, schedule: DataFrame, bands: DataFrame, page_types: DataFrame) -> dict[str, DataFrame]:
    """All stages after detection over a corpus: plan pages, notes, sizes, reconciliation, quality
    checks, tag table. ``schedule`` carries quantities as ``exp_qty``. Shared inputs are written once; a failing
    stage fails the job."""
    plan = cut(plan_boxes(boxes, page_types))
    checks = cut(R.quality_checks(schedule, plan, DOC))
    schedule = schedule.drop("exp_qty")
    marked = cut(mark_notes(plan, words))
    sizes = cut(size_waterfall(plan, words, schedule, bands))
    necked = marked.drop("tag").join(sizes.select(*ID, "tag", "size", c("conf").alias("size_conf")), ID)
    rows = necked.select("doc_id", "cls", "tag", F.coalesce("size", F.lit("")).alias("neck"), "units", F.round(c("size_conf") * 100).cast("bigint").alias("conf"))
    # stages that are counted and read again are written, one after the other
    inst = cut(label_instances(words))
    bom = inst.groupBy("doc_id", c("mark").alias("tag"), F.coalesce("size", F.lit("")).alias("neck")).agg(F.count("*").alias("qty"), F.sum(c("cfm").isNull().cast("int")).alias("cfm_missing"))
    sched = schedule.select("doc_id", "tag", c("size").alias("neck"))
    table = cut(R.tag_table(bom, rows, sched, DOC))
    return {
        "sizes": sizes, "units": marked.select(*ID, "nic", "typ_of", "units"), "instances": inst, "tag_table": table,
        "totals": R.tag_table_totals(table, DOC), "checks": checks,
    }


def stage_manifest(stages: dict[str, DataFrame]) -> DataFrame:
    parts = [d.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("stage", F.lit(k)) for k, d in stages.items()]
    return reduce(DataFrame.unionByName, parts)


