"""Row filters that depend on classes, schedules, groups or page verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions import vocab as V
from markgrid.functions.common import first_match, has_any, hits
from markgrid.functions.keys import class_threshold
from markgrid.operators.inside import containing

c = F.col


def split_by_threshold(boxes: DataFrame, cls: str = "cls", conf: str = "conf", default: float = V.DEFAULT_THRESHOLD) -> DataFrame:
    """Rows marked ``kept`` by the threshold of their class; a missing confidence counts as 1."""
    return boxes.withColumn("kept", F.coalesce(conf, F.lit(1.0)) >= class_threshold(c(cls), default))


def drop_counts(marked: DataFrame, keys: list[str]) -> DataFrame:
    return marked.where("not kept").groupBy(*keys).agg(F.count("*").alias("dropped"))


def scheduled_or_sure(boxes: DataFrame, schedule: DataFrame, keys: list[str], sure: float, conf: str = "conf") -> DataFrame:
    """Boxes whose class is scheduled, or that are sure enough; documents without schedule keep all."""
    classes = schedule.select(*keys, "cls").distinct()
    has = classes.select(*keys).distinct().withColumn("_has", F.lit(True))
    j = boxes.join(classes.withColumn("_in", F.lit(True)), [*keys, "cls"], "left").join(has, keys, "left")
    return j.where(c("_in").isNotNull() | (c(conf) >= sure) | c("_has").isNull()).select(*boxes.columns)


def real_tag(tag: Column) -> Column:
    """True for a tag of plausible shape that is no stop word."""
    u = F.upper(F.trim(F.coalesce(tag, F.lit(""))))
    return u.rlike(V.TAG_LIKE) & ~u.isin(V.NOISE_TAGS)


def without_pages(rows: DataFrame, pages: DataFrame, keys: list[str], drop_types: list[str]) -> DataFrame:
    return rows.join(pages.where(c("type").isin(drop_types)).select(*keys).distinct(), keys, "left_anti")


def is_schedule_page(text: Column, need: int = 4) -> Column:
    """The word, a tag header and enough property words: a schedule table, not prose about one."""
    u = F.upper(text)
    return (u.contains("SCHEDULE") & has_any(u, V.SCHEDULE_PAGE_TAG_HEADERS)
            & (hits(u, V.SCHEDULE_PAGE_PROPERTIES) >= need))


def keep_or_all(rows: DataFrame, keys: list[str], tests: list[Column]) -> DataFrame:
    """Per group the rows passing the first test that any row passes; all rows if none does."""
    flags = [F.max(t.cast("int")).alias(f"_any{i}") for i, t in enumerate(tests)]
    per = rows.groupBy(*keys).agg(*flags)
    keep = first_match([(c(f"_any{i}") == 1, t) for i, t in enumerate(tests)], True)
    return rows.join(per, keys).where(keep).select(*rows.columns)


def first_pages(pages: DataFrame, keys: list[str], types: list[str], n: int | None = None) -> DataFrame:
    """Pages per document ranked by type: listed types in order, then plan pages; the first ``n`` if given."""
    rank = first_match([(c("type") == ty, F.lit(i)) for i, ty in enumerate(types)], F.when(c("is_plan"), F.lit(len(types))))
    w = Window.partitionBy(*keys).orderBy("_rank", "page_no")
    r = pages.withColumn("_rank", rank).where("_rank is not null").withColumn("position", F.row_number().over(w))
    return (r if n is None else r.where(c("position") <= n)).drop("_rank")


def common_classes(rows: DataFrame, cls: str, least: int = 30) -> DataFrame:
    """Rows of classes with at least ``least`` examples."""
    keep = rows.groupBy(cls).agg(F.count("*").alias("_n")).where(c("_n") >= least).select(cls)
    return rows.join(keep, cls, "left_semi")


def class_index(rows: DataFrame, cls: str, known: list[str], least: int = 30) -> DataFrame:
    """Index of every common class: known ones in their order, then by count. Class lists are short."""
    n = rows.groupBy(cls).agg(F.count("*").alias("n")).where(c("n") >= least)
    place = first_match([(c(cls) == k, F.lit(i)) for i, k in enumerate(known)], F.lit(len(known)))
    w = Window.orderBy(place, F.desc("n"), cls)
    return n.withColumn("idx", F.row_number().over(w) - 1)


def leakage_guard(rows: DataFrame, name: Column, bench_text: DataFrame, text: str, shortest: int = 4) -> DataFrame:
    """Rows whose name holds no word (of at least ``shortest`` letters) of a benchmark text.

    Words are looked for in the different names by their rarest gram of ``shortest`` letters.
    """
    words = bench_text.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{%d,})" % shortest), 1)).alias("w")).distinct()
    ids = rows.withColumn("_name", F.lower(name))
    hit = containing(ids, words, [], "_name", "w", shortest).select("_name").distinct()
    return ids.join(hit, "_name", "left_anti").select(*rows.columns)


def own_trade_schedule(name: Column) -> Column:
    """False for glossaries and for schedules of other trades that name none of ours."""
    u = F.upper(F.coalesce(name, F.lit("")))
    other = has_any(u, V.OTHER_TRADE_SCHEDULES) & ~has_any(u, V.OWN_TRADE_WORDS)
    return ~has_any(u, V.GLOSSARY_WORDS) & ~other


def product_filter(name: Column, include: list[str], exclude: list[str]) -> Column:
    u = F.upper(name)
    return has_any(u, include) & ~has_any(u, exclude)


def source_precedence(primary: DataFrame, secondary: DataFrame, keys: list[str], below: int = 5) -> DataFrame:
    """Per document the secondary extraction only where the primary has fewer than ``below`` rows and
    the secondary has more of them."""
    both = primary.withColumn("origin", F.lit("primary")).unionByName(secondary.withColumn("origin", F.lit("secondary")))
    n = both.groupBy(*keys).agg(F.sum((c("origin") == "primary").cast("int")).alias("_p"), F.sum((c("origin") == "secondary").cast("int")).alias("_s"))
    use = F.when((c("_p") < below) & (c("_s") > c("_p")), "secondary").otherwise("primary")
    return both.join(n, keys).where(c("origin") == use).drop("_p", "_s")


def fallback_if_empty(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Secondary rows only for documents the primary has none of."""
    extra = secondary.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(extra.withColumn("origin", F.lit("secondary")))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Keep or drop each page from its discipline and its content type.

    A known discipline decides; without one the page stays unless its content is surely a document
    sheet. Of the kept, a sure document sheet still drops, plans stay, and the rest stays at 0.5.
    """
    disc = F.upper(F.coalesce("discipline", F.lit("")))
    doc_sure = F.coalesce(c("ctype").isin(V.DOC_TYPES) & (c("cconf") >= 0.70), F.lit(False))
    plan = F.coalesce(c("ctype").isin(V.PLAN_TYPES), F.lit(False))
    own = first_match([(disc.isin(V.OWN_DISCIPLINES), True), (disc.isin(V.KNOWN_DISCIPLINES), False)], plan | ~doc_sure)
    return pages.withColumn("own", own).withColumns({
        "is_plan": c("own") & ~doc_sure,
        "verdict": F.when(~c("own"), F.coalesce("ctype", F.lit("non_plan"))).otherwise(F.coalesce("ctype", F.lit("plan"))),
        "confidence": F.when(~c("own"), F.lit(0.85)).when(doc_sure, c("cconf")).when(plan, F.greatest(F.lit(0.8), c("cconf"))).otherwise(F.lit(0.5)),
        "evidence": F.array_compact(F.array(
            first_match([(disc.isin(V.OWN_DISCIPLINES), "own discipline"), (disc.isin(V.KNOWN_DISCIPLINES), "other trade")], "no readable number"),
            F.when(c("ctype").isNotNull(), F.concat(F.lit("content="), c("ctype"))))),
    })


def readiness(docs: DataFrame) -> DataFrame:
    """Verdict and expected seconds of a document from four stage checks and its page counts."""
    blockers = F.array_compact(F.array(
        F.when(~c("pdf_ok"), F.lit("unreadable")), F.when(~c("sheets_ok") & c("pdf_ok"), F.lit("no plan pages")),
        F.when(~c("sheets_ok") & ~c("pdf_ok"), F.lit("sheet filter failed"))))
    warnings = F.array_compact(F.array(
        F.when(~c("schedule_ok"), F.lit("no schedule rows")), F.when(~c("title_ok"), F.lit("no title block"))))
    return docs.withColumns({"blockers": blockers, "warnings": warnings}).withColumns({
        "status": F.when(F.size("blockers") > 0, "WILL_LIKELY_FAIL").when(F.size("warnings") > 0, "PROCEED_WITH_WARNINGS").otherwise("READY"),
        "seconds": c("plan_pages") * 8 + c("ocr_pages") * 1.5 + c("schedule_s") + 20,
    })


def agreement_gate(boxes: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """Status, confidence, flags and evidence of a detection from three signals: what was seen, what
    text was read, what the schedule lists.

    ``boxes``: cls, tag, method, conf, tag_conf (0..1); ``schedule``: tag, cls. Classes are assumed
    normalised. A class counts as scheduled if any scheduled class is compatible with it.
    """
    from markgrid.functions.keys import alias_set, classes_compatible

    tag_class = schedule.groupBy(*keys, "tag").agg(F.min_by("cls", F.struct("row_no", "cls")).alias("tag_cls"))
    # close the alias relation once over the few distinct classes of each document
    listed = schedule.select(*keys, "cls").distinct().select(*keys, F.explode(alias_set(c("cls"))).alias("cls"))
    reverse = {}
    for k, v in V.CLASS_ALIASES.items():
        for x in v if isinstance(v, list) else [v]:
            reverse.setdefault(x, []).append(k)
    entries = [x for k, v in reverse.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
    back = schedule.select(*keys, "cls").distinct().select(*keys, F.explode(F.try_element_at(F.create_map(*entries), c("cls"))).alias("cls"))
    plausible = listed.unionByName(back).distinct().withColumn("cls_ok", F.lit(True))
    j = boxes.join(tag_class, [*keys, "tag"], "left").join(plausible, [*keys, "cls"], "left")
    has = F.coalesce(F.trim("tag") != "", F.lit(False))
    known, cls_ok = c("tag_cls").isNotNull(), c("cls_ok").isNotNull()
    agrees = known & classes_compatible(c("cls"), c("tag_cls"))
    text = has & F.coalesce(c("method").isin(V.TEXT_METHODS), F.lit(False))
    conf, tconf = F.coalesce("conf", F.lit(0.0)), F.coalesce("tag_conf", F.lit(0.0))
    status = F.when(text & agrees, "confirmed").when(has & ~agrees, "flagged").otherwise("needs_review")
    score = (F.when(text & agrees, F.least(F.lit(0.99), 0.80 + 0.19 * ((conf + tconf) / 2)))
             .when(has & ~known, 0.30 * conf).when(has & ~agrees, 0.40 * conf)
             .otherwise(0.35 + 0.45 * F.when(cls_ok, conf).otherwise(0.6 * conf)))
    ev = lambda s, v, x: F.struct(s.alias("source"), v.alias("value"), x.cast("double").alias("conf"))
    return j.withColumns({
        "status": status, "confidence": score,
        "flags": F.array_compact(F.array(F.when(has & ~known, F.lit("tag_not_in_schedule")), F.when(~cls_ok, F.lit("class_not_in_schedule")),
                                         F.when(has & known & ~agrees, F.lit("class_tag_mismatch")))),
        "evidence": F.array_compact(F.array(
            ev(F.lit("vision"), c("cls"), conf), F.when(has, ev(F.coalesce("method", F.lit("tag")), c("tag"), tconf)),
            F.when(known, ev(F.lit("schedule"), c("tag"), F.lit(1.0))))),
    }).drop("tag_cls", "cls_ok")


def status_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.sum((c("status") == s).cast("int")).alias(s) for s in ("confirmed", "needs_review", "flagged")]
    ).withColumn("confirmed_rate", c("confirmed") / c("total"))


def top_flags(items: DataFrame, n: int = 6) -> DataFrame:
    return items.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(n)
