"""Counts, summaries, votes and scores over boxes, tags and pages.

All are hash aggregates with partial aggregation before the shuffle, so a value that holds a third
of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions import vocab as V
from markgrid.functions.common import first_match, hits, rate
from markgrid.functions.keys import class_of_tag
from markgrid.functions.text import page_type_of_title

c = F.col


def mode_of(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per key, the smallest on a tie; counts first, then picks."""
    n = df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-c("_n"), c(value))).alias(out), F.max("_n").alias("votes"), F.count("*").alias("n_values"))


def class_counts(boxes: DataFrame, keys: list[str], conf: str = "conf_pct") -> DataFrame:
    return boxes.groupBy(*keys, "cls").agg(F.count("*").alias("n"), F.count("tag").alias("n_tagged"), F.countDistinct("tag").alias("n_tags"), F.avg(conf).alias("mean_conf"))


def class_tag_counts(boxes: DataFrame, keys: list[str], conf: str = "conf_pct") -> DataFrame:
    named = boxes.withColumn("tag", F.coalesce("tag", F.lit("(no-tag)")))
    return named.groupBy(*keys, "cls", "tag").agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"))


def takeoff_rows(boxes: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity rows: one per (class, tag, neck) read on the plan, one for what is left of a (class,
    tag), and one of quantity 1 for every scheduled tag that was not seen.

    ``schedule``: keys, cls, tag and, if it has them, ``neck`` and ``type`` (of several the least counts). ``pages``
    lists the pages of the class and tag in order; ``shown_neck`` is the neck read, else the schedule's;
    ``product`` is the schedule's type for air devices where it describes one, else the class.
    """
    b = boxes.withColumn("tag", F.coalesce("tag", F.lit(""))).withColumn("neck", F.coalesce("neck", F.lit("")))
    rows = b.groupBy(*keys, "cls", "tag", "neck").agg(
        F.count("*").alias("qty"), F.countDistinct("page_no").alias("n_pages"), F.min("page_no").alias("first_page"))
    kind = F.when(c("neck") != "", "neck").otherwise("remainder")
    unseen = schedule.select(*keys, "cls", "tag").distinct().join(b.where("tag <> ''").select(*keys, "tag").distinct(), [*keys, "tag"], "left_anti")
    out = rows.withColumn("kind", kind).unionByName(unseen.select(
        *keys, "cls", "tag", F.lit("").alias("neck"), F.lit(1).cast("bigint").alias("qty"), F.lit(0).cast("bigint").alias("n_pages"),
        F.lit(None).cast("bigint").alias("first_page"), F.lit("schedule_only").alias("kind")))
    # distinct pages of one tag of one document: as many as the document has pages at most
    pages = b.groupBy(*keys, "cls", "tag").agg(F.array_join(F.array_sort(F.collect_set("page_no")), ", ").alias("pages"))
    own = [F.min(name).alias("_" + name) if name in schedule.columns else F.lit(None).cast("string").alias("_" + name) for name in ("neck", "type")]
    known = schedule.where("tag is not null").groupBy(*keys, "tag").agg(*own)
    j = out.join(pages, [*keys, "cls", "tag"], "left").join(known, [*keys, "tag"], "left")
    described = c("cls").startswith("AD-") & (F.trim("_type").contains(" ") | F.upper("_type").rlike(V.AIR_DEVICE_WORDS))
    return j.select(
        *out.columns, F.coalesce("pages", F.lit("")).alias("pages"), F.when(c("neck") != "", c("neck")).otherwise(F.coalesce("_neck", F.lit(""))).alias("shown_neck"),
        F.when(described, F.trim("_type")).otherwise(c("cls")).alias("product"))


def totals(rows: DataFrame, keys: list[str], level: str, qty: str = "qty") -> DataFrame:
    """Per-level subtotals and a grand total (``is_total``) per key."""
    g = [*keys, level]
    sets = [[c(x) for x in g], [c(x) for x in keys]]
    return rows.groupingSets(sets, *[c(x) for x in g]).agg(F.sum(qty).alias("total"), F.grouping(level).cast("boolean").alias("is_total"))


def instance_or_sum(rows: DataFrame, keys: list[str], qty: str = "qty", cfm: str = "cfm") -> DataFrame:
    """Quantity of a key: rows counted where quantity is missing, else summed; flow total with hits."""
    return rows.groupBy(*keys).agg(
        F.sum(F.coalesce(c(qty), F.lit(1))).alias("total_qty"), F.sum(F.coalesce(c(cfm), F.lit(0))).alias("total_cfm"),
        F.count(cfm).alias("cfm_hits"))


def three_way_quantities(rows: DataFrame, product: str, tag: str, qty: str = "qty") -> DataFrame:
    """Quantities by product, by (product, tag) and by tag, in one pass; blank tags leave the tag views."""
    sets = [[c(product)], [c(product), c(tag)], [c(tag)]]
    level = first_match([(F.grouping(tag) == 1, "product"), (F.grouping(product) == 1, "tag")], "product_tag")
    g = rows.groupingSets(sets, c(product), c(tag)).agg(F.sum(qty).alias("total"), level.alias("level"))
    return g.where((c("level") == "product") | (F.coalesce(c(tag), F.lit("")) != ""))


def bucket_stats(boxes: DataFrame, keys: list[str], conf: str, label: str) -> DataFrame:
    s = boxes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(conf).alias("min_conf"), F.max(conf).alias("max_conf"))
    return s.join(mode_of(boxes, keys, label, label).select(*keys, label), keys, "left")


def matrix(boxes: DataFrame, rows: list[str], across: str, values: list) -> DataFrame:
    """Counts by rows x values with a total. The values are given, so no pass is needed to find them."""
    g = boxes.groupBy(*rows).agg(*[F.sum((c(across) == v).cast("bigint")).alias(f"n_{i}") for i, v in enumerate(values)], F.count("*").alias("total"))
    return g


def majority(votes: DataFrame, keys: list[str], value: str, strong: str) -> DataFrame:
    """Majority value; votes flagged ``strong`` form the pool wherever a group has any.

    Confidence 0.6, or 0.85 with strong votes; +0.1 when unanimous, +0.05 from three votes.
    """
    v = votes.where(c(value).isNotNull())
    n = v.groupBy(*keys, strong, value).agg(F.count("*").alias("_n"))
    top = n.groupBy(*keys, strong).agg(F.min_by(value, F.struct(-c("_n"), c(value))).alias("majority"), F.max("_n").alias("votes"), F.count("*").alias("n_values"))
    best = top.groupBy(*keys).agg(F.max_by(F.struct("majority", "votes", "n_values", strong), strong).alias("_p")).select(*keys, "_p.*")
    base = F.when(c(strong), 0.85).otherwise(0.6) + F.when(c("n_values") == 1, 0.1).otherwise(0.0) + F.when(c("votes") >= 3, 0.05).otherwise(0.0)
    return best.withColumn("confidence", F.least(F.lit(0.99), base)).withColumnRenamed(strong, "strong_pool")


def outliers(votes: DataFrame, best: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value is missing or differs from their group's majority."""
    j = votes.join(best.select(*keys, "majority"), keys)
    kind = F.when(c(value).isNull(), "missing").when(c(value) != c("majority"), "differs")
    return j.withColumn("kind", kind).where("kind is not null")


def drawing_style(instances: DataFrame, keys: list[str]) -> DataFrame:
    """How a document labels its items, by the share of extraction methods."""
    share = lambda ms: F.sum(c("method").isin(ms).cast("int"))
    g = instances.groupBy(*keys).agg(F.count("*").alias("n"), share(["ocr_fallback", "ocr_rescue"]).alias("ocr"), share(["combined_label"]).alias("combined"),
                                     share(["bare_mark", "bare_mark_no_size", "letter_only_mark", "letter_only_mark_no_sz"]).alias("bare"))
    style = first_match([(c("ocr") == c("n"), "ocr_only"), (c("combined") >= 0.75 * c("n"), "combined_label"), (c("bare") >= 0.75 * c("n"), "bare_mark"),
                         ((c("combined") > 0) & (c("bare") > 0), "mixed")], "combined_label")
    return g.withColumn("style", style)


def page_type_scores(text: Column) -> list[Column]:
    """Number of voting phrases per page type found in the page text, in page-type order."""
    u = F.upper(text)
    return [(hits(u, V.PAGE_WORDS[p]) if p in V.PAGE_WORDS else F.lit(0)).alias("s_" + p) for p in V.PAGE_TYPES]


def sheet_vote(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The sheet number a page names most often (ties to the smallest), as its own number."""
    found = texts.select(*keys, F.explode(F.regexp_extract_all(F.upper(text), F.lit(r"\b(M[0-9]{3,4})\b"), 1)).alias("sheet"))
    return mode_of(found, keys, "sheet", "sheet").select(*keys, "sheet")


def page_types(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Page type from phrase votes, the page's own sheet number, tables, detections and path density.

    ``pages``: keys, text, title, n_tables, n_boxes (null before detection), n_paths. A readable title
    decides at once unless it names a document sheet full of detections; then a plan number or a dense
    drawing; else the type with most evidence wins, its confidence being the margin, and many
    detections overrule types that hold few.
    """
    p = pages.join(sheet_vote(pages, keys, text), keys, "left").select("*", *page_type_scores(c(text)))
    u, t = F.upper(c(text)), c
    num = F.substring("sheet", 2, 9).try_cast("int")
    votes = {x: t("s_" + x) for x in V.PAGE_TYPES}
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    cover = (num < 100) | t("sheet").startswith("M00")
    votes["cover"] += one(cover)
    by_number_floor = one(~cover & (num.between(100, 199) | num.between(300, 499)))
    by_number_roof = one(~cover & num.between(200, 299))
    votes["details"] += one(~cover & (num >= 500))
    # numbers outside the usual form only say that this is such a sheet; its words say which
    odd = t("sheet").isNull() & u.rlike(r"\bM[A-Z]?-?[0-9]{1,4}\b")
    plan_word, roof_word = u.contains("PLAN"), u.contains("ROOF")
    by_number_floor += one(odd & plan_word & ~roof_word)
    by_number_roof += one(odd & plan_word & roof_word)
    votes["schedule"] += one(odd & ~plan_word & u.contains("SCHEDULE"))
    votes["details"] += one(odd & ~plan_word & ~u.contains("SCHEDULE") & u.contains("DETAILS"))
    own_plan = (by_number_floor + by_number_roof) > 0
    votes["schedule"] += one(~own_plan & ((t("n_tables") >= 5) | ((t("n_tables") >= 3) & (votes["schedule"] > 0))))
    words = F.size(F.filter(F.split(c(text), r"\s+"), lambda w: w != ""))
    few = (t("n_boxes") >= 3) & (t("n_tables") <= 4) & (words < 100)
    votes["mechanical_plan"] += by_number_floor + one((t("n_boxes") >= 10) | few)
    votes["roof_plan"] += by_number_roof
    balance = u.contains("AIR BALANCE")
    votes["air_balance"] += one(balance)
    votes["schedule"] += one(balance & (votes["schedule"] == 0))
    dense = (t("n_paths") >= 8000) & (words <= 800) & (t("n_paths") / F.greatest(F.lit(1), words) >= 10)
    votes["roof_plan"] += one(dense & u.contains("ROOF"))
    votes["mechanical_plan"] += one(dense & ~u.contains("ROOF"))
    p = p.withColumns({**{"v_" + k: v for k, v in votes.items()}, "own_plan": own_plan, "dense": F.coalesce(dense, F.lit(False)), "n_words": words})
    ranked = F.array_sort(F.array(*[F.struct((-t("v_" + x)).alias("neg"), F.lit(i).alias("ord"), F.lit(x).alias("type")) for i, x in enumerate(V.PAGE_TYPES)]))
    p = p.withColumn("_r", ranked)
    top, second = -t("_r")[0]["neg"], -t("_r")[1]["neg"]
    none = F.when((t("n_words") < 30) & (F.coalesce("n_boxes", F.lit(0)) > 0), "mechanical_plan").otherwise("other")
    won = F.when(top == 0, none).otherwise(t("_r")[0]["type"])
    n_top = F.when(top == 0, 1).otherwise(top)
    many = lambda n, types: (F.coalesce(t("n_boxes"), F.lit(0)) >= n) & won.isin(types)
    over = many(10, ["cover", "legend", "riser_diagram"]) | many(20, ["schedule", "air_balance", "details", "other"])
    sure = t("own_plan") | t("dense")
    titled = page_type_of_title(t("title"))
    use_title = titled.isNotNull() & (titled.isin(V.PLAN_TYPES) | (F.coalesce(t("n_boxes"), F.lit(0)) < 20))
    kind = F.when(use_title, titled).when(sure, F.when(t("v_roof_plan") > 0, "roof_plan").otherwise("mechanical_plan")).when(over, "mechanical_plan").otherwise(won)
    conf = F.when(use_title, 0.95).when(sure | (second == 0), 1.0).otherwise(F.greatest(F.lit(0.0), (n_top - second) / n_top))
    return p.select(*keys, kind.alias("type"), conf.alias("confidence"), "n_words", F.coalesce(kind.isin(V.PLAN_TYPES), F.lit(False)).alias("is_plan"))


def richest(rows: DataFrame, keys: list[str], size: Column, order: str) -> DataFrame:
    """The row with most properties per key, the earliest on a tie."""
    row = F.min_by(F.struct(*rows.columns), F.struct(-size, c(order))).alias("_row")
    return rows.groupBy(*keys).agg(row).select("_row.*")


def preferred_class(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Class of a tag: one that its prefix implies, else the first non-empty, else the first."""
    fits = F.coalesce(c("cls") == class_of_tag(c("tag")), F.lit(False))
    rank = first_match([(fits, 0), (F.coalesce(c("cls"), F.lit("")) != "", 1)], 2)
    return rows.groupBy(*keys, "tag").agg(F.min_by("cls", F.struct(rank, c("row_no"), c("cls"))).alias("cls"))


DIFFUSER_PREFIXES = ["SD", "RG", "EG", "TG", "SR", "CD"]
DIFFUSER_CONTEXT = ["RG", "EG", "TG", "SR", "CD"]


def discovered_tags(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Tags read at least twice; two-letter diffuser prefixes mean air devices where others are around."""
    pat = r"^([A-Z]{1,3})-?(\d{1,2})$"
    u = F.replace(F.upper(F.trim("text")), F.lit(" "), F.lit(""))
    t = texts.withColumn("_u", u).where(c("_u").rlike(pat))
    t = t.select(*keys, F.regexp_extract("_u", pat, 1).alias("prefix"), F.concat(F.regexp_extract("_u", pat, 1), F.lit("-"), F.regexp_extract("_u", pat, 2)).alias("tag"))
    seen = t.groupBy(*keys, "prefix", "tag").agg(F.count("*").alias("n")).where("n >= 2")
    ctx = seen.groupBy(*keys).agg(F.max(c("prefix").isin(DIFFUSER_CONTEXT)).alias("ctx"))
    from markgrid.functions.common import lookup

    known = lookup(V.TAG_PREFIX_CLASS, c("prefix"))
    cls = F.when(c("ctx") & c("prefix").isin(DIFFUSER_PREFIXES), "AD-GRD").otherwise(F.coalesce(known, F.when(c("prefix").isin(DIFFUSER_PREFIXES), "AD-GRD")))
    return seen.join(ctx, keys).withColumn("cls", cls).where("cls is not null").select(*keys, "tag", "n", "cls")


def severity_counts(checks: DataFrame, low_pages: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings by severity, low-confidence page types included."""
    low = low_pages.where("confidence < 0.5").select(*keys, F.lit("low").alias("severity"))
    return checks.select(*keys, "severity").unionByName(low).groupBy(*keys, "severity").agg(F.count("*").alias("n"))


def headline(rows: DataFrame, value: str) -> DataFrame:
    """Count, maximum, upper median and number of at least a half, over a rate between 0 and 1, from exact values.

    The upper median is the row at half the count in sorted order. Rows are counted in ten thousand buckets first; only
    the distinct values of the bucket that holds it are ranked.
    """
    v = rows.where(c(value).isNotNull()).select(c(value).cast("double").alias("v")).withColumn("b", F.floor(c("v") * 10_000))
    per = v.groupBy("b").agg(F.count("*").alias("n"), F.max("v").alias("max"), F.sum((c("v") >= 0.5).cast("bigint")).alias("half"))
    w = Window.partitionBy()
    run = per.select("b", "n", F.sum("n").over(Window.orderBy("b")).alias("cum"), F.sum("n").over(w).alias("total"), F.max("max").over(w).alias("max"), F.sum("half").over(w).alias("at_least_half"))
    at = run.where((c("cum") > F.floor(c("total") / 2)) & (c("cum") - c("n") <= F.floor(c("total") / 2)))
    inside = v.join(at.select("b", "total", "max", "at_least_half", (F.floor(c("total") / 2) - c("cum") + c("n")).alias("skip")), "b")
    distinct = inside.groupBy("v", "total", "max", "at_least_half", "skip").agg(F.count("*").alias("k"))
    ranked = distinct.withColumn("upto", F.sum("k").over(Window.partitionBy("total").orderBy("v")))
    return ranked.where("upto > skip").groupBy("total", "max", "at_least_half").agg(F.min("v").alias("upper_median"))


def text_health(words: DataFrame, keys: list[str], broken: Column, share: float = 0.2, few: int = 10) -> DataFrame:
    """Pages whose words are mostly undecodable, or that have hardly any."""
    g = words.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(broken.cast("int")).alias("n_broken"))
    return g.withColumn("health", first_match([(c("n_broken") >= share * c("n"), "undecoded"), (c("n") < few, "sparse")], "ok"))


def class_dictionary(rows: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """Long form of class -> tag -> properties: the last row of a (class, tag) counts."""
    from markgrid.operators.reconcile import last_wins

    r = last_wins(rows.select(*keys, "cls", "tag", "row_no", *props), [*keys, "cls", "tag"], "row_no")
    kv = F.explode(F.array(*[F.struct(F.lit(p).alias("k"), c(p).cast("string").alias("v")) for p in props])).alias("p")
    return r.select(*keys, "cls", "tag", kv).select(*keys, "cls", "tag", "p.k", "p.v").where("v is not null")


def best_page(pages: DataFrame, keys: list[str], words: Column, labels: Column, strong: int = 4, weak: int = 2) -> DataFrame:
    """Best page by 2*words + labels, under a strict rule, else a loose one, else any with a word."""
    s = pages.withColumns({"_w": words, "_l": labels}).withColumn("score", 2 * c("_w") + c("_l"))
    rule = first_match([((c("_w") >= 1) & (c("score") >= strong), F.lit(1)), (c("score") >= weak, F.lit(2)), (c("_w") >= 1, F.lit(3))])
    r = s.withColumn("rule", rule).where("rule is not null")
    return r.groupBy(*keys).agg(F.min(F.struct("rule", -c("score"), "page_no")).alias("_p")).select(*keys, "_p.rule", "_p.page_no")


def side_by_side(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Counts per key of several result sets, one column each."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, [d.select(*keys, F.lit(n).alias("_src")) for n, d in parts.items()])
    return both.groupBy(*keys).agg(*[F.sum((c("_src") == n).cast("bigint")).alias(n) for n in parts])


def value_recovery(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: distinct true and found values, how many agree, hit flag and covered share of rows.

    ``truth`` and ``found`` hold keys and value.
    """
    from markgrid.operators.reconcile import stacked

    v = stacked(truth, found, [*keys, "value"], {"t": ("l", "1"), "f": ("r", "1")})
    g = v.groupBy(*keys).agg(
        F.sum((c("t") > 0).cast("int")).alias("n_true"), F.sum((c("f") > 0).cast("int")).alias("n_found"),
        F.sum(((c("t") > 0) & (c("f") > 0)).cast("int")).alias("n_both"), F.sum("f").alias("rows_found"), F.sum(F.when(c("t") > 0, c("f")).otherwise(0)).alias("rows_right"))
    return g.withColumns({"hit": c("n_both") > 0, "coverage": rate(c("rows_right"), c("rows_found"))})


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int | None = None) -> DataFrame:
    """Rows ranked per key; the first n if given, where Spark prunes each task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("position", F.row_number().over(w))
    return ranked if n is None else ranked.where(c("position") <= n)


def both_ends(rows: DataFrame, order: list[str], score: str, n: int) -> DataFrame:
    """The n best and n worst rows by score."""
    top = rows.orderBy(F.desc(score), *order).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(score), *order).limit(n).withColumn("end", F.lit("bottom")))


def by_rank(rows: DataFrame, status: str, order: list[str], then: list[str]) -> DataFrame:
    """Sorted by a given order of status values."""
    return rows.orderBy(first_match([(c(status) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order))), *then)


def legend_hits(text: Column) -> Column:
    return hits(F.upper(text), ["LEGEND", "SYMBOL", "ABBREVIATION"])
