"""Two-sided comparison: expected with observed, one table with another, one revision with the next.

Where both sides are reduced by the same key, they are stacked and grouped once instead of being
grouped apart and outer-joined: one shuffle of partly aggregated rows, and no skewed join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions import vocab as V
from markgrid.functions.common import rate, tier
from markgrid.functions.keys import canonical_tag
from markgrid.operators.inside import containing
from markgrid.operators.spatial import overlap_pairs
from markgrid.session import cut

c = F.col


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the highest ``order``."""
    rest = [x for x in df.columns if x not in keys]
    row = F.max_by(F.struct(*[c(x) for x in rest]), c(order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*").select(*df.columns)


def stacked(left: DataFrame, right: DataFrame, keys: list[str], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Both sides grouped by ``keys`` at once. ``sums`` maps an output to (side l|r, column or '1')."""
    def side(df: DataFrame, name: str) -> DataFrame:
        vals = [(F.lit(1) if col == "1" else c(col)).cast("bigint").alias(out) if s == name
                else F.lit(0).cast("bigint").alias(out) for out, (s, col) in sums.items()]
        return df.select(*keys, *vals)

    both = side(left, "l").unionByName(side(right, "r"))
    return both.groupBy(*keys).agg(*[F.sum(out).alias(out) for out in sums])


def tag_presence(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per canonical tag: how often each side has it and how each side writes it."""
    e = expected.where("tag is not null").select(*keys, canonical_tag(c("tag")).alias("canon"), c("tag").alias("e_tag"),
                                                 F.lit(None).cast("string").alias("o_tag"))
    o = observed.where("tag is not null").select(*keys, canonical_tag(c("tag")).alias("canon"), F.lit(None).cast("string").alias("e_tag"),
                                                 c("tag").alias("o_tag"))
    return e.unionByName(o).groupBy(*keys, "canon").agg(
        F.count("e_tag").alias("n_exp"), F.count("o_tag").alias("n_obs"),
        F.min("e_tag").alias("e_tag"), F.min("o_tag").alias("o_tag"))


def tag_cross_reference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Tags that only one side has, as that side writes them."""
    p = tag_presence(expected, observed, keys).where("n_exp = 0 or n_obs = 0")
    return p.select(*keys, F.coalesce("e_tag", "o_tag").alias("tag"),
                    F.when(c("n_obs") == 0, "missing_on_plan").otherwise("orphan").alias("verdict"))


def class_reconciliation(expected: DataFrame, observed: DataFrame, keys: list[str], unique: list[str],
                         conf: str = "conf_pct") -> DataFrame:
    """Distinct expected tags against detections, per class.

    Status: match, under or over for classes counted one by one; orphan_class for such a class that
    no schedule lists; info for the rest.
    """
    e = expected.select(*keys, "cls", canonical_tag(c("tag")).alias("canon"), F.lit(1).alias("e"), F.lit(0).alias("o"),
                        F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n"))
    o = observed.select(*keys, "cls", canonical_tag(c("tag")).alias("canon"), F.lit(0).alias("e"), F.lit(1).alias("o"),
                        F.coalesce(c(conf), F.lit(0)).cast("bigint").alias("s"), c(conf).isNotNull().cast("int").alias("n"))
    per_tag = e.unionByName(o).groupBy(*keys, "cls", "canon").agg(
        F.max("e").alias("e"), F.sum("o").alias("o"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    named = c("canon") != ""
    rows = per_tag.groupBy(*keys, "cls").agg(
        F.sum(F.when(named, c("e")).otherwise(0)).alias("expected"), F.sum("o").alias("detected"),
        F.sum(F.when(named & (c("e") == 1) & (c("o") == 0), 1).otherwise(0)).alias("n_missing"),
        F.sum("s").alias("conf_sum"), F.sum("n").alias("conf_n"))
    counted, delta = c("cls").isin(unique), c("detected") - c("expected")
    status = (F.when(~counted, "info").when(c("expected") == 0, F.when(c("detected") > 0, "orphan_class").otherwise("info"))
              .when(delta == 0, "match").when(delta < 0, "under").otherwise("over"))
    shown = F.when(~counted & (c("expected") == 0), 0).otherwise(delta)
    return rows.withColumns({"delta": shown, "status": status, "counted": counted,
                             "mean_conf": F.when(c("conf_n") > 0, c("conf_sum") / c("conf_n"))})


def missing_by_class(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected tags of a class that no detection of that class carries."""
    k = [*keys, "cls", "canon"]
    e = expected.withColumn("canon", canonical_tag(c("tag"))).groupBy(*k).agg(F.min("tag").alias("tag"))
    o = observed.select(*keys, "cls", canonical_tag(c("tag")).alias("canon")).distinct()
    return e.join(o, k, "left_anti").drop("canon")


def trust(class_rows: DataFrame, presence: DataFrame, keys: list[str], conf_scale: float = 100.0) -> DataFrame:
    """Weighted trust over the components a document has: count match, tag presence, mean confidence."""
    per_cls = class_rows.groupBy(*keys).agg(
        F.sum((c("counted") & (c("expected") > 0)).cast("int")).alias("n_cls"),
        F.sum((c("counted") & (c("expected") > 0) & (c("status") == "match")).cast("int")).alias("n_match"),
        F.sum("conf_sum").alias("conf_sum"), F.sum("conf_n").alias("conf_n"),
        F.sum((c("status") == "under").cast("int")).alias("classes_under"),
        F.sum(c("status").isin("over", "orphan_class").cast("int")).alias("classes_over"))
    per_tag = presence.groupBy(*keys).agg(
        F.sum((c("n_exp") > 0).cast("int")).alias("scheduled"),
        F.sum(((c("n_exp") > 0) & (c("n_obs") > 0)).cast("int")).alias("found"),
        F.sum((c("n_obs") > 0).cast("int")).alias("detected_tags"))
    d = per_cls.join(per_tag, keys, "full_outer")
    w = V.TRUST_WEIGHTS
    parts = {
        "count_match_rate": F.when(c("n_cls") > 0, c("n_match") / c("n_cls")),
        "tag_presence_rate": F.when(c("scheduled") > 0, c("found") / c("scheduled")),
        "mean_detection_conf": F.when(c("conf_n") > 0, c("conf_sum") / c("conf_n") / conf_scale),
    }
    d = d.withColumns(parts)
    total = reduce(Column.__add__, [F.coalesce(c(k) * w[k], F.lit(0.0)) for k in w])
    weight = reduce(Column.__add__, [F.when(c(k).isNotNull(), w[k]).otherwise(0.0) for k in w])
    d = d.withColumn("score", F.when(weight > 0, total / weight))
    return d.withColumn("tier", F.when(c("score").isNull(), "UNKNOWN").otherwise(tier(c("score"), V.TRUST_TIERS, "LOW")))


def failure_modes(class_rows: DataFrame, presence: DataFrame, keys: list[str]) -> DataFrame:
    """Which kinds of disagreement a document shows, one row per kind."""
    by_cls = class_rows.where(c("status").isin("under", "over", "orphan_class")).select(*keys, c("status").alias("mode"))
    by_tag = presence.select(*keys, F.when(c("n_exp") == 0, "orphan_tag").when(c("n_obs") == 0, "missing_tag").alias("mode")).where("mode is not null")
    return by_cls.unionByName(by_tag).groupBy(*keys, "mode").agg(F.count("*").alias("n"))


def keyed_diff(team: DataFrame, ours: DataFrame, keys: list[str], counts: list[str], both_known: list[str]) -> DataFrame:
    """MATCH, DIFF, MISSING (team only) or EXTRA (ours only) per key, with the fields that differ.

    ``counts`` are always compared; ``both_known`` only where both sides state a value (not 0).
    """
    t = team.select(*keys, *[c(x).alias("t_" + x) for x in [*counts, *both_known]], F.lit(True).alias("in_t"))
    o = ours.select(*keys, *[c(x).alias("o_" + x) for x in [*counts, *both_known]], F.lit(True).alias("in_o"))
    j = t.join(o, keys, "full_outer")
    diff = [F.when(c("t_" + x) != c("o_" + x), F.lit(x)) for x in counts]
    diff += [F.when((c("t_" + x) != 0) & (c("o_" + x) != 0) & (c("t_" + x) != c("o_" + x)), F.lit(x)) for x in both_known]
    j = j.withColumn("diffs", F.array_compact(F.array(*diff)))
    status = F.when(c("in_o").isNull(), "MISSING").when(c("in_t").isNull(), "EXTRA").when(F.size("diffs") > 0, "DIFF").otherwise("MATCH")
    return j.withColumn("status", status).drop("in_t", "in_o")


def quantity_diff(team: DataFrame, ours: DataFrame, keys: list[str], qty: str = "qty") -> DataFrame:
    j = stacked(team, ours, keys, {"team": ("l", qty), "ours": ("r", qty)})
    status = (F.when(c("team") == c("ours"), "MATCH").when(c("team") == 0, "EXTRA").when(c("ours") == 0, "MISSING").otherwise("DIFF"))
    return j.withColumns({"delta": c("ours") - c("team"), "status": status})


def quantity_score(team: DataFrame, ours: DataFrame, keys: list[str], qty: str = "qty") -> DataFrame:
    """Recall and precision of summed minima over the keys, one row."""
    j = stacked(team, ours, keys, {"team": ("l", qty), "ours": ("r", qty)})
    s = j.agg(F.sum("team").alias("team_total"), F.sum("ours").alias("ours_total"), F.sum(F.least("team", "ours")).alias("matched"))
    return s.withColumns({"recall": rate(c("matched"), c("team_total")), "precision": rate(c("matched"), c("ours_total"))})


def attribute_lookup(rows: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Attributes by raw tag, else by canonical tag, else by canonical tag in a second source.

    ``first`` and ``second`` hold ``keys, tag, row_no, *attrs``; the last row of a tag counts.
    """
    def by(src: DataFrame, key: Column, p: str) -> DataFrame:
        s = src.select(*keys, key.alias("_k"), "row_no", *attrs)
        s = last_wins(s, [*keys, "_k"], "row_no")
        return s.select(*keys, "_k", F.struct(*attrs).alias(p))

    canon = canonical_tag(c("tag"))
    out = rows.withColumn("_raw", c("tag")).withColumn("_can", canon)
    for src, key, on, p in ((first, c("tag"), "_raw", "_a"), (first, canon, "_can", "_b"), (second, canon, "_can", "_d")):
        out = out.join(by(src, key, p).withColumnRenamed("_k", on), [*keys, on], "left")
    got = F.coalesce("_a", "_b", "_d")
    via = F.when(c("_a").isNotNull(), "raw").when(c("_b").isNotNull(), "canonical").when(c("_d").isNotNull(), "second")
    return out.withColumn("found_by", via).select(*rows.columns, "found_by", *[got[x].alias(x) for x in attrs])


def bill_of_materials(instances: DataFrame, attributes: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Instances counted by (mark, neck) with flow totals, joined to schedule attributes of the mark."""
    b = instances.groupBy(*keys, "mark", "neck").agg(
        F.count("*").alias("qty"), F.sum(F.coalesce("cfm", F.lit(0))).alias("total_cfm"),
        F.sum(c("cfm").isNull().cast("int")).alias("cfm_missing"))
    a = attributes.select(*keys, c("tag").alias("mark"), *attrs)
    return b.join(a, [*keys, "mark"], "left")


def box_agreement(left: DataFrame, right: DataFrame, keys: list[str], min_iou: float = 0.3) -> DataFrame:
    """Which boxes both detectors found: side (left/right), id, agreed."""
    p = overlap_pairs(left, right, keys, min_iou)
    parts = []
    for side, df, col in (("left", left, "a_det_id"), ("right", right, "b_det_id")):
        hit = p.select(*keys, c(col).alias("det_id")).distinct().withColumn("agreed", F.lit(True))
        got = df.select(*keys, "det_id").join(hit, [*keys, "det_id"], "left")
        parts.append(got.select(F.lit(side).alias("side"), *keys, "det_id", F.coalesce("agreed", F.lit(False)).alias("agreed")))
    return parts[0].unionByName(parts[1])


def reference_integrity(defined: DataFrame, referenced: DataFrame, on: list[str]) -> DataFrame:
    """Numbers defined but never referenced, and referenced but never defined."""
    j = stacked(defined, referenced, on, {"n_def": ("l", "1"), "n_ref": ("r", "1")})
    v = F.when(c("n_ref") == 0, "defined_not_referenced").when(c("n_def") == 0, "referenced_not_defined")
    return j.withColumn("verdict", v).where("verdict is not null")


def mention_check(mentions: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Tags named in page text: 'orphan' when detected nowhere, 'cross' when only on other pages."""
    m = mentions.select(*keys, "tag", "page_no").distinct()
    d = detections.where("tag is not null").select(*keys, "tag", "page_no").distinct()
    here = m.join(d.withColumn("here", F.lit(True)), [*keys, "tag", "page_no"], "left")
    j = here.join(d.select(*keys, "tag").distinct().withColumn("any", F.lit(True)), [*keys, "tag"], "left")
    v = F.when(c("any").isNull(), "orphan").when(c("here").isNull(), "cross").otherwise("same_page")
    return j.select(*keys, "page_no", "tag", v.alias("verdict"))


def index_completeness(index: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Index entries without a sheet (in disciplines that are present) and sheets without an entry.

    Both sides are grouped by sheet at once; only entries without a sheet are looked up again, with their disciplines. Entries and
    sheets without a name are never the same.
    """
    on = [*keys, "sheet"]
    named = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in on])
    p = stacked(index, present, on, {"_i": ("l", "1"), "_p": ("r", "1")})
    lone = F.array_compact(F.array(F.when((c("_i") > 0) & ((c("_p") == 0) | ~named), "missing"), F.when((c("_p") > 0) & ((c("_i") == 0) | ~named), "unlisted")))
    lone = cut(p.select(*on, F.explode(lone).alias("verdict")))
    scope = present.where("discipline <> 'Unknown'").select(*keys, "discipline").distinct()
    asked = index.select(*on, "discipline").distinct().join(scope, [*keys, "discipline"], "left_semi").select(*on).distinct()
    same = reduce(lambda a, b: a & b, [c("m." + k).eqNullSafe(c("s." + k)) for k in on])
    miss = lone.where("verdict = 'missing'").alias("m").join(asked.alias("s"), same, "left_semi")
    return miss.unionByName(lone.where("verdict = 'unlisted'"))


def quality_checks(expected: DataFrame, observed: DataFrame, keys: list[str], qty: str = "exp_qty") -> DataFrame:
    """Warnings with severity: tag without detection, untagged count, quantity missing or off."""
    p = tag_presence(expected, observed, keys)
    q = expected.groupBy(*keys, canonical_tag(c("tag")).alias("canon")).agg(F.max(qty).alias("want"))
    p = cut(p.join(q, [*keys, "canon"], "left"))
    row = lambda sev, kind, df, n: df.select(
        *keys, F.lit(sev).alias("severity") if isinstance(sev, str) else sev.alias("severity"), F.lit(kind).alias("kind"),
        "tag", n.cast("bigint").alias("n"))
    p = p.withColumn("tag", F.coalesce("e_tag", "o_tag"))
    off = F.abs(c("n_obs") - c("want")) >= F.greatest(F.lit(2.0), c("want") * 0.3)
    bare = observed.where("tag is null").groupBy(*keys).agg(F.count("*").alias("k")).withColumn("tag", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [
        row("medium", "tag_in_schedule_not_on_plan", p.where("n_exp > 0 and n_obs = 0"), F.lit(0)),
        row(F.when(c("k") < 20, "low").otherwise("medium"), "untagged_detections", bare, c("k")),
        row("high", "quantity_missing", p.where("want > 0 and n_obs = 0"), c("want")),
        row("medium", "quantity_off", p.where(c("want").isNotNull() & off & ~((c("n_obs") == 0) & (c("want") > 0))), c("n_obs") - c("want")),
    ])


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Tags lost and gained per document between two snapshots, as counts and sorted lists."""
    j = stacked(old, new, [*keys, "tag"], {"o": ("l", "1"), "n": ("r", "1")})
    return j.groupBy(*keys).agg(
        F.sum((c("o") > 0).cast("int")).alias("n_old"), F.sum((c("n") > 0).cast("int")).alias("n_new"),
        F.sum(((c("o") > 0) & (c("n") == 0)).cast("int")).alias("n_lost"), F.sum(((c("o") == 0) & (c("n") > 0)).cast("int")).alias("n_gained"),
        F.array_sort(F.collect_list(F.when(c("n") == 0, c("tag")))).alias("lost"), F.array_sort(F.collect_list(F.when(c("o") == 0, c("tag")))).alias("gained"))


def truth_override(rows: DataFrame, human: DataFrame, keys: list[str], derived: str, ruling: str) -> DataFrame:
    """Human verdict where there is one, else the derived one, else null; with its origin."""
    j = rows.join(human.select(*keys, ruling), keys, "left")
    origin = F.when(c(ruling).isNotNull(), "human").when(c(derived).isNotNull(), "derived").otherwise("unknown")
    return j.withColumns({"truth": F.coalesce(ruling, derived), "origin": origin})


def disagreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which two signals differ, nulls included."""
    return rows.where(~c(a).eqNullSafe(c(b)))


def remap_labels(labels: DataFrame, names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Dataset-local class index to the common one through the class name; unmapped labels drop."""
    m = names.join(vocabulary, "name").select("dataset", "cid", c("canon_cid"))
    return labels.join(m, ["dataset", "cid"])


def direct_assignment(boxes: DataFrame, schedule: DataFrame, keys: list[str], cls_alias: Column) -> DataFrame:
    """Untagged boxes of a class (or its scalar alias) for which the schedule has exactly one tag."""
    one = schedule.groupBy(*keys, "cls").agg(F.min("tag").alias("only"), F.max("tag").alias("top")).where("only = top")
    own = one.select(*keys, "cls", c("only").alias("own_tag"))
    ali = one.select(*keys, c("cls").alias("_alias"), c("only").alias("alias_tag"))
    j = boxes.withColumn("_alias", cls_alias).join(own, [*keys, "cls"], "left").join(ali, [*keys, "_alias"], "left")
    return j.withColumn("direct_tag", F.coalesce("own_tag", "alias_tag")).drop("_alias", "own_tag", "alias_tag")


def refine_by_mode(boxes: DataFrame, schedule: DataFrame, keys: list[str], family: str = "AD-", generic: tuple[str, ...] = ("AD-GRD",)) -> DataFrame:
    """Boxes of a family take the most frequent subtype the schedule gives their tag, if it is of the family and not its
    generic class; a specific class is never replaced by the generic one."""
    n = schedule.groupBy(*keys, "tag", "subtype").agg(F.count("*").alias("n"))
    mode = n.groupBy(*keys, "tag").agg(F.min_by("subtype", F.struct(-c("n"), "subtype")).alias("mode"))
    j = boxes.join(mode, [*keys, "tag"], "left")
    use = F.coalesce(c("cls").startswith(family) & c("mode").startswith(family) & (c("mode") != c("cls")) & ~c("mode").isin(*generic), F.lit(False))
    return j.withColumns({"original_cls": F.when(use, c("cls")), "cls": F.when(use, c("mode")).otherwise(c("cls"))}).drop("mode")


def tag_by_value(readings: DataFrame, properties: DataFrame, keys: list[str], box: tuple[str, ...] = ("det_id",), longest: int = 30) -> DataFrame:
    """Reverse lookup of a read value among schedule property values (last row wins).

    ``readings``: keys, box, ord, value; ``properties``: keys, tag, row_no, value. Values of more than ``longest``
    characters are prose, not readings, and generic words say nothing; neither is looked up.
    """
    v = F.upper(F.trim(F.regexp_replace(c("value"), "[\"']", "")))
    clean = properties.withColumn("value", v).where((c("value") != "") & (F.length("value") <= longest) & ~c("value").isin(V.GENERIC_VALUES))
    table = last_wins(clean.select(*keys, "value", "tag", "row_no"), [*keys, "value"], "row_no").drop("row_no")
    hit = readings.withColumn("value", v).join(table, [*keys, "value"])
    return hit.groupBy(*keys, *box).agg(F.min_by("tag", F.struct("ord", "tag")).alias("tag"))


def match_cascade(texts: DataFrame, tags: DataFrame, keys: list[str], tid: str | list[str], shortest: int = 2) -> DataFrame:
    """Text to scheduled tag: exact, else the part before a separator, else a tag inside the text.

    Later steps run only for texts the earlier ones left; in each the longest, then smallest tag wins. Inside a text,
    tags of ``shortest`` characters or more are looked for, each by its rarest gram of that many characters. Every different
    text of the same keys is matched once, and rows learn its match by one join: ``tid`` names what is returned of a row, its id first of all.
    """
    tid = [tid] if isinstance(tid, str) else list(tid)
    norm = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    tg = tags.select(*keys, "tag", norm(c("tag")).alias("_n")).where("_n <> ''").groupBy(*keys, "_n").agg(F.min("tag").alias("match"))
    tg = cut(tg)
    d = texts.select(*keys, "text").distinct().withColumn("_own", norm(c("text"))).where("_own <> ''")
    # the whole text, then the parts before a separator: one lookup serves both steps
    heads = F.array_compact(F.array(c("_own"), *[F.when(c("text").contains(s), norm(F.substring_index("text", s, 1))) for s in "-/ "]))
    tried = d.select(*keys, "text", F.posexplode(heads).alias("pos", "_n")).join(tg, [*keys, "_n"], "left")
    hit = F.min(F.when(c("match").isNotNull(), F.struct("pos", "match"))).alias("_hit")
    tried = cut(tried.groupBy(*keys, "text").agg(hit).select(*keys, "text", "_hit.pos", "_hit.match"))
    first = tried.where("match is not null").select(*keys, "text", "match", F.when(c("pos") == 0, "exact").otherwise("prefix").alias("strength"))
    rest = tried.where("match is null").select(*keys, "text", norm(c("text")).alias("_n"))
    held = containing(rest, tg.withColumnRenamed("_n", "_tag"), keys, "_n", "_tag", shortest)
    found = held.join(tg.withColumnsRenamed({"_n": "_tag"}), [*keys, "_tag"]).groupBy(*keys, "_n").agg(
        F.min_by("match", F.struct(-F.length("_tag"), "match")).alias("match"))
    inside = rest.join(found, [*keys, "_n"]).select(*keys, "text", "match", F.lit("fuzzy").alias("strength"))
    matched = cut(first.unionByName(inside))
    return texts.select(*keys, *tid, "text").join(matched.hint("merge"), [*keys, "text"]).select(*keys, *tid, "match", "strength")


def supplement(primary: DataFrame, secondary: DataFrame, covered_by: list[str]) -> DataFrame:
    """Primary rows, and secondary rows whose key the primary does not cover."""
    extra = secondary.join(primary.select(*covered_by).distinct(), covered_by, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(extra.withColumn("origin", F.lit("secondary")))


def flow_cross_check(instances: DataFrame, stated: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """Summed flow per group against the stated total, within a relative tolerance."""
    s = instances.groupBy(*keys).agg(F.sum("cfm").alias("read_cfm"), F.count("*").alias("n"))
    j = s.join(stated, keys, "left")
    off = F.abs(c("read_cfm") - c("stated_cfm")) / c("stated_cfm")
    v = F.when(c("stated_cfm").isNull() | (c("stated_cfm") == 0), "no_total").when(off <= tolerance, "ok").otherwise("mismatch")
    return j.withColumn("verdict", v)


def tag_table(bom: DataFrame, boxes: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """One table of every tag from three sources.

    ``bom``: keys, tag, neck, qty, cfm_missing; ``boxes``: keys, cls, tag, neck, units, conf;
    ``schedule``: keys, tag, neck. Four branches: plan rows; neck buckets the plan does not cover;
    what is left of the detections of a class and tag; scheduled tags seen nowhere.
    """
    # all rows of a tag meet in one shuffle; the branches are windows over it: by tag, by tag and neck, by tag and class
    live = boxes.where("units > 0").withColumn("tag", F.upper(F.coalesce("tag", F.lit(""))))
    live = live.groupBy(*keys, "cls", "tag", "neck").agg(F.sum("units").alias("units"), F.count("*").alias("bucket"), F.max("conf").alias("conf"))
    sched = schedule.groupBy(*keys, F.upper("tag").alias("tag")).agg(F.min("neck").alias("sched_neck"))
    rows = bom.select(*keys, F.upper("tag").alias("tag"), "neck", c("qty").cast("bigint").alias("qty"), c("cfm_missing").cast("bigint").alias("cfm_missing"), F.lit("plan").alias("_of")).unionByName(
        live.withColumn("_of", F.lit("box")), allowMissingColumns=True).unionByName(sched.withColumn("_of", F.lit("sched")), allowMissingColumns=True)
    tag, neck, cls = [*keys, "tag"], [*keys, "tag", "neck"], [*keys, "tag", "cls"]
    every = lambda on: Window.partitionBy(*on)
    named = lambda on: reduce(lambda a, b: a & b, [c(k).isNotNull() for k in on])
    is_plan, is_box, is_sched = (c("_of") == x for x in ("plan", "box", "sched"))
    bucket = is_box & F.coalesce(c("neck") != "", F.lit(False))
    none, blank = F.lit(0), F.lit("")
    # nulls are equal to nothing, so what is looked up through them is not there
    seen_in = lambda on, what: F.when(named(on), what.over(every(on)))
    # of several classes under one (tag, neck) the first is shown, of a class's necks the first carries what is left
    in_cls, in_neck = F.struct(~is_box, "neck"), F.struct(c("cls").isNull(), "cls")
    rows = rows.repartition(*tag).withColumns({
        "_all": F.sum(F.when(is_box, c("units"))).over(every(cls)), "_in": seen_in(cls, F.sum(F.when(bucket, c("bucket")))), "_at": F.min(in_cls).over(every(cls)) == in_cls})
    rows = rows.withColumns({
        "neck_qty": seen_in(neck, F.sum(F.when(bucket, c("bucket")))), "neck_conf": seen_in(neck, F.max(F.when(bucket, c("conf")))),
        "_planned": F.coalesce(seen_in(neck, F.max(is_plan)), F.lit(False)), "_rank": F.min(F.when(bucket, in_neck)).over(every(neck)) == in_neck})
    left = c("_all") - F.coalesce("_in", none)
    rows = rows.withColumns({"_r1": is_plan, "_r2": bucket & ~c("_planned") & c("_rank"), "_r3": is_box & c("_at") & (left > 0)})
    rows = rows.withColumns({
        "box_qty": seen_in(tag, F.sum(F.when(is_box, c("units")))), "sched_neck": F.when(is_sched, c("sched_neck")).otherwise(seen_in(tag, F.max("sched_neck"))),
        "scheduled": seen_in(tag, F.max(F.when(is_sched, True))), "_blank": F.coalesce(seen_in(tag, F.max(is_plan & (c("neck") == "") & (c("tag") != ""))), F.lit(False)),
        # a blank plan row hides what is left of a tag, but then the tag is seen by that row
        "_seen": F.coalesce(seen_in(tag, F.max(c("_r1") | c("_r2") | c("_r3"))), F.lit(False))})
    note = F.concat_ws("; ",
                       F.when((c("box_qty") > 0) & (c("qty") != c("box_qty")), F.format_string("plan=%d vs boxes=%d", "qty", "box_qty")),
                       F.when(c("cfm_missing") > 0, F.format_string("%d without flow", "cfm_missing")),
                       F.when((c("tag") != "") & c("scheduled").isNull(), "tag not in schedule"))

    def shape(source, cls, neck, plan, box, note, conf):
        return F.struct(cls.alias("cls"), neck.alias("neck"), plan.cast("bigint").alias("plan_qty"), box.cast("bigint").alias("box_qty"),
                        source.alias("source"), note.alias("discrepancy"), conf.cast("bigint").alias("conf"))

    r1 = shape(F.lit("plan"), blank, c("neck"), c("qty"), F.coalesce("neck_qty", "box_qty", none), note, F.coalesce("neck_conf", none))
    r2 = shape(F.lit("bucket"), c("cls"), c("neck"), none, c("bucket"), blank, c("conf"))
    r3 = shape(F.when(c("tag") == "", "untagged").when(c("scheduled"), "boxes+schedule").otherwise("boxes"), c("cls"),
               F.coalesce("sched_neck", blank), none, left, F.when(c("tag") == "", "untagged").otherwise("no neck size found"), none)
    r4 = shape(F.lit("schedule-only"), blank, F.coalesce("sched_neck", blank), none, none, F.lit("scheduled but no detection"), none)
    out = F.array_compact(F.array(F.when(c("_r1"), r1), F.when(c("_r2"), r2), F.when(c("_r3") & ~c("_blank"), r3), F.when(is_sched & ~c("_seen"), r4)))
    return rows.select(*tag, F.explode(out).alias("_out")).select(*tag, "_out.*")


def tag_table_totals(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum(F.when(c("tag") != "", c("box_qty")).otherwise(0)).alias("tagged"),
        F.sum(F.when(c("tag") == "", c("box_qty")).otherwise(0)).alias("untagged"), F.sum("plan_qty").alias("plan_instances"),
        F.sum((c("discrepancy") != "").cast("int")).alias("with_discrepancy"))


def discrepancies_first(table: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted for reading: discrepancies first, then by tag, blank tags last (a range-partitioned sort).

    The table is written before: the sort reads it twice, once for its bounds."""
    return cut(table).orderBy(*keys, c("discrepancy") == "", F.coalesce(F.nullif("tag", F.lit("")), F.lit("zzz")), "neck", "cls", "source")
