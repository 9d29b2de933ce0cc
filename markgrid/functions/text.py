"""Sizes, numbers, scales, dates, titles and notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markgrid.functions import vocab as V
from markgrid.functions.common import bind, first_match, group, has_any, lookup, squeeze, tier

NUM = r"(\d+(?:\.\d+)?)"
ROUND_SIZE = rf'^\s*{NUM}\s*"\s*$'
RECT_SIZE = rf"^\s*{NUM}\s*[/xX]\s*{NUM}\s*$"


def _short(n: Column) -> Column:
    """10.50 as 10.5, 10.0 as 10."""
    return F.when(n.contains("."), F.regexp_replace(n, r"\.?0*$", "")).otherwise(n)


def canonical_size(raw: Column) -> Column:
    """'12"' as round:12, '22X10' or '22/10' as rect:22x10, else null."""
    rnd = F.concat(F.lit("round:"), _short(group(raw, ROUND_SIZE)))
    rect = F.concat(F.lit("rect:"), _short(group(raw, RECT_SIZE, 1)), F.lit("x"), _short(group(raw, RECT_SIZE, 2)))
    return F.coalesce(rnd, rect)


def display_size(canon: Column) -> Column:
    c = F.coalesce(canon, F.lit(""))
    return (
        F.when(c.startswith("round:"), F.concat(F.substr(c, F.lit(7)), F.lit('"')))
        .when(c.startswith("rect:"), F.replace(F.substr(c, F.lit(6)), F.lit("x"), F.lit("/")))
        .otherwise(c)
    )


def comparable_size(raw: Column) -> Column:
    """Inch marks dropped, separators to x, null placeholders kept."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(s == ".", s).otherwise(F.trim(F.translate(F.regexp_replace(s, "[\"']", ""), "×X/", "xxx")))


def neck_key(raw: Column) -> Column:
    """Neck sizes of all sources under one key: 8, 10x10."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "(?i)^(round:|rect:)", "")
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, "[\"'″]", "")), " INCH| inch", ""))
    pat = rf"^{NUM}\s*[xX/]\s*{NUM}$"
    return F.when(s.rlike(pat), F.concat(F.regexp_extract(s, pat, 1), F.lit("x"), F.regexp_extract(s, pat, 2))).otherwise(s)


def plausible_size(canon: Column, lo: float = 2, hi: float = 36) -> Column:
    dims = F.split(F.regexp_replace(canon, "^(round:|rect:)", ""), "x")
    ok = F.forall(dims, lambda d: F.coalesce(d.try_cast("double").between(lo, hi), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def size_and_flow(raw: Column, split_above: float = 30) -> Column:
    """Struct(size, cfm) of a plan label token; null when it is no plausible size.

    '8x8/170' carries a flow; so does '6/100', since no side is above the split.
    """
    t = F.trim(raw)
    lone_inch = t.endswith('"') & ~t.rlike("[xX/]")
    t = F.when(lone_inch, t).otherwise(F.replace(t, F.lit('"'), F.lit("")))
    triple, pair = r"^(\d+(?:\.\d+)?[xX]\d+(?:\.\d+)?)/(\d{2,5})$", rf"^{NUM}/{NUM}$"

    def parse(s: Column) -> Column:
        second = F.regexp_extract(s, pair, 2).try_cast("double")
        flows = s.rlike(pair) & (second > split_above)
        size = (
            F.when(s.rlike(triple), canonical_size(F.regexp_extract(s, triple, 1)))
            .when(flows, canonical_size(F.concat(F.regexp_extract(s, pair, 1), F.lit('"'))))
            .otherwise(canonical_size(s))
        )
        cfm = F.when(s.rlike(triple), F.regexp_extract(s, triple, 2).try_cast("int")).when(flows, second.cast("int"))
        return bind(size, lambda z: F.when(plausible_size(z), F.struct(z.alias("size"), cfm.alias("cfm"))))

    # every size begins with a digit, so most words are settled by one look
    return F.when(t.rlike(r"^\s*\d"), bind(t, parse))


def first_number(text: Column) -> Column:
    return group(text, NUM).try_cast("double")


def cfm_value(text: Column) -> Column:
    """Flow with units and brackets stripped."""
    return F.regexp_replace(F.upper(F.trim(text)), r"[()CFM\s]", "").try_cast("double")


def integer_2_to_6(text: Column) -> Column:
    return group(text, r"\b(\d{2,6})\b").try_cast("int")


def word_reading(text: Column) -> Column:
    """Struct(size, cfm, neck) that one word near a symbol may state."""
    t = F.upper(F.trim(text))
    return F.struct(
        F.coalesce(group(t, r'^(\d{1,3})"?$'), group(t, r"^(\d{1,3}[xX]\d{1,3})$")).alias("size"),
        group(t, r"^(\d{2,4})\s*(?:CFM|L/S)?$").alias("cfm"),
        group(t, r'^(\d{1,3})"?[ØO]?$').alias("neck"),
    )


def expected_shape(type_text: Column) -> Column:
    u = F.upper(F.coalesce(type_text, F.lit("")))
    return first_match([
        (has_any(u, ["SIDEWALL", "SIDE WALL", "DUCT", "GRILLE", "REGISTER", "LINEAR"]), "rect"),
        (has_any(u, ["PLAQUE", "DIFFUSER", "CEILING", "ROUND"]), "round"),
    ])


def shape_of_size(size: Column) -> Column:
    return F.when(F.upper(size).contains("X"), "rect").otherwise("round")


def read_size(text: Column) -> Column:
    """A printed size: 12X10 or 8", null otherwise."""
    t = F.upper(F.trim(text))
    rect = r'^(\d+)\s*["″]?\s*X\s*(\d+)\s*["″]?$'
    rnd = r'^(\d+(?:\.\d+)?)\s*["″′]\s*[ØøOo⌀]?$'
    return (
        F.when(t.rlike(rect), F.concat(F.regexp_extract(t, rect, 1), F.lit("X"), F.regexp_extract(t, rect, 2)))
        .when(t.rlike(rnd), F.concat(F.regexp_extract(t, rnd, 1), F.lit('"')))
    )


def brand_and_model(both: Column, brand: Column, model: Column) -> tuple[Column, Column]:
    """Split 'MAKE / MODEL' at the slash, else at the first space; fall back to own columns."""
    b = F.coalesce(both, F.lit(""))
    sep = F.when(b.contains(" / "), F.lit(" / ")).otherwise(F.lit(" "))
    at = F.instr(b, " / ")
    sp = F.instr(b, " ")
    cutoff = F.when(at > 0, at).when(sp > 0, sp)
    head = F.when(cutoff.isNull(), b).otherwise(b.substr(F.lit(1), cutoff - 1))
    tail = F.when(cutoff.isNull(), F.lit("")).otherwise(b.substr(cutoff + F.length(sep), F.length(b)))
    return F.when(b != "", head).otherwise(brand), F.when(b != "", tail).otherwise(model)


def neck_or_size(neck: Column, size: Column, module: Column, duct: Column) -> Column:
    """A general size column is the neck unless it repeats the module or duct size."""
    blank = F.coalesce(neck, F.lit("")) == ""
    other = ~size.isin("") & ~F.coalesce(size == module, F.lit(False)) & ~F.coalesce(size == duct, F.lit(False))
    return F.when(~blank, neck).when(other, size).otherwise(F.lit(""))


def implied_mounting(mounting: Column, type_text: Column) -> Column:
    u = F.upper(F.coalesce(type_text, F.lit("")))
    implied = first_match([
        (u.contains("DUCT"), "DUCT"), (u.contains("SIDEWALL"), "SURFACE"),
        (has_any(u, ["LAY-IN", "LAY IN", "T-BAR", "T BAR"]), "LAY-IN"),
    ], "")
    return F.when(F.coalesce(mounting, F.lit("")) != "", mounting).otherwise(implied)


PRODUCT_WORDS = (
    r"(?i)DIFFUSER|GRILLE|REGISTER|LINEAR|LAY-?IN|EGGCRATE|LOUVER|SLOT|SUPPLY|RETURN|EXHAUST|T-?BAR|CEILING|"
    r"PERFORATED|DEFLECTION|FACE|PLAQUE|DRUM|NOZZLE|ADJUSTABLE|FIXED|SIDEWALL"
)


def product_name(cls: Column, type_text: Column) -> Column:
    """Air devices take a descriptive schedule type as their product name."""
    t = F.trim(F.coalesce(type_text, F.lit("")))
    wordy = t.rlike(PRODUCT_WORDS) | t.contains(" ")
    return F.when(cls.startswith("AD-") & (t != "") & wordy, t).otherwise(cls)


def slot_width(cls: Column, tag: Column, model: Column) -> Column:
    """Slot width that a model name implies, for linear devices only."""
    c, t = F.upper(F.coalesce(cls, F.lit(""))), F.upper(F.coalesce(tag, F.lit("")))
    linear = has_any(c, ["LINEAR", "SLOT"]) | t.rlike("^(LD|LSD|L-)")
    width = F.coalesce(
        group(model, r"(?i)\bAS(\d)"), group(model, r"(?i)\b(\d)\s*[-/]\s*SLOT"),
        group(model, r"(?i)\b(\d+(?:\.\d+)?)[\"'\s]+SLOT"))
    return F.when(linear, width.try_cast("double"))


NO_SCALE = r"(?i)\bAS\s*NOTED\b|\bNTS\b|\bN\.T\.S\.|\bSCALE\s*:\s*(NONE|NO|N/A)\b|\bNOT\s+TO\s+SCALE\b"
INCH_FOOT = r"(\d+/\d+|\d+(?:\.\d+)?)\s*\"?\s*=\s*(\d+)\s*'"
METRIC = r"\b1\s*:\s*(\d{2,4})\b"


def parse_scale(text: Column) -> Column:
    """Struct(kind, drawing_in, feet, ratio): no_scale, imperial or metric; null without a scale."""
    n = F.regexp_extract(text, INCH_FOOT, 1)
    top, bottom = F.substring_index(n, "/", 1).try_cast("double"), group(n, r"/(\d+)$").try_cast("double")
    inches = F.when(bottom.isNull(), top).when(bottom != 0, top / bottom)
    kind = first_match([
        (text.rlike(NO_SCALE), "no_scale"), (text.rlike(INCH_FOOT) & inches.isNotNull(), "imperial"),
        (text.rlike(METRIC), "metric"),
    ])
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"),
        F.when(kind == "imperial", inches).alias("drawing_in"),
        F.when(kind == "imperial", F.regexp_extract(text, INCH_FOOT, 2).try_cast("int")).alias("feet"),
        F.when(kind == "metric", F.regexp_extract(text, METRIC, 1).try_cast("int")).alias("ratio"),
    ))


def px_per_unit(scale: Column, dpi: float) -> Column:
    """Pixels per real foot (imperial) or metre (metric)."""
    return F.when(scale["kind"] == "imperial", scale["drawing_in"] * dpi / scale["feet"]).when(
        scale["kind"] == "metric", dpi / 25.4 * 1000.0 / scale["ratio"])


def parse_date(text: Column) -> Column:
    """m-d-y (two-digit years turn at 70) or y-m-d with . - / separators; null if neither is a date."""
    mdy, ymd = r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})", r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"
    g = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    y = g(mdy, 3)
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)

    def real(yy: Column, mm: Column, dd: Column) -> Column:
        s = F.format_string("%04d-%02d-%02d", yy, mm, dd)
        return F.when(yy.isNotNull(), s.try_cast("date"))

    return F.coalesce(real(year, g(mdy, 1), g(mdy, 2)), real(g(ymd, 1), g(ymd, 2), g(ymd, 3)))


BAD_FIELD_START = (r"(?i)^(?:ISSUE(?:D)?\b|NOT\b|FOR\b|TO\s+BE\b|APPROVED\b|REVIEWED\b|SEE\b|DESCRIPTION\b|NO\.\b"
                   r"|NOTES?\b|BY\b)")


def clean_field(value: Column) -> Column:
    """Trimmed of colons and dashes, spaces squeezed; null if too short or a known non-value."""
    v = squeeze(F.regexp_replace(F.trim(value), "^[:=-]+|[:=-]+$", ""))
    return F.when((F.length(v) >= 2) & ~v.rlike(BAD_FIELD_START), v)


def valid_field(field: Column, value: Column) -> Column:
    """Field-specific validity of a cleaned value."""
    v, n = value, F.length(value)
    small = ["of", "by", "the", "and", "to", "for", "a", "an", "as", "no", "or"]
    rules = {
        "scale": v.rlike(r"(?i)[0-9/][\"']|NTS|N\.T\.S|AS\s+NOTED|NONE"),
        "date": v.rlike(r"[0-9]{1,2}[\-/.][0-9]{1,2}[\-/.][0-9]{2,4}|[A-Z][a-z]+\s+\d{1,2}[,\s]+\d{4}"),
        "sheet": v.rlike(r"^[A-Z]{1,3}[\-.]?[0-9]{1,4}(?:\.[0-9]+)?$"),
        "revision": v.rlike(r"^[0-9]{1,3}$|^[A-Z]$"),
        "project": (n >= 5) & ~v.rlike(
            r"(?i)^(?:Project|Job|Sheet|Drawing|Date|Scale|Revision)\s*(?:Name|Number|Title|No\.?)?$"),
        "engineer": n.between(2, 40) & ~v.rlike(r"\d{3,}") & ~v.rlike(r"(?i)^(?:DRAWN|DESIGNED|CHECKED)\s+BY$")
        & v.rlike("[A-Z]") & ~F.lower(v).isin(small),
        "firm": n >= 4,
    }
    return first_match([(field == k, r) for k, r in rules.items()], True)


def page_type_of_title(title: Column) -> Column:
    u = F.upper(F.coalesce(title, F.lit("")))
    return first_match([
        (has_any(u, ["LEGEND", "SYMBOL", "ABBREV"]), "legend"), (u.contains("SCHEDULE"), "schedule"),
        (u.contains("DETAIL"), "details"), (has_any(u, ["RISER", "DIAGRAM", "ONE LINE"]), "riser_diagram"),
        (u.contains("NOTES"), "notes"), (u.contains("PLAN") & u.contains("ROOF"), "roof_plan"),
        (u.contains("PLAN"), "mechanical_plan"), (has_any(u, ["COVER", "TITLE SHEET"]), "cover"),
    ])


def sheet_series(number: Column) -> Column:
    """Leading series digit(s) of a sheet number; null where the number tells nothing."""
    s = F.upper(F.trim(number))
    whole = group(s, r"^[A-Z]{1,3}[\s\-.]?(\d{3,4})(?:[A-Z]|\.\d+)?$").try_cast("int")
    dotted = group(s, r"^[A-Z]{1,3}[\s\-]?(\d{1,2})\.\d{1,3}[A-Z]?$").try_cast("int")
    return F.coalesce(F.floor(whole / 100).cast("int"), dotted)


def plan_by_sheet_number(number: Column) -> Column:
    """Series 1 to 4 are plans, 0 and 5 up are not, unknown stays null."""
    s = sheet_series(number)
    return F.when(s.isNotNull(), s.between(1, 4))


def discipline_of(prefix: Column) -> Column:
    p = F.upper(F.coalesce(prefix, F.lit("")))
    return F.coalesce(lookup(V.DISCIPLINE_NAMES, p), lookup(V.DISCIPLINE_NAMES, F.substring(p, 1, 2)),
                      lookup(V.DISCIPLINE_NAMES, F.substring(p, 1, 1)), F.lit("Unknown"))


def plan_by_title(title: Column) -> Column:
    """False where the title names a non-plan sheet, true where it names a plan, else null."""
    u = F.upper(F.coalesce(title, F.lit("")))
    return first_match([(has_any(u, V.NON_PLAN_TITLES), False), (u.contains("PLAN"), True)])


def sheet_is_plan(number: Column, discipline: Column, title: Column, page_text: Column) -> Column:
    """Sheet decision: without a number the page text decides, other trades drop, then title, then
    series; a sheet nothing speaks against stays."""
    u = F.upper(F.coalesce(page_text, F.lit("")))
    return (
        F.when(F.coalesce(number, F.lit("")) == "", has_any(u, ["MECHANICAL PLAN", "HVAC PLAN"]))
        .when(~F.coalesce(F.upper(discipline).isin(V.OWN_DISCIPLINES), F.lit(False)), False)
        .otherwise(F.coalesce(plan_by_title(title), plan_by_sheet_number(number), F.lit(True)))
    )


def room_label(text: Column) -> Column:
    """Struct(label, kind, confidence) of a room label, null for other text and for tags."""
    s = F.trim(text)
    number = s.rlike(r"^\d{2,4}[A-Z]?$")
    named = s.rlike(r"(?i)\b(?:" + "|".join(V.ROOM_WORDS) + r")\b") & (F.length(s) < 50)

    def label(v: Column, kind: str, conf: float) -> Column:
        return F.struct(v.alias("label"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))

    return (
        F.when(s.rlike(V.TAG_LIKE), F.lit(None))
        .when(s.rlike(V.ROOM_PREFIXED), label(F.concat(F.lit("ROOM "), F.regexp_extract(s, V.ROOM_PREFIXED, 1)), "room_number_prefixed", 0.95))
        .when(number & s.rlike(r"^\d{3,}"), label(s, "room_number", 0.7))
        .when(~number & named, label(s, "room_name", 0.8))
    )


def legend_entry(line: Column) -> Column:
    """Struct(abbr, term) of 'TERM (ABBR)' or 'ABBR = TERM'."""
    s = squeeze(line)
    prose = has_any(F.upper(s), V.NOTE_WORDS)
    term = F.regexp_replace(F.regexp_extract(s, V.ABBREVIATION_LINE, 1), r"^[ .,\-]+|[ .,\-]+$", "")
    tail = s.rlike(V.ABBREVIATION_LINE) & ~prose & term.rlike("[A-Za-z]{2,}")
    meaning = F.trim(F.regexp_extract(s, V.LEGEND_LINE, 2))
    head = s.rlike(V.LEGEND_LINE) & (F.length(meaning) > 3)
    make = lambda a, t: F.struct(a.alias("abbr"), t.alias("term"))
    return F.when(tail, make(F.regexp_extract(s, V.ABBREVIATION_LINE, 2), term)).when(
        head, make(F.regexp_extract(s, V.LEGEND_LINE, 1), meaning))


def note_line(line: Column) -> Column:
    """Struct(number, text) of a numbered note line."""
    num, body = F.regexp_extract(line, V.NOTE_LINE, 1).try_cast("int"), F.trim(F.regexp_extract(line, V.NOTE_LINE, 2))
    ok = line.rlike(V.NOTE_LINE) & (num <= 100) & (F.length(body) >= 3)
    return F.when(ok, F.struct(num.alias("number"), body.alias("text")))


def callout_number(text: Column) -> Column:
    n = group(F.trim(text), V.CALLOUT).try_cast("int")
    return F.when(n.between(1, 100), n)


def document_phrases(text: Column) -> dict[str, Column]:
    """Watermark, issue type and content blocks that a text announces."""
    u = F.upper(text)
    blocks = [F.when(has_any(u, ws), F.lit(name)) for name, ws in V.CONTENT_BLOCKS.items()]
    return {
        "watermark": first_match([(u.contains(w), w) for w in V.WATERMARKS]),
        "issue_type": first_match([(u.rlike(p), name) for name, p in V.ISSUE_TYPES]),
        "blocks": F.array_compact(F.array(*blocks)),
    }


def units_of(nic: Column, typ_of: Column) -> Column:
    """Billable units: none when not in contract, N for 'typical of N', else one."""
    return F.when(nic, F.lit(0)).when(typ_of > 1, typ_of).otherwise(F.lit(1))


def size_tier(conf: Column) -> Column:
    return tier(conf, V.SIZE_TIERS, V.SIZE_TIER_FLOOR)


def conf_near_text(dist_pt: Column, strength: Column, is_text: Column, reach: float = 72.0) -> Column:
    fall = F.greatest(F.lit(0.5), 1.0 - (dist_pt - 50) / (reach - 50) * 0.5)
    near = F.when(dist_pt < 50, F.lit(1.0)).otherwise(fall)
    return F.when(is_text, 0.95).otherwise(0.75) * near * F.coalesce(lookup(V.NEAR_TEXT_PATTERN_FACTOR, strength), F.lit(0.6))


def conf_schedule(ocr_conf: Column, strength: Column) -> Column:
    return 0.90 * ocr_conf * F.coalesce(lookup(V.SCHEDULE_MATCH_FACTOR, strength), F.lit(0.5))


def conf_ocr(ocr_conf: Column, dist_px: Column, strength: Column) -> Column:
    near = F.when(dist_px < 200, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1.0 - (dist_px - 200) / 400 * 0.5))
    return 0.80 * ocr_conf * near * F.coalesce(lookup(V.OCR_PATTERN_FACTOR, strength), F.lit(0.6))


def conf_band(cfm: Column, lo: Column, hi: Column, table_size: Column) -> Column:
    half = F.greatest(F.lit(1.0), (hi - lo) / 2)
    edge = F.greatest(F.lit(0.5), 1.0 - F.abs(cfm - (lo + hi) / 2) / half * 0.5)
    return 0.55 * edge * F.when(table_size < 4, 0.75).when(table_size >= 8, 1.0).otherwise(0.85)


def first_property(props: Column, words: list[str], by: str = "column", exact: bool = False) -> Column:
    """Value of an ordered array of (k, v) pairs whose key holds one of the words.

    ``by='column'`` takes the first such column; ``by='word'`` the first word that any column
    holds. ``exact`` compares whole keys.
    """
    def matches(k: Column, ws: list[str]) -> Column:
        u = squeeze(F.upper(k))
        return u.isin(ws) if exact else has_any(u, ws)

    pick = lambda ws: F.get(F.filter(props, lambda p: matches(p["k"], ws)), F.lit(0))["v"]
    return pick(words) if by == "column" else F.coalesce(*[pick([w]) for w in words])
