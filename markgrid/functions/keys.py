"""Tags as entity keys: canonical forms, validation, expansion, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markgrid.functions import vocab as V
from markgrid.functions.common import bind, first_match, group, has_any, lookup, squeeze

STATUS_PREFIX = r"(?i)^\(\s*[ERN]\s*\)\s*"
EDGE = r"^[.\-,;:|/]+|[.\-,;:|/]+$"


def canonical_tag(raw: Column) -> Column:
    """Key under which EF1, EF-1, EF 1 and EF.1 are one tag. For joins, not for display."""
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"[\s\-_.]+", "")


def alnum_key(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")


def _fragments(cell: Column) -> Column:
    parts = F.transform(F.split(F.trim(cell), r"\s+"), lambda f: F.regexp_replace(f, EDGE, ""))
    return F.filter(parts, lambda f: f != "")


def _joined_fragments(frags: Column) -> Column:
    """One fragment as it is; of several, the first that starts with a letter and its successor."""
    at = F.array_position(F.transform(frags, lambda f: f.rlike("^[A-Za-z]")), True).cast("int")
    pair = F.when(at > 0, F.array_join(F.slice(frags, at, F.lit(2)), "-"))
    return F.when(F.size(frags) == 1, frags[0]).otherwise(pair)


def _acceptable(s: Column) -> Column:
    known = lambda p: lookup(V.TAG_PREFIX_CLASS, p).isNotNull()
    u = F.upper(s)
    bare = F.regexp_replace(s, "-", "")
    shape = bare.rlike(r"^[A-Za-z][A-Za-z0-9]{0,15}$") | s.rlike(r"^[A-Za-z0-9]+(-[A-Za-z0-9]+){0,2}$")
    sheet = s.rlike(r"^[A-Za-z]\d{3}($|-)")
    sheet2 = s.rlike(r"^[A-Za-z]{2}\d{3}$") & ~known(F.substring(u, 1, 2))
    span = r"^([A-Z]{1,2})\d{3}-([A-Z]{1,2})\d{3}$"
    sheets = u.rlike(span) & ~known(F.regexp_extract(u, span, 1)) & ~known(F.regexp_extract(u, span, 2))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    model = ~s.contains("-") & (F.length(s) > 8) & (letters >= 4)
    wordy = ~s.rlike(r"\d") & (F.length(s) > 2)
    suffix = r"^([A-Z]{1,5})-[A-Z]{1,3}$"
    lettered = u.rlike(suffix) & known(F.regexp_extract(u, suffix, 1))
    return (
        s.rlike("^[A-Za-z]") & shape & F.length(s).between(1, 20)
        & ~u.isin(V.JUNK_TAGS) & ~s.rlike(V.REFRIGERANT) & ~sheet & ~sheet2 & ~sheets & ~model
        & ~F.regexp_extract(u, "^([A-Z]+)", 1).isin(V.BANNED_TAG_PREFIXES)
        & (~wordy | lettered)
    )


def normalise_tag(raw: Column) -> Column:
    """Strict tag form, null for anything that is no equipment tag."""
    body = F.trim(F.regexp_replace(F.trim(raw), STATUS_PREFIX, ""))
    joined = bind(_fragments(body), _joined_fragments)
    return bind(
        F.regexp_replace(joined, r"^[.\-,;:|/ ]+|[.\-,;:|/ ]+$", ""),
        lambda s: F.when(_acceptable(s), F.upper(s)),
    )


def loose_tag(raw: Column) -> Column:
    """Short letter-led token with a digit; for positioned words."""
    s = F.upper(F.trim(raw))
    ok = s.rlike(V.TAG_LIKE) & ~s.isin(V.JUNK_TAGS) & ~s.rlike(V.REFRIGERANT)
    return F.when(ok, s)


def base_tag(raw: Column) -> Column:
    """Compound suffixes and trailing parentheses removed: LD-1-PLENUM is LD-1, F-SLOT is F."""
    u = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), r"\s*\([^)]*\)\s*$", ""))
    marked = r"^([A-Z]{1,4}-?\d{1,4})(?:-[A-Z]{2,}(?:\s+[A-Z]{2,})*(?:\s+[A-Z]+)*)?$"
    return F.coalesce(group(u, marked), group(u, r"^([A-Z]{1,4})-[A-Z]{2,}"), u)


def split_compound(cell: Column) -> Column:
    """'A, B' is two tags; 'AC-1,2' is AC-1 and AC-2."""
    parts = F.filter(F.transform(F.split(cell, "[,;/&]"), lambda p: F.trim(p)), lambda p: p != "")

    def spread(ps: Column) -> Column:
        head = F.trim(F.regexp_replace(F.upper(F.trim(ps[0])), STATUS_PREFIX, ""))
        rest = F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0)))
        numbers = F.forall(rest, lambda p: p.rlike(r"^\d+$"))
        short = head.rlike(r"^[A-Z]+-\d+$") & (F.size(ps) > 1) & numbers
        prefix = F.regexp_extract(head, r"^([A-Z]+)-", 1)
        full = F.concat(F.slice(ps, F.lit(1), F.lit(1)), F.transform(rest, lambda p: F.concat(prefix, F.lit("-"), p)))
        return F.when(short, full).otherwise(ps)

    return F.when(F.size(parts) == 0, parts).otherwise(bind(parts, spread))


def expand_range(cell: Column, widest: int = 100) -> Column:
    """'CU-1 thru CU-6' as six tags; null when the cell is no range."""
    s = squeeze(F.upper(cell))
    pat = r"^([A-Z]{1,4})-?(\d+)\s*(?:THRU|THROUGH|TO|-|\x{2013}|\x{2014})\s*(?:([A-Z]{1,4})-?)?(\d+)$"
    p1, p2 = F.regexp_extract(s, pat, 1), F.regexp_extract(s, pat, 3)
    lo = F.regexp_extract(s, pat, 2).try_cast("bigint")
    hi = F.regexp_extract(s, pat, 4).try_cast("bigint")
    ok = s.rlike(pat) & ((p2 == "") | (p1 == p2)) & (hi >= lo) & (hi - lo <= widest)
    run = F.transform(F.sequence(F.when(ok, lo), F.when(ok, hi)), lambda i: F.concat(p1, F.lit("-"), i.cast("string")))
    return F.when(ok, run)


def one_prefix_many(cell: Column) -> Column:
    """'24 VAV 27' is VAV-24 and VAV-27; null otherwise."""
    def build(fr: Column) -> Column:
        digits = F.filter(fr, lambda f: f.rlike(r"^\d{1,3}$"))
        letters = F.filter(fr, lambda f: f.rlike("^[A-Za-z]{1,5}$"))
        ok = (F.size(fr) >= 3) & (F.size(digits) >= 2) & (F.size(letters) == 1)
        return F.when(ok, F.transform(digits, lambda d: F.concat(F.upper(F.get(letters, F.lit(0))), F.lit("-"), d)))

    return bind(_fragments(cell), build)


def _valid(tags: Column) -> Column:
    return F.filter(F.transform(tags, normalise_tag), lambda t: t.isNotNull())


def expand_tag_cell(cell: Column) -> Column:
    """Every valid tag of a schedule cell: own line each, one prefix with numbers, range, compound."""
    lines = F.filter(F.transform(F.split(F.trim(cell), "\n"), lambda p: F.trim(p)), lambda ln: ln != "")
    tag_line = r"^[A-Za-z]{1,5}-?\d|^[A-Za-z]{2,5}-[A-Za-z0-9]+$"
    by_line = bind(lines, lambda ls: F.when((F.size(ls) > 1) & F.forall(ls, lambda ln: ln.rlike(tag_line)), _valid(ls)))
    other = F.coalesce(one_prefix_many(cell), expand_range(cell), split_compound(cell))
    whole = bind(by_line, lambda v: F.when(F.size(v) > 0, v).otherwise(_valid(other)))
    return F.when(F.trim(cell) != "", whole).otherwise(F.array().cast("array<string>"))


def tag_type(tag: Column) -> Column:
    """Leading capitals, else the part before the first dash."""
    return F.coalesce(group(tag, "^([A-Z]+)"), F.substring_index(tag, "-", 1))


def tags_in_text(text: Column) -> Column:
    """Valid tags inside running text whose prefix names equipment."""
    found = F.transform(F.regexp_extract_all(F.upper(text), F.lit(V.TAG_IN_TEXT), 1), normalise_tag)
    prefixes = [*V.TAG_PREFIX_CLASS, "A", "B", "C", "D"]
    keep = F.filter(found, lambda t: t.isNotNull() & F.regexp_extract(t, "^([A-Z]+)", 1).isin(prefixes))
    return F.array_distinct(keep)


def class_of_tag(tag: Column) -> Column:
    """Class of the longest known prefix of one to four letters."""
    u = F.upper(tag)
    return F.coalesce(*[lookup(V.TAG_PREFIX_CLASS, F.substring(u, 1, n)) for n in (4, 3, 2, 1)])


def close_tags(a: Column, b: Column) -> Column:
    """Equal up to one edit, with OCR letter/digit confusions free in tags of equal length."""
    same = lambda x, y: (
        (x == y) | F.coalesce(lookup(V.OCR_DIGIT, x) == y, F.lit(False)) | F.coalesce(lookup(V.OCR_DIGIT, y) == x, F.lit(False))
    )
    chars = lambda s: F.filter(F.split(s, ""), lambda ch: ch != "")
    wrong = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: same(x, y)), lambda ok: ~ok))
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(a == b, True).when(gap == 0, wrong <= 1).when(gap == 1, F.levenshtein(a, b, 1) >= 0).otherwise(False)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def project_of(stem: Column) -> Column:
    """Project part of a tile stem '<project>__p<page>...': all before the last '__p'."""
    return F.when(stem.contains("__p"), F.regexp_extract(stem, r"(?s)^(.*)__p", 1)).otherwise(stem)


def scalar_alias(cls: Column) -> Column:
    """Alias of a class where it is a single class."""
    return lookup({k: v for k, v in V.CLASS_ALIASES.items() if isinstance(v, str)}, cls)


def alias_set(cls: Column) -> Column:
    """All classes a class may stand for, including itself."""
    table = {k: v if isinstance(v, list) else [v] for k, v in V.CLASS_ALIASES.items()}
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
    more = F.coalesce(F.try_element_at(F.create_map(*entries), cls), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(cls), more))


def read_as(cls: Column) -> Column:
    """All classes that may stand for a class, including itself: :func:`alias_set` the other way round."""
    table: dict[str, list[str]] = {}
    for k, v in V.CLASS_ALIASES.items():
        for y in v if isinstance(v, list) else [v]:
            table.setdefault(y, []).append(k)
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
    more = F.coalesce(F.try_element_at(F.create_map(*entries), cls), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(cls), more))


def classes_compatible(a: Column, b: Column) -> Column:
    """Same class, or one is an alias of the other in either direction."""
    filled = (a != "") & (b != "")
    return F.coalesce(filled & (F.array_contains(alias_set(a), b) | F.array_contains(alias_set(b), a)), F.lit(False))


def class_of_service(service: Column, mounting: Column) -> Column:
    """Class from service and mounting words, first rule wins."""
    s = squeeze(F.upper(service))
    m = F.coalesce(squeeze(F.upper(mounting)), F.lit(""))
    text = F.trim(F.concat(s, F.lit(" "), m))

    def rules(t: Column) -> Column:
        has = t.contains
        lay = has("LAY-IN") | has("T-BAR") | has("TBAR")
        surf = has("SURFACE") | has("EXPOSED")
        return first_match([
            (lay & has("SUPPLY"), "AD-T-BAR SUPPLY"),
            (lay & has("RETURN"), "AD-T-BAR RETURN"),
            (has("CEILING") & has("SUPPLY"), "AD-T-BAR SUPPLY"),
            (has("CEILING") & has("RETURN"), "AD-T-BAR RETURN"),
            (surf & (has("ROUND") | (has("SUPPLY") & ~has("GRILLE"))), "AD-SURF SUPPLY"),
            (surf & has("RETURN"), "AD-SURF RETURN"),
            (has("LINEAR") & has("SLOT"), "AD-LINEAR SLOT DIFFUSER"),
            (has("LINEAR") & has("PLENUM"), "AD-LINEAR PLENUM"),
            (has("FAN") & has("EXHAUST"), "EXHAUST FAN"),
            (has("FAN"), "FAN"),
            (has("LOUVER") & ~has("LOUVERED"), "LOUVER"),
            (has_any(t, V.GRILLE_WORDS), "AD-GRD"),
        ])

    return F.when(service != "", bind(text, rules))


def class_of_row(service: Column, mounting: Column, tag: Column, schedule_name: Column) -> Column:
    """Class of a schedule row: an air-device schedule decides, then a tag prefix of other equipment,
    then the service words, then any tag prefix."""
    by_text, by_tag = class_of_service(service, mounting), class_of_tag(tag)
    air = has_any(F.upper(F.coalesce(schedule_name, F.lit(""))), V.AIR_DEVICE_SCHEDULE_WORDS)
    return (
        F.when(air, F.lit("AD-GRD"))
        .when(by_tag.isNotNull() & ~by_tag.isin(V.AIR_DEVICE_CLASSES), by_tag)
        .otherwise(F.coalesce(by_text, by_tag))
    )


def normalise_class(raw: Column, fold_rare: bool = True) -> Column:
    """Exact synonym, then the first matching pattern, then the rare fold."""
    u = F.trim(F.upper(F.coalesce(raw, F.lit(""))))
    named = F.coalesce(lookup(V.CLASS_SYNONYMS, u), u)
    ruled = lambda c: first_match([(c.rlike(p), target) for p, target in V.CLASS_PATTERNS], c)
    out = bind(named, ruled)
    return F.coalesce(lookup(V.RARE_CLASSES, out), out) if fold_rare else out


def to_vocabulary(raw: Column, vocabulary: list[str]) -> Column:
    """Normalised class if it belongs to the vocabulary, else null (dropped)."""
    c = normalise_class(raw)
    return F.when(c.isin(vocabulary), c)


def family(cls: Column, prefix: str = "AD-", name: str = "AIR DEVICE") -> Column:
    return F.when(cls.startswith(prefix), F.lit(name)).otherwise(cls)


def external_class(cls: Column, table: dict[str, str], fallback: str) -> Column:
    """Class in an outside vocabulary; unknown classes get the fallback, none is dropped."""
    return F.coalesce(lookup(table, cls), lookup(table, normalise_class(cls)), F.lit(fallback))


def class_threshold(cls: Column, default: float = V.DEFAULT_THRESHOLD) -> Column:
    """Threshold tuned for the raw class name, else for its normal form, else the default."""
    u = F.trim(F.upper(F.coalesce(cls, F.lit(""))))
    return F.coalesce(lookup(V.CLASS_THRESHOLDS, u), lookup(V.CLASS_THRESHOLDS, normalise_class(cls)), F.lit(default))
