"""Tag, class, size and text functions over the derived schedule rows."""

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.functions import geom as G
from markgrid.functions import keys as K
from markgrid.functions import text as X
from markgrid.functions import vocab as V
from markgrid.operators.inside import close_pairs

c = F.col


def sql_list(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_case(col, table, otherwise="null"):
    whens = " ".join(f"when '{k}' then '{v}'" if isinstance(v, str) else f"when '{k}' then {v}e0" for k, v in table.items())
    return f"case {col} {whens} else {otherwise} end"


def sql_rules(col, rules, otherwise):
    whens = " ".join(f"when regexp_matches({col}, '{p}') then '{v}'" for p, v in rules)
    return f"case {whens} else {otherwise} end"


def sql_any(col, words):
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


KNOWN = sql_list(V.TAG_PREFIX_CLASS)


def sql_normalise_tag(source: str, raw: str, keep: str) -> str:
    """Steps of tag validation as CTEs n1..n4 ending in ``ntag``."""
    return f"""
n1 as (select {keep}, trim(regexp_replace(trim({raw}), '^\\(\\s*[ERNern]\\s*\\)\\s*', '')) as body from {source}),
n2 as (select {keep}, list_filter(list_transform(regexp_split_to_array(body, '\\s+'),
   lambda f: regexp_replace(f, '^[.\\-,;:|/]+|[.\\-,;:|/]+$', '', 'g')), lambda f: f <> '') as fr from n1),
n3 as (select {keep}, case when len(fr) = 1 then fr[1] else (
   select case when p > 0 then array_to_string(fr[p:p+1], '-') end from (
     select list_position(list_transform(fr, lambda f: regexp_matches(f, '^[A-Za-z]')), true) as p) z) end as s0 from n2),
n4 as (select {keep}, regexp_replace(s0, '^[.\\-,;:|/ ]+|[.\\-,;:|/ ]+$', '', 'g') as s from n3),
n5 as (select {keep}, case when regexp_matches(s, '^[A-Za-z]')
  and (regexp_matches(replace(s, '-', ''), '^[A-Za-z][A-Za-z0-9]{{0,15}}$') or regexp_matches(s, '^[A-Za-z0-9]+(-[A-Za-z0-9]+){{0,2}}$'))
  and length(s) between 1 and 20 and upper(s) not in {sql_list(V.JUNK_TAGS)}
  and not regexp_matches(upper(s), '^R-?\\d{{2,4}}[A-Z]?$')
  and not regexp_matches(s, '^[A-Za-z]\\d{{3}}($|-)')
  and not (regexp_matches(s, '^[A-Za-z]{{2}}\\d{{3}}$') and upper(s[1:2]) not in {KNOWN})
  and not (regexp_matches(upper(s), '^[A-Z]{{1,2}}\\d{{3}}-[A-Z]{{1,2}}\\d{{3}}$')
    and regexp_extract(upper(s), '^([A-Z]{{1,2}})', 1) not in {KNOWN}
    and regexp_extract(upper(s), '-([A-Z]{{1,2}})', 1) not in {KNOWN})
  and not (not contains(s, '-') and length(s) > 8 and length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 4)
  and regexp_extract(upper(s), '^([A-Z]+)', 1) not in {sql_list(V.BANNED_TAG_PREFIXES)}
  and (regexp_matches(s, '\\d') or length(s) <= 2
    or (regexp_matches(upper(s), '^[A-Z]{{1,5}}-[A-Z]{{1,3}}$') and regexp_extract(upper(s), '^([A-Z]+)-', 1) in {KNOWN}))
  then upper(s) end as ntag from n4)"""


CLASS_OF_TAG = "coalesce(" + ", ".join(
    sql_case(f"upper({{tag}})[1:{n}]", V.TAG_PREFIX_CLASS) for n in (4, 3, 2, 1)) + ")"


def sql_class_of_tag(tag):
    return CLASS_OF_TAG.replace("{tag}", tag)


@query("tag_keys", "T1 T2", """
select l_orderkey, l_partkey, l_suppkey, line_no, raw_tag, regexp_replace(upper(raw_tag), '[\\s\\-_.]+', '', 'g') as canon,
 regexp_replace(upper(raw_tag), '[^A-Z0-9]', '', 'g') as alnum from {raw_items}""")
def _(t):
    return t.raw_items.select("l_orderkey", "l_partkey", "l_suppkey", "line_no", "raw_tag",
                              K.canonical_tag(c("raw_tag")).alias("canon"), K.alnum_key(c("raw_tag")).alias("alnum"))


@query("tag_normalise", "T3", "with " + sql_normalise_tag("{raw_items}", "raw_tag", "raw_tag").strip() + """
select raw_tag, ntag, count(*) as n from n5 group by all""")
def _(t):
    return t.raw_items.groupBy("raw_tag").agg(F.count("*").alias("n")).withColumn("ntag", K.normalise_tag(c("raw_tag")))


@query("tag_loose", "T4", f"""
select text, case when regexp_matches(upper(trim(text)), '{V.TAG_LIKE}') and upper(trim(text)) not in {sql_list(V.JUNK_TAGS)}
 and not regexp_matches(upper(trim(text)), '^R-?\\d{{2,4}}[A-Z]?$') then upper(trim(text)) end as tag, count(*) as n
from {{tokens}} group by all""")
def _(t):
    return t.tokens.groupBy("text").agg(F.count("*").alias("n")).withColumn("tag", K.loose_tag(c("text")))


@query("tag_base", "T5", """
with m as (select case l_partkey % 5 when 0 then 'LD-' || (l_suppkey % 9) || '-PLENUM' when 1 then 'F-SLOT DIFFUSER'
  when 2 then 'CD-' || (l_suppkey % 9) || ' (901-1000)' when 3 then 'VAV-' || (l_suppkey % 9) || 'A' else raw_tag end as mark from {raw_items}),
u as (select mark, trim(regexp_replace(upper(trim(mark)), '\\s*\\([^)]*\\)\\s*$', '')) as u from m)
select mark, coalesce(nullif(regexp_extract(u, '^([A-Z]{1,4}-?\\d{1,4})(?:-[A-Z]{2,}(?:\\s+[A-Z]{2,})*(?:\\s+[A-Z]+)*)?$', 1), ''),
  nullif(regexp_extract(u, '^([A-Z]{1,4})-[A-Z]{2,}', 1), ''), u) as base, count(*) as n from u group by all""")
def _(t):
    s = (c("l_suppkey") % 9).cast("string")
    p = c("l_partkey") % 5
    mark = (F.when(p == 0, F.concat(F.lit("LD-"), s, F.lit("-PLENUM"))).when(p == 1, "F-SLOT DIFFUSER")
            .when(p == 2, F.concat(F.lit("CD-"), s, F.lit(" (901-1000)"))).when(p == 3, F.concat(F.lit("VAV-"), s, F.lit("A")))
            .otherwise(c("raw_tag")))
    return t.raw_items.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).withColumn("base", K.base_tag(c("mark")))


@query("tag_cell_expansion", "T6 T7 T8 T9", """
with cells as (select distinct raw_tag from {raw_items}),
parts as (
 select raw_tag, list_filter(list_transform(regexp_split_to_array(raw_tag, '[,;/&]'), lambda x: trim(x)), lambda x: x <> '') as ps,
  list_filter(list_transform(regexp_split_to_array(trim(raw_tag), '\\s+'), lambda f: regexp_replace(f, '^[.\\-,;:|/]+|[.\\-,;:|/]+$', '', 'g')), lambda f: f <> '') as fr,
  upper(raw_tag) as u from cells),
kinds as (select *,
  len(fr) >= 3 and len(list_filter(fr, lambda f: regexp_matches(f, '^\\d{1,3}$'))) >= 2 and len(list_filter(fr, lambda f: regexp_matches(f, '^[A-Za-z]{1,5}$'))) = 1 as many,
  regexp_matches(u, '^[A-Z]{1,4}-?\\d+\\s*(?:THRU|THROUGH|TO|-)\\s*[A-Z]{1,4}-?\\d+$') and regexp_extract(u, '^([A-Z]+)', 1) = regexp_extract(u, '([A-Z]+)-?\\d+$', 1) as ranged from parts),
cand as (
 select raw_tag, unnest(case
  when many then list_transform(list_filter(fr, lambda f: regexp_matches(f, '^\\d{1,3}$')), lambda d: upper(list_filter(fr, lambda f: regexp_matches(f, '^[A-Za-z]{1,5}$'))[1]) || '-' || d)
  when ranged and cast(regexp_extract(u, '(\\d+)$', 1) as int) - cast(regexp_extract(u, '^[A-Z]+-?(\\d+)', 1) as int) between 0 and 100
   then list_transform(generate_series(cast(regexp_extract(u, '^[A-Z]+-?(\\d+)', 1) as int), cast(regexp_extract(u, '(\\d+)$', 1) as int)), lambda i: regexp_extract(u, '^([A-Z]+)', 1) || '-' || i)
  when len(ps) > 1 and regexp_matches(upper(ps[1]), '^[A-Z]+-\\d+$') and len(list_filter(ps[2:], lambda x: not regexp_matches(x, '^\\d+$'))) = 0
   then list_concat(ps[1:1], list_transform(ps[2:], lambda x: regexp_extract(upper(ps[1]), '^([A-Z]+)', 1) || '-' || x))
  else ps end) as cand from kinds),
""" + sql_normalise_tag("cand", "cand", "raw_tag").strip() + """
select raw_tag, ntag as tag from n5 where ntag is not null""")
def _(t):
    cells = t.raw_items.select("raw_tag").distinct()
    return cells.select("raw_tag", F.explode(K.expand_tag_cell(c("raw_tag"))).alias("tag"))


@query("tag_type_counts", "T10 A34", """
with e as (select doc_id, tag, coalesce(nullif(regexp_extract(tag, '^([A-Z]+)', 1), ''), string_split(tag, '-')[1]) as tag_type from {expected})
select doc_id, tag_type, count(*) as n_vars, count(distinct tag) as n_marks from e where tag_type <> 'Q' group by doc_id, tag_type""")
def _(t):
    # schedule summary, one equipment type excluded
    typed = t.expected.withColumn("tag_type", K.tag_type(c("tag"))).where("tag_type <> 'Q'")
    return typed.groupBy("doc_id", "tag_type").agg(F.count("*").alias("n_vars"), F.countDistinct("tag").alias("n_marks"))


@query("tags_in_description", "T11", "with raw as (select l_orderkey, l_partkey, l_suppkey, line_no, unnest(regexp_extract_all(upper(raw_tag || ' SEE ' || raw_tag || ' LD-1-PLENUM'), '\\b([A-Z]{1,4}-?\\d+[A-Z]?(?:-[A-Z]+)?)\\b', 1)) as cand from {raw_items}),"
       + sql_normalise_tag("raw", "cand", "l_orderkey, l_partkey, l_suppkey, line_no") + f"""
select ntag as tag, count(distinct (l_orderkey, l_partkey, l_suppkey, line_no)) as n from n5 where ntag is not null
 and (regexp_extract(ntag, '^([A-Z]+)', 1) in {KNOWN} or regexp_extract(ntag, '^([A-Z]+)', 1) in ('A','B','C','D')) group by all""")
def _(t):
    text = F.concat(c("raw_tag"), F.lit(" SEE "), c("raw_tag"), F.lit(" LD-1-PLENUM"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "line_no"]
    # the same text repeats: read each distinct one once, then count the rows behind it
    by_text = t.raw_items.select(*keys, text.alias("text")).distinct().groupBy("text").agg(F.count("*").alias("n"))
    return by_text.select(F.explode(K.tags_in_text(c("text"))).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))


@query("class_of_tag_prefix", "T12", f"""
select text, {sql_class_of_tag('text')} as cls, count(*) as n from {{tokens}} group by all""")
def _(t):
    return t.tokens.groupBy("text").agg(F.count("*").alias("n")).withColumn("cls", K.class_of_tag(c("text")))


@query("fuzzy_tag_match", "T13", """
with v as (select distinct doc_id, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as a, word_id, page_no from {tokens}),
p as (select doc_id, page_no, word_id, a, case word_id % 5 when 0 then replace(a, '1', 'I') when 1 then replace(a, '0', 'O')
  when 2 then a || '7' when 3 then substr(a, 2) else 'X' || substr(a, 2) end as b from v)
select doc_id, page_no, word_id, a, b, case when a = b then true
 when length(a) = length(b) then len(list_filter(generate_series(1, cast(length(a) as int)), lambda i: a[i] <> b[i] and not (
   coalesce(map {'I':'1','L':'1','O':'0','Q':'0','D':'0','S':'5','Z':'2','B':'8','G':'6','T':'7'}[a[i]] = b[i], false) or
   coalesce(map {'I':'1','L':'1','O':'0','Q':'0','D':'0','S':'5','Z':'2','B':'8','G':'6','T':'7'}[b[i]] = a[i], false)))) <= 1
 when abs(length(a) - length(b)) = 1 then levenshtein(a, b) <= 1 else false end as close from p""")
def _(t):
    a = K.alnum_key(c("text"))
    k = c("word_id") % 5
    b = (F.when(k == 0, F.replace(a, F.lit("1"), F.lit("I"))).when(k == 1, F.replace(a, F.lit("0"), F.lit("O")))
         .when(k == 2, F.concat(a, F.lit("7"))).when(k == 3, F.expr("substr(a, 2)")).otherwise(F.expr("'X' || substr(a, 2)")))
    rows = t.tokens.select("doc_id", "page_no", "word_id", a.alias("a"), "text").select("doc_id", "page_no", "word_id", "a", b.alias("b"))
    return rows.withColumn("close", K.close_tags(c("a"), c("b")))


SQL_OCR = "map {'I':'1','L':'1','O':'0','Q':'0','D':'0','S':'5','Z':'2','B':'8','G':'6','T':'7'}"


@query("fuzzy_tag_join", "T13", f"""
with w as (select distinct doc_id, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as word from {{tokens}}), g as (select distinct doc_id, regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g') as tag from {{expected}})
select doc_id, word, tag from w join g using (doc_id) where word <> '' and tag <> '' and abs(length(word) - length(tag)) <= 1 and case when word = tag then true
 when length(word) = length(tag) then len(list_filter(generate_series(1, cast(length(word) as int)), lambda i: word[i] <> tag[i] and not (
  coalesce({SQL_OCR}[word[i]] = tag[i], false) or coalesce({SQL_OCR}[tag[i]] = word[i], false)))) <= 1 else levenshtein(word, tag) <= 1 end""")
def _(t):
    words = t.tokens.select("doc_id", K.alnum_key(c("text")).alias("word"))
    tags = t.expected.select("doc_id", K.alnum_key(c("tag")).alias("tag"))
    return close_pairs(words, tags, ["doc_id"], "word", "tag")


@query("slug_and_project", "T14", """
with s as (select page_id, url, 'site ' || url || '__p' || page_id as stem from {pages})
select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug, regexp_extract(stem, '(?s)^(.*)__p', 1) as project from s""")
def _(t):
    stem = F.concat(F.lit("site "), c("url"), F.lit("__p"), c("page_id").cast("string"))
    return t.pages.select("page_id", K.slug(c("url")).alias("slug"), K.project_of(stem).alias("project"))


_ALIASES = [(k, x) for k, v in V.CLASS_ALIASES.items() for x in (v if isinstance(v, list) else [v])]


@query("class_alias", "T15", f"""
with al(src, dst) as (values {", ".join(f"('{a}', '{b}')" for a, b in _ALIASES)}),
p as (select distinct a.raw_cls as a, b.cls as b from {{raw_items}} a join (select unnest(['AD-GRD','AD-T-BAR SUPPLY','CONDENSING UNIT','FIRE DAMPER','VAV']) as cls) b on true)
select a, b, a = b or exists (select 1 from al where (src = a and dst = b) or (src = b and dst = a)) as compatible,
 (select min(dst) from al where src = a having count(*) = 1 and a <> 'AD-GRD') as alias from p""")
def _(t):
    other = F.explode(F.array(*[F.lit(x) for x in ("AD-GRD", "AD-T-BAR SUPPLY", "CONDENSING UNIT", "FIRE DAMPER", "VAV")]))
    return t.raw_items.select(c("raw_cls").alias("a")).distinct().select("a", other.alias("b")).select(
        "a", "b", K.classes_compatible(c("a"), c("b")).alias("compatible"), K.scalar_alias(c("a")).alias("alias"))


def sql_normalise_class(raw):
    u = f"trim(upper(coalesce({raw}, '')))"
    named = f"coalesce({sql_case(u, V.CLASS_SYNONYMS)}, {u})"
    ruled = sql_rules("nm", V.CLASS_PATTERNS, "nm")
    return f"(select coalesce({sql_case('rl', V.RARE_CLASSES)}, rl) from (select {ruled} as rl from (select {named} as nm) a) b)"


VOCAB = ["FAN", "LOUVER", "AD-GRD", "AD-LINEAR PLENUM", "AD-LINEAR SLOT DIFFUSER", "FIRE SMOKE DAMPER", "ROOFTOP UNIT"]


@query("class_normalise", "F1 F2 F3 F4 F5", f"""
with k as (select raw_cls, {sql_normalise_class('raw_cls')} as cls, count(*) as n from {{raw_items}} group by all)
select raw_cls, cls, n, case when cls in {sql_list(VOCAB)} then cls end as in_vocab,
 case when starts_with(cls, 'AD-') then 'AIR DEVICE' else cls end as family,
 case cls when 'FAN' then 'Fan' when 'LOUVER' then 'Louver' when 'VAV' then 'Box' else 'Other' end as ext from k""")
def _(t):
    d = t.raw_items.groupBy("raw_cls").agg(F.count("*").alias("n")).withColumn("cls", K.normalise_class(c("raw_cls")))
    return d.withColumns({
        "in_vocab": K.to_vocabulary(c("raw_cls"), VOCAB), "family": K.family(c("cls")),
        "ext": K.external_class(c("cls"), {"FAN": "Fan", "LOUVER": "Louver", "VAV": "Box"}, "Other"),
    })


SERVICE_RULES = """case when service = '' or service is null then null
 when (contains(x, 'LAY-IN') or contains(x, 'T-BAR')) and contains(x, 'SUPPLY') then 'AD-T-BAR SUPPLY'
 when (contains(x, 'LAY-IN') or contains(x, 'T-BAR')) and contains(x, 'RETURN') then 'AD-T-BAR RETURN'
 when contains(x, 'CEILING') and contains(x, 'SUPPLY') then 'AD-T-BAR SUPPLY'
 when contains(x, 'CEILING') and contains(x, 'RETURN') then 'AD-T-BAR RETURN'
 when (contains(x, 'SURFACE') or contains(x, 'EXPOSED')) and (contains(x, 'ROUND') or (contains(x, 'SUPPLY') and not contains(x, 'GRILLE'))) then 'AD-SURF SUPPLY'
 when (contains(x, 'SURFACE') or contains(x, 'EXPOSED')) and contains(x, 'RETURN') then 'AD-SURF RETURN'
 when contains(x, 'LINEAR') and contains(x, 'SLOT') then 'AD-LINEAR SLOT DIFFUSER'
 when contains(x, 'LINEAR') and contains(x, 'PLENUM') then 'AD-LINEAR PLENUM'
 when contains(x, 'FAN') and contains(x, 'EXHAUST') then 'EXHAUST FAN' when contains(x, 'FAN') then 'FAN'
 when contains(x, 'LOUVER') and not contains(x, 'LOUVERED') then 'LOUVER'
 when """ + sql_any("x", V.GRILLE_WORDS) + " then 'AD-GRD' end"


@query("class_of_schedule_row", "F6 F7", f"""
with s as (select raw_tag, service, mounting, schedule_name, trim(service || ' ' || coalesce(mounting, '')) as x from {{raw_items}}),
k as (select *, {SERVICE_RULES} as by_service, {sql_class_of_tag('raw_tag')} as by_tag from s)
select service, mounting, schedule_name, raw_tag, by_service, case when {sql_any('schedule_name', V.AIR_DEVICE_SCHEDULE_WORDS)} then 'AD-GRD'
  when by_tag not in {sql_list(V.AIR_DEVICE_CLASSES)} then by_tag else coalesce(by_service, by_tag) end as cls, count(*) as n from k group by all""")
def _(t):
    d = t.raw_items.groupBy("service", "mounting", "schedule_name", "raw_tag").agg(F.count("*").alias("n"))
    return d.withColumn("by_service", K.class_of_service(c("service"), c("mounting"))).withColumn(
        "cls", K.class_of_row(c("service"), c("mounting"), c("raw_tag"), c("schedule_name")))


@query("property_lookup", "F8", """
select l_orderkey, l_partkey, l_suppkey, line_no, model,
 case when l_partkey % 2 = 0 then service else raw_size end as by_column, raw_size as by_word, raw_size as exact_header from {raw_items}""")
def _(t):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), c(v).alias("v"))
    service_first = F.array(pair("Service\nType", "service"), pair("NECK SIZE", "raw_size"))
    size_first = F.array(pair("NECK  SIZE", "raw_size"), pair("TYPE", "service"))
    props = F.when(c("l_partkey") % 2 == 0, service_first).otherwise(size_first)
    words = ["NECK", "TYPE"]
    return t.raw_items.withColumn("props", props).select(
        "l_orderkey", "l_partkey", "l_suppkey", "line_no", "model",
        X.first_property(c("props"), words).alias("by_column"),
        X.first_property(c("props"), words, by="word").alias("by_word"),
        X.first_property(c("props"), V.NECK_SIZE_HEADERS, exact=True).alias("exact_header"))


NUMS = r"(\d+(?:\.\d+)?)"
SQL_SHORT = "case when contains({0}, '.') then regexp_replace({0}, '\\.?0*$', '') else {0} end"


def sql_canon(raw):
    rd = f"nullif(regexp_extract({raw}, '^\\s*{NUMS}\\s*\"\\s*$', 1), '')"
    w = f"nullif(regexp_extract({raw}, '^\\s*{NUMS}\\s*[/xX]\\s*{NUMS}\\s*$', 1), '')"
    h = f"nullif(regexp_extract({raw}, '^\\s*{NUMS}\\s*[/xX]\\s*{NUMS}\\s*$', 2), '')"
    return f"coalesce('round:' || {SQL_SHORT.format(rd)}, 'rect:' || {SQL_SHORT.format(w)} || 'x' || {SQL_SHORT.format(h)})"


@query("size_forms", "F9", f"""
with s as (select raw_size, count(*) as n from {{raw_items}} group by all), k as (select *, {sql_canon('raw_size')} as canon from s),
q as (select *, trim(replace(raw_size, '"', '')) as bare from k)
select raw_size, n, canon, case when starts_with(canon, 'round:') then canon[7:] || '"' when starts_with(canon, 'rect:') then replace(canon[6:], 'x', '/') else '' end as shown,
 trim(translate(replace(trim(raw_size), '"', ''), 'X/', 'xx')) as comparable,
 case when regexp_matches(bare, '^{NUMS}\\s*[xX/]\\s*{NUMS}$') then regexp_extract(bare, '^{NUMS}', 1) || 'x' || regexp_extract(bare, '{NUMS}$', 1) else bare end as neck from q""")
def _(t):
    d = t.raw_items.groupBy("raw_size").agg(F.count("*").alias("n")).withColumn("canon", X.canonical_size(c("raw_size")))
    return d.withColumns({"shown": X.display_size(c("canon")), "comparable": X.comparable_size(c("raw_size")),
                          "neck": X.neck_key(c("raw_size"))})


def sql_size_and_flow(rows: str, raw: str) -> str:
    """CTEs from table ``rows`` to ``sf``: its columns with ``size`` and ``cfm`` of the text in column ``raw``."""
    return f"""sq as (select *, case when ends_with(trim({raw}), '"') and not regexp_matches({raw}, '[xX/]') then trim({raw}) else replace(trim({raw}), '"', '') end as x from {rows}),
sk as (select *, regexp_matches(x, '^\\d+(\\.\\d+)?[xX]\\d+(\\.\\d+)?/\\d{{2,5}}$') as triple,
   regexp_matches(x, '^{NUMS}/{NUMS}$') and try_cast(string_split(x, '/')[2] as double) > 30 as flows from sq),
sz as (select *, case when triple then {sql_canon("string_split(x, '/')[1]")} when flows then {sql_canon("string_split(x, '/')[1] || '\"'")} else {sql_canon('x')} end as canon,
  case when triple or flows then cast(cast(string_split(x, '/')[2] as double) as int) end as flow from sk),
sp as (select *, len(list_filter(string_split(regexp_replace(canon, '^(round:|rect:)', ''), 'x'), lambda d: not coalesce(try_cast(d as double) between 2 and 36, false))) = 0 as ok from sz),
sf as (select * exclude (x, triple, flows, canon, flow, ok), case when ok then canon end as size, case when ok then flow end as cfm from sp)"""


@query("size_and_flow", "F10", f"with s as (select raw_size, count(*) as n from {{raw_items}} group by all), {sql_size_and_flow('s', 'raw_size')} select raw_size, n, size, cfm from sf")
def _(t):
    d = t.raw_items.groupBy("raw_size").agg(F.count("*").alias("n")).withColumn("r", X.size_and_flow(c("raw_size")))
    return d.select("raw_size", "n", "r.size", "r.cfm")


@query("number_parsing", "F11", f"""
select cfm_text, text, try_cast(nullif(regexp_extract(cfm_text, '{NUMS}', 1), '') as double) as first_number,
 try_cast(regexp_replace(upper(trim(cfm_text)), '[()CFM\\s]', '', 'g') as double) as cfm,
 try_cast(nullif(regexp_extract(cfm_text, '\\b(\\d{{2,6}})\\b', 1), '') as int) as whole,
 coalesce(nullif(regexp_extract(text, '^(\\d{{1,3}})"?$', 1), ''), nullif(regexp_extract(upper(text), '^(\\d{{1,3}}[xX]\\d{{1,3}})$', 1), '')) as w_size,
 nullif(regexp_extract(text, '^(\\d{{2,4}})\\s*(?:CFM|L/S)?$', 1), '') as w_cfm,
 nullif(regexp_extract(text, '^(\\d{{1,3}})"?[ØO]?$', 1), '') as w_neck
from (select distinct cfm_text, cast(l_suppkey as string) || case when l_partkey % 3 = 0 then '"' when l_partkey % 3 = 1 then 'x12' else '' end as text from {{raw_items}}) d""")
def _(t):
    p = c("l_partkey") % 3
    text = F.concat(c("l_suppkey").cast("string"), F.when(p == 0, '"').when(p == 1, "x12").otherwise(""))
    d = t.raw_items.select("cfm_text", text.alias("text")).distinct().withColumn("w", X.word_reading(c("text")))
    return d.select("cfm_text", "text", X.first_number(c("cfm_text")).alias("first_number"), X.cfm_value(c("cfm_text")).alias("cfm"),
                    X.integer_2_to_6(c("cfm_text")).alias("whole"), c("w.size").alias("w_size"), c("w.cfm").alias("w_cfm"), c("w.neck").alias("w_neck"))


@query("shape_mounting_product", "F12 F13", f"""
select service, mounting, model, raw_cls, count(*) as n,
 case when {sql_any('service', ["SIDEWALL", "SIDE WALL", "DUCT", "GRILLE", "REGISTER", "LINEAR"])} then 'rect' when {sql_any('service', ["PLAQUE", "DIFFUSER", "CEILING", "ROUND"])} then 'round' end as shape,
 case when coalesce(mounting, '') <> '' then mounting when contains(service, 'DUCT') then 'DUCT' when contains(service, 'SIDEWALL') then 'SURFACE' when {sql_any('service', ["LAY-IN", "LAY IN", "T-BAR", "T BAR"])} then 'LAY-IN' else '' end as mount,
 case when contains(service || ' ' || model, ' ') then string_split(service || ' ' || model, ' ')[1] end as brand,
 array_to_string(string_split(service || ' ' || model, ' ')[2:], ' ') as model_no,
 case when starts_with(raw_cls, 'AD-') and (regexp_matches(service, 'DIFFUSER|GRILLE|REGISTER|LINEAR|LAY-?IN|EGGCRATE|LOUVER|SLOT|SUPPLY|RETURN|EXHAUST|T-?BAR|CEILING|PERFORATED|DEFLECTION|FACE|PLAQUE|DRUM|NOZZLE|ADJUSTABLE|FIXED|SIDEWALL') or contains(service, ' ')) then service else raw_cls end as product,
 case when model = 'none' then '' else model end as neck
from {{raw_items}} group by all""")
def _(t):
    d = t.raw_items.groupBy("service", "mounting", "model", "raw_cls").agg(F.count("*").alias("n"))
    both = F.concat(c("service"), F.lit(" "), c("model"))
    brand, model = X.brand_and_model(both, F.lit(None), F.lit(None))
    return d.withColumns({
        "shape": X.expected_shape(c("service")), "mount": X.implied_mounting(c("mounting"), c("service")),
        "brand": brand, "model_no": model, "product": X.product_name(c("raw_cls"), c("service")),
        "neck": X.neck_or_size(F.lit(""), c("model"), F.lit("none"), F.lit("")),
    })


@query("slot_width", "F14", """
with s as (select raw_cls, raw_tag, model, count(*) as n from {raw_items} group by all)
select *, case when contains(upper(raw_cls), 'LINEAR') or contains(upper(raw_cls), 'SLOT') or regexp_matches(upper(raw_tag), '^(LD|LSD|L-)') then
 try_cast(coalesce(nullif(regexp_extract(model, '\\bAS(\\d)', 1), ''), nullif(regexp_extract(model, '\\b(\\d)\\s*[-/]\\s*SLOT', 1), ''),
  nullif(regexp_extract(model, '\\b(\\d+(?:\\.\\d+)?)["''\\s]+SLOT', 1), '')) as double) end as width from s""")
def _(t):
    d = t.raw_items.groupBy("raw_cls", "raw_tag", "model").agg(F.count("*").alias("n"))
    return d.withColumn("width", X.slot_width(c("raw_cls"), c("raw_tag"), c("model")))


SQL_INCH = "(\\d+/\\d+|\\d+(?:\\.\\d+)?)\\s*\"?\\s*=\\s*(\\d+)\\s*''"


@query("drawing_scale", "F15", f"""
with s as (select scale_text, count(*) as n from {{raw_items}} group by all),
k as (select *, case when regexp_matches(scale_text, 'NOT\\s+TO\\s+SCALE|\\bNTS\\b') then 'no_scale' when regexp_matches(scale_text, '{SQL_INCH}') then 'imperial'
  when regexp_matches(scale_text, '\\b1\\s*:\\s*(\\d{{2,4}})\\b') then 'metric' end as kind, regexp_extract(scale_text, '{SQL_INCH}', 1) as num,
  try_cast(regexp_extract(scale_text, '{SQL_INCH}', 2) as int) as ft, try_cast(regexp_extract(scale_text, '\\b1\\s*:\\s*(\\d{{2,4}})\\b', 1) as int) as ra from s),
z as (select *, case when contains(num, '/') then cast(string_split(num, '/')[1] as double) / cast(string_split(num, '/')[2] as double) else try_cast(num as double) end as di from k)
select scale_text, n, kind, case when kind = 'imperial' then di end as drawing_in, case when kind = 'imperial' then ft end as feet,
 case when kind = 'metric' then ra end as ratio, round(case kind when 'imperial' then di * 200.0e0 / ft when 'metric' then 200.0e0 / 25.4e0 * 1000.0e0 / ra end, 6) as px_per_unit from z""")
def _(t):
    d = t.raw_items.groupBy("scale_text").agg(F.count("*").alias("n")).withColumn("s", X.parse_scale(c("scale_text")))
    return d.select("scale_text", "n", "s.*", F.round(X.px_per_unit(c("s"), 200.0), 6).alias("px_per_unit"))


@query("date_parsing", "F16", """
with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%m/%d/%y') when 1 then 'REV ' || strftime(o_orderdate, '%m-%d-%Y')
  when 2 then strftime(o_orderdate, '%Y.%m.%d') else '13/45/99' end as txt, cast(o_orderdate as date) as od from {orders})
, g as (select *, regexp_extract(txt, '(\\d{1,2})[.\\-/](\\d{1,2})[.\\-/](\\d{2,4})', ['a', 'b', 'c']) as m,
 regexp_extract(txt, '(\\d{4})[.\\-/](\\d{1,2})[.\\-/](\\d{1,2})', ['a', 'b', 'c']) as y from d),
k as (select *, try_cast(m.c as int) as yy from g)
select o_orderkey, txt, cast(coalesce(try_cast(format('{:04d}-{}-{}', case when yy < 70 then yy + 2000 when yy < 100 then yy + 1900 else yy end, m.a, m.b) as date),
 try_cast(y.a || '-' || y.b || '-' || y.c as date)) as string) as parsed from k""")
def _(t):
    k, d = c("o_orderkey") % 4, c("o_orderdate")
    txt = (F.when(k == 0, F.date_format(d, "MM/dd/yy")).when(k == 1, F.concat(F.lit("REV "), F.date_format(d, "MM-dd-yyyy")))
           .when(k == 2, F.date_format(d, "yyyy.MM.dd")).otherwise("13/45/99"))
    return t.orders.select("o_orderkey", txt.alias("txt")).withColumn("parsed", X.parse_date(c("txt")).cast("string"))


@query("field_validation", "F17", """
with v as (select distinct scale_text as a, raw_tag as b, service as s, model as m from {raw_items}),
f as (select unnest([{'k': 'scale', 'v': a}, {'k': 'sheet', 'v': b}, {'k': 'project', 'v': s}, {'k': 'engineer', 'v': m}, {'k': 'firm', 'v': m}, {'k': 'revision', 'v': b}]) as kv from v),
z as (select distinct kv.k as field, kv.v as raw, trim(regexp_replace(trim(regexp_replace(trim(kv.v), '^[:=-]+|[:=-]+$', '', 'g')), '\\s+', ' ', 'g')) as cl from f),
y as (select field, raw, case when length(cl) >= 2 and not regexp_matches(cl, '(?i)^(?:ISSUE(?:D)?\\b|NOT\\b|FOR\\b|TO\\s+BE\\b|APPROVED\\b|REVIEWED\\b|SEE\\b|DESCRIPTION\\b|NO\\.\\b|NOTES?\\b|BY\\b)') then cl end as cleaned from z)
select field, raw, cleaned, case field when 'scale' then regexp_matches(cleaned, '(?i)[0-9/]["'']|NTS|N\\.T\\.S|AS\\s+NOTED|NONE')
 when 'sheet' then regexp_matches(cleaned, '^[A-Z]{1,3}[\\-.]?[0-9]{1,4}(?:\\.[0-9]+)?$')
 when 'project' then length(cleaned) >= 5 and not regexp_matches(cleaned, '(?i)^(?:Project|Job|Sheet|Drawing|Date|Scale|Revision)\\s*(?:Name|Number|Title|No\\.?)?$')
 when 'engineer' then length(cleaned) between 2 and 40 and not regexp_matches(cleaned, '\\d{3,}') and not regexp_matches(cleaned, '(?i)^(?:DRAWN|DESIGNED|CHECKED)\\s+BY$') and regexp_matches(cleaned, '[A-Z]')
   and lower(cleaned) not in ('of','by','the','and','to','for','a','an','as','no','or')
 when 'firm' then length(cleaned) >= 4 when 'revision' then regexp_matches(cleaned, '^[0-9]{1,3}$|^[A-Z]$') end as valid from y""")
def _(t):
    kv = lambda k, v: F.struct(F.lit(k).alias("field"), c(v).alias("raw"))
    pairs = F.array(kv("scale", "scale_text"), kv("sheet", "raw_tag"), kv("project", "service"), kv("engineer", "model"),
                    kv("firm", "model"), kv("revision", "raw_tag"))
    d = t.raw_items.select("scale_text", "raw_tag", "service", "model").distinct().select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return d.withColumn("cleaned", X.clean_field(c("raw"))).withColumn("valid", X.valid_field(c("field"), c("cleaned")))


@query("titles_and_sheets", "F18 F19 F20 F36", f"""
with s as (select l_partkey, l_suppkey, case l_partkey % 7 when 0 then 'M' || (l_suppkey % 900) when 1 then 'M-' || (l_suppkey % 9) || '.1' when 2 then 'E10' || (l_suppkey % 9)
  when 3 then 'MECH201A' when 4 then 'ZZ-5' when 5 then null else 'HV' || (100 + l_suppkey % 500) || '.1' end as num,
  case l_suppkey % 9 when 0 then 'MECHANICAL ROOF PLAN' when 1 then 'HVAC PLAN - LEVEL 1' when 2 then 'GENERAL NOTES AND LEGEND' when 3 then 'MECHANICAL SCHEDULES' when 4 then 'DETAILS'
  when 5 then 'PIPING DIAGRAM' when 6 then 'COVER' when 7 then 'SHEET NOTES' else 'ZONE 4' end as title from (select distinct l_partkey, l_suppkey from {{lineitem}}) d),
k as (select *, regexp_extract(num, '^([A-Z]+)', 1) as disc,
 coalesce(try_cast(nullif(regexp_extract(num, '^[A-Z]{{1,3}}[\\s\\-.]?(\\d{{3,4}})(?:[A-Z]|\\.\\d+)?$', 1), '') as int) // 100,
  try_cast(nullif(regexp_extract(num, '^[A-Z]{{1,3}}[\\s\\-]?(\\d{{1,2}})\\.\\d{{1,3}}[A-Z]?$', 1), '') as int)) as series from s)
select l_partkey, l_suppkey, num, title, series, series between 1 and 4 as plan_no,
 coalesce({sql_case('disc', V.DISCIPLINE_NAMES)}, {sql_case('disc[1:2]', V.DISCIPLINE_NAMES)}, {sql_case('disc[1:1]', V.DISCIPLINE_NAMES)}, 'Unknown') as discipline,
 case when {sql_any('title', ["LEGEND", "SYMBOL", "ABBREV"])} then 'legend' when contains(title, 'SCHEDULE') then 'schedule' when contains(title, 'DETAIL') then 'details'
  when {sql_any('title', ["RISER", "DIAGRAM", "ONE LINE"])} then 'riser_diagram' when contains(title, 'NOTES') then 'notes' when contains(title, 'PLAN') and contains(title, 'ROOF') then 'roof_plan'
  when contains(title, 'PLAN') then 'mechanical_plan' when contains(title, 'COVER') then 'cover' end as page_type,
 case when num is null then {sql_any('title', ["MECHANICAL PLAN", "HVAC PLAN"])} when coalesce(disc in {sql_list(V.OWN_DISCIPLINES)}, false) = false then false
  else coalesce(case when {sql_any('title', V.NON_PLAN_TITLES)} then false when contains(title, 'PLAN') then true end, series between 1 and 4, true) end as is_plan from k""")
def _(t):
    p, s = c("l_partkey"), c("l_suppkey")
    st = lambda x: x.cast("string")
    num = (F.when(p % 7 == 0, F.concat(F.lit("M"), st(s % 900))).when(p % 7 == 1, F.concat(F.lit("M-"), st(s % 9), F.lit(".1")))
           .when(p % 7 == 2, F.concat(F.lit("E10"), st(s % 9))).when(p % 7 == 3, "MECH201A").when(p % 7 == 4, "ZZ-5")
           .when(p % 7 == 5, None).otherwise(F.concat(F.lit("HV"), st(100 + s % 500), F.lit(".1"))))
    titles = ["MECHANICAL ROOF PLAN", "HVAC PLAN - LEVEL 1", "GENERAL NOTES AND LEGEND", "MECHANICAL SCHEDULES", "DETAILS",
              "PIPING DIAGRAM", "COVER", "SHEET NOTES", "ZONE 4"]
    title = F.array(*[F.lit(x) for x in titles])[(s % 9).cast("int")]
    d = t.lineitem.select("l_partkey", "l_suppkey").distinct().withColumns({"num": num, "title": title})
    disc = F.regexp_extract(c("num"), "^([A-Z]+)", 1)
    return d.select("l_partkey", "l_suppkey", "num", "title", X.sheet_series(c("num")).alias("series"),
                    X.plan_by_sheet_number(c("num")).alias("plan_no"), X.discipline_of(disc).alias("discipline"),
                    X.page_type_of_title(c("title")).alias("page_type"),
                    X.sheet_is_plan(c("num"), disc, c("title"), c("title")).alias("is_plan"))


@query("room_labels", "F21", f"""
with s as (select case l_partkey % 6 when 0 then 'ROOM ' || (100 + l_suppkey) when 1 then cast(l_suppkey * 3 as string) when 2 then 'Open Office' when 3 then 'CU-' || (l_suppkey % 9)
   when 4 then 'Rm. #' || (20 + l_suppkey) || 'B' else 'zz ' || l_partkey end as txt from {{lineitem}}), d as (select txt, count(*) as n from s group by all)
select txt, n, case when regexp_matches(txt, '{V.TAG_LIKE}') then null when regexp_matches(txt, '{V.ROOM_PREFIXED}') then 'ROOM ' || regexp_extract(txt, '{V.ROOM_PREFIXED}', 1)
 when regexp_matches(txt, '^\\d{{2,4}}[A-Z]?$') then case when regexp_matches(txt, '^\\d{{3,}}') then txt end
 when regexp_matches(txt, '(?i)\\b(?:{"|".join(V.ROOM_WORDS)})\\b') then txt end as label,
 case when regexp_matches(txt, '{V.TAG_LIKE}') then null when regexp_matches(txt, '{V.ROOM_PREFIXED}') then 'room_number_prefixed'
 when regexp_matches(txt, '^\\d{{2,4}}[A-Z]?$') then case when regexp_matches(txt, '^\\d{{3,}}') then 'room_number' end
 when regexp_matches(txt, '(?i)\\b(?:{"|".join(V.ROOM_WORDS)})\\b') then 'room_name' end as kind from d""")
def _(t):
    p, s = c("l_partkey") % 6, c("l_suppkey")
    txt = (F.when(p == 0, F.concat(F.lit("ROOM "), (100 + s).cast("string"))).when(p == 1, (s * 3).cast("string")).when(p == 2, "Open Office")
           .when(p == 3, F.concat(F.lit("CU-"), (s % 9).cast("string"))).when(p == 4, F.concat(F.lit("Rm. #"), (20 + s).cast("string"), F.lit("B")))
           .otherwise(F.concat(F.lit("zz "), c("l_partkey").cast("string"))))
    d = t.lineitem.groupBy(txt.alias("txt")).agg(F.count("*").alias("n")).withColumn("r", X.room_label(c("txt")))
    return d.select("txt", "n", "r.label", "r.kind")


@query("box_geometry", "F25 F27 F30", """
select doc_id, page_no, det_id, (x2 - x1) * (y2 - y1) as area, (x1 + x2) / 2e0 as cx, case when x2 - x1 >= y2 - y1 then 'H' else 'V' end as o,
 round(x1 * (72e0 / 200e0), 6) as x1_pt, round(greatest(0e0, least(1e0, (x1 + x2) / 2e0 / 2200e0)), 9) as ncx, round(greatest(0e0, least(1e0, (y2 - y1) / 1700e0)), 9) as nh from {boxes}""")
def _(t):
    n = G.normalised(F.lit(2200.0), F.lit(1700.0))
    return t.boxes.select("doc_id", "page_no", "det_id", G.area().alias("area"), G.center_x().alias("cx"), G.orientation().alias("o"),
                          F.round(G.px_to_pt(c("x1"), 200), 6).alias("x1_pt"), F.round(n["ncx"], 9).alias("ncx"), F.round(n["nh"], 9).alias("nh"))


@query("arc_length", "F26", """
with s as (select doc_id, page_no, det_id, cast(greatest(x2 - x1, y2 - y1) as double) as ch, cast(least(x2 - x1, y2 - y1) as double) as ri from {strips}),
k as (select *, (ch * ch / 4 + ri * ri) / (2 * ri) as r from s)
select doc_id, page_no, det_id, round(r, 6) as radius, round(2 * r * asin(least(1e0, ch / (2 * r))), 6) as arc_length, round(degrees(asin(least(1e0, ch / (2 * r)))), 6) as theta_deg from k""")
def _(t):
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    a = G.arc(F.greatest(w, h).cast("double"), F.least(w, h).cast("double"))
    return t.strips.select("doc_id", "page_no", "det_id", *[F.round(v, 6).alias(k) for k, v in a.items()])


@query("confidence_formulas", "F28 F29 F31", """
with s as (select doc_id, page_no, word_id, ocr_pct / 100e0 as oc, cast(x0 % 130 as double) as d, case word_id % 4 when 0 then 'exact_combined' when 1 then 'separated' when 2 then 'inferred' else 'other' end as st,
  case word_id % 4 when 0 then 'exact' when 1 then 'prefix' when 2 then 'fuzzy' else 'other' end as ms, case word_id % 4 when 0 then 'standard_round' when 1 then 'standard_rect' when 2 then 'variant' else 'other' end as os,
  word_id % 2 = 0 as is_text, word_id % 9 as wn from {tokens}),
k as (select *, (case when is_text then 0.95e0 else 0.75e0 end) * (case when d < 50 then 1e0 else greatest(0.5e0, 1e0 - (d - 50) / 22e0 * 0.5e0) end) * (case st when 'exact_combined' then 1e0 when 'separated' then 0.85e0 when 'inferred' then 0.65e0 else 0.6e0 end) as c1,
  0.9e0 * oc * (case ms when 'exact' then 1e0 when 'prefix' then 0.95e0 when 'fuzzy' then 0.65e0 else 0.5e0 end) as c2,
  0.8e0 * oc * (case when d * 5 < 200 then 1e0 else greatest(0.3e0, 1e0 - (d * 5 - 200) / 400 * 0.5e0) end) * (case os when 'standard_round' then 1e0 when 'standard_rect' then 0.95e0 when 'variant' then 0.8e0 else 0.6e0 end) as c3,
  0.55e0 * greatest(0.5e0, 1e0 - abs(d - 100) / 100e0 * 0.5e0) * (case when wn < 4 then 0.75e0 when wn >= 8 then 1e0 else 0.85e0 end) as c4 from s)
select doc_id, page_no, word_id, round(c1, 9) as c1, round(c2, 9) as c2, round(c3, 9) as c3, round(c4, 9) as c4,
 case when c2 >= 0.80e0 then 'HIGH' when c2 >= 0.5e0 then 'MEDIUM' when c2 >= 0.15e0 then 'LOW' else 'DROP' end as tier,
 case when wn = 0 then 0 when wn > 1 then wn else 1 end as units from k""")
def _(t):
    w = c("word_id")
    pick = lambda *xs: F.array(*[F.lit(x) for x in xs])[(w % 4).cast("int")]
    d, oc, wn = (c("x0") % 130).cast("double"), c("ocr_pct") / 100, w % 9
    c2 = X.conf_schedule(oc, pick("exact", "prefix", "fuzzy", "other"))
    return t.tokens.select(
        "doc_id", "page_no", "word_id",
        F.round(X.conf_near_text(d, pick("exact_combined", "separated", "inferred", "other"), w % 2 == 0), 9).alias("c1"),
        F.round(c2, 9).alias("c2"),
        F.round(X.conf_ocr(oc, d * 5, pick("standard_round", "standard_rect", "variant", "other")), 9).alias("c3"),
        F.round(X.conf_band(d, F.lit(0.0), F.lit(200.0), wn), 9).alias("c4"),
        X.size_tier(c2).alias("tier"), X.units_of(wn == 0, wn).alias("units"))


@query("legend_and_notes", "F22 F23", f"""
with s as (select l_partkey, l_suppkey, case l_partkey % 5 when 0 then 'CONDENSATE DRAIN ' || l_suppkey || ' (CD)' when 1 then 'EF = EXHAUST FAN NO ' || l_suppkey when 2 then (1 + l_suppkey) || '. PROVIDE DAMPER (A)'
   when 3 then '[' || (l_suppkey % 50) || '] SEE PLAN ' || l_partkey else '<' || (l_suppkey % 120) || '>' end as line from (select distinct l_partkey, l_suppkey from {{lineitem}}) d),
k as (select *, regexp_matches(line, '{V.ABBREVIATION_LINE}') and not {sql_any('upper(line)', V.NOTE_WORDS)} as tail, regexp_matches(line, '{V.LEGEND_LINE}') and length(trim(regexp_extract(line, '{V.LEGEND_LINE}', 2))) > 3 as head,
 regexp_matches(line, '{V.NOTE_LINE}') and coalesce(try_cast(regexp_extract(line, '{V.NOTE_LINE}', 1) as int) <= 100, false) and length(trim(regexp_extract(line, '{V.NOTE_LINE}', 2))) >= 3 as note,
 try_cast(nullif(regexp_extract(line, '{V.CALLOUT}', 1), '') as int) as co from s)
select l_partkey, l_suppkey, line, case when tail then regexp_extract(line, '{V.ABBREVIATION_LINE}', 2) when head then regexp_extract(line, '{V.LEGEND_LINE}', 1) end as abbr,
 case when tail then trim(regexp_extract(line, '{V.ABBREVIATION_LINE}', 1), ' .,-') when head then trim(regexp_extract(line, '{V.LEGEND_LINE}', 2)) end as term,
 case when note then cast(regexp_extract(line, '{V.NOTE_LINE}', 1) as int) end as note_no, case when note then trim(regexp_extract(line, '{V.NOTE_LINE}', 2)) end as note_text,
 case when co between 1 and 100 then co end as callout from k""")
def _(t):
    p, s = c("l_partkey") % 5, c("l_suppkey")
    st = lambda x: x.cast("string")
    line = (F.when(p == 0, F.concat(F.lit("CONDENSATE DRAIN "), st(s), F.lit(" (CD)"))).when(p == 1, F.concat(F.lit("EF = EXHAUST FAN NO "), st(s)))
            .when(p == 2, F.concat(st(1 + s), F.lit(". PROVIDE DAMPER (A)"))).when(p == 3, F.concat(F.lit("["), st(s % 50), F.lit("] SEE PLAN "), st(c("l_partkey"))))
            .otherwise(F.concat(F.lit("<"), st(s % 120), F.lit(">"))))
    d = t.lineitem.select("l_partkey", "l_suppkey").distinct().withColumn("line", line)
    d = d.withColumn("e", X.legend_entry(c("line"))).withColumn("n", X.note_line(c("line")))
    return d.select("l_partkey", "l_suppkey", "line", "e.abbr", "e.term", c("n.number").alias("note_no"), c("n.text").alias("note_text"),
                    X.callout_number(c("line")).alias("callout"))


@query("document_phrases", "F24", f"""
select page_id, case when contains(upper(html), 'NOT FOR CONSTRUCTION') then 'NOT FOR CONSTRUCTION' when contains(upper(html), 'NOT FOR BIDDING') then 'NOT FOR BIDDING' when contains(upper(html), 'NOT FOR BID') then 'NOT FOR BID' when contains(upper(html), 'FOR REVIEW ONLY') then 'FOR REVIEW ONLY' end as watermark,
 case {" ".join(f"when regexp_matches(upper(html), '{p}') then '{n}'" for n, p in V.ISSUE_TYPES)} end as issue_type,
 array_to_string(list_filter([{", ".join(f"case when {sql_any('upper(html)', ws)} then '{n}' end" for n, ws in V.CONTENT_BLOCKS.items())}], lambda x: x is not null), ',') as blocks from {{pages}}""")
def _(t):
    p = X.document_phrases(c("html"))
    return t.pages.select("page_id", p["watermark"].alias("watermark"), p["issue_type"].alias("issue_type"), F.array_join(p["blocks"], ",").alias("blocks"))
