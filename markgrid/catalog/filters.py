"""Filter, verdict and gate queries."""

from pyspark.sql import functions as F

from markgrid.catalog.keys_text import sql_any, sql_case, sql_list, sql_normalise_class
from markgrid.catalog.registry import query
from markgrid.functions import vocab as V
from markgrid.operators import filters as P

c = F.col
DOC = ["doc_id"]

THR = f"coalesce({sql_case('trim(upper(raw_cls))', V.CLASS_THRESHOLDS)}, {sql_case(sql_normalise_class('raw_cls'), V.CLASS_THRESHOLDS)}, 0.4e0)"


@query("class_thresholds", "P1", f"""
with k as (select doc_id, raw_cls, conf_pct / 100e0 as conf, {THR} as th from {{raw_items}})
select doc_id, raw_cls, count(*) as n, count(*) filter (where not conf >= th) as dropped from k group by 1, 2""")
def _(t):
    m = P.split_by_threshold(t.raw_items.withColumn("conf", c("conf_pct") / 100), "raw_cls")
    return m.groupBy("doc_id", "raw_cls").agg(F.count("*").alias("n"), F.sum((~c("kept")).cast("bigint")).alias("dropped"))


@query("scheduled_or_sure", "P2", """
with s as (select o_orderkey as doc_id, case o_orderstatus when 'F' then 'A-F' when 'O' then 'N-O' end as cls from {orders} where o_orderstatus <> 'P'), o as (select l_orderkey as doc_id, page_no, det_id, cls, conf_pct from {boxes})
select o.* from o where exists (select 1 from s where s.doc_id = o.doc_id and s.cls = o.cls) or conf_pct >= 60 or not exists (select 1 from s where s.doc_id = o.doc_id)""")
def _(t):
    s = t.orders.where("o_orderstatus <> 'P'").selectExpr("o_orderkey as doc_id", "case o_orderstatus when 'F' then 'A-F' when 'O' then 'N-O' end as cls")
    b = t.boxes.selectExpr("l_orderkey as doc_id", "page_no", "det_id", "cls", "conf_pct")
    return P.scheduled_or_sure(b, s, DOC, 60, "conf_pct")


@query("noise_tags", "P3", f"""
select doc_id, count(*) as n, count(*) filter (where not (regexp_matches(upper(trim(text)), '{V.TAG_LIKE}') and upper(trim(text)) not in {sql_list(V.NOISE_TAGS)})) as dropped from {{words}} group by 1""")
def _(t):
    m = t.words.withColumn("kept", P.real_tag(c("text")))
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((~c("kept")).cast("bigint")).alias("dropped"))


@query("minimum_confidence", "P4", "select doc_id, page_no, det_id from (select *, case when l_suppkey % 7 = 0 then null else conf_pct / 100e0 end as conf from {boxes}) b where coalesce(conf, 1e0) >= 0.5e0")
def _(t):
    b = t.boxes.withColumn("conf", F.when(c("l_suppkey") % 7 != 0, c("conf_pct") / 100))
    return b.where(F.coalesce("conf", F.lit(1.0)) >= 0.5).select("doc_id", "page_no", "det_id")


def page_types(t):
    names = F.array(*[F.lit(x) for x in V.PAGE_TYPES])
    return t.boxes.groupBy("doc_id", "page_no").agg(F.sum("l_partkey").alias("s"), F.count("*").alias("n_boxes")).select(
        "doc_id", "page_no", names[(c("s") % 10).cast("int")].alias("type"), "n_boxes", (c("s") % 101 / 100.0).alias("conf"))


SQL_PAGES = f"pg as (select doc_id, page_no, [{', '.join(repr(x) for x in V.PAGE_TYPES)}][cast(sum(l_partkey) % 10 as int) + 1] as type, count(*) as n_boxes, sum(l_partkey) % 101 / 100e0 as conf from {{boxes}} group by 1, 2)"


@query("drop_non_plan_pages", "P5", f"with {SQL_PAGES} select b.doc_id, b.page_no, b.det_id from {{boxes}} b join pg using (doc_id, page_no) where pg.type not in {sql_list(V.NON_PLAN_TYPES)}")
def _(t):
    return P.without_pages(t.boxes.select("doc_id", "page_no", "det_id"), page_types(t), ["doc_id", "page_no"], V.NON_PLAN_TYPES)


@query("schedule_pages", "P6", f"""
with p as (select page_id, upper(case page_id % 3 when 0 then 'equipment schedule mark cfm model size voltage phase ' when 1 then 'schedule mark model ' else '' end || html) as u from {{pages}})
select page_id, contains(u, 'SCHEDULE') and {sql_any('u', V.SCHEDULE_PAGE_TAG_HEADERS)} and {' + '.join(f"contains(u, '{w}')::int" for w in V.SCHEDULE_PAGE_PROPERTIES)} >= 4 as is_schedule from p""")
def _(t):
    k = c("page_id") % 3
    head = F.when(k == 0, "equipment schedule mark cfm model size voltage phase ").when(k == 1, "schedule mark model ").otherwise("")
    return t.pages.select("page_id", P.is_schedule_page(F.concat(head, c("html"))).alias("is_schedule"))


@query("filter_or_keep_all", "P7", f"""
with {SQL_PAGES}, f as (select doc_id, max((type = 'mechanical_plan')::int) as a, max((type = 'roof_plan')::int) as b from pg group by 1)
select pg.doc_id, page_no, type from pg join f using (doc_id) where case when a = 1 then type = 'mechanical_plan' when b = 1 then type = 'roof_plan' else true end""")
def _(t):
    p = page_types(t).select("doc_id", "page_no", "type")
    return P.keep_or_all(p, DOC, [c("type") == "mechanical_plan", c("type") == "roof_plan"])


@query("first_candidate_pages", "P8", f"""
with {SQL_PAGES}, r as (select doc_id, page_no, type, case type when 'schedule' then 0 when 'air_balance' then 1 when 'legend' then 2 when 'details' then 3 when 'cover' then 4 when 'notes' then 5 when 'mechanical_plan' then 6 when 'roof_plan' then 6 end as rk from pg)
select doc_id, page_no, type, row_number() over (partition by doc_id order by rk, page_no) as position from r where rk is not null""")
def _(t):
    p = page_types(t).withColumn("is_plan", c("type").isin(V.PLAN_TYPES))
    return P.first_pages(p, DOC, V.SEARCH_ORDER).select("doc_id", "page_no", "type", "position")


@query("common_classes", "P9", """
with d as (select p_name || p_size as cls, l_orderkey, l_partkey, l_suppkey from {lineitem} join {part} on l_partkey = p_partkey), n as (select cls, count(*) as n from d group by 1 having n >= 30)
select cls, n, (row_number() over (order by case cls when 'small ring11' then 0 when 'zz' then 1 else 2 end, n desc, cls)) - 1 as idx from n""")
def _(t):
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(F.concat("p_name", c("p_size").cast("string")).alias("cls"))
    return P.class_index(P.common_classes(d, "cls"), "cls", ["small ring11", "zz"])


@query("leakage_guard", "P10", """
with w as (select distinct unnest(regexp_extract_all(lower(text), '([a-z]{4,})', 1)) as w from {benchmark})
select page_id, url from {pages} p where not exists (select 1 from w where contains(lower(p.url), w.w))""")
def _(t):
    return P.leakage_guard(t.pages.select("page_id", "url"), c("url"), t.benchmark, "text")


@query("own_trade_schedules", "P11 P12", f"""
select schedule_name, count(*) as n, not {sql_any('schedule_name', V.GLOSSARY_WORDS)} and not ({sql_any('schedule_name', V.OTHER_TRADE_SCHEDULES)} and not {sql_any('schedule_name', V.OWN_TRADE_WORDS)}) as own,
 {sql_any('schedule_name', ['DEVICE', 'FAN'])} and not {sql_any('schedule_name', ['FIXTURE'])} as wanted from {{raw_items}} group by 1""")
def _(t):
    d = t.raw_items.groupBy("schedule_name").agg(F.count("*").alias("n"))
    return d.withColumns({"own": P.own_trade_schedule(c("schedule_name")), "wanted": P.product_filter(c("schedule_name"), ["DEVICE", "FAN"], ["FIXTURE"])})


@query("source_precedence", "P13", """
with a as (select l_orderkey as doc_id, l_partkey as row_no, 'primary' as origin from {lineitem} where l_returnflag = 'A'), b as (select l_orderkey as doc_id, l_partkey as row_no, 'secondary' as origin from {lineitem} where l_returnflag <> 'A'),
u as (select * from a union all select * from b), n as (select doc_id, count(*) filter (where origin = 'primary') as p, count(*) filter (where origin = 'secondary') as s from u group by 1)
select u.* from u join n using (doc_id) where origin = case when p < 5 and s > p then 'secondary' else 'primary' end""")
def _(t):
    d = t.lineitem.selectExpr("l_orderkey as doc_id", "l_partkey as row_no", "l_returnflag as f")
    return P.source_precedence(d.where("f = 'A'").drop("f"), d.where("f <> 'A'").drop("f"), DOC)


@query("secondary_if_empty", "P13", """
with a as (select l_orderkey as doc_id, l_partkey as row_no from {lineitem} where l_returnflag = 'A'), b as (select l_orderkey as doc_id, l_partkey as row_no from {lineitem} where l_returnflag <> 'A')
select *, 'primary' as origin from a union all select *, 'secondary' from b where doc_id not in (select doc_id from a)""")
def _(t):
    d = t.lineitem.selectExpr("l_orderkey as doc_id", "l_partkey as row_no", "l_returnflag as f")
    return P.fallback_if_empty(d.where("f = 'A'").drop("f"), d.where("f <> 'A'").drop("f"), DOC)


DISC = ["M", "HV", "E", "A", "ZZ", None]


@query("page_verdicts", "F33", f"""
with {SQL_PAGES}, k as (select doc_id, page_no, case type when 'other' then null else type end as ctype, case type when 'other' then null else conf end as cconf, ['M','HV','E','A','ZZ',null][cast((doc_id + page_no) % 6 as int) + 1] as disc from pg),
z as (select *, coalesce(ctype in {sql_list(V.DOC_TYPES)} and cconf >= 0.7e0, false) as sure, coalesce(ctype in {sql_list(V.PLAN_TYPES)}, false) as plan from k),
y as (select *, case when disc in {sql_list(V.OWN_DISCIPLINES)} then true when disc in {sql_list(V.KNOWN_DISCIPLINES)} then false else plan or not sure end as own from z)
select doc_id, page_no, own, own and not sure as is_plan, case when not own then coalesce(ctype, 'non_plan') else coalesce(ctype, 'plan') end as verdict,
 case when not own then 0.85e0 when sure then cconf when plan then greatest(0.8e0, cconf) else 0.5e0 end as confidence,
 concat_ws(';', case when disc in {sql_list(V.OWN_DISCIPLINES)} then 'own discipline' when disc in {sql_list(V.KNOWN_DISCIPLINES)} then 'other trade' else 'no readable number' end, 'content=' || ctype) as evidence from y""")
def _(t):
    disc = F.array(*[F.lit(x) for x in DISC])[((c("doc_id") + c("page_no")) % 6).cast("int")]
    known = c("type") != "other"
    p = page_types(t).select("doc_id", "page_no", F.when(known, c("type")).alias("ctype"), F.when(known, c("conf")).alias("cconf"), disc.alias("discipline"))
    return P.page_verdicts(p).select("doc_id", "page_no", "own", "is_plan", "verdict", "confidence", F.concat_ws(";", "evidence").alias("evidence"))


@query("readiness", "F34", """
with d as (select doc_id, count(distinct page_no) as plan_pages, count(*) % 5 as ocr_pages, count(*) % 90 as schedule_s, doc_id % 7 <> 0 as pdf_ok, doc_id % 5 <> 0 as sheets_ok, doc_id % 3 <> 0 as schedule_ok, doc_id % 2 = 0 as title_ok from {boxes} group by doc_id)
select doc_id, case when not pdf_ok or not sheets_ok then 'WILL_LIKELY_FAIL' when not schedule_ok or not title_ok then 'PROCEED_WITH_WARNINGS' else 'READY' end as status,
 plan_pages * 8 + ocr_pages * 1.5e0 + schedule_s + 20 as seconds, concat_ws(',', case when not pdf_ok then 'unreadable' end, case when not sheets_ok and pdf_ok then 'no plan pages' end, case when not sheets_ok and not pdf_ok then 'sheet filter failed' end) as blockers from d""")
def _(t):
    d = t.boxes.groupBy("doc_id").agg(F.countDistinct("page_no").alias("plan_pages"), (F.count("*") % 5).alias("ocr_pages"), (F.count("*") % 90).alias("schedule_s"))
    d = d.withColumns({"pdf_ok": c("doc_id") % 7 != 0, "sheets_ok": c("doc_id") % 5 != 0, "schedule_ok": c("doc_id") % 3 != 0, "title_ok": c("doc_id") % 2 == 0})
    return P.readiness(d).select("doc_id", "status", c("seconds").cast("double").alias("seconds"), F.concat_ws(",", "blockers").alias("blockers"))


CLS6 = "case l_partkey % 6 when 0 then 'AD-GRD' when 1 then 'AD-T-BAR SUPPLY' when 2 then 'FAN' when 3 then 'SPLIT SYSTEM' when 4 then 'CONDENSING UNIT' else 'VAV' end"


def gate(t):
    b = t.boxes.selectExpr("doc_id", "page_no", "det_id", f"{CLS6} as cls", "tag", "conf_pct / 100.0D as conf", "(conf_pct * 3 % 100) / 100.0D as tag_conf",
                           "case l_suppkey % 4 when 0 then 'bubble_ocr' when 1 then 'fingerprint' when 2 then 'direct' end as method")
    s = t.expected.selectExpr("doc_id", "tag", "row_no", "case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR RETURN' when 3 then case when doc_id % 4 = 1 then 'HEAT PUMP' else 'FAN' end else 'CONDENSING UNIT' end as cls")
    return P.agreement_gate(b, s, DOC)


_PAIRS = sorted({(a, b) for k, v in V.CLASS_ALIASES.items() for x in (v if isinstance(v, list) else [v]) for a, b in ((k, x), (x, k))})
SQL_GATE = f"""
b as (select doc_id, page_no, det_id, {CLS6} as cls, tag, conf_pct / 100e0 as conf, (conf_pct * 3 % 100) / 100e0 as tconf, case l_suppkey % 4 when 0 then 'bubble_ocr' when 1 then 'fingerprint' when 2 then 'direct' end as method from {{boxes}}),
s as (select doc_id, tag, case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR RETURN' when 3 then case when doc_id % 4 = 1 then 'HEAT PUMP' else 'FAN' end else 'CONDENSING UNIT' end as tcls from {{expected}}),
al(x, y) as (values {", ".join(f"('{x}', '{y}')" for x, y in _PAIRS)}),
sc as (select distinct doc_id, tcls as cls from s union select doc_id, y from s join al on x = tcls),
j as (select b.*, s.tcls, coalesce(b.cls = s.tcls or (b.cls, s.tcls) in (select (x, y) from al), false) as agrees, exists (select 1 from sc where sc.doc_id = b.doc_id and sc.cls = b.cls) as cls_ok,
  b.tag is not null and coalesce(method in ('bubble_ocr', 'fingerprint'), false) as txt from b left join s on s.doc_id = b.doc_id and s.tag = b.tag),
g as (select doc_id, page_no, det_id, case when txt and agrees then 'confirmed' when tag is not null and not agrees then 'flagged' else 'needs_review' end as status,
 case when txt and agrees then least(0.99e0, 0.8e0 + 0.19e0 * ((conf + tconf) / 2)) when tag is not null and tcls is null then 0.3e0 * conf when tag is not null and not agrees then 0.4e0 * conf else 0.35e0 + 0.45e0 * (case when cls_ok then conf else 0.6e0 * conf end) end as cf,
 concat_ws(',', case when tag is not null and tcls is null then 'tag_not_in_schedule' end, case when not cls_ok then 'class_not_in_schedule' end, case when tcls is not null and not agrees then 'class_tag_mismatch' end) as flags,
 1 + (tag is not null)::int + (tcls is not null)::int as n_evidence from j)"""


@query("agreement_gate", "F32 D9", f"with {SQL_GATE.strip()} select doc_id, page_no, det_id, status, round(cf, 6) as confidence, flags, n_evidence from g")
def _(t):
    return gate(t).select("doc_id", "page_no", "det_id", "status", F.round("confidence", 6).alias("confidence"), F.concat_ws(",", "flags").alias("flags"), F.size("evidence").alias("n_evidence"))


@query("status_summary", "A27", f"with {SQL_GATE.strip()} select doc_id, count(*) as total, count(*) filter (where status = 'confirmed') as confirmed, count(*) filter (where status = 'needs_review') as needs_review, count(*) filter (where status = 'flagged') as flagged, round(count(*) filter (where status = 'confirmed') / count(*)::double, 6) as confirmed_rate from g group by 1")
def _(t):
    return P.status_summary(gate(t), DOC).withColumn("confirmed_rate", F.round("confirmed_rate", 6))


@query("top_flags", "A27 O1", f"with {SQL_GATE.strip()}, x as (select unnest(string_split(flags, ',')) as flag from g where flags <> '') select flag, count(*) as n from x group by 1 order by n desc, flag limit 6")
def _(t):
    return P.top_flags(gate(t))
