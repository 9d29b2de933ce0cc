"""Aggregation, vote and top-k queries."""

from pyspark.sql import functions as F

from markgrid.catalog.filters import SQL_PAGES, page_types
from markgrid.catalog.keys_text import sql_case, sql_class_of_tag
from markgrid.catalog.reconciliation import SQL_PRESENCE
from markgrid.catalog.registry import query
from markgrid.functions import vocab as V
from markgrid.operators import aggregate as A
from markgrid.operators import reconcile as R

c = F.col
DOC, PAGE = ["doc_id"], ["doc_id", "page_no"]
CLASSES = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]


@query("class_counts", "A1", "select doc_id, cls, count(*) as n, count(tag) as n_tagged, count(distinct tag) as n_tags, round(avg(conf_pct), 6) as mean_conf from {boxes} group by 1, 2")
def _(t):
    return A.class_counts(t.boxes, DOC).withColumn("mean_conf", F.round("mean_conf", 6))


@query("class_tag_counts", "A2", "select doc_id, cls, coalesce(tag, '(no-tag)') as tag, count(*) as n, round(avg(conf_pct), 6) as mean_conf from {boxes} group by 1, 2, 3")
def _(t):
    return A.class_tag_counts(t.boxes, DOC).withColumn("mean_conf", F.round("mean_conf", 6))


SCHED_NECK = "case when row_no % 4 <> 0 then cast(6 + row_no % 7 as string) end as neck"
SCHED_TYPE = "case row_no % 5 when 0 then ' LAY-IN ' when 1 then 'OMNI' when 2 then 'double deflection' when 3 then 'PCS 2' end as type"
CLS_A3 = "case when cls in ('A-F', 'R-F') then 'AD-' || cls else cls end"


@query("takeoff_rows", "A3 D18", f"""
with b as (select doc_id, page_no, {CLS_A3} as cls, coalesce(tag, '') as tag, case when l_partkey % 3 = 0 then '' else cast(l_suppkey % 4 as string) end as neck from {{boxes}}),
e as (select doc_id, cls, tag, {SCHED_NECK}, {SCHED_TYPE} from {{expected}}), k as (select doc_id, tag, min(neck) as sn, min(type) as ty from e group by 1, 2), pg as (select doc_id, cls, tag, string_agg(page_no, ', ' order by page_no) as pages from (select distinct doc_id, cls, tag, page_no from b) z group by 1, 2, 3),
r as (select doc_id, cls, tag, neck, count(*) as qty, count(distinct page_no) as n_pages, min(page_no) as first_page, case when neck <> '' then 'neck' else 'remainder' end as kind from b group by 1, 2, 3, 4),
u as (select * from r union all select distinct doc_id, cls, tag, '', 1, 0, null::bigint, 'schedule_only' from {{expected}} e where not exists (select 1 from b where b.doc_id = e.doc_id and b.tag = e.tag))
select u.*, coalesce(pages, '') as pages, case when u.neck <> '' then u.neck else coalesce(sn, '') end as shown_neck,
 case when starts_with(u.cls, 'AD-') and (contains(trim(ty), ' ') or regexp_matches(upper(ty), '{V.AIR_DEVICE_WORDS}')) then trim(ty) else u.cls end as product
from u left join pg on pg.doc_id = u.doc_id and pg.cls = u.cls and pg.tag = u.tag left join k on k.doc_id = u.doc_id and k.tag = u.tag""")
def _(t):
    b = t.boxes.selectExpr("doc_id", "page_no", f"{CLS_A3} as cls", "tag", "case when l_partkey % 3 = 0 then '' else cast(l_suppkey % 4 as string) end as neck")
    return A.takeoff_rows(b, t.expected.selectExpr("doc_id", "cls", "tag", SCHED_NECK, SCHED_TYPE), DOC)


@query("class_totals", "A4", "select doc_id, cls, count(*) as total, false as is_total from {boxes} group by 1, 2 union all select doc_id, null, count(*), true from {boxes} group by 1")
def _(t):
    return A.totals(t.boxes.withColumn("one", F.lit(1)), DOC, "cls", "one")


@query("quantity_rule", "A5", """
select tag, cast(sum(coalesce(case when qty % 3 = 0 then null else qty end, 1)) as bigint) as total_qty, cast(sum(coalesce(cfm, 0)) as bigint) as total_cfm, count(cfm) as cfm_hits
from (select tag, qty, nullif(cfm, 0) as cfm from {team}) x group by 1""")
def _(t):
    d = t.team.selectExpr("tag", "case when qty % 3 = 0 then null else qty end as qty", "nullif(cfm, 0) as cfm")
    return A.instance_or_sum(d, ["tag"])


@query("three_way_quantities", "A6", """
select product, null as tag, cast(sum(qty) as bigint) as total, 'product' as level from {team} group by 1 union all select product, tag, cast(sum(qty) as bigint), 'product_tag' from {team} group by 1, 2
union all select null, tag, cast(sum(qty) as bigint), 'tag' from {team} group by 2""")
def _(t):
    return A.three_way_quantities(t.team, "product", "tag")


@query("bucket_stats", "A7", """
with n as (select doc_id, cls, l_suppkey % 7 as lab, count(*) as n from {boxes} group by 1, 2, 3), m as (select doc_id, cls, lab as label from n qualify row_number() over (partition by doc_id, cls order by n desc, lab) = 1)
select b.doc_id, b.cls, count(*) as n, min(conf_pct) as min_conf, max(conf_pct) as max_conf, min(m.label) as label from {boxes} b join m using (doc_id, cls) group by 1, 2""")
def _(t):
    return A.bucket_stats(t.boxes.withColumn("label", c("l_suppkey") % 7), ["doc_id", "cls"], "conf_pct", "label")


@query("room_class_matrix", "A8", "select doc_id, l_partkey % 10 as room, " + ", ".join(f"count(*) filter (where cls = '{x}') as n_{i}" for i, x in enumerate(CLASSES)) + ", count(*) as total from {boxes} group by 1, 2")
def _(t):
    return A.matrix(t.boxes.withColumn("room", c("l_partkey") % 10), ["doc_id", "room"], "cls", CLASSES)


SQL_VOTE = """v as (select doc_id, page_no, case l_partkey % 5 when 0 then null when 1 then '1/8' when 2 then '1/4' when 3 then '1/4' else '1:50' end as scale, l_suppkey % 6 = 0 and doc_id % 3 = 0 as kw from {boxes}),
n as (select doc_id, kw, scale, count(*) as n from v where scale is not null group by 1, 2, 3), k as (select doc_id, kw, arg_min(scale, (-n, scale)) as majority, max(n) as votes, count(*) as n_values from n group by 1, 2),
b as (select doc_id, majority, votes, n_values, kw as strong_pool, least(0.99e0, (case when kw then 0.85e0 else 0.6e0 end) + (case when n_values = 1 then 0.1e0 else 0 end) + (case when votes >= 3 then 0.05e0 else 0 end)) as confidence from k qualify row_number() over (partition by doc_id order by kw desc) = 1)"""


def votes(t):
    return t.boxes.selectExpr("doc_id", "page_no", "case l_partkey % 5 when 0 then null when 1 then '1/8' when 2 then '1/4' when 3 then '1/4' else '1:50' end as scale", "l_suppkey % 6 = 0 and doc_id % 3 = 0 as kw")


@query("majority_vote", "A21", f"with {SQL_VOTE} select doc_id, majority, votes, n_values, strong_pool, round(confidence, 6) as confidence from b")
def _(t):
    return A.majority(votes(t), DOC, "scale", "kw").withColumn("confidence", F.round("confidence", 6))


@query("majority_outliers", "A21", f"with {SQL_VOTE} select v.doc_id, page_no, case when scale is null then 'missing' else 'differs' end as kind, count(*) as n from v join b using (doc_id) where scale is null or scale <> majority group by 1, 2, 3")
def _(t):
    v = votes(t)
    return A.outliers(v, A.majority(v, DOC, "scale", "kw"), DOC, "scale").groupBy("doc_id", "page_no", "kind").agg(F.count("*").alias("n"))


@query("drawing_style", "A22", """
with i as (select l_orderkey as doc_id, case (l_partkey + l_orderkey) % 7 when 0 then 'ocr_fallback' when 1 then 'bare_mark' when 2 then 'bare_mark_no_size' else 'combined_label' end as method from {boxes}),
g as (select doc_id, count(*) as n, count(*) filter (where method = 'ocr_fallback') as ocr, count(*) filter (where method = 'combined_label') as cb, count(*) filter (where method like 'bare%') as ba from i group by 1)
select doc_id, n, case when ocr = n then 'ocr_only' when cb >= 0.75e0 * n then 'combined_label' when ba >= 0.75e0 * n then 'bare_mark' when cb > 0 and ba > 0 then 'mixed' else 'combined_label' end as style from g""")
def _(t):
    i = t.boxes.selectExpr("l_orderkey as doc_id", "case (l_partkey + l_orderkey) % 7 when 0 then 'ocr_fallback' when 1 then 'bare_mark' when 2 then 'bare_mark_no_size' else 'combined_label' end as method")
    return A.drawing_style(i, DOC).select("doc_id", "n", "style")


HEADS = ["MECHANICAL PLAN M101 M101 SEE M501", "SCHEDULE CFM MODEL", "GENERAL NOTES LEGEND", "ROOF PLAN MH-3", "TYPICAL DETAILS M-7", "AIR BALANCE", "M601 M601 M201", ""]
TITLES = ["HVAC ROOF PLAN", "COVER"]


def typed_pages(t):
    head = F.array(*[F.lit(x) for x in HEADS])[(c("page_id") % 8).cast("int")]
    title = F.when(c("page_id") % 13 == 0, F.array(*[F.lit(x) for x in TITLES])[(c("page_id") % 2).cast("int")])
    p = t.pages.select("page_id", F.concat(head, F.lit(" "), c("html")).alias("text"), title.alias("title"), (c("page_id") % 7).alias("n_tables"),
                       F.when(c("page_id") % 3 != 0, c("page_id") % 31).alias("n_boxes"), F.when(c("page_id") % 17 == 0, 90000).otherwise(10).alias("n_paths"))
    return A.page_types(p, ["page_id"], "text")


SQL_HITS = {p: " + ".join(f"contains(u, '{w}')::int" for w in ws) for p, ws in V.PAGE_WORDS.items()}
SQL_TYPED = f"""p0 as (select page_id, [{', '.join(repr(x) for x in HEADS)}][cast(page_id % 8 as int) + 1] || ' ' || html as text, case when page_id % 13 = 0 then case when page_id % 2 = 0 then 'HVAC ROOF PLAN' else 'COVER' end end as title, page_id % 7 as nt,
 case when page_id % 3 <> 0 then page_id % 31 end as nb, case when page_id % 17 = 0 then 90000 else 10 end as np from {{pages}}),
p1 as (select *, upper(text) as u, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words from p0),
sv as (select page_id, s as sheet from (select page_id, unnest(regexp_extract_all(u, '\\b(M[0-9]{{3,4}})\\b', 1)) as s from p1) z group by 1, 2 qualify row_number() over (partition by page_id order by count(*) desc, s) = 1),
p2 as (select p1.*, sheet, cast(substr(sheet, 2) as int) as num, {", ".join(f"{q} as s_{p}" for p, q in SQL_HITS.items())}, contains(u, 'PLAN') as pw, contains(u, 'ROOF') as rw, sheet is null and regexp_matches(u, '\\bM[A-Z]?-?[0-9]{{1,4}}\\b') as odd from p1 left join sv using (page_id)),
p3 as (select *, coalesce(num < 100 or starts_with(sheet, 'M00'), false) as cov from p2),
p4 as (select *, (not cov and coalesce(num between 100 and 199 or num between 300 and 499, false))::int + (odd and pw and not rw)::int as fl, (not cov and coalesce(num between 200 and 299, false))::int + (odd and pw and rw)::int as rf,
  s_schedule + (odd and not pw and contains(u, 'SCHEDULE'))::int as sc1, s_details + (not cov and coalesce(num >= 500, false))::int + (odd and not pw and not contains(u, 'SCHEDULE') and contains(u, 'DETAILS'))::int as v_details, coalesce(np >= 8000 and words <= 800 and np / greatest(1, words)::double >= 10, false) as dense from p3),
p5 as (select *, sc1 + (fl + rf = 0 and (nt >= 5 or (nt >= 3 and sc1 > 0)))::int as sc2 from p4),
p6 as (select *, s_cover + cov::int as v_cover, sc2 + (contains(u, 'AIR BALANCE') and sc2 = 0)::int as v_schedule, s_legend as v_legend, 0 as v_notes, s_mechanical_plan + fl + coalesce(nb >= 10 or (nb >= 3 and nt <= 4 and words < 100), false)::int + (dense and not rw)::int as v_mechanical_plan,
  s_roof_plan + rf + (dense and rw)::int as v_roof_plan, s_riser_diagram as v_riser_diagram, s_air_balance + contains(u, 'AIR BALANCE')::int as v_air_balance, 0 as v_other from p5),
p7 as (select *, list_sort([{", ".join(f"{{'neg': -v_{x}, 'ord': {i}, 'type': '{x}'}}" for i, x in enumerate(V.PAGE_TYPES))}]) as r from p6),
p8 as (select *, -r[1].neg as n1, -r[2].neg as n2, case when r[1].neg = 0 then case when words < 30 and coalesce(nb, 0) > 0 then 'mechanical_plan' else 'other' end else r[1].type end as won, fl + rf > 0 or dense as sure,
  case title when 'HVAC ROOF PLAN' then 'roof_plan' when 'COVER' then case when coalesce(nb, 0) < 20 then 'cover' end end as tt from p7),
p9 as (select page_id, words as n_words, case when tt is not null then tt when sure then case when v_roof_plan > 0 then 'roof_plan' else 'mechanical_plan' end when (coalesce(nb, 0) >= 10 and won in ('cover', 'legend', 'riser_diagram')) or (coalesce(nb, 0) >= 20 and won in ('schedule', 'air_balance', 'details', 'other')) then 'mechanical_plan' else won end as type,
  case when tt is not null then 0.95e0 when sure or n2 = 0 then 1e0 else greatest(0e0, ((case when n1 = 0 then 1 else n1 end) - n2) / (case when n1 = 0 then 1 else n1 end)::double) end as confidence from p8)"""


@query("page_classification", "A23 F18 W11 D11", f"with {SQL_TYPED} select page_id, type, round(confidence, 6) as confidence, n_words, type in ('mechanical_plan', 'roof_plan') as is_plan from p9")
def _(t):
    return typed_pages(t).withColumn("confidence", F.round("confidence", 6))


@query("richest_row", "A24", """
with r as (select doc_id, l_orderkey % 40 as tag, l_partkey * 100000 + l_orderkey as row_no, (service <> 'PUMP')::int + (mounting is not null)::int + (raw_size <> '')::int as n_props from {raw_items})
select doc_id, tag, min(row_no) filter (where n_props = mx) as row_no, max(mx) as n_props from (select *, max(n_props) over (partition by doc_id, tag) as mx from r) z group by 1, 2""")
def _(t):
    r = t.raw_items.selectExpr("doc_id", "l_orderkey % 40 as tag", "l_partkey * 100000 + l_orderkey as row_no",
                               "cast(service <> 'PUMP' as int) + cast(mounting is not null as int) + cast(raw_size <> '' as int) as n_props")
    return A.richest(r, ["doc_id", "tag"], c("n_props"), "row_no")


@query("preferred_class", "A25", f"""
with r as (select doc_id, case l_suppkey % 4 when 0 then 'EF-' when 1 then 'CU-' when 2 then 'SA-' else 'ZZ-' end || (l_orderkey % 60) as tag, case l_partkey % 4 when 0 then 'EXHAUST FAN' when 1 then 'CONDENSING UNIT' when 2 then '' else 'AD-GRD' end as cls, l_partkey * 100000 + l_orderkey as row_no from {{raw_items}}),
k as (select *, case when coalesce(cls = {sql_class_of_tag('tag')}, false) then 0 when cls <> '' then 1 else 2 end as rk from r)
select doc_id, tag, arg_min(cls, (rk, row_no, cls)) as cls from k group by 1, 2""")
def _(t):
    r = t.raw_items.selectExpr("doc_id", "case l_suppkey % 4 when 0 then 'EF-' when 1 then 'CU-' when 2 then 'SA-' else 'ZZ-' end || (l_orderkey % 60) as tag",
                               "case l_partkey % 4 when 0 then 'EXHAUST FAN' when 1 then 'CONDENSING UNIT' when 2 then '' else 'AD-GRD' end as cls", "l_partkey * 100000 + l_orderkey as row_no")
    return A.preferred_class(r, DOC)


@query("discovered_tags", "A26", f"""
with x as (select doc_id, case l_suppkey % 5 when 0 then 'sd ' when 1 then 'RG-' when 2 then 'EF' when 3 then 'ZZ-' else 'TG' end || (l_orderkey % 70) as text from {{raw_items}}),
y as (select doc_id, regexp_extract(replace(upper(text), ' ', ''), '^([A-Z]{{1,3}})-?(\\d{{1,2}})$', 1) as prefix, regexp_extract(replace(upper(text), ' ', ''), '^([A-Z]{{1,3}})-?(\\d{{1,2}})$', 2) as num from x),
s as (select doc_id, prefix, prefix || '-' || num as tag, count(*) as n from y where prefix <> '' group by 1, 2, 3 having count(*) >= 2), q as (select *, bool_or(prefix in ('RG','EG','TG','SR','CD')) over (partition by doc_id) as ctx from s),
z as (select doc_id, tag, n, case when ctx and prefix in ('SD','RG','EG','TG','SR','CD') then 'AD-GRD' else coalesce({sql_case('prefix', V.TAG_PREFIX_CLASS)}, case when prefix in ('SD','RG','EG','TG','SR','CD') then 'AD-GRD' end) end as cls from q) select * from z where cls is not null""")
def _(t):
    x = t.raw_items.selectExpr("doc_id", "case l_suppkey % 5 when 0 then 'sd ' when 1 then 'RG-' when 2 then 'EF' when 3 then 'ZZ-' else 'TG' end || (l_orderkey % 70) as text")
    return A.discovered_tags(x, DOC)


@query("severity_counts", "A28", f"""
with {SQL_PRESENCE.strip()}, {SQL_PAGES}, w as (select doc_id, regexp_replace(upper(tag), '[\\s\\-_.]+', '', 'g') as k, max(exp_qty) as want from {{expected}} group by 1, 2), p as (select pr.*, want from pr left join w using (doc_id, k)),
u as (select doc_id, count(*) as n from {{observed}} where tag is null group by 1),
a as (select doc_id, 'medium' as severity from p where n_exp > 0 and n_obs = 0 union all select doc_id, case when n < 20 then 'low' else 'medium' end from u union all select doc_id, 'high' from p where want > 0 and n_obs = 0
 union all select doc_id, 'medium' from p where abs(n_obs - want) >= greatest(2e0, want * 0.3e0) and not (n_obs = 0 and want > 0) union all select doc_id, 'low' from pg where conf < 0.5e0)
select doc_id, severity, count(*) as n from a group by 1, 2""")
def _(t):
    low = page_types(t).select("doc_id", c("conf").alias("confidence"))
    return A.severity_counts(R.quality_checks(t.expected, t.observed, DOC), low, DOC)


@query("headline_statistics", "A32", """
with a as (select tag, sum(qty) as q from {team} group by 1), b as (select tag, sum(qty) as q from {ours} group by 1), r as (select least(a.q, coalesce(b.q, 0)) / a.q::double as recall from a left join b using (tag)),
o as (select recall, row_number() over (order by recall) as k, count(*) over () as n from r)
select max(n) as total, max(recall) as max, count(*) filter (where recall >= 0.5e0) as at_least_half, max(case when k = n // 2 + 1 then recall end) as upper_median from o""")
def _(t):
    j = R.stacked(t.team, t.ours, ["tag"], {"a": ("l", "qty"), "b": ("r", "qty")}).where("a > 0")
    return A.headline(j.select((F.least("a", "b") / c("a")).alias("recall")), "recall")


@query("class_digest", "A33 O1", """
with n as (select doc_id, cls, count(*) as n from {boxes} group by 1, 2) select doc_id, cls, n, row_number() over (partition by doc_id order by n desc, cls) as position from n""")
def _(t):
    n = t.boxes.groupBy("doc_id", "cls").agg(F.count("*").alias("n"))
    return A.top_per_group(n, DOC, [F.desc("n"), "cls"])


@query("page_text_health", "A35", "select doc_id, page_no, count(*) as n, count(*) filter (where text = '') as n_broken, case when count(*) filter (where text = '') >= 0.02e0 * count(*) then 'undecoded' when count(*) < 10 then 'sparse' else 'ok' end as health from {words} group by 1, 2")
def _(t):
    return A.text_health(t.words, PAGE, c("text") == "", share=0.02)


@query("class_dictionary", "A36", """
with r as (select doc_id, schedule_name as cls, l_orderkey % 30 as tag, l_partkey * 100000 + l_orderkey as row_no, service, mounting, l_partkey, l_suppkey, line_no from {raw_items}),
d as (select * from r qualify row_number() over (partition by doc_id, cls, tag order by row_no desc, service desc, mounting desc nulls last) = 1)
select doc_id, cls, tag, 'order_key' as k, cast(row_no % 100000 as string) as v from d""")
def _(t):
    r = t.raw_items.selectExpr("doc_id", "schedule_name as cls", "l_orderkey % 30 as tag", "l_partkey * 100000 + l_orderkey as row_no", "l_orderkey as order_key")
    return A.class_dictionary(r, DOC, ["order_key"])


@query("best_legend_page", "A39", f"""
with p as (select page_id // 5 as doc_id, page_id as page_no, upper([{', '.join(repr(x) for x in HEADS)}][cast(page_id % 8 as int) + 1] || html) as u from {{pages}}),
s as (select *, contains(u, 'LEGEND')::int + contains(u, 'SYMBOL')::int + contains(u, 'ABBREVIATION')::int as w, contains(u, 'SCHEDULE')::int + contains(u, 'PLAN')::int + contains(u, 'DETAILS')::int as l from p),
r as (select *, 2 * w + l as score, case when w >= 1 and 2 * w + l >= 4 then 1 when 2 * w + l >= 2 then 2 when w >= 1 then 3 end as rule from s)
select doc_id, min(rule) as rule, arg_min(page_no, (rule, -score, page_no)) as page_no from r where rule is not null group by 1""")
def _(t):
    head = F.array(*[F.lit(x) for x in HEADS])[(c("page_id") % 8).cast("int")]
    p = t.pages.selectExpr("page_id div 5 as doc_id", "page_id as page_no", "html", "page_id").withColumn("text", F.concat(head, c("html")))
    from markgrid.functions.common import hits

    labels = hits(F.upper("text"), ["SCHEDULE", "PLAN", "DETAILS"])
    return A.best_page(p, DOC, A.legend_hits(c("text")), labels)


@query("side_by_side_counts", "A40", """
select cls, cast(sum(b) as bigint) as base, cast(sum(r) as bigint) as revised from (select cls, 1 as b, 0 as r from {boxes} union all select cls, 0, 1 from {revision}) x group by 1""")
def _(t):
    return A.side_by_side({"base": t.boxes, "revised": t.revision}, ["cls"])


@query("value_recovery", "A41", """
with a as (select tag, neck as value, count(*) as n from {team} group by 1, 2), b as (select tag, neck as value, count(*) as n from {ours} group by 1, 2), j as (select coalesce(a.tag, b.tag) as tag, coalesce(a.n, 0) as t, coalesce(b.n, 0) as f from a full join b on a.tag = b.tag and a.value = b.value)
select tag, count(*) filter (where t > 0) as n_true, count(*) filter (where f > 0) as n_found, count(*) filter (where t > 0 and f > 0) as n_both, cast(sum(f) as bigint) as rows_found, cast(sum(case when t > 0 then f else 0 end) as bigint) as rows_right,
 count(*) filter (where t > 0 and f > 0) > 0 as hit, round(case when sum(f) > 0 then sum(case when t > 0 then f else 0 end) / sum(f)::double else 0 end, 6) as coverage from j group by 1""")
def _(t):
    a, b = (d.select("tag", c("neck").alias("value")) for d in (t.team, t.ours))
    return A.value_recovery(a, b, ["tag"]).withColumn("coverage", F.round("coverage", 6))


@query("by_status_rank", "O3", "select doc_id, tag, case when n_exp = 0 then 'orphan' when n_obs = 0 then 'under' when n_obs > n_exp then 'over' else 'match' end as status from (select pr.doc_id, coalesce(pr.e_tag, pr.o_tag) as tag, n_exp, n_obs from (select * from (with " + SQL_PRESENCE.strip() + " select * from pr) z) pr) y")
def _(t):
    p = R.tag_presence(t.expected, t.observed, DOC)
    s = F.when(c("n_exp") == 0, "orphan").when(c("n_obs") == 0, "under").when(c("n_obs") > c("n_exp"), "over").otherwise("match")
    return A.by_rank(p.select("doc_id", F.coalesce("e_tag", "o_tag").alias("tag"), s.alias("status")), "status", ["under", "over", "orphan", "match"], ["doc_id", "tag"])


@query("best_and_worst", "O4", "(select tag, qty, 'top' as end from (select tag, cast(sum(qty) as bigint) as qty from {team} group by 1) a order by qty desc, tag limit 5) union all (select tag, qty, 'bottom' from (select tag, cast(sum(qty) as bigint) as qty from {team} group by 1) b order by qty, tag limit 5)")
def _(t):
    return A.both_ends(t.team.groupBy("tag").agg(F.sum("qty").alias("qty")), ["tag"], "qty", 5)


@query("newest_first", "O5 D17", "select event_id, user_id, event_type from {events} order by ts desc, event_id")
def _(t):
    return t.events.orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "event_type")


