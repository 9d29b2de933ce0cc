"""Reconciliation queries."""

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.functions import keys as K
from markgrid.operators import reconcile as R

c = F.col
DOC = ["doc_id"]
UNIQUE = ["1-URGENT", "2-HIGH", "3-MEDIUM"]

CANON = "regexp_replace(upper({0}), '[\\s\\-_.]+', '', 'g')"
SQL_CLASS_ROWS = f"""
e as (select doc_id, cls, count(distinct {CANON.format('tag')}) as expected from {{expected}} group by all),
d as (select doc_id, cls, count(*) as detected, sum(conf_pct) as cs from {{observed}} group by all),
mc as (select x.doc_id, x.cls, count(*) as n_missing from (select distinct doc_id, cls, {CANON.format('tag')} as k from {{expected}}) x
  where not exists (select 1 from {{observed}} o where o.doc_id = x.doc_id and o.cls = x.cls and {CANON.format('o.tag')} = x.k) group by all),
j as (select coalesce(e.doc_id, d.doc_id) as doc_id, coalesce(e.cls, d.cls) as cls, coalesce(expected, 0) as expected, coalesce(detected, 0) as detected, cs
  from e full join d on e.doc_id = d.doc_id and e.cls = d.cls),
cr as (select j.*, coalesce(n_missing, 0) as n_missing, j.cls in ('1-URGENT','2-HIGH','3-MEDIUM') as counted,
  case when j.cls not in ('1-URGENT','2-HIGH','3-MEDIUM') then 'info' when expected = 0 then case when detected > 0 then 'orphan_class' else 'info' end
   when detected = expected then 'match' when detected < expected then 'under' else 'over' end as status from j left join mc using (doc_id, cls))"""
SQL_PRESENCE = f"""
pe as (select doc_id, {CANON.format('tag')} as k, count(*) as n_exp, min(tag) as e_tag from {{expected}} where tag is not null group by 1, 2),
po as (select doc_id, {CANON.format('tag')} as k, count(*) as n_obs, min(tag) as o_tag from {{observed}} where tag is not null group by 1, 2),
pr as (select coalesce(pe.doc_id, po.doc_id) as doc_id, coalesce(pe.k, po.k) as k, coalesce(n_exp, 0) as n_exp, coalesce(n_obs, 0) as n_obs, e_tag, o_tag
  from pe full join po on pe.doc_id = po.doc_id and pe.k = po.k)"""


def class_rows(t):
    return R.class_reconciliation(t.expected, t.observed, DOC, UNIQUE)


@query("class_reconciliation", "J1 D10", f"""
with {SQL_CLASS_ROWS.strip()}
select doc_id, cls, expected, detected, n_missing, status, counted, case when not counted and expected = 0 then 0 else detected - expected end as delta,
 round(cs / detected::double, 6) as mean_conf from cr""")
def _(t):
    d = class_rows(t)
    return d.select("doc_id", "cls", "expected", "detected", "n_missing", "status", "counted", "delta", F.round("mean_conf", 6).alias("mean_conf"))


@query("missing_by_class", "J1", f"""
with e as (select doc_id, cls, tag, {CANON.format('tag')} as k from {{expected}}), o as (select distinct doc_id, cls, {CANON.format('tag')} as k from {{observed}})
select e.doc_id, e.cls, min(tag) as tag from e anti join o using (doc_id, cls, k) group by e.doc_id, e.cls, e.k""")
def _(t):
    return R.missing_by_class(t.expected, t.observed, DOC)


@query("tag_cross_reference", "J2", f"""
with {SQL_PRESENCE.strip()}
select doc_id, coalesce(e_tag, o_tag) as tag, case when n_obs = 0 then 'missing_on_plan' else 'orphan' end as verdict from pr where n_exp = 0 or n_obs = 0""")
def _(t):
    return R.tag_cross_reference(t.expected, t.observed, DOC)


@query("document_trust", "A16 J1 J2 F29", f"""
with {SQL_CLASS_ROWS.strip()}, {SQL_PRESENCE.strip()},
a as (select doc_id, count(*) filter (where counted and expected > 0) as n_cls, count(*) filter (where counted and expected > 0 and status = 'match') as n_match,
  cast(sum(cs) as double) as conf_sum, cast(sum(detected) as double) as conf_n, count(*) filter (where status = 'under') as classes_under, count(*) filter (where status in ('over', 'orphan_class')) as classes_over from cr group by 1),
b as (select doc_id, count(*) filter (where n_exp > 0) as scheduled, count(*) filter (where n_exp > 0 and n_obs > 0) as found, count(*) filter (where n_obs > 0) as detected_tags from pr group by 1),
k as (select coalesce(a.doc_id, b.doc_id) as doc_id, classes_under, classes_over, scheduled, found, detected_tags, case when n_cls > 0 then n_match / n_cls::double end as r1, case when scheduled > 0 then found / scheduled::double end as r2,
  case when conf_n > 0 then conf_sum / conf_n / 100e0 end as r3 from a full join b on a.doc_id = b.doc_id),
s as (select *, (coalesce(r1 * 0.45e0, 0) + coalesce(r2 * 0.35e0, 0) + coalesce(r3 * 0.2e0, 0)) / nullif((case when r1 is null then 0 else 0.45e0 end) + (case when r2 is null then 0 else 0.35e0 end) + (case when r3 is null then 0 else 0.2e0 end), 0) as sc from k)
select doc_id, classes_under, classes_over, scheduled, found, detected_tags, round(r1, 6) as count_match_rate, round(r2, 6) as tag_presence_rate, round(r3, 6) as mean_detection_conf, round(sc, 6) as score,
 case when sc is null then 'UNKNOWN' when sc >= 0.8e0 then 'HIGH' when sc >= 0.5e0 then 'MEDIUM' else 'LOW' end as tier from s""")
def _(t):
    d = R.trust(class_rows(t), R.tag_presence(t.expected, t.observed, DOC), DOC)
    r = lambda x: F.round(x, 6).alias(x)
    return d.select("doc_id", "classes_under", "classes_over", "scheduled", "found", "detected_tags", r("count_match_rate"), r("tag_presence_rate"),
                    r("mean_detection_conf"), r("score"), "tier")


@query("failure_modes", "A29", f"""
with {SQL_CLASS_ROWS.strip()}, {SQL_PRESENCE.strip()},
m as (select doc_id, status as mode from cr where status in ('under', 'over', 'orphan_class') union all
 select doc_id, case when n_exp = 0 then 'orphan_tag' else 'missing_tag' end from pr where n_exp = 0 or n_obs = 0),
p as (select doc_id, mode, count(*) as n from m group by all)
select mode, count(*) as n_docs, cast(sum(n) as bigint) as n from p group by mode""")
def _(t):
    d = R.failure_modes(class_rows(t), R.tag_presence(t.expected, t.observed, DOC), DOC)
    return d.groupBy("mode").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


@query("keyed_table_diff", "J3", """
select coalesce(a.tag, b.tag) as tag, coalesce(a.neck, b.neck) as neck, coalesce(a.product, b.product) as product, a.qty as t_qty, b.qty as o_qty,
 array_to_string(list_filter([case when a.qty <> b.qty then 'qty' end, case when a.cfm <> 0 and b.cfm <> 0 and a.cfm <> b.cfm then 'cfm' end, case when a.module <> 0 and b.module <> 0 and a.module <> b.module then 'module' end], lambda x: x is not null), ',') as diffs,
 case when b.tag is null then 'MISSING' when a.tag is null then 'EXTRA' when a.qty <> b.qty or (a.cfm <> 0 and b.cfm <> 0 and a.cfm <> b.cfm) or (a.module <> 0 and b.module <> 0 and a.module <> b.module) then 'DIFF' else 'MATCH' end as status
from {team} a full join {ours} b on a.tag = b.tag and a.neck = b.neck and a.product = b.product""")
def _(t):
    d = R.keyed_diff(t.team, t.ours, ["tag", "neck", "product"], ["qty"], ["cfm", "module"])
    return d.select("tag", "neck", "product", "t_qty", "o_qty", F.array_join("diffs", ",").alias("diffs"), "status")


@query("quantity_diff_by_tag", "J4 A6", """
with a as (select tag, sum(qty) as q from {team} group by 1), b as (select tag, sum(qty) as q from {ours} group by 1),
j as (select coalesce(a.tag, b.tag) as tag, cast(coalesce(a.q, 0) as bigint) as team, cast(coalesce(b.q, 0) as bigint) as ours from a full join b on a.tag = b.tag)
select *, ours - team as delta, case when team = ours then 'MATCH' when team = 0 then 'EXTRA' when ours = 0 then 'MISSING' else 'DIFF' end as status from j""")
def _(t):
    return R.quantity_diff(t.team, t.ours, ["tag"])


@query("quantity_recall", "J4 A11", """
with a as (select tag, neck, sum(qty) as q from {team} group by 1, 2), b as (select tag, neck, sum(qty) as q from {ours} group by 1, 2),
j as (select coalesce(a.q, 0) as x, coalesce(b.q, 0) as y from a full join b on a.tag = b.tag and a.neck = b.neck)
select cast(sum(x) as bigint) as team_total, cast(sum(y) as bigint) as ours_total, cast(sum(least(x, y)) as bigint) as matched,
 round(sum(least(x, y)) / sum(x)::double, 9) as recall, round(sum(least(x, y)) / sum(y)::double, 9) as precision from j""")
def _(t):
    d = R.quantity_score(t.team, t.ours, ["tag", "neck"])
    return d.withColumns({"recall": F.round("recall", 9), "precision": F.round("precision", 9)})


@query("attribute_lookup", "J5", """
with f as (select doc_id, tag, row_no, exp_qty, cls as prio from {expected}),
s as (select o_orderkey // 250 as doc_id, 'P' || o_orderkey as tag, o_orderkey as row_no, 10 + o_custkey % 6 as exp_qty, o_orderstatus as prio from {orders})
select b.doc_id, b.page_no, b.det_id, b.tag, coalesce(r.exp_qty, k.exp_qty, z.exp_qty) as exp_qty, coalesce(r.prio, k.prio, z.prio) as prio,
 case when r.tag is not null then 'raw' when k.tag is not null then 'canonical' when z.tag is not null then 'second' end as found_by
from {boxes} b left join f r on r.doc_id = b.doc_id and r.tag = b.tag
 left join f k on k.doc_id = b.doc_id and replace(k.tag, '-', '') = replace(b.tag, '-', '')
 left join s z on z.doc_id = b.doc_id and z.tag = replace(b.tag, '-', '')""")
def _(t):
    first = t.expected.select("doc_id", "tag", "row_no", "exp_qty", c("cls").alias("prio"))
    second = t.orders.selectExpr("o_orderkey div 250 as doc_id", "'P' || o_orderkey as tag", "o_orderkey as row_no", "10 + o_custkey % 6 as exp_qty", "o_orderstatus as prio")
    rows = t.boxes.select("doc_id", "page_no", "det_id", "tag")
    return R.attribute_lookup(rows, first, second, DOC, ["exp_qty", "prio"])


def instances(t):
    return t.boxes.selectExpr("doc_id", "tag as mark", "l_partkey % 4 as neck", "case when l_suppkey % 5 <> 0 then 30 + l_partkey % 300 end as cfm")


SQL_BOM = """bom as (select doc_id, tag as mark, l_partkey % 4 as neck, count(*) as qty, cast(sum(case when l_suppkey % 5 <> 0 then 30 + l_partkey % 300 else 0 end) as bigint) as total_cfm,
 count(*) filter (where l_suppkey % 5 = 0) as cfm_missing from {boxes} group by 1, 2, 3)"""


@query("bill_of_materials", "J6 D6", f"with {SQL_BOM} select b.*, e.cls, e.exp_qty from bom b left join {{expected}} e on e.doc_id = b.doc_id and e.tag = b.mark")
def _(t):
    return R.bill_of_materials(instances(t), t.expected, DOC, ["cls", "exp_qty"])


def tag_table_inputs(t, boxes=None):
    """The three sources; ``boxes`` that carry their own units stand in for the table's."""
    units = "case when l_suppkey % 11 = 0 then 0 when l_suppkey % 13 = 0 then 3 else 1 end as units" if boxes is None else "units"
    bom = t.boxes.where("tag is not null").groupBy("doc_id", "tag", (c("l_partkey") % 3).cast("string").alias("neck")).agg(
        F.count("*").alias("qty"), F.sum((c("l_suppkey") % 5 == 0).cast("int")).alias("cfm_missing"))
    boxes = (t.boxes if boxes is None else boxes).selectExpr(
        "doc_id", "cls", "tag", "case when l_partkey % 5 < 3 then cast(l_partkey % 5 as string) else '' end as neck", units, "conf_pct as conf")
    sched = t.expected.selectExpr("doc_id", "tag", "cast(exp_qty as string) as neck")
    return bom, boxes, sched


SQL_TAG_BOM = """bom as (select doc_id, tag, cast(l_partkey % 3 as string) as neck, count(*) as qty, count(*) filter (where l_suppkey % 5 = 0) as cfm_missing from {boxes} where tag is not null group by 1, 2, 3)"""
SQL_TAG_BOXES = """bx as (select doc_id, cls, coalesce(tag, '') as tag, case when l_partkey % 5 < 3 then cast(l_partkey % 5 as string) else '' end as neck,
  case when l_suppkey % 11 = 0 then 0 when l_suppkey % 13 = 0 then 3 else 1 end as units, conf_pct as conf from {boxes})"""
SQL_TAG_BRANCHES = """live as (select * from bx where units > 0),
pt as (select doc_id, tag, sum(units) as box_qty from live group by 1, 2),
bn as (select doc_id, cls, tag, neck, count(*) as bucket, max(conf) as conf from live where neck <> '' group by 1, 2, 3, 4),
tn as (select doc_id, tag, neck, sum(bucket) as neck_qty, max(conf) as neck_conf from bn group by 1, 2, 3),
sc as (select doc_id, tag, min(cast(exp_qty as string)) as sneck from {expected} group by 1, 2),
r1 as (select b.doc_id, b.tag, '' as cls, b.neck, b.qty as plan_qty, coalesce(tn.neck_qty, pt.box_qty, 0) as box_qty, 'plan' as source,
  concat_ws('; ', case when pt.box_qty > 0 and pt.box_qty <> b.qty then 'plan=' || b.qty || ' vs boxes=' || pt.box_qty end, case when b.cfm_missing > 0 then b.cfm_missing || ' without flow' end,
   case when sc.tag is null then 'tag not in schedule' end) as discrepancy, coalesce(tn.neck_conf, 0) as conf
  from bom b left join pt on pt.doc_id = b.doc_id and pt.tag = b.tag left join tn on tn.doc_id = b.doc_id and tn.tag = b.tag and tn.neck = b.neck left join sc on sc.doc_id = b.doc_id and sc.tag = b.tag),
r2 as (select doc_id, tag, cls, neck, 0 as plan_qty, bucket as box_qty, 'bucket' as source, '' as discrepancy, conf from bn b where not exists (select 1 from bom m where m.doc_id = b.doc_id and m.tag = b.tag and m.neck = b.neck)
  qualify row_number() over (partition by doc_id, tag, neck order by cls) = 1),
rs as (select l.doc_id, l.cls, l.tag, l.n - coalesce(k.ib, 0) as n from (select doc_id, cls, tag, sum(units) as n from live group by 1, 2, 3) l left join (select doc_id, cls, tag, sum(bucket) as ib from bn group by 1, 2, 3) k on k.doc_id = l.doc_id and k.cls = l.cls and k.tag = l.tag),
r3 as (select rs.doc_id, rs.tag, rs.cls, coalesce(sc.sneck, '') as neck, 0 as plan_qty, rs.n as box_qty, case when rs.tag = '' then 'untagged' when sc.tag is not null then 'boxes+schedule' else 'boxes' end as source,
  case when rs.tag = '' then 'untagged' else 'no neck size found' end as discrepancy, 0 as conf from rs left join sc on sc.doc_id = rs.doc_id and sc.tag = rs.tag where rs.n > 0),
seen as (select doc_id, tag from r1 union select doc_id, tag from r2 union select doc_id, tag from r3),
r4 as (select sc.doc_id, sc.tag, '' as cls, sc.sneck as neck, 0 as plan_qty, 0 as box_qty, 'schedule-only' as source, 'scheduled but no detection' as discrepancy, 0 as conf from sc
  where not exists (select 1 from seen s where s.doc_id = sc.doc_id and s.tag = sc.tag)),
tt as (select * from r1 union all select * from r2 union all select * from r3 union all select * from r4)"""
SQL_TAG_TABLE = f"{SQL_TAG_BOM}, {SQL_TAG_BOXES}, {SQL_TAG_BRANCHES}"


@query("tag_table", "J7 F31 O2", f"with {SQL_TAG_TABLE.strip()} select doc_id, tag, cls, neck, cast(plan_qty as bigint) as plan_qty, cast(box_qty as bigint) as box_qty, source, discrepancy, cast(conf as bigint) as conf from tt")
def _(t):
    return R.discrepancies_first(R.tag_table(*tag_table_inputs(t), DOC), DOC)


@query("tag_table_totals", "J7", f"""with {SQL_TAG_TABLE.strip()} select doc_id, count(*) as n_rows, cast(sum(case when tag <> '' then box_qty else 0 end) as bigint) as tagged,
 cast(sum(case when tag = '' then box_qty else 0 end) as bigint) as untagged, cast(sum(plan_qty) as bigint) as plan_instances, count(*) filter (where discrepancy <> '') as with_discrepancy from tt group by 1""")
def _(t):
    return R.tag_table_totals(R.tag_table(*tag_table_inputs(t), DOC), DOC)


SQL_IOU = """(greatest(least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1), 0) * greatest(least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1), 0))::double
 / (({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1) + ({1}.x2 - {1}.x1) * ({1}.y2 - {1}.y1) - greatest(least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1), 0) * greatest(least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1), 0))"""


@query("box_agreement", "J8", f"""
with p as (select a.doc_id, a.page_no, a.det_id as l, b.det_id as r from {{boxes}} a join {{revision}} b on a.doc_id = b.doc_id and a.page_no = b.page_no
  and {SQL_IOU.format('a', 'b')} >= 0.3e0)
select 'left' as side, doc_id, page_no, det_id, (doc_id, page_no, det_id) in (select (doc_id, page_no, l) from p) as agreed from {{boxes}} union all
select 'right', doc_id, page_no, det_id, (doc_id, page_no, det_id) in (select (doc_id, page_no, r) from p) from {{revision}}""")
def _(t):
    return R.box_agreement(t.boxes, t.revision, ["doc_id", "page_no"])


@query("note_integrity", "J9", """
with d as (select o_orderkey // 250 as doc_id, o_custkey % 60 as number, count(*) as n from {orders} group by 1, 2),
r as (select doc_id, cast(text as bigint) as number, count(*) as n from {tokens} where regexp_matches(text, '^\\d{1,3}$') and cast(text as int) between 1 and 100 group by 1, 2)
select coalesce(d.doc_id, r.doc_id) as doc_id, coalesce(d.number, r.number) as number, coalesce(d.n, 0) as n_def, coalesce(r.n, 0) as n_ref,
 case when r.n is null then 'defined_not_referenced' else 'referenced_not_defined' end as verdict from d full join r on d.doc_id = r.doc_id and d.number = r.number where d.n is null or r.n is null""")
def _(t):
    from markgrid.functions.text import callout_number

    d = t.orders.selectExpr("o_orderkey div 250 as doc_id", "o_custkey % 60 as number")
    r = t.tokens.select("doc_id", callout_number(c("text")).cast("bigint").alias("number")).where("number is not null")
    return R.reference_integrity(d, r, ["doc_id", "number"])


@query("cross_page_mentions", "J10", """
with m as (select distinct doc_id, page_no, text as tag from {tokens} where text like 'P-%' or regexp_matches(text, '^P\\d')),
d as (select distinct doc_id, page_no, tag from {boxes} where tag is not null)
select m.doc_id, m.page_no, m.tag, case when not exists (select 1 from d where d.doc_id = m.doc_id and d.tag = m.tag) then 'orphan'
 when not exists (select 1 from d where d.doc_id = m.doc_id and d.tag = m.tag and d.page_no = m.page_no) then 'cross' else 'same_page' end as verdict from m""")
def _(t):
    m = t.tokens.where(c("text").like("P-%") | c("text").rlike(r"^P\d")).withColumnRenamed("text", "tag")
    return R.mention_check(m, t.boxes, DOC)


@query("index_completeness", "J11", """
with idx as (select o_orderkey // 250 as doc_id, substr('MEPAZ', 1 + cast(o_custkey % 4 as int), 1) as dl, o_custkey % 40 as num from {orders}),
i as (select distinct doc_id, dl || num as sheet, case dl when 'M' then 'Mechanical' when 'E' then 'Electrical' when 'P' then 'Plumbing' else 'Architectural' end as discipline from idx),
pr as (select l_orderkey // 250 as doc_id, substr('MEZ', 1 + cast(l_partkey % 3 as int), 1) as dl, l_suppkey % 50 as num from {lineitem}),
p as (select distinct doc_id, dl || num as sheet, case dl when 'M' then 'Mechanical' when 'E' then 'Electrical' else 'Unknown' end as discipline from pr)
select doc_id, sheet, 'missing' as verdict from i where exists (select 1 from p where p.doc_id = i.doc_id and p.discipline = i.discipline and p.discipline <> 'Unknown')
 and not exists (select 1 from p where p.doc_id = i.doc_id and p.sheet = i.sheet)
union all select doc_id, sheet, 'unlisted' from p where not exists (select 1 from i where p.doc_id = i.doc_id and p.sheet = i.sheet)""")
def _(t):
    from markgrid.functions.text import discipline_of

    i = t.orders.selectExpr("o_orderkey div 250 as doc_id", "substr('MEPAZ', cast(1 + o_custkey % 4 as int), 1) as dl", "o_custkey % 40 as num")
    p = t.lineitem.selectExpr("l_orderkey div 250 as doc_id", "substr('MEZ', cast(1 + l_partkey % 3 as int), 1) as dl", "l_suppkey % 50 as num")
    shape = lambda d: d.select("doc_id", F.concat("dl", c("num").cast("string")).alias("sheet"), discipline_of(c("dl")).alias("discipline"))
    return R.index_completeness(shape(i), shape(p), DOC)


@query("quality_checks", "J12", f"""
with {SQL_PRESENCE.strip()}, w as (select doc_id, {CANON.format('tag')} as k, max(exp_qty) as want from {{expected}} group by 1, 2),
p as (select pr.*, coalesce(e_tag, o_tag) as tag, want from pr left join w using (doc_id, k)), u as (select doc_id, count(*) as n from {{observed}} where tag is null group by 1)
select doc_id, 'medium' as severity, 'tag_in_schedule_not_on_plan' as kind, tag, 0 as n from p where n_exp > 0 and n_obs = 0
union all select doc_id, case when n < 20 then 'low' else 'medium' end, 'untagged_detections', null, n from u
union all select doc_id, 'high', 'quantity_missing', tag, want from p where want > 0 and n_obs = 0
union all select doc_id, 'medium', 'quantity_off', tag, n_obs - want from p where abs(n_obs - want) >= greatest(2e0, want * 0.3e0) and not (n_obs = 0 and want > 0)""")
def _(t):
    return R.quality_checks(t.expected, t.observed, DOC)


@query("snapshot_changes", "J13", """
with o as (select distinct doc_id, tag from {expected}), n as (select distinct doc_id, tag from {observed} where tag is not null),
j as (select coalesce(o.doc_id, n.doc_id) as doc_id, o.tag as ot, n.tag as nt from o full join n on o.doc_id = n.doc_id and o.tag = n.tag)
select doc_id, count(ot) as n_old, count(nt) as n_new, count(*) filter (where nt is null) as n_lost, count(*) filter (where ot is null) as n_gained, coalesce(string_agg(ot, '|' order by ot) filter (where nt is null), '') as lost, coalesce(string_agg(nt, '|' order by nt) filter (where ot is null), '') as gained from j group by 1""")
def _(t):
    d = R.snapshot_changes(t.expected, t.observed.where("tag is not null"), DOC)
    return d.withColumns({x: F.array_join(x, "|") for x in ("lost", "gained")})


@query("truth_override", "J14", """
select d.doc_id, case when lang = 'en' then n_chars > 1500 end as derived, coalesce(quality = 1, case when lang = 'en' then n_chars > 1500 end) as truth,
 case when quality is not null then 'human' when lang = 'en' then 'derived' else 'unknown' end as origin from {documents} d left join {labels} l on l.doc_id = d.doc_id""")
def _(t):
    rows = t.documents.selectExpr("doc_id", "case when lang = 'en' then n_chars > 1500 end as derived")
    human = t.labels.selectExpr("doc_id", "quality = 1 as human")
    return R.truth_override(rows, human, DOC, "derived", "human").select("doc_id", "derived", "truth", "origin")


@query("signal_disagreement", "J15", """
select d.doc_id, quality = 1 as human, n_chars > 1500 as sized from {documents} d left join {labels} l on l.doc_id = d.doc_id where (quality = 1) is distinct from (n_chars > 1500)""")
def _(t):
    d = t.documents.selectExpr("doc_id", "n_chars > 1500 as sized").join(t.labels.selectExpr("doc_id", "quality = 1 as human"), "doc_id", "left")
    return R.disagreement(d.select("doc_id", "human", "sized"), "human", "sized")


@query("label_remap", "J16", """
with nm as (select distinct l_returnflag as dataset, l_linenumber as cid, 'class ' || ((l_linenumber * (case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end)) % 7) as name from {lineitem}),
vc as (select name, row_number() over (order by name) - 1 as canon_cid from (select distinct name from nm where name <> 'class 0') d)
select l_orderkey, l_partkey, l_suppkey, dataset, cid, canon_cid from (select l_orderkey, l_partkey, l_suppkey, l_returnflag as dataset, l_linenumber as cid from {lineitem}) l join nm using (dataset, cid) join vc using (name)""")
def _(t):
    names = t.lineitem.selectExpr(
        "l_returnflag as dataset", "l_linenumber as cid",
        "'class ' || ((l_linenumber * (case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end)) % 7) as name").distinct()
    from pyspark.sql import Window

    # class vocabularies are a few dozen names
    vocab = names.where("name <> 'class 0'").select("name").distinct().withColumn("canon_cid", F.row_number().over(Window.orderBy("name")) - 1)
    labels = t.lineitem.selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag as dataset", "l_linenumber as cid")
    return R.remap_labels(labels, names, vocab).select("l_orderkey", "l_partkey", "l_suppkey", "dataset", "cid", "canon_cid")


@query("direct_assignment", "J17", """
with s as (select doc_id, case exp_qty when 1 then 'CONDENSING UNIT' when 2 then 'AD-GRD' else 'FAN' end as cls, min(tag) as only from (select doc_id, exp_qty, case when exp_qty < 3 then 'T' || exp_qty else tag end as tag from {expected}) e group by 1, 2 having count(distinct tag) = 1),
b as (select doc_id, page_no, det_id, case l_partkey % 5 when 0 then 'SPLIT SYSTEM' when 1 then 'AD-T-BAR SUPPLY' when 2 then 'AD-GRD' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls from {boxes})
select b.doc_id, page_no, det_id, b.cls, coalesce(o.only, a.only) as direct_tag from b left join s o on o.doc_id = b.doc_id and o.cls = b.cls
 left join s a on a.doc_id = b.doc_id and a.cls = case b.cls when 'SPLIT SYSTEM' then 'CONDENSING UNIT' when 'AD-T-BAR SUPPLY' then 'AD-GRD' end""")
def _(t):
    sched = t.expected.selectExpr("doc_id", "case exp_qty when 1 then 'CONDENSING UNIT' when 2 then 'AD-GRD' else 'FAN' end as cls",
                                  "case when exp_qty < 3 then 'T' || exp_qty else tag end as tag")
    b = t.boxes.selectExpr("doc_id", "page_no", "det_id", "case l_partkey % 5 when 0 then 'SPLIT SYSTEM' when 1 then 'AD-T-BAR SUPPLY' when 2 then 'AD-GRD' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls")
    return R.direct_assignment(b, sched, DOC, K.scalar_alias(c("cls"))).select("doc_id", "page_no", "det_id", "cls", "direct_tag")


@query("subtype_refinement", "J18", """
with s as (select l_orderkey // 250 as doc_id, 'P' || l_orderkey as tag, case l_suppkey % 5 when 0 then 'AD-GRD' when 1 then 'EXHAUST FAN' when 2 then 'AD-T-BAR SUPPLY' else 'AD-SURF SUPPLY' end as sub from {lineitem}),
n as (select doc_id, tag, sub, count(*) as n from s group by 1, 2, 3),
m as (select doc_id, tag, sub as mode from n qualify row_number() over (partition by doc_id, tag order by n desc, sub) = 1),
b as (select doc_id, page_no, det_id, tag, case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-T-BAR SUPPLY' when 2 then 'AD-SURF SUPPLY' else 'FAN' end as cls from {boxes}),
j as (select b.*, mode, starts_with(b.cls, 'AD-') and starts_with(coalesce(mode, ''), 'AD-') and mode <> b.cls and mode <> 'AD-GRD' as yes from b left join m on m.doc_id = b.doc_id and m.tag = b.tag)
select doc_id, page_no, det_id, case when yes then mode else cls end as cls, case when yes then cls end as original_cls from j""")
def _(t):
    sched = t.lineitem.selectExpr("l_orderkey div 250 as doc_id", "'P' || l_orderkey as tag", "case l_suppkey % 5 when 0 then 'AD-GRD' when 1 then 'EXHAUST FAN' when 2 then 'AD-T-BAR SUPPLY' else 'AD-SURF SUPPLY' end as subtype")
    b = t.boxes.selectExpr("doc_id", "page_no", "det_id", "case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-T-BAR SUPPLY' when 2 then 'AD-SURF SUPPLY' else 'FAN' end as cls", "tag")
    return R.refine_by_mode(b, sched, DOC).select("doc_id", "page_no", "det_id", "cls", "original_cls")


@query("value_to_tag", "J19", """
with v as (select doc_id, tag, row_no, upper(trim(replace(replace(val, '"', ''), '''', ''))) as val from (select doc_id, tag, row_no, (row_no % 97) || '"' as val from {expected}) e),
l as (select doc_id, val, arg_max(tag, row_no) as tag from v group by 1, 2)
select b.doc_id, page_no, det_id, l.tag from {boxes} b join l on l.doc_id = b.doc_id and l.val = cast(l_partkey % 120 as string) where b.tag is null""")
def _(t):
    props = t.expected.selectExpr("doc_id", "tag", "row_no", "(row_no % 97) || '\"' as value")
    b = t.boxes.where("tag is null").selectExpr("doc_id", "page_no", "det_id", "0 as ord", "cast(l_partkey % 120 as string) as value")
    return R.tag_by_value(b, props, DOC, ("page_no", "det_id")).select("doc_id", "page_no", "det_id", "tag")


@query("match_cascade", "J20", """
with tg as (select doc_id, regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g') as n, min(tag) as tag from {expected} group by 1, 2),
tx as (select doc_id, {'p': page_no, 'w': word_id} as wid, text, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as n from {tokens}),
e as (select tx.doc_id, wid, tag as match, 'exact' as strength from tx join tg on tg.doc_id = tx.doc_id and tg.n = tx.n),
h as (select doc_id, wid, h.p as pos, h.s as n from (select doc_id, wid, unnest([{'p': 1, 's': case when contains(text, '-') then regexp_replace(upper(string_split(text, '-')[1]), '[^A-Z0-9]', '', 'g') end},
   {'p': 2, 's': case when contains(text, '/') then regexp_replace(upper(string_split(text, '/')[1]), '[^A-Z0-9]', '', 'g') end}]) as h from tx where wid not in (select wid from e where e.doc_id = tx.doc_id)) z where h.s <> ''),
p as (select h.doc_id, wid, arg_min(tag, pos) as match, 'prefix' as strength from h join tg on tg.doc_id = h.doc_id and tg.n = h.n group by 1, 2),
d as (select doc_id, wid from e union select doc_id, wid from p),
f as (select tx.doc_id, wid, arg_min(tag, (-length(tg.n), tag)) as match, 'fuzzy' as strength from tx join tg on tg.doc_id = tx.doc_id and contains(tx.n, tg.n) and length(tg.n) >= 2
  where (tx.doc_id, wid) not in (select (doc_id, wid) from d) group by 1, 2)
select doc_id, wid.p as page_no, wid.w as word_id, match, strength from (select * from e union all select * from p union all select * from f) z""")
def _(t):
    return R.match_cascade(t.tokens.select("doc_id", "page_no", "word_id", "text"), t.expected, DOC, ["page_no", "word_id"])


@query("supplement_merge", "J21", """
with a as (select doc_id, page_no, tag as mark, det_id as id from {boxes} where tag is not null), b as (select doc_id, page_no, text as mark, word_id as id from {tokens})
select *, 'primary' as origin from a union all select *, 'secondary' from b where not exists (select 1 from a where a.doc_id = b.doc_id and a.page_no = b.page_no and a.mark = b.mark)""")
def _(t):
    a = t.boxes.where("tag is not null").selectExpr("doc_id", "page_no", "tag as mark", "det_id as id")
    b = t.tokens.selectExpr("doc_id", "page_no", "text as mark", "word_id as id")
    return R.supplement(a, b, ["doc_id", "page_no", "mark"])


@query("flow_cross_check", "J22", """
with s as (select doc_id, substr(cls, 1, 1) as prefix, cast(sum(30 + l_partkey % 300) as bigint) as read_cfm, count(*) as n from {boxes} group by 1, 2),
k as (select s.*, case doc_id % 4 when 0 then read_cfm when 1 then read_cfm + read_cfm // 40 when 2 then read_cfm + read_cfm // 60 end as stated_cfm from s)
select *, case when stated_cfm is null then 'no_total' when abs(read_cfm - stated_cfm) / stated_cfm::double <= 0.02e0 then 'ok' else 'mismatch' end as verdict from k""")
def _(t):
    i = t.boxes.selectExpr("doc_id", "substr(cls, 1, 1) as prefix", "30 + l_partkey % 300 as cfm")
    s = i.groupBy("doc_id", "prefix").agg(F.sum("cfm").alias("r")).selectExpr(
        "doc_id", "prefix", "case doc_id % 4 when 0 then r when 1 then r + r div 40 when 2 then r + r div 60 end as stated_cfm")
    return R.flow_cross_check(i, s, ["doc_id", "prefix"])
