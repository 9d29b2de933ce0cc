"""Multi-stage plan queries."""

import uuid

from pyspark.sql import functions as F

from markgrid.catalog.filters import SQL_PAGES, page_types
from markgrid.catalog.reconciliation import CANON, SQL_IOU, SQL_PRESENCE, SQL_TAG_BOM, SQL_TAG_BRANCHES, tag_table_inputs
from markgrid.catalog.registry import QUERIES, query
from markgrid.catalog.keys_text import sql_class_of_tag, sql_list, sql_size_and_flow
from markgrid.catalog.spatial_joins import BOX_XY, DIST, ON, SQL_CALLOUTS, SQL_PRINTS, SQL_TOKENS, TOK_XY, greedy_pairs, serial_pairs, stack_tags, stacked_words
from markgrid.functions import keys as K
from markgrid.functions import vocab as V
from markgrid.operators import match as M
from markgrid.plans import cascades as C
from markgrid.session import cut, scratch_dir

c = F.col
PAGE = ["doc_id", "page_no"]
ID = [*PAGE, "det_id"]


def schedule(t, *more):
    """Scheduled tags with class, neck and flow."""
    return t.expected.selectExpr("doc_id", "tag", "row_no", "case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR SUPPLY' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls",
                                 "case row_no % 5 when 0 then '<varies>' when 1 then '' else (4 + row_no % 9) || '\"' end as size", "20 + row_no * 13 % 900 as cfm", *more)


SQL_SCHED = "sd as (select doc_id, tag, row_no, case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR SUPPLY' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls, case row_no % 5 when 0 then '<varies>' when 1 then '' else (4 + row_no % 9) || '\"' end as size, 20 + row_no * 13 % 900 as cfm from {expected})"


def bands(t):
    return t.expected.selectExpr("doc_id", "(row_no * 37) % 900 as lo", "(row_no * 37) % 900 + 20 as hi", "(4 + row_no % 13) || '\"' as band")


def words(t):
    return M.word_points(t.tokens)


def cascade_values(t):
    """Schedule values with their plain numbers, the latest order last."""
    v = "case l_partkey % 3 when 0 then 'A-F' when 1 then 'N-O' else 'R-F' end as cls"
    r = t.raw_items.selectExpr("doc_id", v, "'T' || (l_orderkey % 251) as tag", "l_orderkey as row_no", "explode(array((l_orderkey * 7 % 1013) || '\" / P-' || l_orderkey, cast(l_orderkey * 7 % 1013 as string))) as value")
    return r


CLS_C1 = "case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' when 2 then 'EXHAUST FAN' else 'SPLIT SYSTEM' end"
ANTI = "not exists (select 1 from {1} where {1}.doc_id = {0}.doc_id and {1}.page_no = {0}.page_no and {1}.det_id = {0}.det_id)"
SQL_C1 = f"""{TOK_XY}, {SQL_SCHED}, {SQL_CALLOUTS}, {SQL_PRINTS}, cc as (select co.*, {sql_class_of_tag('tag')} as cls from co),
b0 as (select doc_id, page_no, det_id, {CLS_C1} as cls, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {{boxes}}),
one as (select doc_id, cls, min(tag) as tag from sd group by 1, 2 having count(distinct tag) = 1),
l1 as (select b0.doc_id, page_no, det_id, coalesce(o.tag, a.tag) as tag from b0 left join one o on o.doc_id = b0.doc_id and o.cls = b0.cls left join one a on a.doc_id = b0.doc_id and a.cls = case b0.cls when 'SPLIT SYSTEM' then 'CONDENSING UNIT' when 'AD-SURF SUPPLY' then 'AD-GRD' end where coalesce(o.tag, a.tag) is not null),
b1 as (select * from b0 where {ANTI.format('b0', 'l1')}),
cb as (with recursive {serial_pairs(f"select a.doc_id, a.page_no, a.word_id as l, b.det_id as r, {DIST.format('a', 'b')} as dist from cc a join b1 b on {ON.format('a', 'b')} and (a.cls = b.cls or (b.cls = 'SPLIT SYSTEM' and a.cls = 'CONDENSING UNIT')) where {DIST.format('a', 'b')} <= 100", 'dist')} select * from picks),
l2 as (select cb.doc_id, cb.page_no, cb.r as det_id, cc.tag from cb join cc on {ON.format('cc', 'cb')} and cc.word_id = cb.l), b2 as (select * from b1 where {ANTI.format('b1', 'l2')}),
nk as (select distinct b.doc_id, b.page_no, b.det_id, b.cls, unnest({SQL_TOKENS.format('k.text')}) as token from b2 b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 100),
fq as (select nk.doc_id, nk.page_no, nk.det_id as l, fp.tag as r, count(*) as score from nk join fp on fp.doc_id = nk.doc_id and fp.cls = nk.cls and fp.token = nk.token group by 1, 2, 3, 4),
l3 as (with recursive {greedy_pairs("select * from fq", '-score', rtype='varchar')} select pairs.doc_id, pairs.page_no, l as det_id, r as tag, score from pairs join fq using (doc_id, page_no, l, r)), b3 as (select * from b2 where {ANTI.format('b2', 'l3')}),
tg as (select doc_id, regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g') as n, min(tag) as tag, min(cls) as tcls from sd group by 1, 2),
mt as (select k.doc_id, k.page_no, k.word_id, k.cx, k.cy, coalesce(e.tag, p.tag) as tag, coalesce(e.tcls, p.tcls) as tcls, length(coalesce(e.n, p.n)) as ln from tk k left join tg e on e.doc_id = k.doc_id and e.n = regexp_replace(upper(k.text), '[^A-Z0-9]', '', 'g')
  left join tg p on p.doc_id = k.doc_id and contains(k.text, '-') and p.n = regexp_replace(upper(string_split(k.text, '-')[1]), '[^A-Z0-9]', '', 'g') where coalesce(e.tag, p.tag) is not null),
al(src, dst) as (values {", ".join(f"('{a}', '{x}')" for a, v in V.CLASS_ALIASES.items() for x in (v if isinstance(v, list) else [v]))}),
j4 as (select b.doc_id, b.page_no, b.det_id, m.tag, m.tcls, m.word_id, {DIST.format('b', 'm')} as dist, {DIST.format('b', 'm')} - 80 * m.ln as score from b3 b join mt m on {ON.format('b', 'm')} and (b.cls = m.tcls or (b.cls, m.tcls) in (select (src, dst) from al)) where {DIST.format('b', 'm')} <= 600),
l4 as (select doc_id, page_no, det_id, arg_min(tag, (score, word_id)) as tag, arg_min(tcls, (score, word_id)) as tcls, arg_min(dist, (score, word_id)) as dist from j4 group by 1, 2, 3), b4 as (select * from b3 where {ANTI.format('b3', 'l4')}),
s5 as (select distinct doc_id, tag, cls from sd), p5 as (select doc_id, cls, count(*) as n from s5 group by 1, 2),
r5 as (select b.*, coalesce(o.cls, a.cls) as rc from b4 b left join p5 o on o.doc_id = b.doc_id and o.cls = b.cls left join p5 a on a.doc_id = b.doc_id and a.cls = case b.cls when 'SPLIT SYSTEM' then 'CONDENSING UNIT' when 'AD-SURF SUPPLY' then 'AD-GRD' end where coalesce(o.n, a.n) >= 2),
j5 as (select b.doc_id, b.page_no, b.det_id, m.tag, m.word_id, {DIST.format('b', 'm')} as dist from r5 b join mt m on {ON.format('b', 'm')} join s5 on s5.doc_id = m.doc_id and s5.tag = m.tag and s5.cls = b.rc where {DIST.format('b', 'm')} <= 140), l5 as (select doc_id, page_no, det_id, arg_min(tag, (dist, word_id)) as tag, min(dist) as dist from j5 group by 1, 2, 3), b5 as (select * from b4 where {ANTI.format('b4', 'l5')}),
vq as (select doc_id, cast(l_orderkey * 7 % 1013 as string) as value, arg_max('T' || (l_orderkey % 251), l_orderkey) as tag from {{raw_items}} group by 1, 2),
w6 as (select b.doc_id, b.page_no, b.det_id, k.word_id, coalesce(nullif(regexp_extract(upper(k.text), '^(\\d{{2,4}})$', 1), ''), nullif(regexp_extract(upper(k.text), '^(\\d{{1,3}})"?$', 1), ''), nullif(regexp_extract(upper(k.text), '^(\\d{{1,3}}X\\d{{1,3}})$', 1), '')) as value from b5 b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 80),
l6 as (select w6.doc_id, w6.page_no, w6.det_id, arg_min(vq.tag, (word_id, vq.tag)) as tag from w6 join vq on vq.doc_id = w6.doc_id and vq.value = w6.value group by 1, 2, 3)"""


@query("tag_inference_cascade", "C1 J17 G14 G6 G16 G4 J19", f"""with {SQL_C1}
select b.doc_id, b.page_no, b.det_id, coalesce(l4.tcls, b.cls) as cls, coalesce(l1.tag, l2.tag, l3.tag, l4.tag, l5.tag, l6.tag) as tag, case when l1.tag is not null then 'direct' when l2.tag is not null then 'text_layer_callout' when l3.tag is not null then 'fingerprint' when l4.tag is not null then 'bubble_detect' when l5.tag is not null then 'bubble_ocr' when l6.tag is not null then 'size_cfm' else 'none' end as method,
 round(case when l1.tag is not null or l2.tag is not null then 1e0 when l3.tag is not null then least(0.5e0 + 0.15e0 * l3.score, 0.95e0) when l4.tag is not null then 1 - least(l4.dist / 600, 1e0) when l5.tag is not null then 1 - l5.dist / 140 when l6.tag is not null then 0.7e0 else 0e0 end, 6) as confidence, false as synthetic
from b0 b left join l1 using (doc_id, page_no, det_id) left join l2 using (doc_id, page_no, det_id) left join l3 using (doc_id, page_no, det_id) left join l4 using (doc_id, page_no, det_id) left join l5 using (doc_id, page_no, det_id) left join l6 using (doc_id, page_no, det_id)
union all select cc.doc_id, cc.page_no, null, cc.cls, cc.tag, 'text_layer_callout', 1e0, true from cc where not exists (select 1 from cb where {ON.format('cb', 'cc')} and cb.l = cc.word_id)""")
def _(t):
    co = M.stacked_callouts(stacked_words(t), list(V.TAG_PREFIX_CLASS), stack_tags(t)).withColumn("cls", K.class_of_tag(c("tag")))
    b = t.boxes.selectExpr(*ID, "case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' when 2 then 'EXHAUST FAN' else 'SPLIT SYSTEM' end as cls", "x1", "y1", "x2", "y2")
    d = C.infer_tags(b, words(t), schedule(t), cascade_values(t), co)
    return d.withColumn("confidence", F.round("confidence", 6))


@query("near_text_size", "C2 W10", f"""with {BOX_XY}, {TOK_XY}, j as (select b.doc_id, b.page_no, b.det_id, k.word_id, upper(k.text) as x, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 72),
r as (select *, row_number() over (partition by doc_id, page_no, det_id order by dist, word_id) as rk, regexp_extract(x, '^([A-Z]{{1,3}}-?\\d{{1,6}})-(\\d+(?:\\.\\d+)?"|\\d+[xX/]\\d+)$', 2) as cs, case when regexp_matches(x, '^[A-Z]{{1,3}}-?\\d{{1,6}}$') then x end as tag,
 case when regexp_matches(x, '^\\d+X\\d+$') then x when regexp_matches(x, '^\\d+"$') then x end as size from j),
p as (select a.doc_id, a.page_no, a.det_id, a.rk as tr, b.rk as sr, a.tag as tag, b.size as size, a.dist as dist from r a join r b using (doc_id, page_no, det_id) where a.tag is not null and b.size is not null and b.rk between a.rk + 1 and a.rk + 3 and b.dist <= a.dist + 20)
select doc_id, page_no, det_id, arg_min(tag, (tr, sr)) as tag, arg_min(size, (tr, sr)) as size, round(0.95e0 * 0.85e0 * case when arg_min(dist, (tr, sr)) < 50 then 1e0 else greatest(0.5e0, 1e0 - (arg_min(dist, (tr, sr)) - 50) / 22e0 * 0.5e0) end, 6) as conf from p group by 1, 2, 3""")
def _(t):
    return C.near_text_size(t.boxes, words(t)).select(*ID, "tag", "size", F.round("conf", 6).alias("conf"))


@query("schedule_size", "C3 J20", f"""with {SQL_SCHED}, {BOX_XY}, {TOK_XY}, tg as (select doc_id, regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g') as n, min(tag) as tag from sd group by 1, 2), tx as (select *, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as n from tk),
e as (select tx.doc_id, page_no, word_id, tag as match, 1 as rk from tx join tg on tg.doc_id = tx.doc_id and tg.n = tx.n), p as (select tx.doc_id, page_no, word_id, tag as match, 2 as rk from tx join tg on tg.doc_id = tx.doc_id and contains(tx.text, '-') and tg.n = regexp_replace(upper(string_split(tx.text, '-')[1]), '[^A-Z0-9]', '', 'g')),
p2 as (select tx.doc_id, page_no, word_id, tag as match, 3 as rk from tx join tg on tg.doc_id = tx.doc_id and contains(tx.text, '/') and tg.n = regexp_replace(upper(string_split(tx.text, '/')[1]), '[^A-Z0-9]', '', 'g')),
f as (select tx.doc_id, page_no, word_id, arg_min(tag, (-length(tg.n), tag)) as match, 4 as rk from tx join tg on tg.doc_id = tx.doc_id and contains(tx.n, tg.n) group by 1, 2, 3),
m as (select * from (select * from e union all select * from p union all select * from p2 union all select * from f) z qualify row_number() over (partition by doc_id, page_no, word_id order by rk) = 1),
j as (select b.doc_id, b.page_no, b.det_id, m.match, m.rk, k.ocr_pct, k.word_id, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} join m on {ON.format('m', 'k')} and m.word_id = k.word_id where {DIST.format('b', 'k')} <= 200),
n as (select * from j qualify row_number() over (partition by doc_id, page_no, det_id order by dist, word_id) = 1), s as (select doc_id, tag, min(size) as size from sd group by 1, 2)
select n.doc_id, n.page_no, n.det_id, n.match as tag, case when s.size <> '<varies>' then s.size end as size, round(case when s.size = '<varies>' then 0.3e0 else 0.9e0 * (ocr_pct / 100e0) * (case rk when 1 then 1e0 when 4 then 0.65e0 else 0.95e0 end) end, 6) as conf from n join s on s.doc_id = n.doc_id and s.tag = n.match where s.size <> ''""")
def _(t):
    d = C.schedule_size(t.boxes, words(t), schedule(t))
    return d.select(*ID, "tag", "size", F.round("conf", 6).alias("conf"))


SQL_L3 = f"""s as (select doc_id, page_no, word_id, cx, cy, case when regexp_matches(text, '^\\d+x\\d+$') then upper(text) else text end as size, ocr_pct / 100e0 as oc from tk where regexp_matches(text, '^\\d+x\\d+$|^\\d+"$')),
j3 as (select b.doc_id, b.page_no, b.det_id, s.word_id, s.size, s.oc, {DIST.format('b', 's')} as dist from bx b join s on {ON.format('b', 's')} where {DIST.format('b', 's')} <= 300),
m3 as (select doc_id, page_no, det_id, min({{'rank': -oc * (1 - least(dist / 600, 0.8e0)), 'w': word_id, 'size': size, 'oc': oc, 'dist': dist}}) as h from j3 group by 1, 2, 3),
l3 as (select doc_id, page_no, det_id, h.size as size, 0.8e0 * h.oc * (case when h.dist < 200 then 1e0 else greatest(0.3e0, 1e0 - (h.dist - 200) / 400 * 0.5e0) end) * (case when contains(h.size, 'X') then 0.95e0 else 1e0 end) as conf from m3)"""
SQL_WATERFALL = f"""{BOX_XY}, {TOK_XY}, {SQL_SCHED}, l1 as ({QUERIES['near_text_size'].sql}), l2 as ({QUERIES['schedule_size'].sql}), {SQL_L3},
bd as (select doc_id, (row_no * 37) % 900 as lo, (row_no * 37) % 900 + 20 as hi, (4 + row_no % 13) || '"' as band from {{expected}}), nb as (select doc_id, count(*) as n from bd group by 1), cf as (select doc_id, tag, min(cfm) as cfm from sd group by 1, 2),
h4 as (select b.doc_id, b.page_no, b.det_id, b.tag, cf.cfm, min({{'lo': lo, 'hi': hi, 'band': band}}) as h from bx b join cf on cf.doc_id = b.doc_id and cf.tag = b.tag join bd on bd.doc_id = b.doc_id and cf.cfm between lo and hi group by 1, 2, 3, 4, 5),
l4 as (select h4.doc_id, page_no, det_id, tag, h.band as size, 0.55e0 * greatest(0.5e0, 1 - abs(cfm - (h.lo + h.hi) / 2e0) / greatest(1e0, (h.hi - h.lo) / 2e0) * 0.5e0) * (case when n < 4 then 0.75e0 when n >= 8 then 1e0 else 0.85e0 end) as conf from h4 join nb using (doc_id)),
wf as (select b.doc_id, b.page_no, b.det_id, b.tag as own, case when l1.det_id is not null then l1.tag when l2.det_id is not null then l2.tag when l3.conf >= 0.2e0 then null else l4.tag end as rd,
 case when l1.det_id is not null then l1.size when l2.det_id is not null then l2.size when l3.conf >= 0.2e0 then l3.size else l4.size end as size,
 case when l1.det_id is not null then 'level1-separated' when l2.det_id is not null then case when l2.size is null then 'level2-schedule-varies' else 'level2-schedule-via-bubble' end when l3.conf >= 0.2e0 then 'level3-ocr-near-detection' when l4.det_id is not null then 'level4-cfm-range-lookup' else 'level5-unknown' end as source,
 case when l1.det_id is not null then l1.conf when l2.det_id is not null then l2.conf when l3.conf >= 0.2e0 then l3.conf else coalesce(l4.conf, 0) end as conf
 from bx b left join l1 using (doc_id, page_no, det_id) left join l2 using (doc_id, page_no, det_id) left join l3 using (doc_id, page_no, det_id) left join l4 using (doc_id, page_no, det_id)),
wt as (select *, case when conf >= 0.8e0 then 'HIGH' when conf >= 0.5e0 then 'MEDIUM' when conf >= 0.15e0 then 'LOW' else 'DROP' end as tier, own is null and rd is not null as promoted from wf)"""


@query("size_waterfall", "C2 F28 F29", f"with {SQL_WATERFALL} select doc_id, page_no, det_id, coalesce(own, rd) as tag, size, source, round(conf, 6) as conf, tier, promoted from wt")
def _(t):
    return C.size_waterfall(t.boxes, words(t), schedule(t), bands(t)).withColumn("conf", F.round("conf", 6))


@query("size_waterfall_stats", "C2", f"with {SQL_WATERFALL} select source, tier, count(*) as n, count(size) as n_sized, count(*) filter (where promoted) as n_promoted from wt group by 1, 2")
def _(t):
    return C.waterfall_stats(C.size_waterfall(t.boxes, words(t), schedule(t), bands(t)))


@query("context_enrichment", "C4 G3 N5", f"""with recursive {BOX_XY}, {TOK_XY}, o as (select * from bx where cls = 'A-F'), g as (select * from bx where cls = 'N-O'), w1 as (select distinct o.doc_id, o.page_no, o.det_id from o join g on {ON.format('o', 'g')} where {SQL_IOU.format('o', 'g')} > 0.05e0 or {DIST.format('o', 'g')} < 100),
cr as (select distinct g.doc_id, g.page_no, g.det_id from g join tk on {ON.format('g', 'tk')} and tk.text = 'C.R.D.' and abs(tk.cx - g.cx) < 200 and abs(tk.cy - g.cy) < 200), ty as (select distinct b.doc_id, b.page_no, b.det_id from bx b join tk on {ON.format('b', 'tk')} and tk.text = 'TYP' and abs(tk.cx - b.cx) < 200 and abs(tk.cy - b.cy) < 200)
select b.doc_id, b.page_no, b.det_id, w1.det_id is not null as with_grille, case when cr.det_id is not null then 'CRD' end as damper_type, ty.det_id is not null as typical from bx b left join w1 using (doc_id, page_no, det_id) left join cr using (doc_id, page_no, det_id) left join ty using (doc_id, page_no, det_id)""")
def _(t):
    return C.enrich_context(t.boxes.select(*ID, "cls", "x1", "y1", "x2", "y2"), words(t), ["A-F"], ["N-O"]).select(*ID, "with_grille", "damper_type", "typical")


@query("context_corners", "C4 N5", f"with cr as ({QUERIES['closed_rectangles'].sql}), m as (select distinct doc_id, page_no, unnest([t_id, b_id, l_id, r_id]) as det_id from cr) select s.doc_id, s.page_no, s.det_id, case when m.det_id is not null then 4 end as corners from {{strips}} s left join m using (doc_id, page_no, det_id)")
def _(t):
    return C.enrich_context(t.strips.select(*ID, "cls", "x1", "y1", "x2", "y2"), words(t), ["F"], ["O"]).select(*ID, "corners")


@query("context_statistics", "C4 N4 N5", f"""with bx as (select *, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {{strips}}), {TOK_XY}, rm as ({QUERIES['run_merge'].sql}), cr as ({QUERIES['closed_rectangles'].sql}),
o as (select * from bx where cls = 'F'), g as (select * from bx where cls = 'O'), w1 as (select distinct o.doc_id, o.page_no, o.det_id from o join g on {ON.format('o', 'g')} where {SQL_IOU.format('o', 'g')} > 0.05e0 or {DIST.format('o', 'g')} < 100),
cd as (select distinct g.doc_id, g.page_no, g.det_id from g join tk on {ON.format('g', 'tk')} and tk.text = 'C.R.D.' and abs(tk.cx - g.cx) < 200 and abs(tk.cy - g.cy) < 200), ty as (select distinct b.doc_id, b.page_no, b.det_id from bx b join tk on {ON.format('b', 'tk')} and tk.text = 'TYP' and abs(tk.cx - b.cx) < 200 and abs(tk.cy - b.cy) < 200),
d as (select distinct doc_id from bx) select d.doc_id, (select count(*) from w1 where w1.doc_id = d.doc_id) as with_grille, (select count(*) from cd where cd.doc_id = d.doc_id) as crd, (select count(*) from ty where ty.doc_id = d.doc_id) as typical, (select count(*) from cr where cr.doc_id = d.doc_id) as rectangles, (select count(*) from rm where rm.doc_id = d.doc_id and merged_count > 1) as runs from d""")
def _(t):
    from markgrid.operators.suppress import merge_runs

    strips = cut(t.strips)
    return C.context_stats(C.enrich_context(strips, words(t), ["F"], ["O"]), merge_runs(strips))


@query("fill_counts", "C5 F14 G19", """with bd as (select doc_id, (row_no * 37) % 900 as lo, (row_no * 37) % 900 + 20 as hi from {expected}), it as (select doc_id, raw_cls as cls, raw_tag as tag, model, 20 + (l_partkey * 13) % 900 as cfm, case when l_suppkey % 3 = 0 then raw_size end as neck, case when l_orderkey % 4 = 0 then 1e0 end as slot from {raw_items}),
h as (select distinct n.doc_id, n.cfm from (select distinct doc_id, cfm from it where neck is null) n join bd on bd.doc_id = n.doc_id and n.cfm between lo and hi)
select it.doc_id, count(*) filter (where neck is null and h.cfm is not null) as neck_filled, count(*) filter (where slot is null and (contains(cls, 'LINEAR') or contains(cls, 'SLOT') or regexp_matches(upper(tag), '^(LD|LSD|L-)')) and model in ('AS22O', '2-SLOT', '1.5" SLOT')) as slot_filled from it left join h on h.doc_id = it.doc_id and h.cfm = it.cfm group by 1""")
def _(t):
    rows = t.raw_items.selectExpr("doc_id", "l_orderkey", "l_partkey", "l_suppkey", "line_no", "raw_cls as cls", "raw_tag as tag", "model", "20 + (l_partkey * 13) % 900 as cfm",
                                  "case when l_suppkey % 3 = 0 then raw_size end as neck", "case when l_orderkey % 4 = 0 then 1.0D end as slot")
    return C.fill_counts(C.fill_missing(rows, bands(t), ["doc_id"]), ["doc_id"])


@query("post_processing", "C6 S15")
def _(t):
    stages = C.post_process(t.boxes, words(t), schedule(t, "exp_qty"), bands(t), page_types(t))
    return C.stage_manifest({k: d for k, d in stages.items()})


SQL_PLAN = f"{SQL_PAGES}, pb as (select b.* from {{boxes}} b join pg using (doc_id, page_no) where pg.type not in {sql_list(V.NON_PLAN_TYPES)})"


@query("post_processing_checks", "C6 J12", f"""
with {SQL_PLAN}, {SQL_PRESENCE.strip().replace('{observed}', 'pb')}, w as (select doc_id, {CANON.format('tag')} as k, max(exp_qty) as want from {{expected}} group by 1, 2),
p as (select pr.*, coalesce(e_tag, o_tag) as tag, want from pr left join w using (doc_id, k)), u as (select doc_id, count(*) as n from pb where tag is null group by 1)
select doc_id, 'medium' as severity, 'tag_in_schedule_not_on_plan' as kind, tag, 0 as n from p where n_exp > 0 and n_obs = 0
union all select doc_id, case when n < 20 then 'low' else 'medium' end, 'untagged_detections', null, n from u
union all select doc_id, 'high', 'quantity_missing', tag, want from p where want > 0 and n_obs = 0
union all select doc_id, 'medium', 'quantity_off', tag, n_obs - want from p where abs(n_obs - want) >= greatest(2e0, want * 0.3e0) and not (n_obs = 0 and want > 0)""")
def _(t):
    return C.plan_checks(t.boxes, schedule(t, "exp_qty"), page_types(t))


def noted(t):
    return words(t).withColumn("text", F.when(c("text") == "TYP", F.concat(F.lit("TYP OF "), (c("word_id") % 5).cast("string"))).otherwise(c("text")))


SQL_NOTED = f"""{BOX_XY}, {TOK_XY}, ni as (select * from tk where text = 'NIC'), ty as (select *, word_id % 5 as n from tk where text = 'TYP' and word_id % 5 >= 2),
hn as (select doc_id, page_no, word_id, arg_min(det_id, (dist, det_id)) as det_id from (select k.doc_id, k.page_no, k.word_id, b.det_id, {DIST.format('b', 'k')} as dist from ni k join bx b on {ON.format('b', 'k')}) z where dist <= 200 group by 1, 2, 3),
sx as (select *, least(x0, coalesce(x0b, x0), coalesce(x0c, x0), coalesce(x0d, x0)) as mx from (select *, lead(x0, 1) over g as x0b, lead(x0, 2) over g as x0c, lead(x0, 3) over g as x0d from tk window g as (partition by doc_id, page_no order by word_id)) z),
wn as (select doc_id, page_no, word_id, text, (min(x0) over h + max(x1) over h) / 2e0 as cx, (min(y0) over h + max(y1) over h) / 2e0 as cy from tk window h as (partition by doc_id, page_no order by word_id rows between current row and 3 following)),
ht as (select doc_id, page_no, word_id, arg_min(det_id, (dist, det_id)) as det_id from (select k.doc_id, k.page_no, k.word_id, b.det_id, {DIST.format('b', 'k')} as dist from wn k join bx b on {ON.format('b', 'k')} where k.text = 'TYP' and k.word_id % 5 >= 2) z where dist <= 200 group by 1, 2, 3),
nm as (select doc_id, page_no, det_id from hn group by 1, 2, 3), tm as (select doc_id, page_no, det_id, min(word_id) as word_id from ht group by 1, 2, 3),
un as (select b.doc_id, b.page_no, b.det_id, b.l_suppkey, nm.det_id is not null as nic, tm.word_id % 5 as typ_of, cast(case when nm.det_id is not null then 0 when tm.word_id is not null then tm.word_id % 5 else 1 end as int) as units from bx b left join nm using (doc_id, page_no, det_id) left join tm using (doc_id, page_no, det_id))"""


@query("note_marks", "C7 W8 G2 F31", f"with {SQL_NOTED} select doc_id, page_no, det_id, nic, cast(typ_of as int) as typ_of, units from un")
def _(t):
    return C.mark_notes(t.boxes, noted(t)).select(*ID, "nic", "typ_of", "units")


@query("note_backfill", "C7", f"with {SQL_NOTED}, dn as (select doc_id from {{boxes}} group by 1 having count(*) >= 1000) select doc_id, page_no, det_id, cast(1 + l_suppkey % 2 as int) as old_units, units from un where doc_id in (select doc_id from dn) and units <> 1 + l_suppkey % 2")
def _(t):
    jobs = t.boxes.groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr("doc_id", "case when n >= 1000 then 'done' else 'running' end as status")
    b = t.boxes.withColumn("units", (1 + c("l_suppkey") % 2).cast("int"))
    return C.backfill(jobs, b, noted(t))


SQL_MARKED = """bq as (select u.doc_id, b.cls, coalesce(b.tag, '') as tag, case when b.l_partkey % 5 < 3 then cast(b.l_partkey % 5 as string) else '' end as neck, u.units, b.conf_pct as conf from un u join {boxes} b on b.doc_id = u.doc_id and b.page_no = u.page_no and b.det_id = u.det_id)"""


@query("note_write_back", "C7 J7", f"""with {SQL_NOTED}, {SQL_TAG_BOM}, {SQL_MARKED}, {SQL_TAG_BRANCHES.replace('from bx where', 'from bq where')}, dn as (select doc_id from {{boxes}} group by 1 having count(*) >= 1000)
select doc_id, tag, cls, neck, cast(plan_qty as bigint) as plan_qty, cast(box_qty as bigint) as box_qty, source, discrepancy, cast(conf as bigint) as conf from tt where doc_id in (select doc_id from dn)""")
def _(t):
    folder = f"{scratch_dir(t.spark)}/backfill-{uuid.uuid4().hex}"
    jobs = t.boxes.groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr("doc_id", "case when n >= 1000 then 'done' else 'running' end as status")
    C.write_back(jobs, t.boxes, noted(t), lambda marked: tag_table_inputs(t, marked), folder)
    return t.spark.read.schema("tag string, cls string, neck string, plan_qty bigint, box_qty bigint, source string, discrepancy string, conf bigint, doc_id bigint").parquet(f"{folder}/tag_table")


SQL_MARKS = f"""tw as (select *, regexp_extract(upper(trim(text)), '^([A-Z]{{1,3}}-?\\d{{1,6}})-(\\d+(?:\\.\\d+)?"?|\\d+[xX/]\\d+)$', 1) as mc, regexp_extract(upper(trim(text)), '^([A-Z]{{1,3}}-?\\d{{1,6}})-(\\d+(?:\\.\\d+)?"?|\\d+[xX/]\\d+)$', 2) as zc from tk),
cb as (select * from tw where mc <> ''), br as (select * from tw a where mc = '' and regexp_matches(upper(trim(text)), '^[A-Z]{{1,3}}-?\\d{{1,6}}$') and not exists (select 1 from cb where {ON.format('cb', 'a')} and cb.mc = upper(trim(a.text)) and abs(cb.cx - a.cx) < 15 and abs(cb.cy - a.cy) < 15)),
e9 as (select a.doc_id, a.page_no, a.word_id as l, b.word_id as r, {DIST.format('a', 'b')} as cost from br a join tk b on {ON.format('a', 'b')} and regexp_matches(b.text, '^\\d+"$|^\\d+[/xX]\\d+$') where case when abs(a.cy - b.cy) <= 15 then abs(a.cx - b.cx) <= 120 else abs(a.cy - b.cy) <= 50 and abs(a.cx - b.cx) <= 40 end)"""


@query("label_instances", "C8 G11 G20 D5", f"""with recursive {TOK_XY}, {SQL_MARKS}, {serial_pairs("select *, min(cost) over (partition by doc_id, page_no, l) as turn from e9", 'cost', 'turn')}
select doc_id, page_no, word_id, mc as mark, 'combined_label' as method from cb union all select br.doc_id, br.page_no, br.word_id, upper(trim(br.text)), case when p.r is not null then 'bare_mark' else 'bare_mark_no_size' end from br left join picks p on {ON.format('p', 'br')} and p.l = br.word_id""")
def _(t):
    return C.label_instances(words(t)).select(*PAGE, "word_id", "mark", "method")


# tokens with marks of several prefixes and letter-only marks, and the marks that each document's schedule lists
MARK_TEXT = "case when text like 'P-%' then substr('SGVAVP', cast(1 + word_id % 3 * 2 as int), 2) || '-' || (word_id % 60) when text = 'C.R.D.' then 'CD' when text like '%/%' then replace(text, '/', 'x8/') else text end"
LISTED = "select doc_id, substr('SGVAVP', cast(1 + row_no % 3 * 2 as int), 2) || '-' || (row_no % 60) as mark from {e} union all select doc_id, case row_no % 3 when 0 then 'CD' when 1 then 'TYP' else 'EF' end from {e}"


@query("bare_marks", "C8 F10", f"""with recursive tk as (select doc_id, page_no, word_id, x0, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy, {MARK_TEXT} as text from {{tokens}}), wl as ({LISTED.replace('{e}', '{expected}')}), {sql_size_and_flow('tk', 'text')},
nm as (select doc_id, page_no, word_id, cx, cy, text as mark, false as lettered from tk where regexp_matches(text, '^([A-Z]{{1,2}}\\d{{1,3}}|[A-Z]{{1,3}}-\\d{{1,3}})$') and regexp_extract(text, '^[A-Z]+') not in {sql_list(V.EQUIPMENT_PREFIXES)} and (doc_id not in (select doc_id from wl) or (doc_id, text) in (select (doc_id, mark) from wl))),
lt as (select doc_id, page_no, word_id, cx, cy, text as mark, true as lettered from tk where text in ('CD', 'TYP') and (doc_id, text) in (select (doc_id, mark) from wl) qualify row_number() over (partition by doc_id, page_no, text, x0 order by word_id) = 1),
mk as (select * from nm union all select * from lt), s9 as (select * from sf where size is not null),
e9 as (select a.doc_id, a.page_no, a.word_id as l, b.word_id as r, {DIST.format('a', 'b')} as cost from mk a join s9 b on {ON.format('a', 'b')} where case when abs(a.cy - b.cy) <= 15 then abs(a.cx - b.cx) <= 120 else abs(a.cy - b.cy) <= 50 and abs(a.cx - b.cx) <= 40 end),
{serial_pairs("select *, min(cost) over (partition by doc_id, page_no, l) as turn from e9", 'cost', 'turn')}
select mk.doc_id, mk.page_no, mk.word_id, mk.mark, s9.size, s9.cfm, case when lettered then 'letter_only_mark' else 'bare_mark' end || case when s9.size is null then '_no_size' else '' end as method,
 case when lettered and s9.size is not null then 0.70e0 when lettered then 0.55e0 when s9.size is not null then 0.75e0 else 0.30e0 end as confidence
from mk left join picks p on {ON.format('p', 'mk')} and p.l = mk.word_id left join s9 on {ON.format('s9', 'mk')} and s9.word_id = p.r""")
def _(t):
    w = words(t).withColumn("text", F.expr(MARK_TEXT))
    return C.bare_marks(w, t.spark.sql(LISTED, e=t.expected))


FRONT = ["NOT FOR CONSTRUCTION", "LEGEND", "PERMIT SET", "", "SHEET INDEX"]


def verified_pages(t):
    from markgrid.functions.text import discipline_of

    head = F.array(*[F.lit(x) for x in FRONT])[(c("page_id") % 5).cast("int")]
    return t.pages.select((c("page_id") / 10).cast("bigint").alias("doc_id"), c("page_id").alias("page_no"), F.concat(F.expr("substr('MEZ', cast(1 + page_id % 3 as int), 1)"), (c("page_id") % 23).cast("string")).alias("sheet"),
                          discipline_of(F.expr("substr('MEZ', cast(1 + page_id % 3 as int), 1)")).alias("discipline"), F.concat(head, F.lit(" "), c("html")).alias("text"))


@query("document_verification", "C9 F24 J11", f"""with p as (select page_id // 10 as doc_id, substr('MEZ', cast(1 + page_id % 3 as int), 1) as dl, page_id % 23 as num, upper([{', '.join(repr(x) for x in FRONT)}][cast(page_id % 5 as int) + 1] || ' ' || html) as u from {{pages}}),
q as (select doc_id, dl || num as sheet, case dl when 'M' then 'Mechanical' when 'E' then 'Electrical' else 'Unknown' end as disc, u from p), ix as (select distinct doc_id % (select count(*) // 10 from {{pages}}) as doc_id, case when exp_qty % 2 = 0 then 'M' else 'E' end || (row_no % 23) as sheet, case when exp_qty % 2 = 0 then 'Mechanical' else 'Electrical' end as disc from {{expected}}),
d as (select doc_id, bool_or(contains(u, 'NOT FOR CONSTRUCTION') or contains(u, 'NOT FOR BID') or contains(u, 'FOR REVIEW ONLY')) as wm, bool_or(regexp_matches(u, 'ISSUED\\s+FOR\\s+(CONSTRUCTION|PERMIT|BID)|(CONSTRUCTION|PERMIT|BID)\\s+SET')) as iss, bool_or(contains(u, 'LEGEND') or contains(u, 'SYMBOL') or contains(u, 'ABBREVIATION')) as lg from q group by 1),
mi as (select doc_id, sheet from ix where exists (select 1 from q where q.doc_id = ix.doc_id and q.disc = ix.disc and q.disc <> 'Unknown') and not exists (select 1 from q where q.doc_id = ix.doc_id and q.sheet = ix.sheet)), un as (select distinct doc_id, sheet from q where not exists (select 1 from ix where q.doc_id = ix.doc_id and q.sheet = ix.sheet))
select doc_id, 'error' as level, 'watermark' as code, 1 as n from d where wm union all select doc_id, 'info', 'no_issue_type', 1 from d where not iss union all select doc_id, 'warning', 'no_legend', 1 from d where not lg
union all select doc_id, 'error', 'missing_sheets', count(*) from mi group by 1 union all select doc_id, 'warning', 'unlisted_sheets', count(*) from un group by 1""")
def _(t):
    pages = verified_pages(t)
    n = t.pages.count() // 10
    even = "exp_qty % 2 = 0"
    index = t.expected.selectExpr(f"doc_id % {n} as doc_id", f"case when {even} then 'M' else 'E' end || (row_no % 23) as sheet", f"case when {even} then 'Mechanical' else 'Electrical' end as discipline").distinct()
    return C.verify_document(pages, index, ["doc_id"])


@query("document_digest", "C10", f"""with {SQL_PAGES}, a as (select doc_id, type, count(*) as n from pg group by 1, 2), b as (select doc_id, string_agg(type || '=' || n, ',' order by type) as pages_by_type from a group by 1), g as (select doc_id, count(distinct tag) as n_tags, count(*) as n_rows from {{expected}} group by 1),
nt as (select doc_id, count(*) as n_notes from {{lines}} where regexp_matches(text, '^\\d+\\. ') group by 1) select coalesce(b.doc_id, g.doc_id, nt.doc_id) as doc_id, coalesce(pages_by_type, '') as pages_by_type, coalesce(n_tags, 0) as n_tags, coalesce(n_rows, 0) as n_rows, coalesce(n_notes, 0) as n_notes
from b full join g on b.doc_id = g.doc_id full join nt on nt.doc_id = coalesce(b.doc_id, g.doc_id)""")
def _(t):
    notes = t.lines.where(c("text").rlike(r"^\d+\. "))
    d = C.document_digest(page_types(t), t.expected, notes)
    shown = F.coalesce(F.array_join(F.transform(F.map_entries("pages_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))
    return d.withColumn("pages_by_type", shown)


