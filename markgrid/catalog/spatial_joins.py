"""Spatial, greedy and band-join queries."""

from pyspark.sql import functions as F

from markgrid.catalog.keys_text import KNOWN, sql_class_of_tag
from markgrid.catalog.reconciliation import SQL_IOU
from markgrid.catalog.registry import query
from markgrid.functions import keys as K
from markgrid.functions import text as X
from markgrid.functions import vocab as V
from markgrid.operators import assign as A
from markgrid.operators import kernels as KN
from markgrid.operators import match as M
from markgrid.operators import reconcile as R
from markgrid.session import cut

c = F.col
PAGE = ["doc_id", "page_no"]

BOX_XY = "bx as (select *, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {boxes})"
TOK_XY = "tk as (select *, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy from {tokens})"
DIST = "sqrt(({0}.cx - {1}.cx) * ({0}.cx - {1}.cx) + ({0}.cy - {1}.cy) * ({0}.cy - {1}.cy))"
ON = "{0}.doc_id = {1}.doc_id and {0}.page_no = {1}.page_no"


def greedy_pairs(edges: str, order: str, ltype="bigint", rtype="bigint") -> str:
    """CTEs: ``edges`` (doc_id, page_no, l, r, ...) walked in order; result ``pairs``."""
    return f"""ed as (select *, row_number() over (partition by doc_id, page_no order by {order}, l, r) as k from ({edges}) e0),
gr(doc_id, page_no, k, ul, ur) using key (doc_id, page_no) as (
 select distinct doc_id, page_no, 0::bigint, []::{ltype}[], []::{rtype}[] from ed
 union select gr.doc_id, gr.page_no, gr.k + 1, case when list_contains(ul, l) or list_contains(ur, r) then ul else list_append(ul, l) end,
  case when list_contains(ul, l) or list_contains(ur, r) then ur else list_append(ur, r) end
 from gr join ed on {ON.format('gr', 'ed')} and ed.k = gr.k + 1),
pairs as (select doc_id, page_no, unnest(ul) as l, unnest(ur) as r from gr)"""


def serial_pairs(edges: str, prefer: str, turn: str = "l", takes: str = "true") -> str:
    """CTEs: left rows in turn order take their first free right row; result ``picks`` (l, r, takes)."""
    return f"""ed as ({edges}),
cl as (select doc_id, page_no, l, list({{'r': r, 'takes': {takes}}} order by {prefer}, r) as cs, row_number() over (partition by doc_id, page_no order by min({turn}), l) as k from ed group by doc_id, page_no, l),
sr(doc_id, page_no, k, used, got) using key (doc_id, page_no) as (
 select distinct doc_id, page_no, 0::bigint, []::bigint[], []::struct(l bigint, r bigint, takes boolean)[] from cl
 union select sr.doc_id, sr.page_no, sr.k + 1, case when p[1].takes then list_append(used, p[1].r) else used end,
  case when len(p) > 0 then list_append(got, {{'l': l, 'r': p[1].r, 'takes': p[1].takes}}) else got end
 from (select sr.*, cl.l, list_filter(cl.cs, lambda x: not list_contains(sr.used, x.r)) as p from sr join cl on {ON.format('sr', 'cl')} and cl.k = sr.k + 1) sr),
picks as (select doc_id, page_no, g.l as l, g.r as r, g.takes as takes from (select doc_id, page_no, unnest(got) as g from sr) z)"""


@query("nearest_label", "G1 F25", f"""
with {BOX_XY}, {TOK_XY},
j as (select b.doc_id, b.page_no, b.det_id, k.word_id as label_id, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')})
select doc_id, page_no, det_id, arg_min(label_id, (dist, label_id)) as label_id, round(min(dist), 6) as dist from j group by 1, 2, 3""")
def _(t):
    labels = M.word_points(t.tokens).withColumnRenamed("word_id", "label_id")
    d = M.assign_nearest(t.boxes.select(*PAGE, "det_id", "x1", "y1", "x2", "y2"), labels)
    return d.select(*PAGE, "det_id", "label_id", F.round("dist", 6).alias("dist"))


@query("nearest_label_capped", "G1", f"""
with {BOX_XY}, tk as (select * from (select *, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy from {{tokens}}) z where text in ('TYP', 'NIC', 'EF')),
j as (select b.doc_id, b.page_no, b.det_id, k.word_id as label_id, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 150),
m as (select doc_id, page_no, det_id, arg_min(label_id, (dist, label_id)) as label_id from j group by 1, 2, 3)
select b.doc_id, b.page_no, b.det_id, label_id, case when label_id is not null then 'ASSIGNED' when exists (select 1 from tk where {ON.format('tk', 'b')}) then 'UNASSIGNED' end as state from bx b left join m using (doc_id, page_no, det_id)""")
def _(t):
    labels = M.word_points(t.tokens.where(c("text").isin("TYP", "NIC", "EF"))).withColumnRenamed("word_id", "label_id")
    d = M.assign_nearest(t.boxes.select(*PAGE, "det_id", "x1", "y1", "x2", "y2"), labels, cap=150)
    return d.select(*PAGE, "det_id", "label_id", "state")


@query("note_to_box", "G2", f"""
with {BOX_XY}, nt as (select * from (select *, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy from {{tokens}}) z where text = 'NIC'),
n as (select k.doc_id, k.page_no, k.word_id, arg_min(b.det_id, ({DIST.format('b', 'k')}, b.det_id)) as det_id from nt k join bx b on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 200 group by 1, 2, 3)
select doc_id, page_no, det_id, min(word_id) as note_id from n group by 1, 2, 3""")
def _(t):
    notes = M.word_points(t.tokens.where("text = 'NIC'")).withColumnRenamed("word_id", "note_id")
    return M.note_to_box(notes, t.boxes, 200)


@query("marker_near_box", "G3", f"""
with {BOX_XY}, tk as (select doc_id, page_no, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy from {{tokens}} where text = 'C.R.D.')
select b.doc_id, b.page_no, b.det_id, exists (select 1 from tk where {ON.format('tk', 'b')} and abs(tk.cx - b.cx) < 200 and abs(tk.cy - b.cy) < 200) as flag from bx b""")
def _(t):
    return M.near_any(t.boxes.select(*PAGE, "det_id", "x1", "y1", "x2", "y2"), M.word_points(t.tokens.where("text = 'C.R.D.'")), 200).select(*PAGE, "det_id", "flag")


@query("box_with_context", "G3", f"""
with {BOX_XY}, o as (select * from bx where cls = 'A-F'), g as (select * from bx where cls = 'N-O'),
h as (select distinct o.doc_id, o.page_no, o.det_id from o join g on {ON.format('o', 'g')} where {SQL_IOU.format('o', 'g')} > 0.05e0 or {DIST.format('o', 'g')} < 100)
select doc_id, page_no, det_id, h.det_id is not null as flag from o left join h using (doc_id, page_no, det_id)""")
def _(t):
    return M.with_context(t.boxes.where("cls = 'A-F'"), t.boxes.where("cls = 'N-O'"), 0.05, 100).select(*PAGE, "det_id", "flag")


@query("nearest_words", "G4", f"""
with {BOX_XY}, {TOK_XY}, j as (select b.doc_id, b.page_no, b.det_id, k.word_id, k.text, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 100),
r as (select *, row_number() over (partition by doc_id, page_no, det_id order by dist, word_id) as rk from j)
select doc_id, page_no, det_id, min(case when rk = 1 then text end) as text, round(min(dist), 6) as dist, round(1 - min(dist) / 100, 6) as confidence, coalesce(string_agg(text, '|' order by rk) filter (where rk > 1), '') as alternatives from r where rk <= 4 group by 1, 2, 3""")
def _(t):
    d = M.best_and_alternatives(M.nearby_words(t.boxes, M.word_points(t.tokens), 100))
    return d.select(*PAGE, "det_id", "text", F.round("dist", 6).alias("dist"), F.round("confidence", 6).alias("confidence"), F.array_join("alternatives", "|").alias("alternatives"))


@query("closest_valid_tag", "G4", f"""
with {BOX_XY}, {TOK_XY}, sd as (select distinct doc_id, tag, case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR SUPPLY' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls from {{expected}}), per as (select doc_id, cls, count(*) as n from sd group by 1, 2), bc as (select *, case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' when 2 then 'EXHAUST FAN' else 'SPLIT SYSTEM' end as c0 from bx),
rb as (select b.doc_id, b.page_no, b.det_id, b.cx, b.cy, coalesce(o.cls, a.cls) as rc from bc b left join per o on o.doc_id = b.doc_id and o.cls = b.c0 left join per a on a.doc_id = b.doc_id and a.cls = case b.c0 when 'SPLIT SYSTEM' then 'CONDENSING UNIT' when 'AD-SURF SUPPLY' then 'AD-GRD' end where coalesce(o.n, a.n) >= 2),
j as (select b.doc_id, b.page_no, b.det_id, k.text as tag, k.word_id, {DIST.format('b', 'k')} as dist from rb b join tk k on {ON.format('b', 'k')} join sd on sd.doc_id = k.doc_id and sd.tag = k.text and sd.cls = b.rc where {DIST.format('b', 'k')} <= 140)
select doc_id, page_no, det_id, arg_min(tag, (dist, word_id)) as tag, round(1 - min(dist) / 140, 6) as confidence from j group by 1, 2, 3""")
def _(t):
    b = t.boxes.selectExpr(*PAGE, "det_id", "case l_partkey % 4 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' when 2 then 'EXHAUST FAN' else 'SPLIT SYSTEM' end as cls", "x1", "y1", "x2", "y2")
    s = t.expected.selectExpr("doc_id", "tag", "case exp_qty when 1 then 'AD-GRD' when 2 then 'AD-T-BAR SUPPLY' when 3 then 'FAN' else 'CONDENSING UNIT' end as cls")
    return M.closest_valid_tag(b, M.word_points(t.tokens).withColumn("tag", c("text")), s, 140).withColumn("confidence", F.round("confidence", 6))


@query("distance_greedy_pairs", "G5", f"""with recursive {BOX_XY}, {TOK_XY},
{greedy_pairs(f"select b.doc_id, b.page_no, b.det_id as l, k.word_id as r, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 90", 'dist')}
select doc_id, page_no, l as det_id, r as word_id from pairs""")
def _(t):
    from markgrid.functions.geom import with_center

    return M.closest_pairs(with_center(t.boxes), M.word_points(t.tokens), 90, "det_id", "word_id").select(*PAGE, "det_id", "word_id")


def print_values(t):
    return t.raw_items.selectExpr("doc_id", "case l_partkey % 3 when 0 then 'A-F' when 1 then 'N-O' else 'R-F' end as cls", "'T' || (l_orderkey % 251) as tag",
                                  "(l_orderkey * 7 % 1013) || '\" / P-' || l_orderkey as value")


SQL_TOKENS = "list_distinct(list_filter(list_transform(regexp_split_to_array(replace(upper(trim({0})), '\"', ''), '[\\s/,]+'), lambda p: regexp_replace(p, '^[.()]+|[.()]+$', '', 'g')), lambda p: length(p) >= 2 and regexp_matches(p, '\\d')))"
SQL_PRINTS = f"""vl as (select doc_id, case l_partkey % 3 when 0 then 'A-F' when 1 then 'N-O' else 'R-F' end as cls, 'T' || (l_orderkey % 251) as tag, (l_orderkey * 7 % 1013) || '" / P-' || l_orderkey as value from {{raw_items}}),
vt as (select distinct doc_id, cls, tag, unnest({SQL_TOKENS.format('value')}) as token from vl),
fp as (select * from vt where (doc_id, token) in (select (doc_id, token) from vt group by doc_id, token having count(distinct tag) <= 2))"""


@query("fingerprint_tokens", "A17", f"with {SQL_PRINTS} select * from fp")
def _(t):
    return M.fingerprints(print_values(t), ["doc_id"])


@query("fingerprint_assignment", "G6", f"""with recursive {BOX_XY}, {TOK_XY}, {SQL_PRINTS},
nb as (select distinct b.doc_id, b.page_no, b.det_id, b.cls, unnest({SQL_TOKENS.format('k.text')}) as token from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 100),
{greedy_pairs("select nb.doc_id, nb.page_no, nb.det_id as l, fp.tag as r, count(*) as score from nb join fp on fp.doc_id = nb.doc_id and fp.cls = nb.cls and fp.token = nb.token group by 1, 2, 3, 4", '-score', rtype='varchar')}
select doc_id, page_no, l as det_id, r as tag from pairs""")
def _(t):
    return M.fingerprint_match(t.boxes, M.word_points(t.tokens), M.fingerprints(print_values(t), ["doc_id"]), 100).select(*PAGE, "det_id", "tag")


SQL_REV_EDGES = f"""select a.doc_id, a.page_no, a.det_id as l, b.det_id as r, {SQL_IOU.format('a', 'b')} as iou, a.cls as l_cls, b.cls as r_cls from {{boxes}} a join {{revision}} b on {ON.format('a', 'b')}
 and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 where {SQL_IOU.format('a', 'b')} >= {{t}}"""


def rev_edges(th):
    return SQL_REV_EDGES.replace("{t}", th)


SQL_REVISION = f"""{serial_pairs(rev_edges('0.1e0'), '-iou', takes='l_cls = r_cls or iou >= 0.5e0')},
df as (select o.doc_id, o.page_no, o.det_id, case when p.takes then p.r end as new_id, case when p.l is null or not p.takes then 'removed' when e.iou >= 0.5e0 then case when e.l_cls = e.r_cls then 'unchanged' else 'relabeled' end else 'moved' end as status
 from {{boxes}} o left join picks p on {ON.format('p', 'o')} and p.l = o.det_id left join ed e on {ON.format('p', 'e')} and p.l = e.l and p.r = e.r
 union all select n.doc_id, n.page_no, null, n.det_id, 'added' from {{revision}} n where not exists (select 1 from picks p where {ON.format('p', 'n')} and p.r = n.det_id and p.takes))"""


@query("revision_diff", "G7", f"with recursive {SQL_REVISION} select * from df")
def _(t):
    return M.revision_diff(t.boxes, t.revision)


@query("diff_summary", "A37", f"""with recursive {SQL_REVISION}
select doc_id, page_no, count(*) filter (where status = 'unchanged') as unchanged, count(*) filter (where status = 'moved') as moved, count(*) filter (where status = 'relabeled') as relabeled,
 count(*) filter (where status = 'removed') as removed, count(*) filter (where status = 'added') as added from df group by 1, 2""")
def _(t):
    d = M.revision_diff(t.boxes, t.revision)
    return d.groupBy(*PAGE).agg(*[F.sum((c("status") == s).cast("bigint")).alias(s) for s in ("unchanged", "moved", "relabeled", "removed", "added")])


@query("truth_matching", "G8", f"""with recursive {serial_pairs(rev_edges('0.3e0'), '-iou')} select doc_id, page_no, l, r from picks""")
def _(t):
    return M.match_in_order(t.boxes, t.revision, 0.3).select(*PAGE, "l", "r")


@query("review_diff", "G9", f"""with recursive rvp as (select doc_id, page_no from {{boxes}} group by 1, 2 having count(*) >= 130),
{serial_pairs("select doc_id, page_no, l, r, iou, l_cls, r_cls from (" + rev_edges('0.4e0') + ") e1 where (doc_id, page_no) in (select (doc_id, page_no) from rvp)", '-iou')}
select o.doc_id, o.page_no, o.det_id, case when p.l is null then 'deleted' when e.l_cls = e.r_cls then 'accepted' else 'relabeled' end as status from {{boxes}} o join rvp using (doc_id, page_no)
 left join picks p on {ON.format('p', 'o')} and p.l = o.det_id left join ed e on {ON.format('p', 'e')} and p.l = e.l and p.r = e.r
union all select n.doc_id, n.page_no, n.det_id, 'added' from {{revision}} n join rvp using (doc_id, page_no) where not exists (select 1 from picks p where {ON.format('p', 'n')} and p.r = n.det_id)""")
def _(t):
    reviewed = t.boxes.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 130")
    return M.review_diff(t.boxes, t.revision, reviewed)


@query("first_within_radius", "G10", f"""with recursive {BOX_XY}, rx as (select *, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {{revision}}),
{serial_pairs(f"select a.doc_id, a.page_no, a.det_id as l, b.det_id as r from bx a join rx b on {ON.format('a', 'b')} where {DIST.format('a', 'b')} <= 40", 'r')}
select doc_id, page_no, l as det_id, r as truth_id from picks""")
def _(t):
    from markgrid.functions.geom import with_center

    truth = with_center(t.revision).withColumnRenamed("det_id", "truth_id")
    return M.first_within(with_center(t.boxes), truth, 40, "det_id", "truth_id").select(*PAGE, "det_id", "truth_id")


def marks_sizes(t):
    w = M.word_points(t.tokens)
    marks = w.where(c("text").rlike("^P-?[0-9]")).withColumnRenamed("word_id", "mark_id")
    sizes = w.where(c("text").rlike('["x]')).withColumnRenamed("word_id", "size_id")
    return marks, sizes


SQL_SIZE_EDGES = f"""select a.doc_id, a.page_no, a.word_id as l, b.word_id as r, {DIST.format('a', 'b')} as cost from tk a join tk b on {ON.format('a', 'b')} and regexp_matches(a.text, '^P-?[0-9]') and regexp_matches(b.text, '["x]')
 where case when abs(a.cy - b.cy) <= 15 then abs(a.cx - b.cx) <= 120 else abs(a.cy - b.cy) <= 50 and abs(a.cx - b.cx) <= 40 end"""


@query("mark_size_pairs", "G11", f"""with recursive {TOK_XY}, e9 as ({SQL_SIZE_EDGES}),
{serial_pairs("select *, min(cost) over (partition by doc_id, page_no, l) as turn from e9", 'cost', 'turn')}
select doc_id, page_no, l as mark_id, r as size_id from picks""")
def _(t):
    m, s = marks_sizes(t)
    return M.pair_sizes_greedy(M.size_edges(m, s)).select(*PAGE, c("l").alias("mark_id"), c("r").alias("size_id"))


@query("mark_size_optimal", "G11", f"""with recursive {TOK_XY}, e9 as ({SQL_SIZE_EDGES}), ee as (select doc_id, page_no, l as a, r as b from e9 union select doc_id, page_no, r, l from e9),
cc(doc_id, page_no, id, root) using key (doc_id, page_no, id) as (select distinct doc_id, page_no, a, a from ee union
 select ee.doc_id, ee.page_no, ee.a, min(cc.root) from cc join ee on {ON.format('ee', 'cc')} and ee.b = cc.id join recurring.cc as rc on {ON.format('rc', 'ee')} and rc.id = ee.a where cc.root < rc.root group by 1, 2, 3),
m9 as (select e9.doc_id, e9.page_no, root, l, list({{'r': r, 'cost': cost}}) as cs, row_number() over (partition by e9.doc_id, e9.page_no, root order by l) as k from e9 join cc on {ON.format('e9', 'cc')} and cc.id = e9.l group by 1, 2, 3, 4),
-- every way to give each mark of a component a free size or none
al(doc_id, page_no, root, k, used, total) as (select distinct doc_id, page_no, root, 0::bigint, []::bigint[], 0::double from m9
 union all select al.doc_id, al.page_no, al.root, al.k + 1, case when o.r is null then used else list_append(used, o.r) end, total + coalesce(o.cost, 0)
 from al join m9 on {ON.format('al', 'm9')} and al.root = m9.root and m9.k = al.k + 1, unnest(list_append(m9.cs, {{'r': null, 'cost': null}})) as u(o) where o.r is null or not list_contains(used, o.r)),
la as (select al.*, row_number() over (partition by al.doc_id, al.page_no, al.root order by len(used) desc, total) as rk from al join (select doc_id, page_no, root, max(k) as k from m9 group by 1, 2, 3) z using (doc_id, page_no, root, k))
select doc_id, page_no, cast(sum(len(used)) as bigint) as n_pairs, round(sum(total), 2) as total from la where rk = 1 group by 1, 2""")
def _(t):
    best = A.optimal_pairs(M.size_edges(*marks_sizes(t)), PAGE)
    return best.groupBy(*PAGE).agg(F.count("*").alias("n_pairs"), F.round(F.sum("cost"), 2).alias("total"))


@query("mark_size_components", "G11 D20", f"""with recursive {TOK_XY}, e9 as ({SQL_SIZE_EDGES}), ee as (select doc_id, page_no, l as a, r as b from e9 union select doc_id, page_no, r, l from e9),
cc(doc_id, page_no, id, root) using key (doc_id, page_no, id) as (select distinct doc_id, page_no, a, a from ee union
 select ee.doc_id, ee.page_no, ee.a, min(cc.root) from cc join ee on {ON.format('ee', 'cc')} and ee.b = cc.id join recurring.cc as rc on {ON.format('rc', 'ee')} and rc.id = ee.a where cc.root < rc.root group by 1, 2, 3)
select * from cc""")
def _(t):
    m, s = marks_sizes(t)
    return KN.components(M.size_edges(m, s).select(*PAGE, c("l").alias("a"), c("r").alias("b")), PAGE)


@query("flow_below_label", "G12", f"""with recursive {TOK_XY},
{serial_pairs(f'''select a.doc_id, a.page_no, a.word_id as l, b.word_id as r, (b.cx - a.cx) * (b.cx - a.cx) + (b.y0 - a.y1) * (b.y0 - a.y1) as d2 from tk a join tk b on {ON.format('a', 'b')} and regexp_matches(a.text, '^P-?[0-9]')
  and regexp_matches(b.text, '^[0-9]+$') where b.y0 between a.y1 and a.y1 + 40 and abs(b.cx - a.cx) <= 30''', 'd2')}
select doc_id, page_no, l as anchor_id, r as word_id from picks""")
def _(t):
    w = M.word_points(t.tokens)
    a = w.where(c("text").rlike("^P-?[0-9]")).select(*PAGE, c("word_id").alias("anchor_id"), "cx", c("y1").alias("bottom"))
    n = w.where(c("text").rlike("^[0-9]+$")).select(*PAGE, "word_id", "cx", c("y0").alias("top"))
    return M.flow_below(a, n).select(*PAGE, "anchor_id", "word_id")


# prefix words and numbers close enough to stack
STACK = """select doc_id, page_no, word_id, text, conf, x0, y0, x0 + 24 as x1, y0 + 10 as y1 from (
 select doc_id, page_no, word_id, ocr_pct as conf, (x0 // 240) * 240 + word_id % 5 as x0, (y0 // 75) * 75 + (case when word_id % 2 = 0 then 0 else 9 end) as y0,
  case when word_id % 2 = 0 then case (word_id // 2) % 3 when 0 then 'EF' when 1 then 'CU-' else 'rtu' end else cast(1 + x1 % 20 as string) end as text from {tokens}) q_"""


def stacked_words(t):
    return t.spark.sql(STACK.replace("//", " div "), tokens=t.tokens)


def stack_tags(t):
    return t.expected.selectExpr("doc_id", "case row_no % 3 when 0 then 'EF-' when 1 then 'CU-' else 'RTU-' end || (row_no % 15) as tag")


SQL_CALLOUTS = f"""sw as (select *, (x0 + x1) / 2e0 as cx from ({STACK}) s0), st as (select distinct doc_id, case row_no % 3 when 0 then 'EF-' when 1 then 'CU-' else 'RTU-' end || (row_no % 15) as tag from {{expected}}),
hd as (select *, replace(upper(text), '-', '') as u from sw where replace(upper(text), '-', '') in {KNOWN}),
co as (select h.doc_id, h.page_no, h.word_id, h.cx, arg_min(h.u || '-' || n.text, n.word_id) as tag, arg_min((h.y0 + n.y1) / 2e0, n.word_id) as cy from hd h join sw n on {ON.format('h', 'n')} and regexp_matches(n.text, '^\\d{{1,3}}$') and abs(n.cx - h.cx) < 12
  and n.y0 - h.y0 > 3e0 and n.y0 - h.y0 < 15e0 and exists (select 1 from st where st.doc_id = h.doc_id and st.tag = h.u || '-' || n.text) group by 1, 2, 3, 4)"""


@query("stacked_callouts", "G13", f"with {SQL_CALLOUTS} select * from co")
def _(t):
    return M.stacked_callouts(stacked_words(t), list(V.TAG_PREFIX_CLASS), stack_tags(t))


CLS4 = "case l_partkey % 4 when 0 then 'EXHAUST FAN' when 1 then 'SPLIT SYSTEM' when 2 then 'PACKAGED ROOFTOP UNIT' else 'VENT CAP' end"


@query("callouts_to_boxes", "G14", f"""with recursive {SQL_CALLOUTS}, cc as (select co.*, {sql_class_of_tag('tag')} as cls from co),
bx as (select doc_id, page_no, det_id, {CLS4} as cls, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {{boxes}} where tag is null),
{serial_pairs(f"select a.doc_id, a.page_no, a.word_id as l, b.det_id as r, {DIST.format('a', 'b')} as dist from cc a join bx b on {ON.format('a', 'b')} and (a.cls = b.cls or (b.cls = 'SPLIT SYSTEM' and a.cls = 'CONDENSING UNIT') or (b.cls = 'VENT CAP' and a.cls = 'EXHAUST FAN')) where {DIST.format('a', 'b')} <= 220", 'dist')}
select cc.doc_id, cc.page_no, cc.word_id, cc.tag, p.r as det_id, p.r is null as synthetic, case when p.r is null then cx - 20 end as x1, case when p.r is null then cy + 20 end as y2 from cc left join picks p on {ON.format('p', 'cc')} and p.l = cc.word_id""")
def _(t):
    co = M.stacked_callouts(stacked_words(t), list(V.TAG_PREFIX_CLASS), stack_tags(t)).withColumn("cls", K.class_of_tag(c("tag")))
    b = t.boxes.where("tag is null").selectExpr(*PAGE, "det_id", f"{CLS4} as cls", "tag", "x1", "y1", "x2", "y2")
    return M.callouts_to_boxes(co, b, 220).select(*PAGE, "word_id", "tag", "det_id", "synthetic", "x1", "y2")


@query("merged_short_pairs", "G15", f"""with {TOK_XY}, p as (select a.doc_id, a.page_no, a.word_id as first_id, b.word_id as second_id, a.text as x, b.text as y from tk a join tk b on {ON.format('a', 'b')} and a.word_id < b.word_id and length(a.text) <= 3 and length(b.text) <= 3
 where abs(a.cx - b.cx) <= 40 and abs(a.cy - b.cy) <= 40)
select doc_id, page_no, first_id, second_id, x || '-' || y as text from p union all select doc_id, page_no, first_id, second_id, y || '-' || x from p""")
def _(t):
    return M.merged_pairs(M.word_points(t.tokens), 3, 40, 40).select(*PAGE, "first_id", "second_id", "text")


@query("longest_tag_near_box", "G16", f"""with {BOX_XY}, {TOK_XY},
tg as (select doc_id, regexp_replace(tag, '[^A-Z0-9]', '', 'g') as n, min(tag) as tag, min(case exp_qty % 2 when 0 then 'AD-T-BAR SUPPLY' else 'AD-GRD' end) as tcls from {{expected}} group by 1, 2),
mt as (select k.doc_id, k.page_no, k.word_id, k.cx, k.cy, coalesce(e.tag, p.tag) as tag, coalesce(e.tcls, p.tcls) as tcls, length(coalesce(e.n, p.n)) as ln from tk k
  left join tg e on e.doc_id = k.doc_id and e.n = regexp_replace(upper(k.text), '[^A-Z0-9]', '', 'g') left join tg p on p.doc_id = k.doc_id and contains(k.text, '-') and p.n = regexp_replace(upper(string_split(k.text, '-')[1]), '[^A-Z0-9]', '', 'g') where coalesce(e.tag, p.tag) is not null),
bb as (select doc_id, page_no, det_id, cx, cy, case l_partkey % 3 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' else 'FAN' end as cls from bx),
j as (select b.doc_id, b.page_no, b.det_id, b.cls, m.tag, m.tcls, m.word_id, {DIST.format('b', 'm')} as dist, {DIST.format('b', 'm')} - 80 * m.ln as score from bb b join mt m on {ON.format('b', 'm')}
  and ((b.cls = 'AD-GRD') or (b.cls = 'AD-SURF SUPPLY' and m.tcls = 'AD-GRD')) where {DIST.format('b', 'm')} <= 600)
select doc_id, page_no, det_id, cls, arg_min(tag, (score, word_id)) as tag, arg_min(tcls, (score, word_id)) as new_cls, round(1 - arg_min(dist, (score, word_id)) / 600, 6) as confidence from j group by 1, 2, 3, 4""")
def _(t):
    tags = t.expected.groupBy("doc_id", "tag").agg(F.min(F.when(c("exp_qty") % 2 == 0, "AD-T-BAR SUPPLY").otherwise("AD-GRD")).alias("tag_cls"))
    w = cut(M.word_points(t.tokens).select(*PAGE, "word_id", "text", "cx", "cy"))
    hit = R.match_cascade(w, t.expected, ["doc_id"], ["page_no", "word_id"]).where("strength <> 'fuzzy'")
    m = w.join(hit, [*PAGE, "word_id"]).join(tags.withColumnRenamed("tag", "match"), ["doc_id", "match"])
    m = m.select(*PAGE, "word_id", "cx", "cy", c("match").alias("tag"), "tag_cls", F.length(K.alnum_key(c("match"))).alias("matched_len"))
    b = t.boxes.selectExpr(*PAGE, "det_id", "case l_partkey % 3 when 0 then 'AD-GRD' when 1 then 'AD-SURF SUPPLY' else 'FAN' end as cls", "x1", "y1", "x2", "y2")
    return M.longest_near_tag(b, cut(m), 600).withColumn("confidence", F.round("confidence", 6))


@query("shape_guided_size", "G17", f"""with {BOX_XY}, {TOK_XY},
sz as (select doc_id, page_no, word_id, cx, cy, case when regexp_matches(text, '^\\d+x\\d+$') then upper(text) when regexp_matches(text, '^\\d+"$') then text end as size from tk),
bb as (select doc_id, page_no, det_id, cx, cy, case l_partkey % 3 when 0 then 'rect' when 1 then 'round' end as want from bx),
j as (select b.doc_id, b.page_no, b.det_id, b.want, s.word_id, s.size, case when contains(s.size, 'X') then 'rect' else 'round' end as shape, {DIST.format('b', 's')} as dist from bb b join sz s on {ON.format('b', 's')} and s.size is not null where {DIST.format('b', 's')} <= 150),
g as (select doc_id, page_no, det_id, want, min({{'dist': dist, 'w': word_id, 'size': size, 'shape': shape}}) as a, min({{'dist': dist, 'w': word_id, 'size': size, 'shape': shape}}) filter (where shape = want) as f from j group by 1, 2, 3, 4),
h as (select *, case when f is not null and f.dist <= a.dist * 1.6e0 + 25 then f else a end as hit from g)
select doc_id, page_no, det_id, hit.size as size, round(hit.dist, 6) as dist, case when (want is null or hit.shape = want) and hit.dist <= 70 then 'HIGH' when hit.dist <= 130 then 'MEDIUM' else 'LOW' end as tier from h""")
def _(t):
    s = M.word_points(t.tokens).withColumn("size", X.read_size(c("text"))).where("size is not null").withColumn("shape", X.shape_of_size(c("size")))
    b = t.boxes.selectExpr(*PAGE, "det_id", "case l_partkey % 3 when 0 then 'rect' when 1 then 'round' end as want", "x1", "y1", "x2", "y2")
    return M.shape_guided(b, s, 150).withColumn("dist", F.round("dist", 6))


@query("value_of_label", "G18", f"""with l as (select * from {{tokens}} where text in ('TYP', 'EF')), j as (select l.doc_id, l.page_no, l.word_id, l.text as label, w.text, w.word_id as wid, w.x0 - l.x0 as dx, l.y0 - w.y0 as dy from l join {{tokens}} w on {ON.format('l', 'w')} and w.word_id <> l.word_id
  and abs(w.x0 - l.x0) <= 160 and abs(w.y0 - l.y0) <= 90),
a as (select doc_id, page_no, word_id, arg_min(text, (dy, wid)) as v from j where abs(dx) <= 12 and dy > 0 and dy <= 90 group by 1, 2, 3), b as (select doc_id, page_no, word_id, arg_min(text, (dx, wid)) as v from j where dx > 0 and dx <= 160 and abs(dy) <= 8 group by 1, 2, 3)
select l.doc_id, l.page_no, l.word_id, l.text as label, coalesce(a.v, b.v) as value, case when a.v is not null then 'above' when b.v is not null then 'right' end as via from l left join a using (doc_id, page_no, word_id) left join b using (doc_id, page_no, word_id)""")
def _(t):
    return M.value_of_label(t.tokens.where(c("text").isin("TYP", "EF")), t.tokens, 90, 12, 160, 8)


@query("band_fill", "G19 C5", """
with bd as (select doc_id, (row_no * 37) % 900 as lo, (row_no * 37) % 900 + 20 as hi, 'b' || (row_no % 13) as band from {expected}),
it as (select doc_id, l_orderkey, l_partkey, l_suppkey, line_no, 20 + (l_partkey * 13) % 900 as cfm, case when l_suppkey % 3 = 0 then raw_size end as neck from {raw_items}),
nd as (select distinct doc_id, cfm from it where neck is null), h as (select n.doc_id, n.cfm, arg_min(band, (lo, hi, band)) as band from nd n join bd on bd.doc_id = n.doc_id and n.cfm between lo and hi group by 1, 2)
select it.doc_id, l_orderkey, l_partkey, l_suppkey, line_no, it.cfm, coalesce(neck, band) as neck, case when neck is not null then 'own' when band is not null then 'band' else 'none' end as origin from it left join h on h.doc_id = it.doc_id and h.cfm = it.cfm""")
def _(t):
    bands = t.expected.selectExpr("doc_id", "(row_no * 37) % 900 as lo", "(row_no * 37) % 900 + 20 as hi", "'b' || (row_no % 13) as band")
    rows = t.raw_items.selectExpr("doc_id", "l_orderkey", "l_partkey", "l_suppkey", "line_no", "20 + (l_partkey * 13) % 900 as cfm", "case when l_suppkey % 3 = 0 then raw_size end as neck")
    return M.fill_from_band(rows, bands, ["doc_id"], "cfm", "neck", 32.0)


@query("no_same_mark_nearby", "G20", f"""with {TOK_XY}, n as (select doc_id, page_no, word_id, text as mark, cx, cy from tk where ocr_pct < 75), k as (select doc_id, page_no, text as mark, cx, cy from tk where ocr_pct >= 75)
select doc_id, page_no, word_id, mark from n where not exists (select 1 from k where {ON.format('k', 'n')} and k.mark = n.mark and abs(k.cx - n.cx) < 15 and abs(k.cy - n.cy) < 15)""")
def _(t):
    w = M.word_points(t.tokens).withColumnRenamed("text", "mark").select(*PAGE, "word_id", "mark", "cx", "cy", "ocr_pct")
    return M.without_same_nearby(w.where("ocr_pct < 75"), w.where("ocr_pct >= 75"), "mark", 15).select(*PAGE, "word_id", "mark")


@query("text_near_point", "G21", f"""with w as (select *, lead(text, 1) over wn as t1, lead(text, 2) over wn as t2, lead(text, 3) over wn as t3 from {{words}} window wn as (partition by doc_id, page_no, line_no order by word_no)),
r as (select doc_id, page_no, word_id, x0, y0, unnest([{{'n': 1, 's': text}}, {{'n': 2, 's': text || t1}}, {{'n': 3, 's': text || t1 || t2}}, {{'n': 4, 's': text || t1 || t2 || t3}}]) as q from w),
q as (select doc_id, page_no, word_id, x0, y0, q.n as n, regexp_replace(upper(q.s), '[^A-Z0-9]', '', 'g') as want from r where q.s is not null),
p as (select doc_id, page_no, word_id + 5 as det_id, regexp_replace(upper(case word_id % 3 when 0 then text when 1 then text || t1 else text || t1 || t2 end), '[^A-Z0-9]', '', 'g') as want, x0 + 30 as cx, y0 + 20 as cy from w)
select p.doc_id, p.page_no, p.det_id, p.want, arg_min(q.word_id, (sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)), q.word_id, q.n)) as word_id, arg_min(q.n, (sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)), q.word_id, q.n)) as n_words
from p join q on {ON.format('p', 'q')} and p.want = q.want where p.want <> '' and sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)) <= 120 group by 1, 2, 3, 4""")
def _(t):
    from pyspark.sql import Window

    # points and words come from one shuffle
    words = t.words.select(*PAGE, "line_no", "word_no", "word_id", "text", "x0", "y0").repartition(*PAGE)
    w = Window.partitionBy(*PAGE, "line_no").orderBy("word_no")
    t1, t2 = F.lead("text", 1).over(w), F.lead("text", 2).over(w)
    k = c("word_id") % 3
    want = F.when(k == 0, c("text")).when(k == 1, F.concat("text", t1)).otherwise(F.concat(c("text"), t1, t2))
    p = words.select(*PAGE, (c("word_id") + 5).alias("det_id"), F.regexp_replace(F.upper(want), "[^A-Z0-9]", "").alias("want"), (c("x0") + 30).alias("cx"), (c("y0") + 20).alias("cy"))
    return M.text_near_point(p.where("want <> ''"), words, 120).select(*PAGE, "det_id", "want", "word_id", "n_words")


@query("weighted_nearest_size", "G22", f"""with {BOX_XY}, {TOK_XY},
s as (select doc_id, page_no, word_id, cx, cy, text as size, ocr_pct / 100e0 as oc, case when contains(text, '"') then 'standard_round' when contains(text, 'x') then 'standard_rect' else 'variant' end as st from tk where regexp_matches(text, '^[0-9]+["x]|^[0-9]+/')),
j as (select b.doc_id, b.page_no, b.det_id, s.*  exclude (doc_id, page_no, cx, cy), {DIST.format('b', 's')} as dist from bx b join s on {ON.format('b', 's')} where {DIST.format('b', 's')} <= 300),
m as (select doc_id, page_no, det_id, min({{'rank': -oc * (1 - least(dist / 600, 0.8e0)), 'w': word_id, 'size': size, 'st': st, 'oc': oc, 'dist': dist}}) as h from j group by 1, 2, 3),
k as (select doc_id, page_no, det_id, h.w as word_id, h.size as size, 0.8e0 * h.oc * (case when h.dist < 200 then 1e0 else greatest(0.3e0, 1e0 - (h.dist - 200) / 400 * 0.5e0) end) * (case h.st when 'standard_round' then 1e0 when 'standard_rect' then 0.95e0 else 0.8e0 end) as conf from m)
select doc_id, page_no, det_id, word_id, size, round(conf, 6) as confidence from k where conf >= 0.2e0""")
def _(t):
    s = M.word_points(t.tokens.where(c("text").rlike('^[0-9]+["x]|^[0-9]+/')))
    st = F.when(c("text").contains('"'), "standard_round").when(c("text").contains("x"), "standard_rect").otherwise("variant")
    s = s.withColumns({"size": c("text"), "strength": st, "ocr_conf": c("ocr_pct") / 100})
    return M.weighted_nearest(t.boxes, s, 300).withColumn("confidence", F.round("confidence", 6))


@query("labels_in_box", "G23 F35", f"""with {TOK_XY}, j as (select b.doc_id, b.page_no, b.det_id, k.word_id, k.text, k.ocr_pct from {{boxes}} b join tk k on {ON.format('b', 'k')} and k.cx between b.x1 - 30 and b.x2 + 30 and k.cy between b.y1 - 30 and b.y2 + 30),
q as (select *, case when regexp_matches(text, '^[A-Z]{{1,3}}-?\\d{{1,3}}[A-Z]?$') then 'mark' when regexp_matches(text, '^\\d+("|[x/]\\d+)$') then 'size' when regexp_matches(text, '^\\d{{2,4}}$') and cast(text as int) between 30 and 9999 then 'cfm' end as kind from j)
select doc_id, page_no, det_id, arg_min(upper(text), word_id) filter (where kind = 'mark') as mark, arg_min(case when contains(text, '"') then 'round:' || replace(text, '"', '') else 'rect:' || replace(text, '/', 'x') end, word_id) filter (where kind = 'size') as size,
 arg_min(try_cast(text as int), word_id) filter (where kind = 'cfm') as cfm, round(avg(ocr_pct), 6) as mean_conf, count(*) as n_tokens from q group by 1, 2, 3""")
def _(t):
    d = M.label_of_tokens(M.tokens_in_box(t.boxes, M.word_points(t.tokens), 30))
    return d.withColumn("mean_conf", F.round("mean_conf", 6))
