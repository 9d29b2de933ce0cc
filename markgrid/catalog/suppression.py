"""Suppression, merging and graph queries."""

from pyspark.sql import functions as F

from markgrid.catalog.reconciliation import SQL_IOU
from markgrid.catalog.registry import query
from markgrid.operators import suppress as S

OUT = ["doc_id", "page_no", "det_id"]
ON = "{0}.doc_id = {1}.doc_id and {0}.page_no = {1}.page_no"
BOX = "struct(det_id bigint, cls varchar, x1 bigint, y1 bigint, x2 bigint, y2 bigint)"


def walk(name: str, source: str, clash: str) -> str:
    """CTEs: boxes of each page in rank order, each kept unless it clashes with a kept one (k vs b)."""
    return f"""{name}r as (select *, row_number() over (partition by doc_id, page_no order by conf_pct desc, det_id) as k from {source}),
{name}w(doc_id, page_no, k, kept) using key (doc_id, page_no) as (
 select distinct doc_id, page_no, 0::bigint, []::{BOX}[] from {name}r
 union select w.doc_id, w.page_no, w.k + 1, case when len(list_filter(w.kept, lambda kp: {clash})) > 0 then w.kept
   else list_append(w.kept, {{'det_id': b.det_id, 'cls': b.cls, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) end
 from {name}w w join {name}r b on {ON.format('w', 'b')} and b.k = w.k + 1),
{name} as (select doc_id, page_no, unnest(kept).det_id as det_id from {name}w)"""


IOU = SQL_IOU.format("kp", "b")


@query("nms_two_pass", "N1", f"""with recursive {walk('p1', '{boxes}', f"kp.cls = b.cls and {IOU} >= 0.45e0")}, p1b as (select b.* from {{boxes}} b join p1 using (doc_id, page_no, det_id)),
{walk('p2', 'p1b', f"{IOU} >= 0.7e0")} select * from p2""")
def _(t):
    return S.suppress_two_pass(t.boxes.select(*OUT, "cls", "conf_pct", "x1", "y1", "x2", "y2")).select(*OUT)


@query("nms_class_free", "N2", f"with recursive {walk('p1', '{boxes}', f'{IOU} > 0.3e0')} select * from p1")
def _(t):
    return S.suppress_iou(t.boxes, 0.3, strict=True).select(*OUT)


@query("nms_class_free_at_threshold", "N2", f"with recursive {walk('p1', '{boxes}', f'{IOU} >= 0.4e0')} select * from p1")
def _(t):
    return S.suppress_iou(t.boxes, 0.4).select(*OUT)


@query("nms_centre_window", "N3", f"with recursive {walk('p1', '{boxes}', 'abs((kp.x1 + kp.x2) - (b.x1 + b.x2)) < 100 and abs((kp.y1 + kp.y2) - (b.y1 + b.y2)) < 100')} select * from p1")
def _(t):
    return S.suppress_window(t.boxes, 50).select(*OUT)


@query("run_merge", "N4 D20", f"""with recursive s as (select * from {{strips}}),
e0 as (select a.doc_id, a.page_no, a.det_id as a, b.det_id as b from s a join s b on {ON.format('a', 'b')} and a.cls = b.cls and a.det_id < b.det_id where
 (abs(a.y1 - b.y1) <= (a.y2 - a.y1) * 0.3e0 and abs(a.y2 - b.y2) <= (a.y2 - a.y1) * 0.3e0 and greatest(b.x1 - a.x2, a.x1 - b.x2) between -10 and 80) or
 (abs(a.x1 - b.x1) <= (a.x2 - a.x1) * 0.3e0 and abs(a.x2 - b.x2) <= (a.x2 - a.x1) * 0.3e0 and greatest(b.y1 - a.y2, a.y1 - b.y2) between -10 and 80)),
ee as (select * from e0 union select doc_id, page_no, b, a from e0),
cc(doc_id, page_no, id, root) using key (doc_id, page_no, id) as (select doc_id, page_no, det_id, det_id from s union
 select ee.doc_id, ee.page_no, ee.a, min(cc.root) from cc join ee on {ON.format('ee', 'cc')} and ee.b = cc.id join recurring.cc as rc on {ON.format('rc', 'ee')} and rc.id = ee.a where cc.root < rc.root group by 1, 2, 3)
select s.doc_id, s.page_no, s.cls, root, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as merged_count,
 case when count(*) > 1 then greatest(max(x2) - min(x1), max(y2) - min(y1)) end as face_length, round(sum(conf_pct) / count(*)::double, 6) as mean_score
from s join cc on cc.doc_id = s.doc_id and cc.page_no = s.page_no and cc.id = s.det_id group by 1, 2, 3, 4""")
def _(t):
    m = S.merge_runs(t.strips)
    return m.select("doc_id", "page_no", "cls", "root", "x1", "y1", "x2", "y2", "merged_count", "face_length",
                    F.round("mean_score", 6).alias("mean_score"))


@query("closed_rectangles", "N5", f"""with recursive o as (select *, x2 - x1 >= y2 - y1 as h from {{strips}}),
q0 as (select t.doc_id, t.page_no, t.det_id as t_id, b.det_id as b_id, l.det_id as l_id, r.det_id as r_id from o t join o b on {ON.format('t', 'b')} and t.h and b.h and t.det_id <> b.det_id and abs(t.x1 - b.x1) < 80 and abs(t.x2 - b.x2) < 80 and t.y1 < b.y1
 join o l on {ON.format('t', 'l')} and not l.h and abs(l.x1 - t.x1) < 80 and abs(l.y1 - t.y1) < 80 and abs(l.y2 - b.y2) < 80
 join o r on {ON.format('t', 'r')} and not r.h and r.det_id <> l.det_id and abs(r.x2 - t.x2) < 80 and abs(r.y1 - t.y1) < 80 and abs(r.y2 - b.y2) < 80),
q as (select *, row_number() over (partition by doc_id, page_no order by t_id, b_id, l_id, r_id) as k from q0),
w(doc_id, page_no, k, used, got) using key (doc_id, page_no) as (select distinct doc_id, page_no, 0::bigint, []::bigint[], []::bigint[] from q
 union select w.doc_id, w.page_no, w.k + 1, case when list_has_any(w.used, [t_id, b_id, l_id, r_id]) then w.used else list_concat(w.used, [t_id, b_id, l_id, r_id]) end,
  case when list_has_any(w.used, [t_id, b_id, l_id, r_id]) then w.got else list_append(w.got, q.k) end from w join q on {ON.format('w', 'q')} and q.k = w.k + 1)
select q.doc_id, q.page_no, t_id, b_id, l_id, r_id from q join (select doc_id, page_no, unnest(got) as k from w) g using (doc_id, page_no, k)""")
def _(t):
    return S.closed_rectangles(t.strips)
