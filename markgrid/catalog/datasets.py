"""Dataset construction queries."""

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.functions import keys as K
from markgrid.operators import dataset as D

c = F.col
PAGE = ["doc_id", "page_no"]
CANON = "regexp_replace(upper(tag), '[\\s\\-_.]+', '', 'g')"


@query("tag_set_scores", "U1", f"""with a as (select distinct doc_id, {CANON} as k from {{expected}}), b as (select distinct doc_id, {CANON} as k from {{boxes}} where tag is not null), j as (select coalesce(a.doc_id, b.doc_id) as doc_id, a.k as ak, b.k as bk from a full join b on a.doc_id = b.doc_id and a.k = b.k)
select doc_id, count(ak) as n_true, count(bk) as n_found, count(*) filter (where ak = bk) as both, count(*) filter (where bk is null) as missed, count(*) filter (where ak is null) as extra, round(count(*) filter (where ak = bk) / count(ak)::double, 6) as recall, round(count(*) filter (where ak = bk) / count(bk)::double, 6) as precision from j group by 1""")
def _(t):
    d = D.set_scores(t.expected, t.boxes, ["doc_id"])
    return d.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query("merged_corrections", "U2 J16 W9 D15", """with b as (select o_orderkey as k, o_orderpriority as cls from {orders}), q as (select event_id * 3 % 20000 as k, event_type as cls, event_id from {events}), l as (select k, arg_max(cls, event_id) as cls from q group by 1)
select k, cls, 'base' as origin from b where k not in (select k from l) union all select k, cls, 'correction' from l""")
def _(t):
    b = t.orders.selectExpr("o_orderkey as k", "o_orderpriority as cls")
    q = t.events.selectExpr("event_id * 3 % 20000 as k", "event_type as cls", "event_id")
    return D.merged_corrections(b, q, ["k"], "event_id")


@query("oversampled_merge", "U3", """with b as (select doc_id, lang from {documents}), e as (select p.page_id as doc_id, case when p.page_id % 5 = 0 then 'val' else 'train' end as split from {pages} p)
select doc_id, 'train' as split, 0 as rep, 'base' as src from b union all select doc_id, split, cast(r as int), 'extra' from e, (select unnest(generate_series(0, 3)) as r) x where split = 'train' or r = 0""")
def _(t):
    b = t.documents.selectExpr("doc_id", "'train' as split", "'base' as src")
    e = t.pages.selectExpr("page_id as doc_id", "case when page_id % 5 = 0 then 'val' else 'train' end as split", "'extra' as src")
    return D.oversampled(b, e, 4)


@query("next_version", "U4", "select coalesce(max(try_cast(regexp_extract(v, '^v(\\d+)$', 1) as int)), 11) + 1 as next_version from (select case when p_partkey % 3 = 0 then 'v' || p_size else 'draft' || p_partkey end as v from {part}) x")
def _(t):
    d = t.part.selectExpr("case when p_partkey % 3 = 0 then 'v' || p_size else 'draft' || p_partkey end as v")
    return D.next_version(d, "v", r"^v(\d+)$", 11)


SQL_SPLIT = "g as (select distinct source from {documents}), v as (select source from g qualify row_number() over (order by md5('7|' || source)) <= greatest(1, floor((select count(*) from g) * 0.2e0 + 0.5e0))), sp as (select d.doc_id, d.source, d.lang, case when v.source is not null then 'val' else 'train' end as split from {documents} d left join v on v.source = d.source)"


@query("group_split", "U5", f"with {SQL_SPLIT} select doc_id, source, split from sp")
def _(t):
    return D.group_split(t.documents.select("doc_id", "source"), "source", 0.2, 7)


@query("named_group_split", "U5", "select doc_id, source, case when source in ('src3', 'src7') then 'val' else 'train' end as split from {documents}")
def _(t):
    return D.group_split(t.documents.select("doc_id", "source"), "source", 0.2, 7, ["src3", "src7"])


@query("split_card", "A31", f"""with {SQL_SPLIT} select lang, count(*) filter (where split = 'train') as boxes_train, count(*) filter (where split = 'val') as boxes_val, count(distinct case when split = 'train' then source end) as images_train,
 count(distinct case when split = 'val' then source end) as images_val, count(*) filter (where split = 'val') = 0 as no_val from sp group by 1""")
def _(t):
    d = D.group_split(t.documents.select("doc_id", "source", "lang"), "source", 0.2, 7)
    return D.split_card(d, "lang", ["train", "val"], "source")


@query("thin_preserving_sample", "U6", """with n as (select cls || qty as k, l_orderkey as item from {boxes}), th as (select k from n group by 1 having count(*) < 170), m as (select distinct item from n where k in (select k from th)), r as (select distinct item from n where item not in (select item from m)),
f as (select item from r qualify row_number() over (order by md5('3|' || item)) <= greatest(0, 9000 - (select count(*) from m))) select item, 'thin' as why from m union all select item, 'fill' from f""")
def _(t):
    n = t.boxes.selectExpr("cls || qty as k", "l_orderkey as item")
    return D.thin_preserving(n, "item", "k", 170, 9000, 3)


@query("every_kth_row", "U7", "select event_id, idx from (select event_id, row_number() over (order by event_id) - 1 as idx from {events}) x where idx % 8 = 0")
def _(t):
    return D.every_kth(t.events.select("event_id"), "event_id", 8)


SQL_TILES = """st as (select unnest(generate_series(0, 1999, 480)) as s), sy as (select unnest(generate_series(0, 1499, 480)) as s),
b as (select *, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy, greatest(1, x2 - x1) as bw, greatest(1, y2 - y1) as bh from {boxes}),
g as (select b.*, st.s as tx, sy.s as ty, cx - greatest(0, least(st.s + 640, 2000) - 640) as ax, cy - greatest(0, least(sy.s + 640, 1500) - 640) as ay from b join st on true join sy on true),
h as (select *, greatest(0, ax - bw / 2e0) as u1, least(640, ax + bw / 2e0) as u2, greatest(0, ay - bh / 2e0) as v1, least(640, ay + bh / 2e0) as v2 from g where ax >= 0 and ax < 640 and ay >= 0 and ay < 640)"""


@query("tile_assignment", "U8", f"with {SQL_TILES} select doc_id, page_no, det_id, tx, ty, round((u1 + u2) / 2 / 640, 9) as ncx, round((v2 - v1) / 640, 9) as nh from h where u2 > u1 and v2 > v1")
def _(t):
    d = D.tiles(t.boxes.select(*PAGE, "det_id", "x1", "y1", "x2", "y2"), F.lit(2000), F.lit(1500))
    return d.select(*PAGE, "det_id", "tx", "ty", F.round("ncx", 9).alias("ncx"), F.round("nh", 9).alias("nh"))


@query("empty_tiles", "U8", """with p as (select distinct doc_id, page_no from {boxes}), s as (select * from {boxes}), sx as (select unnest(generate_series(0, 1999, 100)) as tx), sy as (select unnest(generate_series(0, 1499, 100)) as ty), g as (select * from p join sx on true join sy on true),
u as (select distinct s.doc_id, s.page_no, tx, ty from s join sx on (x1 + x2) / 2e0 >= greatest(0, least(tx + 120, 2000) - 120) and (x1 + x2) / 2e0 < greatest(0, least(tx + 120, 2000) - 120) + 120 join sy on (y1 + y2) / 2e0 >= greatest(0, least(ty + 120, 1500) - 120) and (y1 + y2) / 2e0 < greatest(0, least(ty + 120, 1500) - 120) + 120),
e as (select g.*, row_number() over (partition by doc_id, page_no order by ty, tx) as k from g anti join u using (doc_id, page_no, tx, ty)) select doc_id, page_no, tx, ty from e where (k - 1) % 10 = 0""")
def _(t):
    b = t.boxes.select(*PAGE, "det_id", "x1", "y1", "x2", "y2")
    return D.empty_tiles(b, t.boxes.select(*PAGE).distinct(), PAGE, 2000, 1500, 10, 120, 20)


@query("retiled_labels", "U9", """with l as (select doc_id, page_no, det_id, (x1 + x2) / 2e0 as cx, (y1 + y2) / 2e0 as cy from {boxes}), st as (select unnest(generate_series(0, 1999, 300)) as tx), sy as (select unnest(generate_series(0, 1499, 300)) as ty)
select doc_id, page_no, det_id, tx, ty, case when det_id % 5 = 0 then 'val' else 'train' end as split from l join st on cx >= greatest(0, least(tx + 400, 2000) - 400) and cx < greatest(0, least(tx + 400, 2000) - 400) + 400 join sy on cy >= greatest(0, least(ty + 400, 1500) - 400) and cy < greatest(0, least(ty + 400, 1500) - 400) + 400""")
def _(t):
    # sixty-fourths keep the round trip exact
    n = t.boxes.selectExpr(*PAGE, "det_id", "case when det_id % 5 = 0 then 'val' else 'train' end as split", "(x1 + x2) / 2.0D / 2000 as ncx", "(y1 + y2) / 2.0D / 1500 as ncy", "(x2 - x1) / 2000.0D as nw", "(y2 - y1) / 1500.0D as nh")
    return D.retiled(n, F.lit(2000), F.lit(1500), 400, 100).select(*PAGE, "det_id", "tx", "ty", "split")


@query("held_out_excluded", "U10 S10", """with m as (select source, case when count(*) % 3 = 0 or source like '%7' then 'held-out' else 'in-sample' end as split from {documents} group by 1) select doc_id, case when starts_with(lang, 'e') then 'E' else lang end as family from {documents} where source not in (select source from m where split = 'held-out')""")
def _(t):
    m = t.documents.groupBy("source").agg(F.count("*").alias("n")).selectExpr("source", "case when n % 3 = 0 or source like '%7' then 'held-out' else 'in-sample' end as split")
    d = D.without_held_out(t.documents, m, "source")
    return d.select("doc_id", K.family(c("lang"), "e", "E").alias("family"))


ANNOT_VOCAB = ["FAN", "LOUVER", "AD-GRD", "FIRE SMOKE DAMPER", "ROOFTOP UNIT", "GAS UNIT HEATER", "FAN COIL UNIT"]


def annotated(t):
    return D.canonical_rows(t.raw_items, K.to_vocabulary(c("raw_cls"), ANNOT_VOCAB))


def _cls_sql():
    from markgrid.catalog.keys_text import sql_list, sql_normalise_class

    return f"(select case when k in {sql_list(ANNOT_VOCAB)} then k end from (select {sql_normalise_class('raw_cls')} as k) y)"


@query("canonical_annotations", "U11 D7", f"with r as (select doc_id, {_cls_sql()} as cls from {{raw_items}}) select doc_id, count(*) filter (where cls is not null) as kept, count(*) filter (where cls is null) as dropped, count(distinct cls) as n_classes from r group by 1")
def _(t):
    return annotated(t).groupBy("doc_id").agg(F.count("cls").alias("kept"), F.sum(c("cls").isNull().cast("bigint")).alias("dropped"), F.countDistinct("cls").alias("n_classes"))


@query("dropped_subjects", "U11", f"with r as (select raw_cls, {_cls_sql()} as cls from {{raw_items}}) select raw_cls, count(*) as n_dropped from r where cls is null group by 1")
def _(t):
    return D.drop_report(annotated(t), "raw_cls")


@query("stable_class_index", "U12", """with e as (select p_brand as cls, cast(row_number() over (order by min(p_partkey)) - 1 as bigint) as idx from {part} group by 1), n as (select distinct p_type as cls from {part} where p_type not in (select cls from e))
select cls, idx from e union all select cls, (select coalesce(max(idx), -1) from e) + row_number() over (order by cls) from n""")
def _(t):
    from pyspark.sql import Window

    # brands are numbered in the order of their first part; the types of all parts are the names to be added
    first = t.part.groupBy(c("p_brand").alias("cls")).agg(F.min("p_partkey").alias("m"))
    e = first.select("cls", (F.row_number().over(Window.orderBy("m")) - 1).cast("bigint").alias("idx"))
    names = t.part.select(F.explode(F.array("p_brand", "p_type")).alias("cls"))
    return D.stable_index(e, names, "cls")


@query("append_reviewed_truth", "U13", """with tr as (select doc_id, page_no, det_id, cls, case when page_no = 3 then 300 else 200 end as dpi from {revision}), k as (select distinct cls from {boxes})
select doc_id, page_no, det_id, cls, 'base' as src from {boxes} union all select doc_id, page_no, det_id, cls, 'truth' from tr where dpi = 200 and cls in (select cls from k)""")
def _(t):
    base = t.boxes.selectExpr(*PAGE, "det_id", "cls", "'base' as src")
    tr = t.revision.selectExpr(*PAGE, "det_id", "cls", "'truth' as src", "case when page_no = 3 then 300 else 200 end as dpi")
    return D.append_truth(base, tr, t.boxes.select("cls"), 200)[0]


@query("skipped_truth", "U13", """with tr as (select cls, case when page_no = 3 then 300 else 200 end as dpi from {revision}), k as (select distinct cls from {boxes}) select case when dpi <> 200 then 'dpi' else 'unknown_class' end as why, cls, count(*) as n from tr where dpi <> 200 or cls not in (select cls from k) group by 1, 2""")
def _(t):
    base = t.boxes.selectExpr(*PAGE, "det_id", "cls", "'base' as src")
    tr = t.revision.selectExpr(*PAGE, "det_id", "cls", "'truth' as src", "case when page_no = 3 then 300 else 200 end as dpi")
    return D.append_truth(base, tr, t.boxes.select("cls"), 200)[1]
