"""Layout, table and text-structure queries."""

from pyspark.sql import functions as F

from markgrid.catalog.keys_text import sql_list
from markgrid.catalog.registry import QUERIES, query
from markgrid.catalog.spatial_joins import BOX_XY, DIST, ON, TOK_XY
from markgrid.functions import vocab as V
from markgrid.operators import layout as L
from markgrid.operators import match as M

c = F.col
PAGE = ["doc_id", "page_no"]

SQL_ROWS = """it as (select *, sum(nw) over (partition by doc_id, page_no order by cy, item_id rows unbounded preceding) as row_no from (select *, (coalesce(cy - lag(cy) over (partition by doc_id, page_no order by cy, item_id) > 12, false))::int as nw from {items}) z)"""


@query("row_clusters", "W1", f"with {SQL_ROWS} select doc_id, page_no, item_id, cast(row_no as bigint) as row_no from it")
def _(t):
    return L.row_clusters(t.items, 12).select(*PAGE, "item_id", "row_no")


SQL_ANCHORS = """x as (select distinct doc_id, page_no, cast(cx as double) as cx from {items}), an(doc_id, page_no, anchor, col_no) as (select doc_id, page_no, min(cx), 0 from x group by 1, 2
 union all select x.doc_id, x.page_no, min(x.cx), an.col_no + 1 from an join x on x.doc_id = an.doc_id and x.page_no = an.page_no and x.cx > an.anchor + 50 group by x.doc_id, x.page_no, an.col_no)"""


@query("column_anchors", "W2", f"with recursive {SQL_ANCHORS} select doc_id, page_no, cast(col_no as bigint) as col_no, round(anchor, 6) as anchor from an")
def _(t):
    return L.column_anchors(t.items, 50).select(*PAGE, c("col_no").cast("bigint").alias("col_no"), F.round("anchor", 6).alias("anchor"))


@query("snapped_cells", "W3", f"""with recursive {SQL_ANCHORS}, {SQL_ROWS}, n as (select it.doc_id, it.page_no, it.row_no, it.item_id, it.text, arg_min(an.col_no, (abs(it.cx - an.anchor), an.col_no)) as col_no from it join an using (doc_id, page_no) where abs(it.cx - an.anchor) <= 80 group by 1, 2, 3, 4, 5)
select doc_id, page_no, cast(row_no as bigint) as row_no, cast(col_no as bigint) as col_no, string_agg(text, ' ' order by item_id) as text from n group by 1, 2, 3, 4""")
def _(t):
    d = L.snap(L.row_clusters(t.items.select(*PAGE, "item_id", "cx", "cy", "text"), 12), L.column_anchors(t.items, 50), 80)
    return d.select(*PAGE, "row_no", c("col_no").cast("bigint").alias("col_no"), "text")


@query("header_rows", "W4", f"""with {SQL_ROWS}, p as (select *, trim(upper(text), ' :,.-') as u from it),
s as (select doc_id, page_no, row_no, sum(case when u in {sql_list(V.READ_TAG_HEADERS)} then 3 when {' or '.join(f"contains(u, '{w}')" for w in V.READ_PROPERTY_HEADERS)} then 1 else 0 end) as score from p group by 1, 2, 3),
b as (select doc_id, page_no, arg_min(row_no, (-score, row_no)) as best from s where score > 0 group by 1, 2),
h as (select * from s where score >= 4 and not exists (select 1 from s a where a.doc_id = s.doc_id and a.page_no = s.page_no and a.score >= 4 and (a.row_no = s.row_no - 1 and a.score >= s.score or a.row_no = s.row_no + 1 and a.score > s.score)))
select doc_id, page_no, cast(row_no as bigint) as header_row, cast(score as bigint) as score, cast(best as bigint) as best from h join b using (doc_id, page_no)""")
def _(t):
    it = L.row_clusters(t.items, 12)
    return L.header_rows(it).join(L.best_header(it).withColumnRenamed("header_row", "best"), PAGE)


@query("read_tables", "W5", f"""with r as (select doc_id, item_id // 10 as row_no, max(case when item_id % 10 = 0 then upper(replace(text, ' ', '')) end) as tag,
 'CFM=' || max(case when item_id % 10 = 1 then text end) || ';MODEL=' || max(case when item_id % 10 = 2 then text end) || ';NECK SIZE=' || max(case when item_id % 10 = 3 then text end) as props from {{items}} where item_id >= 10 group by 1, 2)
select doc_id, 1 as page_no, row_no, tag, props from r where regexp_matches(tag, '{V.TAG_LIKE}')""")
def _(t):
    d = L.read_tables(L.row_clusters(t.items.select(*PAGE, "item_id", "cx", "cy", "text"), 12))
    props = F.array_join(F.transform("props", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    return d.select(*PAGE, "row_no", "tag", props.alias("props"))


@query("grid_schedules", "W6 S2 D3 D4", f"""with q as (select l_orderkey, raw_tag, service, model, cfm_text, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, line_no, conf_pct) as rn, count(*) over (partition by l_orderkey) as n from {{raw_items}}),
x as ({QUERIES['tag_cell_expansion'].sql})
select distinct l_orderkey as doc_id, case when l_orderkey % 2 = 0 then rn + 1 else rn end as row_no, case when l_orderkey % 2 = 0 then 'FAN SCHEDULE ' || (o_custkey % 9) else '' end as schedule_name, tag,
 'SERVICE=' || service || ';MODEL=' || model || ';CFM=' || cfm_text as props from q join {{orders}} on l_orderkey = o_orderkey join x on x.raw_tag = q.raw_tag where l_orderkey % 2 = 0 or n >= 2""")
def _(t):
    d = L.schedule_rows(t.cells, ["doc_id", "table_no"])
    props = F.array_join(F.transform("props", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    return d.select("doc_id", c("row_no").cast("bigint").alias("row_no"), "schedule_name", "tag", props.alias("props"))


@query("forward_fill", "W7 S4", """with p as (select p_type, p_partkey, case when p_name = lag(p_name) over (partition by p_type order by p_partkey) or p_size % 3 = 0 then null else p_name end as product from {part})
select p_type, p_partkey, last_value(product ignore nulls) over (partition by p_type order by p_partkey rows unbounded preceding) as product from p""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_type").orderBy("p_partkey")
    p = t.part.withColumn("product", F.when(~F.coalesce(c("p_name") == F.lag("p_name").over(w), F.lit(False)) & (c("p_size") % 3 != 0), c("p_name")))
    return L.carry_forward(p.select("p_type", "p_partkey", "product"), ["p_type"], "p_partkey", "product", block=256)


PHRASED = """select doc_id, page_no, word_id, x0, y0, x0 + 24 as x1, y0 + 10 as y1, case word_id % 11 when 0 then 'N.I.C.' when 3 then 'not' when 4 then '(IN' when 5 then 'contract)' when 6 then 'BY' when 7 then 'others.' when 8 then 'TYP.' when 9 then 'OF' when 10 then '(' || (word_id % 7) || ')' else text end as text from {words}"""


@query("phrase_windows", "W8", f"""with w0 as ({PHRASED}), w as (select *, replace(trim(upper(text), ' .,():;'), '.', '') as t from w0),
l as (select *, lead(t, 1) over g as t1, lead(t, 2) over g as t2, lead(x1, 1) over g as e1, lead(x1, 2) over g as e2, lead(x0, 1) over g as b1, lead(x0, 2) over g as b2, lead(y1, 1) over g as d1, lead(y1, 2) over g as d2, lead(y0, 1) over g as a1, lead(y0, 2) over g as a2 from w window g as (partition by doc_id, page_no order by word_id))
select doc_id, page_no, word_id, 'NIC' as phrase, x0 as bx0, y1 as by1 from l where t = 'NIC' union all select doc_id, page_no, word_id, 'NOT IN CONTRACT', least(x0, b1, b2), greatest(y1, d1, d2) from l where t = 'NOT' and t1 = 'IN' and t2 = 'CONTRACT'
union all select doc_id, page_no, word_id, 'BY OTHERS', least(x0, b1), greatest(y1, d1) from l where t = 'BY' and t1 = 'OTHERS'""")
def _(t):
    w = t.spark.sql(PHRASED, words=t.words)
    return L.phrases(w, V.NIC_PHRASES).select(*PAGE, "word_id", "phrase", "bx0", "by1")


@query("typical_counts", "W8", f"""with w as ({PHRASED}), l as (select *, concat_ws(' ', text, lead(text, 1) over g, lead(text, 2) over g, lead(text, 3) over g) as s, min(x0) over h as mx, max(x1) over h as ex from w
 window g as (partition by doc_id, page_no order by word_id), h as (partition by doc_id, page_no order by word_id rows between current row and 3 following)),
k as (select *, try_cast(nullif(regexp_extract(s, '{V.TYPICAL_OF}', 1), '') as int) as n from l where starts_with(upper(text), 'TYP')) select doc_id, page_no, word_id, n, (mx + ex) / 2e0 as cx from k where n >= 2""")
def _(t):
    return L.typical_counts(t.spark.sql(PHRASED, words=t.words)).select(*PAGE, "word_id", "n", "cx")


@query("latest_per_key", "W9 ST2", "select user_id, event_id, event_type from {events} qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    return L.latest(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], [c("ts"), c("event_id")]).select("user_id", "event_id", "event_type")


SQL_PAIR = f"""with {BOX_XY}, {TOK_XY}, j as (select b.doc_id, b.page_no, b.det_id, k.word_id, k.text, {DIST.format('b', 'k')} as dist from bx b join tk k on {ON.format('b', 'k')} where {DIST.format('b', 'k')} <= 120),
r as (select *, row_number() over (partition by doc_id, page_no, det_id order by dist, word_id) as rk, regexp_matches(text, '^P-?[0-9]+$') as is_tag, regexp_matches(text, '^[0-9]+("|x[0-9]+)$') as is_size from j),
p as (select a.doc_id, a.page_no, a.det_id, a.rk as tr, b.rk as sr, a.text as tag, b.text as size from r a join r b using (doc_id, page_no, det_id) where a.is_tag and b.is_size and b.rk between a.rk + 1 and a.rk + 3 and b.dist <= a.dist + 20)
select doc_id, page_no, det_id, arg_min(tag, (tr, sr)) as tag, arg_min(size, (tr, sr)) as size from p group by 1, 2, 3"""


@query("tag_then_size", "W10", SQL_PAIR)
def _(t):
    n = M.nearest_words(M.nearby_words(t.boxes, M.word_points(t.tokens), 120))
    n = n.withColumns({"tag": F.when(c("text").rlike("^P-?[0-9]+$"), c("text")), "size": F.when(c("text").rlike('^[0-9]+("|x[0-9]+)$'), c("text"))})
    return L.tag_then_size(n).select(*PAGE, "det_id", "tag", "size")


@query("note_dictionary", "W12 F23", """with n as (select doc_id, page_no, line_no, cast(regexp_extract(text, '^(\\d+)\\.', 1) as int) as number, regexp_extract(text, '^\\d+\\. (.*)$', 1) as note from {lines} where regexp_matches(text, '^\\d+\\. ')),
f as (select * from n qualify row_number() over (partition by doc_id, page_no, number order by line_no) = 1) select doc_id, number, page_no, note from f qualify row_number() over (partition by doc_id, number order by page_no desc) = 1""")
def _(t):
    from markgrid.functions.text import note_line

    n = t.lines.withColumn("n", note_line(c("text"))).where("n is not null").select("doc_id", "page_no", "line_no", "n.number", c("n.text").alias("note"))
    return L.first_then_last(n, ["doc_id"]).select("doc_id", "number", "page_no", "note")


SPANS = "select doc_id, page_no, word_id as span_id, text, x0 as x, y0 as y, cast(6 + ocr_pct % 9 as double) as size, 2000 as page_w, 1500 as page_h from {tokens}"


@query("title_pick", "W13", f"""with s0 as (select * from ({SPANS}) z where x >= 0.7e0 * page_w or y >= 0.75e0 * page_h), m as (select doc_id, page_no, size as ms from s0 qualify row_number() over (partition by doc_id, page_no order by size) = count(*) over (partition by doc_id, page_no) // 2 + 1),
k as (select s0.*, case when size < ms then size * 0.5e0 else size end + (case when starts_with(text, 'P') then 5e0 when text in ('TYP', 'NIC') then 3e0 else 0e0 end) as score from s0 join m using (doc_id, page_no))
select doc_id, page_no, arg_min(text, (-score, span_id)) as text, max(score) as score from k group by 1, 2""")
def _(t):
    bonus = F.when(c("text").startswith("P"), 5.0).when(c("text").isin("TYP", "NIC"), 3.0).otherwise(0.0)
    return L.title_pick(t.spark.sql(SPANS, tokens=t.tokens), bonus)


@query("sheet_index", "W14", """with l as (select * from {lines}), e as (select doc_id, page_no, line_no, case when regexp_matches(text, '^(M|E)[-\\s]?\\d{1,4}$') then 'column' else 'row' end as path, regexp_extract(text, '^([ME])', 1) as pre, regexp_extract(text, '^[ME][-\\s]?(\\d+)', 1) as num,
  case when regexp_matches(text, '^M-\\d+ ') then regexp_extract(text, '^M-\\d+ (.*)$', 1) else '' end as title from l where regexp_matches(text, '^(M|E)[-\\s]?\\d{1,4}( [A-Z].*)?$')),
u as (select doc_id, page_no, path, pre || '-' || num as sheet, pre, arg_min(title, line_no) as title from e group by 1, 2, 3, 4, 5), h as (select doc_id, page_no, bool_or(contains(text, 'SHEET INDEX')) as hd from l group by 1, 2),
n as (select u.doc_id, u.page_no, hd, count(*) filter (where path = 'row') as nr, count(*) filter (where path = 'column') as nc from u join h using (doc_id, page_no) group by 1, 2, 3),
b as (select *, case when hd and nr >= 3 then 'row' when nc >= 6 then 'column' when hd and nc >= 3 then 'column' end as path from n), p as (select doc_id, page_no, path from b where path is not null qualify row_number() over (partition by doc_id order by case path when 'row' then nr else nc end desc, page_no) = 1)
select u.doc_id, u.page_no, u.sheet, coalesce(nullif(u.title, ''), r.title, '') as title, case u.pre when 'M' then 'Mechanical' else 'Electrical' end as discipline from u join p using (doc_id, page_no, path) left join (select * from u where path = 'row') r on r.doc_id = u.doc_id and r.page_no = u.page_no and r.sheet = u.sheet""")
def _(t):
    return L.sheet_index(t.lines, ["doc_id"])


@query("text_around_anchor", "W15", """with a as (select doc_id, page_no, min(line_no) as pos from {lines} where starts_with(text, 'SHEET NO') group by 1, 2), k as (select a.doc_id, a.page_no, l.line_no, l.text from a join {lines} l on l.doc_id = a.doc_id and l.page_no = a.page_no and l.line_no between pos - 4 and pos + 4 where contains(l.text, 'PLAN') or contains(l.text, 'NOTES')),
f as (select doc_id, page_no, text, min(line_no) as ln from k group by 1, 2, 3), s as (select doc_id, page_no, string_agg(text, ' ' order by ln) as context from f group by 1, 2)
select a.doc_id, a.page_no, l.text as anchor, coalesce(context, '') as context from a join {lines} l on l.doc_id = a.doc_id and l.page_no = a.page_no and l.line_no = pos left join s on s.doc_id = a.doc_id and s.page_no = a.page_no""")
def _(t):
    return L.text_around(t.lines, c("text").startswith("SHEET NO"), c("text").contains("PLAN") | c("text").contains("NOTES"))


NOTES = "select doc_id, page_no, line_no as item_id, line_no * 14 as cy, case when line_no % 9 = 0 then text || chr(10) || (1 + line_no % 12) || '. RUN TOGETHER ' || line_no else text end as text from {lines}"


@query("notes_below_header", "W16", f"""with i as ({NOTES}), h as (select doc_id, page_no, min(item_id) as hid from i where contains(text, 'NOTE') group by 1, 2), b as (select i.* from i left join h using (doc_id, page_no) where hid is null or item_id >= hid),
k as (select doc_id, page_no, item_id, unnest(string_split(text, chr(10))) as ch, generate_subscripts(string_split(text, chr(10)), 1) as part from b), g as (select *, try_cast(regexp_extract(ch, '^(\\d{{1,3}})[.)]\\s', 1) as int) as number, regexp_extract(ch, '^\\d+[.)]\\s+(.*)$', 1) as note from k)
select doc_id, page_no, number, arg_min(note, (item_id, part)) as text from g where number between 1 and 100 and length(note) >= 5 group by 1, 2, 3""")
def _(t):
    return L.notes_below_header(t.spark.sql(NOTES, lines=t.lines))


RULES = [(r"SUPPLY\s+DIFFUSER", "AD-T-BAR SUPPLY"), (r"\bEF-", "EXHAUST FAN"), (r"\bCU", "CONDENSING UNIT")]


@query("legend_rows", "W17 F22", f"""with {SQL_ROWS}, r as (select doc_id, page_no, row_no, string_agg(text, ' ' order by cx, item_id) as label, min(y1) as ty1, max(y2) as ty2, arg_min(x1, (cx, item_id)) as tx1, arg_max(x2, (cx, item_id)) as tx2 from it group by 1, 2, 3),
s as (select *, greatest(0, tx1 - 200) as sx1, tx1 - 5 as sx2, greatest(0, ty1 - 15) as sy1, ty2 + 15 as sy2 from r where length(label) >= 3 and not (contains(upper(label), 'LEGEND') or contains(upper(label), 'SYMBOLS') or contains(upper(label), 'DESCRIPTION') or contains(upper(label), 'DRAWING')))
select doc_id, page_no, cast(row_no as bigint) as row_no, label, case when regexp_matches(upper(label), 'SUPPLY\\s+DIFFUSER') then 'AD-T-BAR SUPPLY' when regexp_matches(upper(label), '\\bEF-') then 'EXHAUST FAN' when regexp_matches(upper(label), '\\bCU') then 'CONDENSING UNIT' end as cls, tx1, tx2, sx1, sx2, sy1, sy2 from s where sx2 > sx1 + 10 and sy2 > sy1 + 10""")
def _(t):
    return L.legend_rows(L.row_clusters(t.items, 12), RULES).select(*PAGE, "row_no", "label", "cls", "tx1", "tx2", "sx1", "sx2", "sy1", "sy2")


@query("document_fields", "F37 F17", """with d as (select l.*, n.text as nt from {lines} l left join {lines} n on n.doc_id = l.doc_id and n.page_no = l.page_no and n.line_no = l.line_no + 1),
k as (select doc_id, page_no, line_no, 'project' as field, 1 as pass, regexp_extract(text, '^PROJECT: (.*)$', 1) as value from d where starts_with(text, 'PROJECT: ') union all select doc_id, page_no, line_no, 'engineer', 1, 'AB' from d where text = 'DRAWN BY: AB'
 union all select doc_id, page_no, line_no, 'sheet', 1, regexp_extract(text, '^SHEET NO: (.*)$', 1) from d where starts_with(text, 'SHEET NO: ') union all select doc_id, page_no, line_no, 'scale', 2, nt from d where text = 'SCALE:' and regexp_matches(nt, '(?i)[0-9/]["'']|NTS|N\\.T\\.S|AS\\s+NOTED|NONE'))
select doc_id, page_no, field, arg_min(value, (pass, line_no)) as value from k group by 1, 2, 3""")
def _(t):
    labels = {"project": "PROJECT", "engineer": "(?:DRAWN|CHECKED) BY", "sheet": "SHEET NO", "scale": "SCALE"}
    return L.field_cascade(t.lines, labels, PAGE)
