"""Tables of the domain (boxes, words, schedules, ...) derived from the given parquet tables.

Each derivation is one SELECT over whole tables, shared by Spark and by the SQL oracle. ``//`` is
integer division, ``{name}`` another table, EACH4 one copy of the row for each of 0 to 3.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from markgrid.session import true_sizes

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DERIVED: dict[str, str] = {}

# detections: one box per lineitem; about 143 per page
DERIVED["boxes"] = """
select *, x1 + w as x2, y1 + h as y2 from (
 select l_orderkey // 250 as doc_id, cast(l_linenumber as bigint) as page_no,
  cast(row_number() over (partition by l_orderkey // 250, l_linenumber
    order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as det_id,
  l_returnflag || '-' || l_linestatus as cls,
  5 + (l_partkey * 7 + l_suppkey * 13) % 95 as conf_pct,
  ((l_partkey * 37) % 25) * 80 + (l_orderkey % 9) as x1,
  ((l_suppkey * 53) % 20) * 75 + (l_partkey % 7) as y1,
  40 + (l_partkey % 4) * 6 as w, 30 + (l_suppkey % 3) * 5 as h,
  l_orderkey, l_partkey, l_suppkey, cast(l_quantity as bigint) as qty,
  case when l_partkey % 9 = 0 then null when l_linenumber % 2 = 0 then 'P' || l_orderkey
    else 'P-' || l_orderkey end as tag
 from {lineitem}) q_
"""

# second version of the boxes: some moved a little, some relabelled, some moved off to nowhere
DERIVED["revision"] = """
select doc_id, page_no, det_id, conf_pct,
  case when det_id % 11 = 0 then 'X-X' else cls end as cls, tag, qty,
  x1 + (det_id % 4) * 12 + off as x1, y1 + (det_id % 3) * 6 + off as y1,
  x2 + (det_id % 4) * 12 + off as x2, y2 + (det_id % 3) * 6 + off as y2
from (select *, case when det_id % 7 = 0 then 5000 else 0 end as off from {boxes}) q_
"""

# wide thin boxes for run merging and rectangles
DERIVED["strips"] = """
select doc_id, page_no, det_id, cls, conf_pct, x1, y1,
  case when det_id % 2 = 0 then x1 + 70 else x1 + 20 end as x2,
  case when det_id % 2 = 0 then y1 + 20 else y1 + 70 end as y2
from (select doc_id, page_no, det_id, l_linestatus as cls, conf_pct,
   (x1 // 80) * 80 as x1, (y1 // 75) * 75 + (l_partkey % 3) as y1
 from (select *, right(cls, 1) as l_linestatus from {boxes}) q_) r_
"""

# schedule: one row per order; a tenth carries a tag that nobody observed
DERIVED["expected"] = """
select o_orderkey // 250 as doc_id, o_orderkey as row_no,
  case when o_orderkey % 10 = 3 then 'Q-' else 'P-' end || o_orderkey as tag,
  o_orderpriority as cls, 1 + o_custkey % 6 as exp_qty
from {orders}
"""

DERIVED["observed"] = """
select q_.doc_id, q_.page_no, q_.det_id, q_.tag, r_.o_orderpriority as cls, q_.conf_pct, q_.qty
from {boxes} q_ join {orders} r_ on q_.l_orderkey = r_.o_orderkey
"""

# text tokens placed on the same pages as the boxes
DERIVED["tokens"] = """
select l_orderkey // 250 as doc_id, cast(l_linenumber as bigint) as page_no,
  cast(row_number() over (partition by l_orderkey // 250, l_linenumber
    order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as word_id,
  ((l_partkey * 41) % 25) * 80 + (l_suppkey % 11) as x0,
  ((l_suppkey * 47) % 20) * 75 + (l_orderkey % 13) as y0,
  ((l_partkey * 41) % 25) * 80 + (l_suppkey % 11) + 24 as x1,
  ((l_suppkey * 47) % 20) * 75 + (l_orderkey % 13) + 10 as y1,
  50 + l_partkey % 50 as ocr_pct,
  case (l_suppkey + l_partkey) % 12
    when 0 then 'P-' || l_orderkey when 1 then 'P' || l_orderkey when 2 then 'P-' || l_orderkey || '-84'
    when 3 then (4 + l_partkey % 15) || '"' when 4 then (6 + l_partkey % 5) || 'x' || (4 + l_suppkey % 7)
    when 5 then cast(30 + l_partkey % 900 as string) when 6 then (4 + l_partkey % 9) || '/' || (20 + l_suppkey % 80)
    when 7 then 'TYP' when 8 then 'NIC' when 9 then 'EF' when 10 then 'C.R.D.'
    else cast(1 + l_partkey % 40 as string) end as text
from {lineitem}
"""

# running text: every token of every document in reading order, 12 per line, 107 lines per page
DERIVED["words"] = """
select doc_id, 1 + (pos // 12) // 107 as page_no, pos as word_id, (pos // 12) % 107 as line_no,
  pos % 12 as word_no, (pos % 12) * 100 as x0, ((pos // 12) % 107) * 14 as y0, text
from {tokens_raw}
"""

# take-off rows: what the team counted, and what we counted (own key for a fifth of the parts)
DERIVED["team"] = """
select p_brand as tag, cast(p_size as bigint) as neck, p_type as product,
  sum(cast(l_quantity as bigint)) as qty, count(*) as n_rows,
  max(p_partkey % 5) as cfm, max(p_partkey % 7) as module
from {lineitem} join {part} on l_partkey = p_partkey group by p_brand, p_size, p_type
"""
DERIVED["ours"] = """
select case when neck % 5 = 0 then tag || 'x' else tag end as tag, neck, product,
  qty + case when neck % 3 = 0 then 1 else 0 end as qty, cfm + neck % 2 as cfm, (module + neck % 2) % 7 as module
from {team}
"""

# raw class names, sizes, cells and properties as they come out of schedules
DERIVED["raw_items"] = """
select l_orderkey // 250 as doc_id, l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as line_no,
  5 + (l_partkey * 7 + l_suppkey * 13) % 95 as conf_pct,
  case l_partkey % 22 when 0 then 'FANS' when 1 then 'fan' when 2 then 'LOUVERS' when 3 then 'AD-LINEAR PLENUM 1" SLOT'
   when 4 then 'AD-LINEAR SLOT DIFFUSER 1.5" SLOT' when 5 then 'COMBINATION FIRE/SMOKE DAMPER' when 6 then 'ROOF CAP'
   when 7 then 'AD-GRD' when 8 then 'ELECTRIC UNIT HEATER' when 9 then 'VRF FAN COIL 2 TON' when 10 then 'VAV'
   when 11 then 'DEHUMIDIFIER' when 12 then 'MINI-SPLIT OUTDOOR UNIT' when 13 then 'MINI SPLIT CASSETTE'
   when 14 then 'SPLIT SYSTEM' when 15 then 'AD-T-BAR SUPPLY' when 16 then 'ROOFTOP UNIT RTU'
   when 17 then 'MOTORIZED  DAMPER' when 18 then 'DX COIL CONDENSER' when 19 then 'FIRE DAMPER' when 20 then 'AD-T-BAR RETURN'
   else 'SOMETHING NEW' end as raw_cls,
  case l_suppkey % 12 when 0 then (4 + l_partkey % 20) || '"' when 1 then (4 + l_partkey % 20) || '/' || (4 + l_suppkey % 9)
   when 2 then ' ' || (l_partkey % 30) || ' x ' || (6 + l_suppkey % 20) when 3 then (5 + l_partkey % 9) || 'X' || (l_suppkey % 40)
   when 4 then (6 + l_partkey % 8) || 'x8/' || (100 + l_partkey % 300) when 5 then (5 + l_partkey % 7) || '/' || (90 + l_partkey % 200)
   when 6 then (6 + l_partkey % 7) || '"x' || (6 + l_suppkey % 5) || '"' when 7 then cast(l_partkey % 99 as string)
   when 8 then (10 + l_partkey % 5) || '.50"' when 9 then 'abc' when 10 then '' else '10/10/8' end as raw_size,
  case l_partkey % 16 when 0 then 'CU-' || (1 + l_suppkey % 5) || ' thru CU-' || (4 + l_suppkey % 7)
   when 1 then 'A, B' when 2 then 'AC-' || (1 + l_suppkey % 9) || ',2,3' when 3 then (l_suppkey % 50) || ' VAV ' || (1 + l_partkey % 40)
   when 4 then '(E) EF-' || (l_suppkey % 60) when 5 then 'NOTES: ' || (l_suppkey % 5) when 6 then 'R-410A' when 7 then 'M' || (100 + l_suppkey % 800)
   when 8 then 'FP0' || (10 + l_suppkey % 80) when 9 then 'RKF12AXVJU' when 10 then 'VAV-N' when 11 then 'ef' || (l_suppkey % 9)
   when 12 then 'D / E' when 13 then 'USE-NT' when 14 then 'P501-P' || (500 + l_suppkey % 99) else 'ahu_' || (l_suppkey % 12) end as raw_tag,
  case l_suppkey % 10 when 0 then 'CEILING SUPPLY AIR' when 1 then 'LAY-IN RETURN' when 2 then 'EXHAUST FAN' when 3 then 'SURFACE ROUND'
   when 4 then 'LINEAR SLOT' when 5 then 'LOUVERED RETURN' when 6 then 'INTAKE LOUVER' when 7 then 'PERFORATED FACE' when 8 then 'TRANSFER FAN'
   else 'PUMP' end as service,
  case l_partkey % 4 when 0 then 'T-BAR' when 1 then 'EXPOSED' when 2 then '' else null end as mounting,
  case l_partkey % 5 when 0 then 'AIR DEVICE SCHEDULE' when 1 then 'PLUMBING FIXTURE SCHEDULE' when 2 then 'PLUMBING AND HVAC SCHEDULE'
   when 3 then 'LEGEND' else 'FAN SCHEDULE' end as schedule_name,
  case l_suppkey % 6 when 0 then 'AS22O' when 1 then '2-SLOT' when 2 then '1.5" SLOT' when 3 then 'TITUS OMNI' else 'none' end as model,
  case l_partkey % 9 when 0 then '1/4" = 1''-0"' when 1 then 'SCALE: 1/8" = 1''-0"' when 2 then 'SCALE 1:50' when 3 then 'NOT TO SCALE'
   when 4 then '3" = 10''-0"' else 'PLAN' end as scale_text,
  cast(20 + (l_partkey * 13) % 900 as string) || case when l_partkey % 2 = 0 then ' CFM' else '' end as cfm_text
from {lineitem}
"""

# schedule pages as positioned items: a header row, then one row per lineitem of the order
DERIVED["items"] = """
select doc_id, page_no, item_id, x as cx, y as cy, x - 30 as x1, y - 6 as y1, x + 30 as x2, y + 6 as y2, text from (
 select o_orderkey as doc_id, 1 as page_no, cast(k as bigint) as item_id, 100 + 200 * k + (o_orderkey % 5) as x, 100 + (k % 2) as y,
  case k when 0 then 'MARK' when 1 then 'CFM' when 2 then 'MODEL' else 'NECK SIZE' end as text
 from (select *, EACH4 as k from {orders}) q_
 union all
 select l_orderkey as doc_id, 1 as page_no, 10 * rn + k as item_id, 100 + 200 * k + (l_partkey % 40) as x, 100 + 30 * rn + (k + l_suppkey) % 4 as y,
  case k when 0 then case l_suppkey % 3 when 0 then 'EF-' when 1 then 'CU' else 'and ' end || (l_partkey % 200) when 1 then cast(30 + l_partkey % 900 as string)
   when 2 then 'M' || (l_suppkey % 70) else (4 + l_partkey % 9) || '"' end as text
 from (select *, EACH4 as k from (select *, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as bigint) as rn from {lineitem}) w_) q_) s_
"""

# schedule grids: title, header and rows; tables of odd orders lie on their side without title
DERIVED["cells"] = """
select doc_id, table_no, case when doc_id % 2 = 1 then c else r + 1 end as row_no, case when doc_id % 2 = 1 then r else c end as col_no, text from (
 select o_orderkey as doc_id, 0 as table_no, -1 as r, 0 as c, case when o_orderkey % 2 = 0 then 'FAN SCHEDULE ' || (o_custkey % 9) end as text from {orders}
 union all
 select o_orderkey, 0, 0, k, case k when 0 then 'MARK' when 1 then 'SERVICE' when 2 then 'MODEL' else 'CFM' end
 from (select *, EACH4 as k from {orders}) q_
 union all
 select l_orderkey, 0, rn, k, case k when 0 then raw_tag when 1 then service when 2 then model else cfm_text end
 from (select *, EACH4 as k from (select *, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, line_no, conf_pct) as int) as rn from {raw_items}) w_) q_) s_ where text is not null
"""

# text lines of small documents
DERIVED["lines"] = """
select l_orderkey // 40 as doc_id, cast(l_linenumber as bigint) as page_no,
  cast(row_number() over (partition by l_orderkey // 40, l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as line_no,
  case (l_partkey + l_suppkey) % 14 when 0 then 'M-' || (100 + l_suppkey % 90) || ' MECHANICAL PLAN' when 1 then 'M' || (100 + l_suppkey % 90)
   when 2 then 'E' || (l_partkey % 40) when 3 then case when l_partkey % 3 = 0 then 'SHEET INDEX' else 'GENERAL NOTES' end
   when 4 then (1 + l_suppkey % 30) || '. ACCESS PANEL ' || l_partkey when 5 then 'PROJECT: TOWER ' || l_partkey when 6 then 'SCALE:'
   when 7 then '1/4" = 1''-0"' when 8 then 'DRAWN BY: AB' when 9 then 'AND 2 PLACES' when 10 then 'SHEET NO: M' || (100 + l_suppkey % 90)
   when 11 then 'HVAC ROOF PLAN' when 12 then 'LEGEND' else 'SUPPLY  DIFFUSER ' || (l_partkey % 9) end as text
from {lineitem}
"""


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


class Tables:
    """Lazy access to base and derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._seen = spark, sf_dir.rstrip("/"), {}
        true_sizes(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._make(name)
        return self._seen[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "tokens_raw":
            return self.documents.selectExpr("doc_id", "posexplode(split(text, ' ')) as (pos, text)").selectExpr(
                "doc_id", "cast(pos as bigint) as pos", r"regexp_replace(text, '[^A-Za-z0-9]', '') as text")
        sql = DERIVED[name]
        sql = sql.replace("//", " div ").replace("EACH4", "explode(sequence(0, 3))")
        return self.spark.sql(sql, **{d: getattr(self, d) for d in references(sql)})


DUCK = {name: sql.replace("EACH4", "unnest([0, 1, 2, 3])") for name, sql in DERIVED.items()}
DUCK["tokens_raw"] = r"""
select doc_id, generate_subscripts(parts, 1) - 1 as pos,
  regexp_replace(unnest(parts), '[^A-Za-z0-9]', '', 'g') as text
from (select doc_id, string_split(text, ' ') as parts from documents) d
"""


def duck_sql(sql: str) -> str:
    """The oracle text with every derived table it uses in front as a CTE."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in references(text):
            if name not in BASE and name not in order:
                visit(DUCK[name])
                order.append(name)

    def plain(text: str) -> str:
        return re.sub(r"\{([a-z]\w*)\}", r"\1", text).strip()

    visit(sql)
    if not order:
        return plain(sql)
    head = ",\n".join(f"{n} as materialized (\n{plain(DUCK[n])}\n)" for n in order)
    body = plain(sql)
    if re.match(r"with recursive\b", body, re.I):
        return f"with recursive {head},\n{body[len('with recursive'):].strip()}"
    if re.match(r"with\b", body, re.I):
        return f"with {head},\n{body[4:].strip()}"
    return f"with {head}\n{body}"
