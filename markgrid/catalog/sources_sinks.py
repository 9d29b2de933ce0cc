"""Source and sink queries: derived tables written out in each format and read back."""

import uuid

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.session import scratch_dir
from markgrid.sources import readers as R
from markgrid.sources import writers as W

c = F.col


def fresh(t, name):
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


BOXJ = "named_struct('cls', cls, 'conf', conf_pct / 100.0D, 'x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)"


def detection_files(t):
    """One JSON record per document; its shape depends on the document."""
    p = t.boxes.groupBy("doc_id", "page_no").agg(F.expr(f"transform(array_sort(collect_list(struct(det_id, {BOXJ} as b))), s -> s.b)").alias("bs"))
    g = p.groupBy("doc_id").agg(F.expr("map_from_entries(collect_list(struct(cast(page_no - 1 as string) as k, bs as v)))").alias("pages"))
    obj = F.to_json(F.struct(F.lit(300).alias("dpi"), "pages"))
    f = t.boxes.groupBy("doc_id").agg(F.expr("array_sort(collect_list(struct(page_no - 1 as page, det_id, cls as `class`, conf_pct / 100.0D as conf, x1, y1, x2, y2)))").alias("l"))
    j = g.join(f, "doc_id")
    shape = c("doc_id") % 3
    v = F.when(shape == 0, obj).when(shape == 1, F.to_json(F.struct(c("l").alias("detections")))).otherwise(F.to_json("l"))
    return j.select("doc_id", v.alias("value"))


@query("read_detections", "S1 D1", """select doc_id, page_no, cls, case doc_id % 3 when 0 then 300 else 200 end as dpi, count(*) as n, cast(sum(x1) as bigint) as sx1, cast(sum(y2) as bigint) as sy2, round(sum(conf_pct) / 100e0, 6) as sconf from {boxes} group by 1, 2, 3, 4""")
def _(t):
    path = fresh(t, "detections")
    detection_files(t).write.partitionBy("doc_id").text(path)
    d = R.detections(t.spark, path + "/doc_id=*").withColumn("doc_id", F.regexp_extract("file", r"doc_id=(\d+)", 1).cast("bigint"))
    g = d.groupBy("doc_id", c("page_no").cast("bigint").alias("page_no"), "cls", "dpi").agg(
        F.count("*").alias("n"), F.sum("x1").cast("bigint").alias("sx1"), F.sum("y2").cast("bigint").alias("sy2"), F.round(F.sum("conf"), 6).alias("sconf"))
    return g


@query("read_variables", "S2 D3", "select doc_id, tag, 'PRIO=' || cls || ';QTY=' || exp_qty as props, row_no from {expected}")
def _(t):
    path = fresh(t, "variables")
    v = F.struct("tag", F.lit("s").alias("schedule_name"), F.lit(1).alias("page"), F.create_map(F.lit("PRIO"), "cls", F.lit("QTY"), c("exp_qty").cast("string")).alias("properties"), c("row_no").cast("int").alias("source_row_index"))
    g = t.expected.groupBy("doc_id").agg(F.collect_list(v).alias("variables"))
    g.select("doc_id", F.when(c("doc_id") % 2 == 0, F.to_json("variables")).otherwise(F.to_json(F.struct("variables"))).alias("value")).write.partitionBy("doc_id").text(path)
    d = R.variables(t.spark, path + "/doc_id=*").withColumn("doc_id", F.regexp_extract("file", r"doc_id=(\d+)", 1).cast("bigint"))
    props = F.array_join(F.array_sort(F.transform("properties", lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return d.select("doc_id", "tag", props.alias("props"), c("row_no").cast("bigint").alias("row_no"))


@query("event_log_round_trip", "S3 D13", "select event_type as source, count(*) as n, count(*) filter (where event_id % 3 = 0) as n_correct from {events} group by 1")
def _(t):
    path = fresh(t, "events")
    e = t.events.selectExpr("(event_id % 101) / 100.0D as predicted_confidence", "event_id % 3 = 0 as was_correct", "event_type as source", "cast(user_id as string) as tag", "cast(event_id as string) as job_id")
    W.append_events(e, path)
    # broken lines, as interrupted writers leave them
    t.events.selectExpr("concat('{\"source\": \"', event_type) as value").write.mode("append").text(path)
    return R.event_log(t.spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum(c("was_correct").cast("bigint")).alias("n_correct"))


SHEET = """select l_orderkey as doc_id, rn + 3 as row_no, array(case when l_partkey % 3 = 0 then '' when l_partkey % 17 = 0 then 'GRAND TOTAL' else 'fan ' || (l_partkey % 40) end, case when l_suppkey % 5 = 0 then cast(l_quantity as int) || '.0' when l_suppkey % 7 = 0 then 'n/a' when l_suppkey % 11 = 0 then '0' else cast(cast(l_quantity as int) as string) end, 'T-' || (l_suppkey % 30)) as cells
 from (select *, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as bigint) as rn from {lineitem}) q_ union all
 select o_orderkey, 1, array('Take-off', null, null) from {orders} union all select o_orderkey, 3, array('Product', 'Count', 'Tag') from {orders}"""
SQL_SHEET = "(select *, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as rn from lineitem)"


@query("takeoff_sheet_reader", "S4 W7", f"""with r as (select l_orderkey as doc_id, rn + 3 as row_no, case when l_partkey % 3 = 0 then null when l_partkey % 17 = 0 then 'GRAND TOTAL' else 'FAN ' || (l_partkey % 40) end as prod, case when l_suppkey % 5 = 0 then cast(l_quantity as int) when l_suppkey % 7 = 0 then null when l_suppkey % 11 = 0 then 0 else cast(l_quantity as int) end as qty, 'T-' || (l_suppkey % 30) as tag from {SQL_SHEET} z),
f as (select doc_id, row_no, tag, qty, last_value(prod ignore nulls) over (partition by doc_id order by row_no rows unbounded preceding) as product from r where prod is null or prod <> 'GRAND TOTAL') select doc_id, row_no, product, tag, qty from f where product is not null and qty > 0""")
def _(t):
    return R.takeoff_sheet(t.spark.sql(SHEET, lineitem=t.lineitem, orders=t.orders), ["doc_id"])


TEAM = """select l_suppkey as doc_id, rn + 1 as row_no, array('ld-' || (l_partkey % 30) || case when l_partkey % 2 = 0 then '-PLENUM' else '' end, (4 + l_partkey % 6) || case when l_partkey % 2 = 0 then '"' else '' end, case l_orderkey % 4 when 0 then 'Grille' when 1 then 'FCU' when 2 then 'Diffuser Tot' else '' end, cast(cast(l_quantity as int) as string), case when l_orderkey % 5 = 0 then 'x' else cast(l_orderkey % 90 as string) end) as cells
 from (select *, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_extendedprice) as bigint) as rn from {lineitem}) q_ union all select s_suppkey, 1, array('Mark', 'Neck', 'Product', 'Qty', 'Airflow') from {supplier}"""


def sql_team(pivot):
    n = "sum(cast(l_quantity as int))" if pivot else "count(*)"
    extra = "and l_orderkey % 4 <> 2" if pivot else ""
    return f"""select l_suppkey as doc_id, 'LD-' || (l_partkey % 30) as tag, cast(4 + l_partkey % 6 as string) as neck, cast({n} as bigint) as qty, cast(sum(case when l_orderkey % 5 = 0 then 0 else l_orderkey % 90 end) as bigint) as total_cfm,
 count(*) filter (where l_orderkey % 5 <> 0) as cfm_hits from {{lineitem}} where l_orderkey % 4 <> 1 {extra} group by 1, 2, 3"""


@query("team_sheet_instances", "S5 A5", sql_team(False))
def _(t):
    return R.team_sheet(t.spark.sql(TEAM, lineitem=t.lineitem, supplier=t.supplier), ["doc_id"], False, R.grille_products())


@query("team_sheet_pivot", "S5 A5", sql_team(True))
def _(t):
    return R.team_sheet(t.spark.sql(TEAM, lineitem=t.lineitem, supplier=t.supplier), ["doc_id"], True, R.grille_products())


SECTION = """select l_suppkey as doc_id, rn as row_no, case when rn = 20 then 'GRILLES / REGISTERS' when rn > 40 and l_partkey % 13 = 0 then 'GRD TOTAL' else 'S' || l_partkey end as a, l_orderkey as b
 from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_extendedprice) as rn from {lineitem}) q_"""


@query("sheet_section", "S6", f"""with s as ({SECTION.replace(') q_', ') q')}), h as (select doc_id, min(row_no) filter (where contains(a, 'GRILLE')) as f from s group by 1), e as (select s.doc_id, min(row_no) as z from s join h using (doc_id) where a = 'GRD TOTAL' and row_no >= f + 2 group by 1)
select s.doc_id, row_no, a, b from s join h using (doc_id) left join e using (doc_id) where row_no >= f + 2 and (z is null or row_no < z)""")
def _(t):
    s = t.spark.sql(SECTION, lineitem=t.lineitem)
    return R.sheet_section(s, ["doc_id"], c("a").contains("GRILLE"), c("a").contains("GRD TOTAL")).withColumn("row_no", c("row_no").cast("bigint"))


@query("truth_annotations", "S7 D7", """select doc_id, l_orderkey, l_partkey, l_suppkey, line_no, raw_cls as subject, raw_tag as tag, cast(l_suppkey as string) as seq, round(least(l_partkey, l_suppkey) * (200e0 / 72e0), 6) as x1, round(greatest(l_partkey, l_suppkey) * (200e0 / 72e0), 6) as x2 from {raw_items} where l_orderkey % 5 <> 0 and raw_cls <> 'LOUVERS'""")
def _(t):
    a = t.raw_items.selectExpr("doc_id", "line_no as page_no", "struct(l_orderkey, l_partkey, l_suppkey, line_no) as ann_id", "case when l_orderkey % 5 = 0 then 'Line' else 'Polygon' end as type",
                               "case when raw_cls = 'LOUVERS' then 'Cloud' else raw_cls end as subject", "concat(raw_tag, '\\r', l_suppkey) as content", "l_partkey as ax", "l_suppkey as bx", "l_suppkey as ay", "l_partkey as by")
    d = R.truth_annotations(a, 200)
    return d.select("doc_id", "ann_id.*", "subject", "tag", "seq", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("reviewed_annotations", "S8 W9 D8", """with v as (select l_orderkey as task_id, l_linenumber as ver, l_linenumber = 4 as cancelled from {lineitem} group by 1, 2, 3), l as (select task_id, max(ver) as ver from v where not cancelled group by 1)
select l_orderkey as task_id, l_partkey % 50 as x, 'C' || (l_suppkey % 5) as cls, round((l_partkey % 50) / 100e0 * 1700, 6) as x1, round(((l_partkey % 50) + 10) / 100e0 * 1700, 6) as x2, count(*) as n from {lineitem} join l on task_id = l_orderkey and ver = l_linenumber where l_suppkey % 9 <> 0 group by 1, 2, 3, 4, 5""")
def _(t):
    res = t.lineitem.selectExpr("l_orderkey as task_id", "l_linenumber as ver", "named_struct('type', case when l_suppkey % 9 = 0 then 'choices' else 'rectanglelabels' end, 'x', cast(l_partkey % 50 as double), 'y', 1.0D, 'width', 10.0D, 'height', 5.0D, 'original_width', 1700, 'original_height', 2200, 'label', 'C' || (l_suppkey % 5)) as r")
    v = res.groupBy("task_id", "ver").agg(F.collect_list("r").alias("result"))
    tasks = v.groupBy("task_id").agg(F.collect_list(F.struct(F.concat(F.lit("2024-01-0"), "ver").alias("created_at"), (c("ver") == 4).alias("was_cancelled"), "result")).alias("annotations"))
    d = R.reviewed_annotations(tasks)
    return d.groupBy("task_id", F.round(c("x1") / 17).cast("bigint").alias("x"), "cls", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2")).agg(F.count("*").alias("n"))


@query("label_files", "S9 D16", "select 'd' || doc_id as stem, det_id % 6 as cid, count(*) as n, cast(sum(cast(round(x1 / 2200e0 * 1e6) as bigint)) as bigint) as sx from {boxes} group by 1, 2")
def _(t):
    path = fresh(t, "labels")
    n = t.boxes.selectExpr("'d' || doc_id as stem", "cast(det_id % 6 as int) as cid", "x1 / 2200.0D as ncx", "y1 / 1700.0D as ncy", "0.01D as nw", "0.02D as nh")
    # a broken line per image must not come back
    broken = t.boxes.selectExpr("'d' || doc_id as stem", "'6 0.5 oops' as value").distinct()
    W.lines_by_stem(W.label_text(n).unionByName(broken), path)
    d = R.label_files(t.spark, path)
    return d.groupBy("stem", c("cid").cast("bigint").alias("cid")).agg(F.count("*").alias("n"), F.sum(F.round(c("ncx") * 1e6).cast("bigint")).alias("sx"))


@query("benchmark_manifest", "S10 D19", "select source as name, case when count(*) > 20 then 'in-sample' else 'held-out' end as split from {documents} group by 1 having contains(source, '1')")
def _(t):
    path = fresh(t, "manifest")
    p = t.documents.groupBy("source").agg(F.count("*").alias("n")).selectExpr("named_struct('name', source, 'slug', source, 'split', case when n > 20 then 'in-sample' else 'held-out' end, 'pdf', 'x.pdf', 'truth', 'x.json') as p")
    p.agg(F.collect_list("p").alias("projects")).select(F.to_json(F.struct("projects")).alias("value")).write.text(path)
    return R.manifest(t.spark, path, "1").select("name", "split")


@query("page_truth", "S11 D19", "select source as pdf, cast(doc_id as int) as page_no, quality = 1 as is_plan from {documents} d left join {labels} l using (doc_id)")
def _(t):
    path = fresh(t, "truth")
    d = t.documents.join(t.labels.selectExpr("doc_id", "quality = 1 as q"), "doc_id", "left").groupBy("source").agg(F.expr("map_from_entries(collect_list(struct(cast(doc_id as string), q)))").alias("m"))
    # one record per file; nulls must survive
    d.select(F.to_json(F.create_map("source", "m"), {"ignoreNullFields": "false"}).alias("value")).repartition(8, "value").write.text(path)
    return R.page_truth(t.spark, path, lines=True)


@query("snapshot_round_trip", "S12 J13", "select doc_id, count(distinct tag) as n_tags from {expected} group by 1")
def _(t):
    path = fresh(t, "snapshot")
    W.snapshot(t.expected.select("doc_id", "tag"), path)
    return t.spark.read.parquet(path).groupBy("doc_id").agg(F.countDistinct("tag").alias("n_tags"))


@query("file_discovery", "S13", """with f as (select url as path, list_last(string_split(url, '/')) as name from {pages} where not contains(url, 'ref=x')) select name, arg_min(path, (case when contains(path, '/fr/') then 0 else 1 end, path)) as path from f group by 1""")
def _(t):
    f = t.pages.select(c("url").alias("path"), F.element_at(F.split("url", "/"), -1).alias("name"))
    return R.first_of_name(f, exclude="ref=x", prefer=["/fr/"])


@query("csv_sink", "S14", "select cls, cast(count(*) as string) as n, cast(min(conf_pct) as string) as lo from {boxes} group by 1")
def _(t):
    path = fresh(t, "csv")
    W.csv_report(t.boxes.groupBy("cls").agg(F.count("*").alias("n"), F.min("conf_pct").alias("lo")), path)
    return t.spark.read.option("header", True).csv(path)


@query("artefact_manifest", "S15", "select doc_id, 'boxes' as stage, count(*) as n_rows from {boxes} group by 1 union all select doc_id, 'expected', count(*) from {expected} group by 1")
def _(t):
    m = W.artefacts({"boxes": t.boxes.select("doc_id", "page_no", "det_id"), "expected": t.expected}, fresh(t, "artefacts"))
    return m.select("doc_id", "stage", "n_rows")
