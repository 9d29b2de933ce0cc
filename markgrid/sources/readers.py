"""Readers: files and sheets into the fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.functions import vocab as V
from markgrid.functions.common import first_match, has_any
from markgrid.functions.keys import base_tag
from markgrid.functions.text import comparable_size
from markgrid.operators.layout import carry_forward, latest

c = F.col

BOX = ("struct<cls:string,class:string,conf:double,tag:string,tag_method:string,tag_confidence:double,"
       "x1:double,y1:double,x2:double,y2:double>")
DETECTION_FILE = f"struct<pdf:string,dpi:int,pages:map<string,array<{BOX}>>,detections:array<struct<page:int,{BOX[7:]}>>"


def detections(spark: SparkSession, path: str, page_base: int = 0, dpi: int = 200) -> DataFrame:
    """Detection files, one document each, in any of three shapes: a map of pages, a list under
    ``detections``, or a bare list. Pages become 1-based; a resolution in the file wins over ``dpi``.
    """
    files = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("file"), "value")
    flat = f"array<struct<page:int,{BOX[7:]}>"
    d = files.withColumn("o", F.when(F.ltrim("value").startswith("{"), F.from_json("value", DETECTION_FILE))).withColumn(
        "l", F.when(F.ltrim("value").startswith("["), F.from_json("value", flat)))
    by_page = d.where("o.pages is not null").select("file", c("o.dpi").alias("dpi"), F.explode("o.pages").alias("p", "boxes"))
    by_page = by_page.select("file", "dpi", c("p").try_cast("int").alias("page"), F.posexplode("boxes").alias("i", "b"))
    listed = d.select("file", c("o.dpi").alias("dpi"), F.posexplode(F.coalesce("l", "o.detections")).alias("i", "b")).select(
        "file", "dpi", c("b.page").alias("page"), "i", "b")
    fields = ["conf", "tag", "tag_method", "tag_confidence", "x1", "y1", "x2", "y2"]
    shape = lambda x: x.select(
        "file", F.coalesce("dpi", F.lit(dpi)).alias("dpi"), (c("page") + 1 - page_base).alias("page_no"), c("i").cast("bigint").alias("det_id"),
        F.coalesce("b.cls", "b.class").alias("cls"), *[c("b." + f) for f in fields])
    return shape(by_page).unionByName(shape(listed))


VARIABLE = "struct<tag:string,schedule_name:string,page:int,properties:map<string,string>,inferred_yolo_class:string,source_row_index:int>"


def variables(spark: SparkSession, path: str) -> DataFrame:
    """Schedule rows: a list, or an object that wraps one under ``variables``."""
    f = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("file"), "value")
    v = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{VARIABLE}>")),
                   F.from_json("value", f"struct<variables:array<{VARIABLE}>>")["variables"])
    e = f.select("file", F.explode(v).alias("v"))
    return e.select("file", "v.tag", "v.schedule_name", c("v.page").alias("page_no"), F.map_entries("v.properties").alias("properties"),
                    c("v.inferred_yolo_class").alias("cls"), c("v.source_row_index").alias("row_no"))


CALIBRATION_EVENT = T.StructType([
    T.StructField("predicted_confidence", T.DoubleType()), T.StructField("was_correct", T.BooleanType()), T.StructField("source", T.StringType()),
    T.StructField("tag", T.StringType()), T.StructField("job_id", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def event_log(spark: SparkSession, path: str, schema: T.StructType = CALIBRATION_EVENT) -> DataFrame:
    """Append-only JSON lines; malformed lines are skipped."""
    bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    d = spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return d.where("_corrupt is null").drop("_corrupt")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Label lines ``cid cx cy w h``, one file (``<stem>.txt``) or folder (``stem=<stem>``) per image;
    lines that do not parse are skipped."""
    stem = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", "stem=([^/]+)/", 1), F.lit("")), F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1))
    d = spark.read.option("recursiveFileLookup", True).text(path).select(stem.alias("stem"), F.split(F.trim("value"), r"\s+").alias("p"))
    num = lambda i: F.get("p", F.lit(i)).try_cast("double")
    d = d.select("stem", F.get("p", F.lit(0)).try_cast("int").alias("cid"), *[num(i).alias(n) for i, n in enumerate(["ncx", "ncy", "nw", "nh"], 1)], F.size("p").alias("n"))
    return d.where("n = 5 and cid is not null and ncx is not null and ncy is not null and nw is not null and nh is not null").drop("n")


def manifest(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """Projects of a benchmark manifest, optionally those whose name holds a text."""
    p = "struct<name:string,slug:string,split:string,pdf:string,truth:string>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<projects:array<{p}>>")["projects"]).alias("p")).select("p.*")
    return d.where(F.lower("name").contains(contains.lower())) if contains else d


def page_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Three-valued page truth: file -> page -> true, false or null (unknown), nulls kept; an object a file, or a line."""
    d = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,map<string,boolean>>").alias("m"))
    return d.select(F.explode("m").alias("pdf", "pages")).select("pdf", F.explode("pages").alias("page", "is_plan")).select("pdf", c("page").cast("int").alias("page_no"), "is_plan")


def first_of_name(files: DataFrame, include: str | None = None, exclude: str | None = None, prefer: list[str] | None = None) -> DataFrame:
    """One path per file name, tokens included and excluded; preferred folder words first, then path order."""
    if include:
        files = files.where(c("path").rlike(include))
    if exclude:
        files = files.where(~c("path").rlike(exclude))
    rank = first_match([(c("path").contains(w), F.lit(i)) for i, w in enumerate(prefer or [])], F.lit(len(prefer or [])))
    return files.groupBy("name").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def takeoff_sheet(rows: DataFrame, keys: list[str], first: int | None = None) -> DataFrame:
    """Quantity rows of a sheet given as keys, row_no, cells (array of strings).

    The header is the first row (of the first ``first``, if given) with PRODUCT and QTY or COUNT; a blank product repeats
    the one above; TOTAL rows and quantities of 0 or less are left out.
    """
    up = F.transform("cells", lambda x: F.upper(F.trim(F.coalesce(x, F.lit("")))))
    d = rows.withColumn("u", up)
    is_head = (F.lit(True) if first is None else c("row_no") <= first) & F.array_contains("u", "PRODUCT") & (F.array_contains("u", "QTY") | F.array_contains("u", "COUNT"))
    head = d.where(is_head).groupBy(*keys).agg(F.min_by(F.struct("row_no", "u"), "row_no").alias("_h"))
    at = lambda n: F.nullif(F.array_position("_h.u", n), F.lit(0))
    head = head.select(*keys, c("_h.row_no").alias("_head"), at("PRODUCT").alias("_p"), F.coalesce(at("QTY"), at("COUNT")).alias("_q"), at("TAG").alias("_t"))
    cell = lambda i: F.when(c(i).isNotNull(), F.get("u", (c(i) - 1).cast("int")))
    b = d.join(head, keys).where(c("row_no") > c("_head")).select(*keys, "row_no", F.nullif(cell("_p"), F.lit("")).alias("_prod"), cell("_q").alias("_qty"), cell("_t").alias("tag"))
    b = b.where(~F.coalesce(c("_prod").contains("TOTAL"), F.lit(False)))
    b = carry_forward(b, keys, "row_no", "_prod", "product")
    qty = F.coalesce(c("_qty").try_cast("int"), F.floor(c("_qty").try_cast("double")).cast("int"))
    return b.withColumn("qty", qty).where("product is not null and qty > 0").select(*keys, "row_no", "product", "tag", "qty")


TEAM_HEADERS = {
    "tag": ["TAG", "MARK", "UNIT TAG", "SYMBOL"], "neck": ["NECK SIZE", "NECK", "SIZE"], "module": ["MODULE SIZE", "MODULE", "FACE SIZE"],
    "cfm": ["CFM", "AIR FLOW", "AIRFLOW"], "product": ["PRODUCT"], "qty": ["QTY", "COUNT"],
}


def team_sheet(rows: DataFrame, keys: list[str], pivot: bool, products: list[str] | None = None) -> DataFrame:
    """Team rows by (tag, neck), below the first row that names a tag column. Raw sheets hold one row per instance (quantity = rows); pivot sheets
    carry a quantity and TOTAL rows, which are left out. ``products`` keeps rows naming one of them."""
    up = F.transform("cells", lambda x: F.upper(F.trim(F.coalesce(x, F.lit("")))))
    d = rows.withColumn("u", up)
    named = d.where(F.arrays_overlap("u", F.array(*[F.lit(n) for n in TEAM_HEADERS["tag"]])))
    head = named.groupBy(*keys).agg(F.min("row_no").alias("_head"), F.min_by("u", "row_no").alias("_h"))
    col = lambda names: F.coalesce(*[F.nullif(F.array_position("_h", n), F.lit(0)) for n in names])
    head = head.select(*keys, "_head", *[col(ns).alias("_" + f) for f, ns in TEAM_HEADERS.items()])
    cell = lambda f: F.when(c("_" + f).isNotNull(), F.get("u", (c("_" + f) - 1).cast("int")))
    b = d.join(head, keys).where(c("row_no") > c("_head")).select(*keys, "row_no", base_tag(cell("tag")).alias("tag"), comparable_size(cell("neck")).alias("neck"),
                                                      F.coalesce(cell("product"), F.lit("")).alias("product"), cell("qty").try_cast("int").alias("qty"), cell("cfm").try_cast("int").alias("cfm"))
    b = b.where("tag <> ''")
    if products:
        b = b.where((c("product") == "") | has_any(c("product"), products))
    if pivot:
        b = b.where(~c("product").rlike("(TOT|TOTAL)$"))
    n = F.sum(F.coalesce("qty", F.lit(0))) if pivot else F.count("*")
    return b.groupBy(*keys, "tag", "neck").agg(n.cast("bigint").alias("qty"), F.sum(F.coalesce("cfm", F.lit(0))).cast("bigint").alias("total_cfm"), F.count("cfm").alias("cfm_hits"))


def sheet_section(rows: DataFrame, keys: list[str], header: Column, sentinel: Column, skip: int = 2) -> DataFrame:
    """Rows of one section: after its first header row (and sub-headers) up to the first sentinel."""
    b = rows.groupBy(*keys).agg(F.min(F.when(header, c("row_no"))).alias("_from")).where("_from is not null")
    d = rows.join(b, keys).where(c("row_no") >= c("_from") + skip)
    e = d.groupBy(*keys).agg(F.min(F.when(sentinel, c("row_no"))).alias("_to"))
    return d.join(e, keys).where(c("_to").isNull() | (c("row_no") < c("_to"))).drop("_from", "_to")


NOT_EQUIPMENT = ["AREA MEASUREMENT", "CLOUD", "LENGTH MEASUREMENT", "TEXT BOX"]


def truth_annotations(annotations: DataFrame, dpi: float) -> DataFrame:
    """Polygon annotations as truth boxes in pixels: tag and sequence split, corners ordered."""
    a = annotations.where((c("type") == "Polygon") & ~F.upper("subject").isin(NOT_EQUIPMENT))
    k = dpi / 72.0
    parts = F.split(F.coalesce("content", F.lit("")), "\r")
    return a.select("doc_id", "page_no", "ann_id", "subject", parts[0].alias("tag"), F.get(parts, F.lit(1)).alias("seq"),
                    (F.least("ax", "bx") * k).alias("x1"), (F.least("ay", "by") * k).alias("y1"),
                    (F.greatest("ax", "bx") * k).alias("x2"), (F.greatest("ay", "by") * k).alias("y2"))


def reviewed_annotations(tasks: DataFrame) -> DataFrame:
    """Latest version of each task that was not cancelled; its rectangles from percent to pixels.

    ``tasks``: task_id, annotations (created_at, was_cancelled, result (type, x, y, width, height,
    original_width, original_height, label)).
    """
    v = tasks.select("task_id", F.posexplode("annotations").alias("i", "a")).select("task_id", "i", "a.created_at", "a.was_cancelled", "a.result").where("not coalesce(was_cancelled, false)")
    v = latest(v, ["task_id"], [c("created_at"), c("i")])
    r = v.select("task_id", F.posexplode("result").alias("box_id", "r")).where("r.type = 'rectanglelabels'")
    px = lambda a, b, w: (c("r." + a) + (c("r." + b) if b else 0)) / 100.0 * c("r." + w)
    return r.select("task_id", "box_id", c("r.label").alias("cls"), px("x", None, "original_width").alias("x1"), px("y", None, "original_height").alias("y1"),
                    px("x", "width", "original_width").alias("x2"), px("y", "height", "original_height").alias("y2"))


def grille_products() -> list[str]:
    return [w for w in V.AIR_DEVICE_SCHEDULE_WORDS if " " not in w] + ["LOUVER", "LINEAR"]
