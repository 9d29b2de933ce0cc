"""What the operators share: reading, row-wise text functions, ranks without hot groups."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from markgrid.session import cut

#: bytes of an Arrow batch, the unit of memory of every Python function: both sides hold one whole; a longer text is alone
BATCH_BYTES = 2 << 20
#: rows that a Python function sees at once
SLICE = 1024


def bounded(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: tuple, make: Callable):
    """Build a value once in each Python worker and keep it for its later tasks."""
    store = sys.modules.setdefault("_markgrid_llm_store", types.ModuleType("_markgrid_llm_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def share(spark: SparkSession, value) -> Callable:
    """Broadcast a value of bounded size; the result, called in a task, gives it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def add_columns(df: DataFrame, text: str, make: Callable[[], Callable], fields: list[tuple[str, T.DataType]], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with columns computed from a text column, row by row, in Arrow batches.

    ``make()`` runs once a task and returns ``f(values) -> one list or array per field``. Rows are neither joined nor
    reordered, so repeated rows, null ids and any further columns pass through; a column of a computed name is replaced.
    """
    bounded(df.sparkSession)
    gone = {n for n, _ in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in gone]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])
    source = df if text not in gone else df.withColumn("_text_in", F.col(text))
    at = text if text not in gone else "_text_in"
    names, new = [f.name for f in kept], [(n, to_arrow_type(t)) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                cols = f(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(n) for n in names] + [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, new, strict=True)],
                    names=names + [n for n, _ in new],
                )

    return source.select(*dict.fromkeys([*names, at])).mapInArrow(run, schema)


def flat_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Any number of rows from each slice of rows: ``f(record batch) -> list of columns``."""
    bounded(df.sparkSession)
    out = T._parse_datatype_string(schema)
    names, kinds = [f.name for f in out.fields], [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                cols = f(whole.slice(i, SLICE))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return df.mapInArrow(run, out)


def rank_within(df: DataFrame, group: list[str], order: list[str], rows: int, per_part: int, name: str = "rank") -> DataFrame:
    """A gapless rank from 0 within ``group``, without sorting a group in one task.

    Rows are dealt over hash parts of about ``per_part`` rows of the whole input; a row's rank is its number in its part plus
    the sizes of the group's earlier parts. The order is a fixed shuffle by hash; equal rows get ranks in any order.
    """
    parts = max(1, -(-rows // per_part))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    return _numbered(df.columns, dealt, group, [F.xxhash64(*order, F.lit(1)), *map(F.col, order)], name)


def ordered_rank(df: DataFrame, group: list[str], order: list[str], rows: int, per_part: int, name: str = "rank") -> DataFrame:
    """A gapless rank from 0 within ``group`` by ``order``, without sorting a group in one task.

    Rows are dealt over ranges of ``order`` of about ``per_part`` rows and written, so that they keep their part.
    """
    dealt = cut(df.repartitionByRange(max(1, -(-rows // per_part)), *order).withColumn("_part", F.spark_partition_id()))
    return _numbered(df.columns, dealt, group, [F.col(c) for c in order], name)


def _numbered(columns: list[str], dealt: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """A row's rank: its number by ``order`` in its ``_part`` plus the sizes of the group's earlier parts."""
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n")).select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    on = F.col("l._part") == F.col("r._part")
    for c in group:
        on = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) & on
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .alias("l")
        .join(sizes.alias("r"), on)
        .select(*[F.col(f"l.{c}") for c in columns], (F.col("l._own") + F.col("r._before")).cast("long").alias(name))
    )
