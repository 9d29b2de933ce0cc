"""Session helpers: building a session and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "markgrid", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # hash instead of sort-merge joins where every partition's build side is small at run time
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


#: what a file of keys and points holds in memory, as a multiple of its compressed size
UNPACKED = "32.0"


def true_sizes(spark: SparkSession) -> None:
    """Joins are planned by what files hold in memory, not by their compressed size, unless the session has its own factor.

    Keys and points compress so well that a file under the broadcast threshold may hold hundreds of megabytes. Sides that
    are small are still broadcast, by their size at run time.
    """
    if spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0":
        spark.conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names, else one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_cuts"


#: shuffle files go when the job that wrote them has ended, not when the driver happens to collect its garbage
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs started inside."""
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_tidily(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as parquet and drop the shuffle files of that job: nothing reads them once the rows are written."""
    with settings(df.sparkSession, {TIDY: "true"}):
        df.write.options(**options).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, survives lost executors, and carries its true size, so the
    optimizer can choose broadcast or shuffle joins on it by checked size. The disk of what led to it is free again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    write_tidily(df, path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    with settings(df.sparkSession, {TIDY: "true"}):
        return df.limit(1).count() == 0
