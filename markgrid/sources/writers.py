"""Writers: logs, label files, CSV reports, artefacts by document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def label_text(labels: DataFrame) -> DataFrame:
    """Label rows as lines: ``stem, value``."""
    return labels.select("stem", F.format_string("%d %.6f %.6f %.6f %.6f", "cid", "ncx", "ncy", "nw", "nh").alias("value"))


def lines_by_stem(lines: DataFrame, path: str) -> None:
    """Lines ``stem, value`` in one folder per image stem (``stem=<stem>``).

    They are dealt by stem first: one file an image, not one for every task that holds a line of it. A stem that is
    too large for one task is split over several files.
    """
    lines.hint("rebalance", "stem").write.mode("overwrite").partitionBy("stem").text(path)


def label_lines(labels: DataFrame, path: str) -> None:
    """Label lines in one folder per image stem."""
    lines_by_stem(label_text(labels), path)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Regression snapshot: parquet, partitioned by document when it has few."""
    df.write.mode("overwrite").parquet(path)


def artefacts(stages: dict[str, DataFrame], path: str, doc: str = "doc_id") -> DataFrame:
    """Every stage as parquet clustered by document, and a manifest of rows per document and stage."""
    counts = []
    for name, df in stages.items():
        target = f"{path}/{name}"
        df.repartition(doc).sortWithinPartitions(doc).write.mode("overwrite").parquet(target)
        back = df.sparkSession.read.schema(df.schema).parquet(target)
        counts.append(back.groupBy(doc).agg(F.count("*").alias("n_rows")).withColumn("stage", F.lit(name)))
    return reduce(DataFrame.unionByName, counts)
