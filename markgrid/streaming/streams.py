"""Structured Streaming forms of the append-only logs and pollers.

Sinks write through ``foreachBatch`` keyed by batch id, so a batch replayed after a lost executor or
driver overwrites its own output and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.operators.evaluate import calibrate
from markgrid.operators.reconcile import last_wins

c = F.col


def source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def _by_batch(path: str):
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Run a stream over what is there now, one output folder per batch."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(_by_batch(out)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def live_reliability(events: DataFrame, p_pct: Column, correct: Column) -> DataFrame:
    """Running counts and sums per source and bucket; whole numbers, so any order of arrival agrees.

    State: at most ten rows per source.
    """
    b = F.least(F.floor(p_pct / 10), F.lit(9))
    y = correct.cast("bigint")
    gap = p_pct - 100 * y
    return events.groupBy("source", b.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(p_pct).alias("sum_pct"), F.sum(y).alias("n_correct"), F.sum(gap * gap).alias("sum_sq"))


def refit_live(events: DataFrame, out: str, checkpoint: str, p_pct: Column, correct: Column, keep: list[str]) -> None:
    """Rows calibrated as they arrive, by curves refitted after every batch.

    Batch k is calibrated by the curves of version k - 1, those that stood when its rows came, so no row is judged by
    its own outcome; then its counts are added and version k is written. ``out`` holds ``scored/batch=k`` (``keep``,
    source, calibrated) and ``sums/version=k`` (at most ten rows a source). A batch reads only its own rows and the
    version before, and overwrites its own folders, so one replayed after a loss leaves the same files.
    """
    def step(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        new = live_reliability(df, p_pct, correct)
        names = new.columns
        before = spark.read.schema(new.schema).parquet(f"{out}/sums/version={k - 1}") if k else new.limit(0)
        calibrate(df, curves_of(before), "source", p_pct / 100).select(*keep, "source", "calibrated").write.mode("overwrite").parquet(f"{out}/scored/batch={k}")
        both = before.unionByName(new).groupBy("source", "bucket").agg(*[F.sum(n).alias(n) for n in names[2:]])
        both.coalesce(1).write.mode("overwrite").parquet(f"{out}/sums/version={k}")

    q = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def curves_of(sums: DataFrame, least_events: int = 30, least_bucket: int = 5) -> DataFrame:
    """Curves (source, curve) from running sums, by the rule of ``evaluate.calibration_curves``."""
    pt = F.struct((c("sum_pct") / c("n") / 100).alias("x"), (c("n_correct") / c("n")).alias("y"))
    g = sums.groupBy("source").agg(F.sum("n").alias("_all"), F.array_sort(F.collect_list(F.when(c("n") >= least_bucket, pt))).alias("curve"))
    return g.where((c("_all") >= least_events) & (F.size("curve") > 0)).select("source", "curve")


def brier_of(reliability: DataFrame) -> DataFrame:
    return reliability.groupBy("source").agg(F.sum("n").alias("n"), (F.sum("sum_sq") / F.sum("n") / 10000).alias("brier"))


def latest_records(queue: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Latest record per key (update mode). State holds one row per key; a resubmission replaces it,
    which first-wins deduplication within a watermark would not do."""
    return queue.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("_r")).select(key, "_r.*")


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Result of an update-mode stream: of each key the row of its last batch."""
    return last_wins(spark.read.parquet(path), keys, "batch").drop("batch")


def threshold_trigger(items: DataFrame, out: str, checkpoint: str, need: int) -> None:
    """Write one trigger row in the first batch after which at least ``need`` items have arrived."""
    total = items.groupBy().agg(F.count("*").alias("n"))

    def fire(df: DataFrame, batch_id: int) -> None:
        hit = df.where(c("n") >= need).select(F.lit(need).alias("threshold"), "n", F.lit(batch_id).cast("bigint").alias("fired_in"))
        hit.write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    q = (total.writeStream.outputMode("complete").foreachBatch(fire).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def first_trigger(spark: SparkSession, out: str) -> DataFrame:
    t = spark.read.schema("threshold int, n bigint, fired_in bigint").parquet(out)
    return t.groupBy("threshold").agg(F.min("fired_in").alias("fired_in"), F.min("n").alias("n"))


def reap_stale(jobs: DataFrame, now: Column, limit_minutes: int | None = None) -> DataFrame:
    """Jobs still running or queued become errors; with a limit only those without progress that long."""
    stale = c("status").isin("running", "queued")
    if limit_minutes is not None:
        stale = stale & (c("updated_at") < now - F.make_interval(mins=F.lit(limit_minutes)))
    return jobs.withColumns({
        "error": F.when(stale, F.coalesce("error", F.lit("interrupted"))).otherwise(c("error")),
        "status": F.when(stale, "error").otherwise(c("status"))})


def stale_jobs(events: DataFrame, minutes: int, delay: str = "1 minute") -> DataFrame:
    """Streaming extension: a row for each silence of a job longer than ``minutes``, once the watermark
    is past it: the last event before the silence and the number of events since the one before.

    ``events``: job_id, ts. A session window is exactly this state, kept and expired by Spark.
    """
    w = F.session_window("ts", f"{minutes} minutes")
    g = events.withWatermark("ts", delay).groupBy("job_id", w.alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))
    return g.select("job_id", "last_event", "n_events")
