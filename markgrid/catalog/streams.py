"""Streaming queries over the event log, drained over several files and batches."""

import uuid

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.session import scratch_dir
from markgrid.streaming import streams as ST

c = F.col


def arriving(t, df, order, run, batches=4):
    """The rows arrive in slices of ``order``; after each, ``run(stream, out, checkpoint)`` resumes the
    query from its checkpoint and takes what is new as one batch. Returns the output folder."""
    base = f"{scratch_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(c(order).cast("double")), F.max(c(order).cast("double"))).first()
    slice_no = F.least(F.floor((c(order).cast("double") - lo) * batches / max(hi - lo, 1.0)), F.lit(batches - 1))
    for i in range(batches):
        df.where(slice_no == i).write.mode("append").parquet(base + "/in")
        run(ST.source(t.spark, base + "/in", df.schema), base + "/out", base + "/ck")
    return base + "/out"


EV = "ev as (select event_type as source, (event_id * 37) % 101 as pp, ((event_id * event_id * 13 + event_id * 7) % 100 < (event_id * 37) % 101)::int as ok from {events})"


def reliability(t):
    e = t.events.selectExpr("event_id", "event_type as source", "(event_id * 37) % 101 as pp", "((event_id * event_id * 13 + event_id * 7) % 100) < ((event_id * 37) % 101) as ok")
    out = arriving(t, e, "event_id", lambda s, o, ck: ST.drain(ST.live_reliability(s, c("pp"), c("ok")), o, ck, "update"))
    return ST.read_latest(t.spark, out, ["source", "bucket"])


@query("stream_reliability", "ST1 A19", f"with {EV} select source, least(pp // 10, 9) as bucket, count(*) as n, cast(sum(pp) as bigint) as sum_pct, cast(sum(ok) as bigint) as n_correct, cast(sum((pp - 100 * ok) * (pp - 100 * ok)) as bigint) as sum_sq from ev group by 1, 2")
def _(t):
    return reliability(t)


@query("stream_brier", "ST1 A18", f"with {EV} select source, count(*) as n, round(sum((pp - 100 * ok) * (pp - 100 * ok)) / count(*)::double / 10000, 9) as brier from ev group by 1")
def _(t):
    return ST.brier_of(reliability(t)).withColumn("brier", F.round("brier", 9))


@query("stream_live_calibration", "ST1 A20", f"""with {EV.replace('(select ', '(select event_id, ', 1)}, se as (select ev.*, least(floor((event_id - lo) * 4e0 / greatest(hi - lo, 1)), 3)::int as sl from ev, (select min(event_id) as lo, max(event_id) as hi from {{events}}) z),
sm as (select v.sl, source, least(pp // 10, 9) as bucket, count(*) as n, sum(pp) / count(*)::double / 100 as x, sum(ok) / count(*)::double as y from se join (select unnest([1, 2, 3]) as sl) v on se.sl < v.sl group by 1, 2, 3),
cv as (select sl, source, list({{'x': x, 'y': y}} order by x) filter (where n >= 5) as cv from sm group by 1, 2 having sum(n) >= 30),
q as (select event_id, se.source, pp / 100e0 as p, cv, list_filter(cv, lambda a: a.x <= pp / 100e0) as lo, list_filter(cv, lambda a: a.x > pp / 100e0) as hi from se left join cv on cv.sl = se.sl and cv.source = se.source)
select event_id, source, round(case when cv is null then p when len(lo) = 0 then hi[1].y when len(hi) = 0 then lo[-1].y else lo[-1].y + (hi[1].y - lo[-1].y) * (p - lo[-1].x) / (hi[1].x - lo[-1].x) end, 6) as calibrated from q""")
def _(t):
    e = t.events.selectExpr("event_id", "event_type as source", "(event_id * 37) % 101 as pp", "((event_id * event_id * 13 + event_id * 7) % 100) < ((event_id * 37) % 101) as ok")
    out = arriving(t, e, "event_id", lambda s, o, ck: ST.refit_live(s, o, ck, c("pp"), c("ok"), ["event_id"]))
    return t.spark.read.parquet(out + "/scored").select("event_id", "source", F.round("calibrated", 6).alias("calibrated"))


@query("stream_latest_records", "ST2 W9 D15", "select user_id, event_id, event_type from {events} qualify row_number() over (partition by user_id order by event_id desc) = 1")
def _(t):
    out = arriving(t, t.events.select("event_id", "user_id", "event_type"), "event_id",
                   lambda s, o, ck: ST.drain(ST.latest_records(s, "user_id", "event_id", ["event_type"]), o, ck, "update"))
    return ST.read_latest(t.spark, out, ["user_id"])


@query("stream_class_totals", "ST2 U2", "with l as (select user_id, event_type from {events} qualify row_number() over (partition by user_id order by event_id desc) = 1) select event_type, count(*) as n from l group by 1")
def _(t):
    out = arriving(t, t.events.select("event_id", "user_id", "event_type"), "event_id",
                   lambda s, o, ck: ST.drain(ST.latest_records(s, "user_id", "event_id", ["event_type"]), o, ck, "update"))
    return ST.read_latest(t.spark, out, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_threshold_trigger", "ST3", "select 1000 as threshold, true as fired, count(*) >= 1000 as reached from {events}")
def _(t):
    out = arriving(t, t.events.select("event_id"), "event_id", lambda s, o, ck: ST.threshold_trigger(s, o, ck, 1000))
    return ST.first_trigger(t.spark, out).select("threshold", (c("fired_in") >= 0).alias("fired"), (c("n") >= 1000).alias("reached"))


JOBS = "select user_id as job_id, case max(event_id) % 4 when 0 then 'running' when 1 then 'queued' when 2 then 'done' else 'error' end as status, max(ts) as updated_at, case when max(event_id) % 8 = 3 then 'boom' end as error from {events} group by user_id"


@query("reap_stale_jobs", "ST4 D17", f"with j as ({JOBS}), n as (select max(updated_at) as now from j) select job_id, case when status in ('running', 'queued') and updated_at < now - interval 30 minute then 'error' else status end as status, case when status in ('running', 'queued') and updated_at < now - interval 30 minute then coalesce(error, 'interrupted') else error end as error from j, n")
def _(t):
    j = t.spark.sql(JOBS, events=t.events)
    now = j.agg(F.max("updated_at").cast("string")).first()[0]  # the clock of the log
    return ST.reap_stale(j, F.lit(now).cast("timestamp_ntz"), 30).select("job_id", "status", "error")


@query("stream_stale_jobs", "ST4", """with g as (select user_id as job_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute, true)::int as nw from {events}), s as (select job_id, ts, sum(nw) over (partition by job_id order by ts rows unbounded preceding) as k from g),
w as (select job_id, k, max(ts) as last_event, count(*) as n_events from s group by 1, 2) select job_id, last_event, n_events from w where last_event + interval 30 minute <= (select date_trunc('millisecond', max(ts)) - interval 1 minute from {events})""")
def _(t):
    e = t.events.select(c("user_id").alias("job_id"), c("ts").cast("timestamp").alias("ts"))
    out = arriving(t, e, "ts", lambda s, o, ck: ST.drain(ST.stale_jobs(s, 30), o, ck, "append"))
    return t.spark.read.parquet(out).select("job_id", c("last_event").cast("timestamp_ntz").alias("last_event"), "n_events")
