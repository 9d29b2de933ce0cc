"""Evaluation and calibration queries."""

from pyspark.sql import functions as F

from markgrid.catalog.registry import query
from markgrid.catalog.spatial_joins import ON, rev_edges, serial_pairs
from markgrid.operators import evaluate as E
from markgrid.operators import match as M

c = F.col
PAGE = ["doc_id", "page_no"]

SQL_OUT = f"""{serial_pairs(rev_edges('0.3e0'), '-iou')}, mt as (select p.doc_id, p.page_no, p.l, p.r, e.l_cls, e.r_cls from picks p join ed e on {ON.format('p', 'e')} and p.l = e.l and p.r = e.r),
oc as (select t.cls as truth_cls, m.r_cls as pred_cls from {{boxes}} t left join mt m on {ON.format('m', 't')} and m.l = t.det_id union all
 select null, n.cls from {{revision}} n where not exists (select 1 from mt m where {ON.format('m', 'n')} and m.r = n.det_id)),
pc as (select cls, cast(sum(t) as bigint) as n_true, cast(sum(p) as bigint) as n_pred, cast(sum(h) as bigint) as tp from (select truth_cls as cls, 1 as t, 0 as p, coalesce((truth_cls = pred_cls)::int, 0) as h from oc where truth_cls is not null
  union all select pred_cls, 0, 1, 0 from oc where pred_cls is not null) z group by 1)"""
PRF = "round(coalesce(tp / nullif(n_pred, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(n_true, 0)::double, 0), 6) as recall, round(case when tp > 0 then 2 * (tp / n_pred::double) * (tp / n_true::double) / (tp / n_pred::double + tp / n_true::double) else 0 end, 6) as f1"


def outcomes(t):
    m = M.match_in_order(t.boxes, t.revision, 0.3)
    return M.outcomes(t.boxes, t.revision, m)


def rounded(d, *cols):
    return d.withColumns({x: F.round(x, 6) for x in cols})


@query("per_class_scores", "A9", f"with recursive {SQL_OUT} select cls, n_true, n_pred, tp, n_pred - tp as fp, n_true - tp as fn, {PRF} from pc")
def _(t):
    return rounded(E.per_class(outcomes(t)), "precision", "recall", "f1")


@query("micro_scores", "A9", f"with recursive {SQL_OUT}, s as (select cast(sum(tp) as bigint) as tp, cast(sum(n_pred) as bigint) as n_pred, cast(sum(n_true) as bigint) as n_true from pc) select tp, n_pred, n_true, {PRF} from s")
def _(t):
    return rounded(E.micro(E.per_class(outcomes(t))), "precision", "recall", "f1")


SQL_CM = "cm as (select coalesce(truth_cls, '(none)') as truth_cls, coalesce(pred_cls, '(none)') as pred_cls, count(*) as n from oc group by 1, 2)"


@query("confusion_matrix", "A10", f"with recursive {SQL_OUT}, {SQL_CM} select * from cm")
def _(t):
    return E.confusion(outcomes(t))


@query("top_confusions", "A10 O1", f"with recursive {SQL_OUT}, {SQL_CM} select * from cm where truth_cls <> pred_cls order by n desc, truth_cls, pred_cls limit 8")
def _(t):
    return E.top_confusions(E.confusion(outcomes(t)), 8)


@query("confused_pairs", "A10", f"with recursive {SQL_OUT}, {SQL_CM} select least(truth_cls, pred_cls) as a, greatest(truth_cls, pred_cls) as b, cast(sum(n) as bigint) as n from cm where truth_cls <> pred_cls group by 1, 2")
def _(t):
    return E.confused_pairs(E.confusion(outcomes(t)))


SQL_TU = "a as (select product, tag, neck, sum(qty) as t from {team} group by 1, 2, 3), b as (select product, tag, neck, sum(qty) as p from {ours} group by 1, 2, 3)"


@query("count_overlap_scores", "A11", f"""with {SQL_TU}, j as (select coalesce(a.product, b.product) as product, coalesce(t, 0) as t, coalesce(p, 0) as p from a full join b on a.product = b.product and a.tag = b.tag and a.neck = b.neck),
s as (select product, cast(sum(t) as bigint) as n_true, cast(sum(p) as bigint) as n_pred, cast(sum(least(t, p)) as bigint) as tp, cast(sum(greatest(0, p - t)) as bigint) as over, cast(sum(greatest(0, t - p)) as bigint) as under from j group by 1) select product, n_true, n_pred, tp, over, under, {PRF} from s""")
def _(t):
    return rounded(E.count_overlap(t.team, t.ours, ["product"], ["tag", "neck"]), "precision", "recall", "f1")


@query("project_scores_three_keys", "A12", "with " + ", ".join(
    f"k{i} as (select '{'+'.join(by)}' as level, cast(sum(t) as bigint) as n_true, cast(sum(p) as bigint) as n_pred, cast(sum(least(t, p)) as bigint) as tp from (select sum(t) as t, sum(p) as p from (select product, tag, qty as t, 0 as p from {{team}} union all select product, tag, 0, qty from {{ours}}) x group by {', '.join(by)}) y)"
    for i, by in enumerate([["product"], ["product", "tag"], ["tag"]])) + f" select level, n_true, n_pred, tp, {PRF} from (select * from k0 union all select * from k1 union all select * from k2) z")
def _(t):
    out = None
    for by in (["product"], ["product", "tag"], ["tag"]):
        s = E.count_overlap(t.team, t.ours, [], by).select(F.lit("+".join(by)).alias("level"), "n_true", "n_pred", "tp", "precision", "recall", "f1")
        out = s if out is None else out.unionByName(s)
    return rounded(out, "precision", "recall", "f1")


@query("promotion_verdict", "A13", """
with x as (select page_no % 2 as split, cls, count(*) as t from {boxes} group by 1, 2), y as (select page_no % 2 as split, cls, count(*) as p from {revision} group by 1, 2), z as (select page_no % 2 as split, cls, count(*) as q from {boxes} where conf_pct >= 50 group by 1, 2),
j as (select split, sum(t) as t, sum(coalesce(p, 0)) as p, sum(least(t, coalesce(p, 0))) as hp, sum(coalesce(q, 0)) as q, sum(least(t, coalesce(q, 0))) as hq from x left join y using (split, cls) left join z using (split, cls) group by 1),
e as (select page_no % 2 as split, count(*) as extra from {revision} where cls = 'X-X' group by 1),
f as (select split, 2 * (hp / (p + extra)::double) * (hp / t::double) / (hp / (p + extra)::double + hp / t::double) as cf, 2 * (hq / q::double) * (hq / t::double) / (hq / q::double + hq / t::double) as bf from j join e using (split))
select split, round(bf, 6) as base_f1, round(cf, 6) as cand_f1, case when cf - bf > 0.01e0 then 'promote' when cf - bf < -0.01e0 then 'keep' else 'toss-up' end as verdict from f""")
def _(t):
    n = lambda d: d.withColumn("split", c("page_no") % 2).groupBy("split", "cls").agg(F.count("*").alias("qty"))
    truth = n(t.boxes)
    cand = E.count_overlap(truth, n(t.revision), ["split"], ["cls"]).select("split", c("f1").alias("cand_f1"))
    base = E.count_overlap(truth, n(t.boxes.where("conf_pct >= 50")), ["split"], ["cls"]).select("split", c("f1").alias("base_f1"))
    return rounded(E.verdict(base.join(cand, "split")), "base_f1", "cand_f1")


CUTS = [10, 20, 30, 40, 50, 60, 70]
SQL_SWEEP = f"""ct as (select unnest({CUTS}) as threshold), tr as (select doc_id, cls, count(*) as t from {{boxes}} group by 1, 2), pr as (select threshold, doc_id, cls, count(*) as p from {{revision}} join ct on conf_pct >= threshold group by 1, 2, 3),
j as (select ct.threshold, t, 0 as z, doc_id, cls from tr, ct), k as (select coalesce(j.threshold, pr.threshold) as threshold, coalesce(t, 0) as t, coalesce(p, 0) as p from j full join pr on j.threshold = pr.threshold and j.doc_id = pr.doc_id and j.cls = pr.cls),
s as (select threshold, cast(sum(t) as bigint) as n_true, cast(sum(p) as bigint) as n_pred, cast(sum(least(t, p)) as bigint) as tp from k group by 1)"""


@query("threshold_sweep", "A14", f"with {SQL_SWEEP} select threshold, n_true, n_pred, tp, {PRF} from s")
def _(t):
    s = E.threshold_sweep(t.boxes, t.revision, ["doc_id", "cls"], "conf_pct", CUTS)
    return rounded(s.select("threshold", "n_true", "n_pred", "tp", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("best_threshold", "A14", f"with {SQL_SWEEP}, q as (select threshold, {PRF} from s) select threshold, f1 from q order by f1 desc, threshold limit 1")
def _(t):
    return rounded(E.best_cut(rounded(E.threshold_sweep(t.boxes, t.revision, ["doc_id", "cls"], "conf_pct", CUTS), "f1")), "f1")


@query("page_selection_scores", "A15", f"""with s as (select lang, count(*) filter (where quality = 1 and n_chars > 1200) as tp, count(*) filter (where quality = 0 and n_chars > 1200) as fp, count(*) filter (where quality = 1 and n_chars <= 1200) as fn, count(*) filter (where quality is null) as uncertain
 from {{documents}} d left join {{labels}} l on l.doc_id = d.doc_id group by 1), k as (select *, tp + fp as n_pred, tp + fn as n_true from s) select lang, tp, fp, fn, uncertain, {PRF} from k""")
def _(t):
    d = t.documents.select("doc_id", "lang", (c("n_chars") > 1200).alias("picked")).join(t.labels.select("doc_id", (c("quality") == 1).alias("truth")), "doc_id", "left")
    return rounded(E.selection_score(d, ["lang"], "truth", "picked"), "precision", "recall", "f1")


@query("project_position_scores", "A38", f"""with recursive {SQL_OUT}, m as (select doc_id, count(*) as pos, count(*) filter (where l_cls = r_cls) as fu from mt group by 1), a as (select doc_id, count(*) as n_true from {{boxes}} group by 1), b as (select doc_id, count(*) as n_pred from {{revision}} group by 1)
select doc_id, n_true, n_pred, coalesce(pos, 0) as pos, coalesce(fu, 0) as full, round(coalesce(pos, 0) / n_true::double, 6) as pos_recall, round(coalesce(fu, 0) / n_true::double, 6) as full_recall, round(coalesce(fu, 0) / n_pred::double, 6) as full_precision,
 case when fu / n_true::double >= 0.9e0 then '>=90' when fu / n_true::double >= 0.5e0 then '50-90' else '<50' end as bucket from a join b using (doc_id) left join m using (doc_id)""")
def _(t):
    d = E.project_scores(t.boxes, t.revision, M.match_in_order(t.boxes, t.revision, 0.3), ["doc_id"])
    return rounded(d.select("doc_id", "n_true", "n_pred", "pos", "full", "pos_recall", "full_recall", "full_precision", "bucket"), "pos_recall", "full_recall", "full_precision")


EV = "ev as (select event_id, event_type as source, ((event_id * 37) % 101) as pp, ((event_id * event_id * 13 + event_id * 7) % 100) < ((event_id * 37) % 101) as ok from {events})"


def log(t):
    return t.events.selectExpr("event_id", "event_type as source", "(event_id * 37) % 101 as pp", "((event_id * event_id * 13 + event_id * 7) % 100) < ((event_id * 37) % 101) as ok")


@query("brier_scores", "A18", f"with {EV} select source, count(*) as n, round(cast(sum(cast(round((pp / 100e0 - ok::int) * (pp / 100e0 - ok::int) * 1000000000000) as hugeint)) as double) / count(*) / 1000000000000, 6) as brier from ev group by 1 union all select '(all)', count(*), round(cast(sum(cast(round((pp / 100e0 - ok::int) * (pp / 100e0 - ok::int) * 1000000000000) as hugeint)) as double) / count(*) / 1000000000000, 6) from ev")
def _(t):
    y = c("ok").cast("int")
    by, al = E.brier(log(t), ["source"], c("pp") / 100, y), E.brier(log(t), [], c("pp") / 100, y)
    return rounded(by.unionByName(al.withColumn("source", F.lit("(all)"))), "brier")


SQL_REL = "rl as (select source, least(pp // 10, 9) as bucket, count(*) as n, avg(pp / 100e0) as x, avg(ok::int) as y from ev group by 1, 2)"


@query("reliability_table", "A19", f"with {EV}, {SQL_REL} select source, bucket, n, round(x, 6) as mean_predicted, round(y, 6) as mean_actual, round(x - y, 6) as gap from rl")
def _(t):
    return rounded(E.reliability(log(t), ["source"], c("pp") / 100, c("ok")), "mean_predicted", "mean_actual", "gap")


@query("calibrated_confidence", "A20 D13 D14", f"""with {EV}, {SQL_REL}, ok as (select source from ev group by 1 having count(*) >= 30), cv as (select source, list({{'x': x, 'y': y}} order by x) as cv from rl where n >= 5 and source in (select source from ok) group by 1),
q as (select event_id, source, pp / 100e0 as p, cv, list_filter(cv, lambda a: a.x <= pp / 100e0) as lo, list_filter(cv, lambda a: a.x > pp / 100e0) as hi from ev left join cv using (source))
select event_id, source, round(case when cv is null then p when len(lo) = 0 then hi[1].y when len(hi) = 0 then lo[-1].y else lo[-1].y + (hi[1].y - lo[-1].y) * (p - lo[-1].x) / (hi[1].x - lo[-1].x) end, 6) as calibrated from q""")
def _(t):
    curves = E.calibration_curves(log(t), "source", c("pp") / 100, c("ok"))
    return rounded(E.calibrate(log(t), curves, "source", c("pp") / 100), "calibrated").select("event_id", "source", "calibrated")


@query("isotonic_calibration", "A20 H7", f"""with {EV}, a as (select pp, count(*) as n, sum(ok::int) as s from ev group by 1), r as (select pp, sum(n) over (order by pp) as cn, sum(s) over (order by pp) as cs, n, s from a),
m as (select lo.pp as lo, hi.pp as hi, (hi.cs - lo.cs + lo.s) / (hi.cn - lo.cn + lo.n)::double as mean from r lo join r hi on hi.pp >= lo.pp),
w as (select a.pp, m.lo, min(m.mean) as least from a join m on m.lo <= a.pp and m.hi >= a.pp group by 1, 2), f as (select pp, max(least) as fitted from w group by 1)
select event_id, round(fitted, 6) as calibrated from ev join f using (pp)""")
def _(t):
    ev = log(t).select("event_id", (c("pp") / 100).alias("p"), c("ok").cast("double").alias("y"))
    return E.isotonic(ev, "p", "y").transform(ev).select("event_id", F.round("prediction", 6).alias("calibrated"))


@query("class_coverage", "A30", """select lang || '/' || source as cls, count(*) filter (where not held) as trainable, count(*) filter (where held) as held_out, case when count(*) filter (where not held) = 0 then 'NONE' when count(*) filter (where not held) < 30 then 'THIN' else 'OK' end as state
 from (select d.*, l.doc_id is not null as held from {documents} d left join {labels} l on l.doc_id = d.doc_id) x group by 1""")
def _(t):
    d = t.documents.select("doc_id", F.concat("lang", F.lit("/"), "source").alias("cls")).join(t.labels.select("doc_id", F.lit(True).alias("h")), "doc_id", "left")
    return E.coverage(d, "cls", c("h").isNotNull())
