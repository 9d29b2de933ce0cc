"""Scores between truth and prediction, sweeps, verdicts and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markgrid.functions.common import first_match, rate
from markgrid.operators.reconcile import stacked

c = F.col


def prf(tp: Column, n_pred: Column, n_true: Column) -> dict[str, Column]:
    """Precision, recall, F1; 0 where undefined."""
    p, r = rate(tp, n_pred), rate(tp, n_true)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def per_class(outcomes: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per class from rows (truth_cls, pred_cls)."""
    hit = (c("truth_cls") == c("pred_cls")).cast("int")
    pairs = outcomes.groupBy("truth_cls", "pred_cls").agg(F.count("*").alias("n"))
    side = F.explode(F.array(
        F.struct(c("truth_cls").alias("cls"), c("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.coalesce(hit, F.lit(0)).alias("h")),
        F.struct(c("pred_cls").alias("cls"), F.lit(0).cast("bigint").alias("t"), c("n").alias("p"), F.lit(0).alias("h")))).alias("s")
    g = pairs.select("n", side).select("n", "s.*").where("cls is not null").groupBy("cls").agg(
        F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(c("h") * c("n")).alias("tp"))
    return g.withColumns({"fp": c("n_pred") - c("tp"), "fn": c("n_true") - c("tp"), **prf(c("tp"), c("n_pred"), c("n_true"))})


def micro(per_cls: DataFrame) -> DataFrame:
    s = per_cls.agg(*[F.sum(x).alias(x) for x in ("tp", "n_pred", "n_true")])
    return s.withColumns(prf(c("tp"), c("n_pred"), c("n_true")))


def confusion(outcomes: DataFrame) -> DataFrame:
    """Counts of (truth, predicted); absent sides read '(none)'."""
    n = F.lit("(none)")
    return outcomes.select(F.coalesce("truth_cls", n).alias("truth_cls"), F.coalesce("pred_cls", n).alias("pred_cls")).groupBy("truth_cls", "pred_cls").agg(F.count("*").alias("n"))


def top_confusions(matrix: DataFrame, n: int) -> DataFrame:
    return matrix.where("truth_cls <> pred_cls").orderBy(F.desc("n"), "truth_cls", "pred_cls").limit(n)


def confused_pairs(matrix: DataFrame) -> DataFrame:
    """Confusions regardless of direction."""
    m = matrix.where("truth_cls <> pred_cls")
    return m.groupBy(F.least("truth_cls", "pred_cls").alias("a"), F.greatest("truth_cls", "pred_cls").alias("b")).agg(F.sum("n").alias("n"))


def count_overlap(truth: DataFrame, pred: DataFrame, group: list[str], by: list[str], qty: str = "qty") -> DataFrame:
    """Recall, precision and F1 from summed minima of counts, per group."""
    j = stacked(truth, pred, [*group, *by], {"t": ("l", qty), "p": ("r", qty)})
    aggs = [F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.least("t", "p")).alias("tp"),
            F.sum(F.greatest(F.lit(0), c("p") - c("t"))).alias("over"), F.sum(F.greatest(F.lit(0), c("t") - c("p"))).alias("under")]
    g = j.groupBy(*group).agg(*aggs) if group else j.agg(*aggs)
    return g.withColumns(prf(c("tp"), c("n_pred"), c("n_true")))


def verdict(scores: DataFrame, base: str = "base_f1", cand: str = "cand_f1", margin: float = 0.01) -> DataFrame:
    d = c(cand) - c(base)
    return scores.withColumn("verdict", F.when(d > margin, "promote").when(d < -margin, "keep").otherwise("toss-up"))


def threshold_sweep(truth: DataFrame, pred: DataFrame, by: list[str], conf: str, cuts: list) -> DataFrame:
    """Count-overlap scores at every cut. Predictions are first counted by highest passed cut, so the
    sweep expands counts, not rows."""
    step = F.lit(0)
    for i, x in enumerate(cuts):
        step = F.when(c(conf) >= x, F.lit(i + 1)).otherwise(step) if i else F.when(c(conf) >= x, F.lit(1)).otherwise(F.lit(0))
    n = pred.withColumn("_s", step).groupBy(*by, "_s").agg(F.count("*").alias("qty")).where("_s > 0")
    at = n.select(*by, "qty", F.explode(F.sequence(F.lit(1), c("_s"))).alias("cut"))
    p = at.groupBy(*by, "cut").agg(F.sum("qty").alias("qty"))
    t = truth.groupBy(*by).agg(F.count("*").alias("qty")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(len(cuts)))))
    s = count_overlap(t, p, ["cut"], by)
    return s.withColumn("threshold", F.array(*[F.lit(x) for x in cuts])[c("cut") - 1]).drop("cut")


def best_cut(sweep: DataFrame) -> DataFrame:
    """The threshold of highest F1, the lowest on a tie."""
    return sweep.groupBy().agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -c("threshold"))).alias("_b")).select("_b.*")


def selection_score(rows: DataFrame, keys: list[str], truth: str, picked: str) -> DataFrame:
    """Precision and recall of a yes/no selection; rows of unknown truth are counted apart."""
    yes = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("bigint"))
    g = rows.groupBy(*keys).agg(yes(c(truth) & c(picked)).alias("tp"), yes(~c(truth) & c(picked)).alias("fp"), yes(c(truth) & ~c(picked)).alias("fn"),
                                yes(c(truth).isNull()).alias("uncertain"))
    return g.withColumns(prf(c("tp"), c("tp") + c("fp"), c("tp") + c("fn")))


def project_scores(truth: DataFrame, pred: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per project: recall and precision by position alone, and by position and class; recall class.

    ``matches``: keys, l_cls, r_cls.
    """
    m = matches.groupBy(*keys).agg(F.count("*").alias("pos"), F.sum((c("l_cls") == c("r_cls")).cast("bigint")).alias("full"))
    n = stacked(truth, pred, keys, {"n_true": ("l", "1"), "n_pred": ("r", "1")}).join(m, keys, "left").na.fill(0, ["pos", "full"])
    n = n.withColumns({"pos_recall": rate(c("pos"), c("n_true")), "pos_precision": rate(c("pos"), c("n_pred")),
                       "full_recall": rate(c("full"), c("n_true")), "full_precision": rate(c("full"), c("n_pred"))})
    return n.withColumn("bucket", first_match([(c("full_recall") >= 0.9, ">=90"), (c("full_recall") >= 0.5, "50-90")], "<50"))


def brier(events: DataFrame, keys: list[str], p: Column, y: Column) -> DataFrame:
    """Mean squared gap between predicted probability and outcome.

    Gaps are added as whole millionths of a millionth, so the sum does not depend on the order of rows.
    """
    d = p - y.cast("double")
    whole = F.round(d * d * 1_000_000_000_000).cast("decimal(38,0)")
    aggs = [F.count("*").alias("n"), (F.sum(whole).cast("double") / F.count("*") / 1_000_000_000_000).alias("brier")]
    return events.groupBy(*keys).agg(*aggs) if keys else events.agg(*aggs)


def reliability(events: DataFrame, keys: list[str], p: Column, y: Column, buckets: int = 10) -> DataFrame:
    """Mean prediction against mean outcome per bucket of prediction; the last bucket is closed.

    Buckets compare with i/n bounds, so 0.3 never falls below its own edge.
    """
    b = F.lit(0)
    for i in range(1, buckets):
        b = F.when(p >= i / buckets, F.lit(i)).otherwise(b)
    g = events.withColumns({"_b": b, "_p": p, "_y": y.cast("int")}).groupBy(*keys, c("_b").alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("_p").alias("mean_predicted"), F.avg("_y").alias("mean_actual"))
    return g.withColumn("gap", c("mean_predicted") - c("mean_actual"))


def calibration_curves(events: DataFrame, source: str, p: Column, y: Column, least_events: int = 30, least_bucket: int = 5) -> DataFrame:
    """Per source the points (x, y) of mean prediction and mean outcome, not forced to be monotone.

    At most ten points per source: (source, xs ARRAY<STRUCT<x, y>>).
    """
    r = reliability(events, [source], p, y)
    w = Window.partitionBy(source)
    r = r.withColumn("_all", F.sum("n").over(w)).where((c("_all") >= least_events) & (c("n") >= least_bucket))
    pt = F.struct(c("mean_predicted").alias("x"), c("mean_actual").alias("y"))
    return r.groupBy(source).agg(F.array_sort(F.collect_list(pt)).alias("curve"))


def interpolate(curve: Column, v: Column) -> Column:
    """Linear between the curve's points, flat beyond its ends; v itself without a curve."""
    below = F.filter(curve, lambda q: q["x"] <= v)
    above = F.filter(curve, lambda q: q["x"] > v)
    lo, hi = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inner = lo["y"] + (hi["y"] - lo["y"]) * (v - lo["x"]) / (hi["x"] - lo["x"])
    return F.when(curve.isNull() | (F.size(curve) == 0), v).when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(inner)


def calibrate(rows: DataFrame, curves: DataFrame, source: str, p: Column) -> DataFrame:
    """Calibrated confidence by the curve of the row's source, else by one whose first word opens the
    source's name, else unchanged."""
    own = curves.select(c(source), c("curve").alias("_own"))
    head = F.substring_index(c(source), "-", 1)
    fam = curves.select(head.alias("_head"), c(source).alias("_s"), "curve").groupBy("_head").agg(F.min_by("curve", "_s").alias("_fam"))
    j = rows.withColumn("_head", head).join(own, source, "left").join(fam, "_head", "left")
    return j.withColumn("calibrated", interpolate(F.coalesce("_own", "_fam"), p)).drop("_own", "_fam", "_head")


def isotonic(events: DataFrame, p: str, y: str):
    """Monotone alternative: Spark's isotonic regression over the distinct predictions, weighted by their events."""
    from pyspark.ml.regression import IsotonicRegression

    points = events.groupBy(c(p).cast("double").alias(p)).agg(F.avg(c(y).cast("double")).alias(y), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol=p, labelCol=y, weightCol="weight").fit(points)


def coverage(rows: DataFrame, cls: str, held_out: Column, thin: int = 30) -> DataFrame:
    """Examples per class that can be trained on or are held out; THIN below the bound."""
    g = rows.groupBy(cls).agg(F.sum((~held_out).cast("bigint")).alias("trainable"), F.sum(held_out.cast("bigint")).alias("held_out"))
    return g.withColumn("state", first_match([(c("trainable") == 0, "NONE"), (c("trainable") < thin, "THIN")], "OK"))
