"""Evaluation of scores: sweeps, operating points, metrics with intervals, parity, shift.

Undefined ratios follow one rule: precision without predictions is 0; recall and false-accept rate
without cases are NaN; F1 is 0 where precision and recall are, and NaN where recall is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clamp, poisson, rounded, wilson
from ..functions.shipping import ship
from .report import quantile_linear, ranked

#: The thresholds of a sweep, 0.050 to 0.995 by 0.005, and the false-accept bar.
FIRST, STEP, POINTS, FALSE_ACCEPTS = 0.05, 0.005, 190, 0.01


def _threshold(i: Column) -> Column:
    return F.round(F.lit(FIRST) + F.lit(STEP) * i, 3)


def _ratio(a: Column, b: Column, none: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(none))


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """precision, recall, f1, far under the rule above."""
    precision, recall = _ratio(tp, tp + fp, 0.0), _ratio(tp, tp + fn, float("nan"))
    f1 = F.when(F.isnan(recall), F.lit(float("nan"))).when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return {"precision": precision, "recall": recall, "f1": f1, "far": _ratio(fp, fp + tn, float("nan"))}


def sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """threshold, tp, fp, precision, recall, f1, far at every threshold of the grid (score >= threshold).

    Each score falls in the cell of the last threshold it reaches; the cells' counts, one row each,
    are summed from above. The rows of the table aren't multiplied by the grid.
    """
    s = F.col(score)
    near = F.floor((s - FIRST) / STEP + 0.5)
    cell = F.least(F.when(s >= _threshold(near), near).otherwise(near - 1), F.lit(POINTS - 1))
    cells = df.where(s.isNotNull() & ~F.isnan(s)).groupBy(F.greatest(cell, F.lit(-1)).cast("int").alias("i")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(-1, POINTS).select(F.col("id").cast("int").alias("i"))
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = grid.join(cells, "i", "left").na.fill(0)  # 191 rows
    tp, all_ = F.sum("pos").over(above), F.sum("n").over(above)
    full = full.select("i", tp.alias("tp"), (all_ - tp).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("n").over(whole).alias("t")).where("i >= 0")
    m = metrics(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"), F.col("t") - F.col("p") - F.col("fp"))
    return full.select(_threshold(F.col("i")).alias("threshold"), "tp", "fp", *(rounded(v).alias(k) for k, v in m.items()))


def operating_point(curve: DataFrame) -> DataFrame:
    """The lowest threshold whose false-accept rate is within the bar; else the best F1, the lowest first."""
    good = F.min(F.when(F.col("far") <= FALSE_ACCEPTS, F.col("threshold")))
    best = F.max(F.struct(F.nanvl("f1", F.lit(-1.0)).alias("f1"), (-F.col("threshold")).alias("t")))
    return curve.agg(good.alias("good"), best.alias("best")).select(F.coalesce("good", -F.col("best.t")).alias("threshold"), F.when(F.col("good").isNotNull(), "far").otherwise("f1").alias("rule"))


def quantile_threshold(df: DataFrame, score: str, truth: str, p: float = 0.99) -> DataFrame:
    """The quantile of the negatives' scores within [0.05, 0.99]; 0.5 without negatives."""
    name = f"p{round(p * 100)}"
    q = quantile_linear(df.where(~F.col(truth)).select(F.lit(0).alias("_g"), score), "_g", score, [p])
    return q.agg(F.max(name).alias("q")).select(F.round(F.coalesce(clamp(F.col("q"), 0.05, 0.99), F.lit(0.5)), 6).alias("threshold"))


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return counts.select("tp", "fp", "fn", "tn", *(rounded(v).alias(k) for k, v in metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))).items()))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """truth, predicted, n for every pair of classes."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"`{truth}` string, `{predicted}` string")
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return grid.join(counts, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def subset_recall(df: DataFrame, subset: str, hit: str, entity: str) -> DataFrame:
    """By subset: n, k hits, distinct entities, the rate and its Wilson bounds."""
    counts = df.groupBy(subset).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("k"), F.count_distinct(entity).alias("n_entities"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select(subset, "n", "k", "n_entities", rounded(F.col("k") / F.col("n")).alias("rate"), rounded(low).alias("low"), rounded(high).alias("high"))


def rate_interval(df: DataFrame, events: str, hours: str) -> DataFrame:
    """Adds rate, low, high per hour from columns of event counts and hours."""
    low, high = poisson(F.col(events))
    h = F.col(hours)
    return df.withColumns({"rate": rounded(F.col(events) / h), "low": rounded(low / h), "high": rounded(high / h)})


def cohens_d(df: DataFrame, dim: str, value: str, group: str, a: int, b: int) -> DataFrame:
    """By dimension: the difference of two groups' means over their pooled deviation; NaN below two rows, 0 without spread."""
    x, y = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    s = df.groupBy(dim).agg(F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"), F.count(x).alias("na"), F.count(y).alias("nb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    d = F.when((F.col("na") < 2) | (F.col("nb") < 2), F.lit(float("nan"))).when(pooled == 0, 0.0).otherwise((F.col("ma") - F.col("mb")) / pooled)
    return s.select(dim, "na", "nb", rounded(d).alias("d"))


def znorm(df: DataFrame, dim: str, value: str, fit_on: str, floor: float = 1e-6) -> DataFrame:
    """Adds z: the value against mean and population deviation of the rows under ``fit_on``, by dimension."""
    stats = df.where(fit_on).groupBy(dim).agg(F.avg(value).alias("_m"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("_s"))
    return df.join(stats, dim).withColumn("z", rounded((F.col(value) - F.col("_m")) / F.col("_s"), 4)).drop("_m", "_s")


def parity(df: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """One row: largest absolute difference, correlation, share of flipped decisions, and the three bars."""
    flip = F.avg(((F.col(a) >= threshold) != (F.col(b) >= threshold)).cast("double"))
    s = df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("d"), F.corr(a, b).alias("c"), flip.alias("f"))
    return s.select(rounded(F.col("d")).alias("max_diff"), rounded(F.col("c")).alias("corr"), rounded(F.col("f")).alias("flips"), ((F.col("d") <= 0.05) & (F.col("c") >= 0.99) & (F.col("f") <= 0.01)).alias("passed"))


def quantised(x: Column, scale: float, zero: int) -> Column:
    """Through signed bytes and back: half to even, clamped."""
    q = F.least(F.greatest(F.bround(x / scale) + zero, F.lit(-128.0)), F.lit(127.0))
    return (q - zero) * scale


def compare_models(df: DataFrame, case: str, model: str, score: str, truth: str, models: list[str], threshold: float) -> DataFrame:
    """One row a pair of decisions: truth, a and b (the two models' decisions on the same case), n; cases that one model lacks are left out."""
    wide = df.groupBy(case, truth).pivot(model, models).agg(F.max(score))
    a, b = (F.col(m) >= threshold for m in models)
    return wide.where(F.col(models[0]).isNotNull() & F.col(models[1]).isNotNull()).groupBy(F.col(truth).alias("truth"), a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


def det_curve(curve: DataFrame) -> DataFrame:
    """threshold, false accepts and false rejects of a sweep, on a logarithmic scale floored at 1e-6."""
    log = lambda c: rounded(F.log10(F.greatest(c, F.lit(1e-6))), 6)
    return curve.select("threshold", log(F.col("far")).alias("log_far"), log(1 - F.col("recall")).alias("log_frr"))


def session_latency(matched: DataFrame, session: str) -> DataFrame:
    """By session: spans, detected ones, and the median latency of these."""
    counts = matched.groupBy(session).agg(F.count("*").alias("n"), F.count_if("detected").alias("n_detected"))
    median = quantile_linear(matched, session, "latency", [0.5]).select(F.col(session).alias("_s"), F.col("p50").alias("median_latency"))
    return counts.join(median, F.col(session).eqNullSafe(F.col("_s")), "left").drop("_s")


def tiers(df: DataFrame, subsets: dict[str, Column], positives: list[str], score: str, threshold: float, utterance: list[str]) -> DataFrame:
    """By subset (each a condition; a row may be in several, subsets without rows are left out): n, fired, metric, k (detections of
    positives, correct rejections of the others), its rate and Wilson bounds, and for positives the distinct utterances."""
    of = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in subsets.items())))
    same = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in utterance))
    rows = df.select(F.explode(of).alias("subset"), (F.col(score) >= threshold).alias("_fired"), same.alias("_u"))
    counts = rows.groupBy("subset").agg(F.count("*").alias("n"), F.count_if("_fired").alias("fired"), F.count_distinct("_u").alias("_us"))
    positive = F.col("subset").isin(*positives)
    counts = counts.withColumns({"metric": F.when(positive, "recall").otherwise("correct_reject"), "k": F.when(positive, F.col("fired")).otherwise(F.col("n") - F.col("fired"))})
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("subset", "n", "fired", "metric", "k", rounded(F.col("k") / F.col("n")).alias("rate"), rounded(low).alias("low"), rounded(high).alias("high"), F.when(positive, F.col("_us")).alias("n_utterances"))


def model_curves(df: DataFrame, model: str, score: str, truth: str) -> DataFrame:
    """By model and threshold (0.05 to 0.95 by 0.05): recall, its Wilson bounds, and the share of false accepts among the others.

    Scores are counted by the last threshold they reach, and the counts, some rows a model, summed from above.
    """
    step = lambda i: F.round(0.05 * i, 2)
    near = F.floor(F.col(score) * 20 + 0.5)
    cell = F.greatest(F.least(F.when(F.col(score) >= step(near), near).otherwise(near - 1), F.lit(19)), F.lit(0)).cast("int")
    cells = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(model, cell.alias("i")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    grid = cells.select(model).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    full = grid.join(cells, [model, "i"], "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy(model).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(model)
    full = full.select(model, "i", F.sum("pos").over(above).alias("k"), F.sum("neg").over(above).alias("fa"), F.sum("pos").over(whole).alias("n"), F.sum("neg").over(whole).alias("m")).where("i between 1 and 19")
    low, high = wilson(F.col("k"), F.col("n"))
    return full.select(model, step(F.col("i")).alias("threshold"), rounded(_ratio(F.col("k"), F.col("n"), float("nan"))).alias("recall"), rounded(low).alias("low"), rounded(high).alias("high"), rounded(_ratio(F.col("fa"), F.col("m"), float("nan"))).alias("far"))


def auc(df: DataFrame, tier: str, score: str, truth: str) -> DataFrame:
    """By tier: positives, others, and the area under the ROC curve by mean ranks; NaN without rows of both kinds."""
    some = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    positives = some.where(F.col(truth)).groupBy(F.col(tier).alias("_t"), F.col(score).alias("_v")).agg(F.count("*").alias("p"))
    places = ranked(some, tier, score)
    both = places.join(positives, places[tier].eqNullSafe(F.col("_t")) & (places["v"] == F.col("_v")), "left")
    p = F.coalesce("p", F.lit(0))
    sums = both.groupBy(tier).agg(F.sum(p).alias("n_positive"), F.max("n").alias("n"), F.sum(p * (F.col("below") + F.col("upto") + 1) / 2).alias("r"))
    n, k = F.col("n") - F.col("n_positive"), F.col("n_positive")
    return sums.select(tier, "n_positive", n.alias("n_other"), rounded(F.when((n > 0) & (k > 0), (F.col("r") - k * (k + 1) / 2) / (k * F.when(n > 0, n))).otherwise(F.lit(float("nan")))).alias("auc"))


def separability(df: DataFrame, key: str, vector: str, group: str, a: int, b: int, folds: int = 5) -> DataFrame:
    """How well a linear probe tells two groups of vectors apart: fold, n and accuracy on the rows held out, folds by a hash of the key."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(group).isin(a, b)).select(F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"), (F.col(group) == b).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    out = None
    for k in range(folds):
        model = LogisticRegression(maxIter=50, regParam=1e-3).fit(rows.where(F.col("fold") != k))
        one = model.transform(rows.where(F.col("fold") == k)).groupBy("fold").agg(F.count("*").alias("n"), rounded(F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def shift_report(shift: DataFrame, dim: str, d: str, z_a: str, z_b: str, low: int, high: int) -> DataFrame:
    """One row of a table of dimensions with d and the two groups' mean z: mean |d|, the dimension of the largest |d| (the first of equals),
    the tilt (mean d from dimension ``high`` on less that below ``low``), and the root mean square displacement in z."""
    size = F.abs(d)
    return shift.agg(
        rounded(F.avg(size)).alias("mean_abs_d"),
        F.max(F.struct(size.alias("s"), (-F.col(dim)).alias("i"))).alias("w"),
        rounded(F.avg(F.when(F.col(dim) >= high, F.col(d))) - F.avg(F.when(F.col(dim) < low, F.col(d)))).alias("tilt"),
        rounded(F.sqrt(F.avg((F.col(z_b) - F.col(z_a)) ** 2))).alias("displacement"),
    ).select("mean_abs_d", (-F.col("w.i")).alias("worst_dim"), "tilt", "displacement")


def best_class(scores: Column) -> Column:
    """The place of the largest score, the first of equals, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def batch_scores(df: DataFrame, inputs: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, batch: int = 256, to: str = "score") -> DataFrame:
    """``df`` with the score of a model over a column of arrays of ``size`` numbers. ``load`` is called once a worker and gives a function from a matrix of at most ``batch`` rows to their scores; a null row has none."""
    from pyspark.ml.functions import predict_batch_udf

    ship(df.sparkSession)
    run = predict_batch_udf(load, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[size]])
    x = F.col(inputs).cast("array<double>")
    # A null row goes in as zeros, and its score is taken back.
    return df.withColumn(to, F.when(x.isNotNull(), run(F.coalesce(x, F.array_repeat(F.lit(0.0), size)))))
