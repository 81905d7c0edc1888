"""Scoring and metrics, all as partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import dynamic_loss, safe_divide, unscale
from wattloom.operators.clean import KEYS
from wattloom.operators.ordered import grouped_percentile, with_running
from wattloom.params import DEFAULT, Params
from wattloom.session import materialize


def fuse_probabilities(scored: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of overlapping window probabilities per time step; only covered steps remain."""
    return (
        scored.select(*keys, "start", F.posexplode("prob").alias("pos", "v"))
        .groupBy(*keys, (F.col("start") + p.backcast + F.col("pos")).alias("t"))
        .agg(F.avg("v").alias("y_prob"))
    )


def with_truth(fused_prob: DataFrame, fused_labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return fused_prob.join(fused_labels.select(*keys, "t", F.col("anomaly").alias("y_true")), [*keys, "t"])


def confusion(scored: DataFrame, threshold: float = 0.5, inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four quadrants. ``inclusive``: a score at the threshold counts as positive."""
    hit = F.col("y_prob") >= threshold if inclusive else F.col("y_prob") > threshold
    true = F.col("y_true") == 1
    return scored.groupBy(*by).agg(
        F.count_if(true & hit).alias("tp"),
        F.count_if(~true & ~hit).alias("tn"),
        F.count_if(~true & hit).alias("fp"),
        F.count_if(true & ~hit).alias("fn"),
    )


def classification(conf: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy, base rate, n; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    return (
        conf.withColumn("n_points", n)
        .withColumn("precision", safe_divide(tp, tp + fp))
        .withColumn("recall", safe_divide(tp, tp + fn))
        .withColumn("f1", safe_divide(2 * tp, 2 * tp + fp + fn))
        .withColumn("accuracy", safe_divide(tp + tn, n))
        .withColumn("anomaly_rate", safe_divide(tp + fn, n))
    )


def confusion_share(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form: quadrant, count, share of all points of its row."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    cells = F.array(*[
        F.struct(F.lit(c.upper()).alias("quadrant"), F.col(c).alias("points")) for c in ("tn", "fp", "fn", "tp")
    ])
    return conf.select(*by, total.alias("__n"), F.explode(cells).alias("c")).select(
        *by, "c.quadrant", "c.points", safe_divide(F.col("c.points"), F.col("__n")).alias("share")
    )


def auroc(scored: DataFrame, slices: int = 256) -> DataFrame:
    """Area under the ROC curve by ranks, ties halved; null when only one class occurs.

    Rows collapse to one per distinct score first. Scores are then cut at their own quantiles, and
    only one row per slice takes part in the global running sum.
    """
    per = scored.groupBy("y_prob").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )
    probs = [i / slices for i in range(1, slices)]
    inner = sorted(set(per.approxQuantile("y_prob", probs, 1.0 / (4 * slices))))
    cuts = [float("-inf"), *inner, float("inf")]
    if len(cuts) > 2:
        sliced = Bucketizer(splits=cuts, inputCol="y_prob", outputCol="__slice").transform(per)
    else:
        sliced = per.withColumn("__slice", F.lit(0.0))
    cum = with_running(sliced, [], [F.col("y_prob")], F.col("__slice").cast("long"), {"neg_upto": ("sum", "neg")})
    won = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") + 0.5 * F.col("neg"))
    totals = cum.agg(F.sum(won).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return totals.select(
        F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p").cast("double") * F.col("q"))).alias("auroc"),
        F.col("p").alias("positives"),
        F.col("q").alias("negatives"),
    )


# ---- forecast errors as aggregate expressions over columns pred / true ------------------------


def mae(pred: Column, true: Column) -> Column:
    return F.avg(F.abs(pred - true))


def mse(pred: Column, true: Column) -> Column:
    return F.avg((pred - true) * (pred - true))


def rmse(pred: Column, true: Column) -> Column:
    return F.sqrt(mse(pred, true))


def mape(pred: Column, true: Column) -> Column:
    return F.avg(F.abs((pred - true) / true))


def mspe(pred: Column, true: Column) -> Column:
    return F.avg(F.pow((pred - true) / true, 2))


def cvrmse(pred: Column, true: Column, eps: float = 1e-8) -> Column:
    n = F.count(true)
    return F.sqrt(F.sum((pred - true) * (pred - true)) / n) / (F.sum(true) / n + F.lit(eps))


def nrmse(pred: Column, true: Column, period: int = 24, eps: float = 1e-8) -> Column:
    """Percent of the mean; the divisor counts whole periods only."""
    whole = F.lit(period) * F.floor(F.count(true) / period)
    return F.lit(100.0) / (F.avg(true) + F.lit(eps)) * F.sqrt(F.sum((pred - true) * (pred - true)) / F.nullif(whole, F.lit(0)))


def nrmse_mean(pred: Column, true: Column) -> Column:
    return rmse(pred, true) / F.avg(true)


def nrmse_range(pred: Column, true: Column, eps: float = 1e-8) -> Column:
    return rmse(pred, true) / (F.max(true) - F.min(true) + F.lit(eps))


def rse(pred: Column, true: Column) -> Column:
    return F.sqrt(F.sum((true - pred) * (true - pred))) / F.sqrt(F.var_pop(true) * F.count(true))


def bundle(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "true") -> DataFrame:
    """mae, mse, rmse, mape, mspe and rmse/mean in one pass."""
    a, b = F.col(pred), F.col(true)
    return df.groupBy(*by).agg(
        mae(a, b).alias("mae"), mse(a, b).alias("mse"), rmse(a, b).alias("rmse"),
        mape(a, b).alias("mape"), mspe(a, b).alias("mspe"), nrmse_mean(a, b).alias("nrmse"),
    )


def correlation_over_horizons(df: DataFrame, horizon: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of pred and true per horizon step, then the mean over steps."""
    per = df.groupBy(*by, horizon).agg(F.corr("pred", "true").alias("c"))
    return per.groupBy(*by).agg(F.avg("c").alias("corr"))


def building_metrics(points: DataFrame, keys: Sequence[str] = KEYS, eps: float = 1e-8) -> DataFrame:
    """Per building from normalised trend and season: errors on both scales and the mean loss.

    ``points``: keys, start, tp, tt, sp, st (predicted and true, trend and season) and the scaling
    tm, ts, sm, ss. The loss is formed per window, then averaged.
    """
    pred_n, true_n = F.col("tp") + F.col("sp"), F.col("tt") + F.col("st")
    scale = lambda t, s: unscale(F.col(t), F.col("tm"), F.col("ts"), eps) + unscale(F.col(s), F.col("sm"), F.col("ss"), eps)
    pts = points.select(
        *keys, "start",
        scale("tp", "sp").alias("pred"), scale("tt", "st").alias("true"),
        pred_n.alias("pred_n"), true_n.alias("true_n"),
        F.pow(F.col("tp") - F.col("tt"), 2).alias("et"), F.pow(F.col("sp") - F.col("st"), 2).alias("es"),
    )
    # moments per window are enough for every metric, and they add up
    per = pts.groupBy(*keys, "start").agg(
        dynamic_loss(F.avg("et"), F.avg("es")).alias("loss"),
        F.count(F.lit(1)).alias("c"),
        F.sum("true").alias("sy"),
        F.sum(F.abs(F.col("pred") - F.col("true"))).alias("a"),
        F.sum(F.pow(F.col("pred") - F.col("true"), 2)).alias("q"),
        F.sum(F.abs(F.col("pred_n") - F.col("true_n"))).alias("an"),
        F.sum(F.pow(F.col("pred_n") - F.col("true_n"), 2)).alias("qn"),
    )
    tot = per.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("c", "sy", "a", "q", "an", "qn")], F.avg("loss").alias("avg_test_loss")
    )
    n, mean = F.col("c"), F.col("sy") / F.col("c") + F.lit(eps)
    whole = F.nullif(F.lit(24) * F.floor(n / 24), F.lit(0))
    return tot.select(
        *keys,
        (F.sqrt(F.col("q") / n) / mean).alias("cvrmse"),
        (F.lit(100.0) / mean * F.sqrt(F.col("q") / whole)).alias("nrmse"),
        (F.col("a") / n).alias("mae"), (F.col("an") / n).alias("mae_norm"),
        (F.col("q") / n).alias("mse"), (F.col("qn") / n).alias("mse_norm"),
        "avg_test_loss",
    )


def region_medians(per_building: DataFrame, region: str = "grp") -> DataFrame:
    """Median over the buildings of a region, five error measures."""
    cols = ("nrmse", "mae", "mae_norm", "mse", "mse_norm")
    per_building = materialize(per_building.select(region, *cols), "per-building")  # dear to compute, and read three times
    long = grouped_percentile(per_building, [region], cols, {"median": 0.5})
    return long.groupBy(region).agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(c) for c in cols])
