"""Baseline models in place of the neural network: least squares, seasonal-naive, logistic.

Least squares needs only the summed cross products of features and targets. Each task adds up its
rows, one small matrix per key; the matrices are summed by Spark and solved per key. One pass
gives all horizons and all keys (folds or devices).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.arrays import AT_ONCE
from wattloom.functions.scalars import dynamic_loss
from wattloom.params import DEFAULT, Params
from wattloom.session import materialize


def cross_products(df: DataFrame, key: str, features: str, targets: str, squares: bool = False) -> DataFrame:
    """Summed products (key, i, j, v): row i of the features (0 is the constant) with column j of
    [features, targets]. With ``squares`` row -1 holds the sums of squares of the same columns."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch.num_rows
            k = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            y = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            for at in range(0, rows, AT_ONCE):
                own = slice(at, at + AT_ONCE)
                left = np.hstack([np.ones((len(k[own]), 1)), x[own]])
                full = np.hstack([left, y[own]])
                for value in np.unique(k[own]):
                    m = k[own] == value
                    part = left[m].T @ full[m]
                    if squares:
                        part = np.vstack([part, (full[m] ** 2).sum(axis=0)])
                    sums[int(value)] = sums[int(value)] + part if int(value) in sums else part
        for value, m in sums.items():
            i, j = np.indices(m.shape)
            if squares:
                i[-1] = -1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, value, dtype=np.int64)), pa.array(i.ravel().astype(np.int32)),
                 pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())],
                names=["key", "i", "j", "v"],
            )

    picked = df.select(F.col(key).cast("long"), features, targets)
    return (
        picked.mapInArrow(summed, "key long, i int, j int, v double")
        .groupBy("key", "i", "j")
        .agg(F.sum("v").alias("v"))
    )


def least_squares(products: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Coefficients (key, n, horizon, coef): one solve of bounded size per key."""

    def solve(part):
        d = int(part["i"].max()) + 1
        m = np.zeros((d, int(part["j"].max()) + 1))
        m[part["i"].to_numpy(), part["j"].to_numpy()] = part["v"].to_numpy()
        a, b = m[:, :d], m[:, d:]
        penalty = np.eye(d) * ridge * max(a[0, 0], 1.0)
        penalty[0, 0] = 0.0
        coef = np.linalg.solve(a + penalty, b)
        return part.iloc[:0][["key"]].reindex(range(b.shape[1])).assign(
            key=part["key"].iloc[0], n=int(round(a[0, 0])), horizon=range(b.shape[1]), coef=list(coef.T)
        )

    return products.groupBy("key").applyInPandas(solve, "key long, n long, horizon int, coef array<double>")


def fit(df: DataFrame, key: str, features: str, targets: str, ridge: float = 1e-6) -> DataFrame:
    return least_squares(cross_products(df, key, features, targets), ridge)


def coefficient_matrices(coefs: DataFrame) -> dict[int, np.ndarray]:
    """Small result to the driver: one (features + 1) x horizons matrix per key."""
    out: dict[int, dict[int, list[float]]] = {}
    for row in coefs.collect():
        out.setdefault(row["key"], {})[row["horizon"]] = row["coef"]
    return {k: np.array([v[h] for h in sorted(v)]).T for k, v in out.items()}


def predictor(matrices: dict[int, np.ndarray]):
    """(key, features) -> predicted targets, one matrix product per key and batch."""
    horizons = next(iter(matrices.values())).shape[1]

    @F.arrow_udf("array<double>")
    def predict(key: pa.Array, x: pa.Array) -> pa.Array:
        k = key.to_numpy(zero_copy_only=False)
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
        out = np.full((len(k), horizons), np.nan)
        for at in range(0, len(k), AT_ONCE):
            own = slice(at, at + AT_ONCE)
            for value, m in matrices.items():
                hit = k[own] == value
                if hit.any():
                    out[own][hit] = m[0] + rows[own][hit] @ m[1:]
        offsets = pa.array(np.arange(0, out.size + 1, horizons, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return predict


def seasonal_naive(series: str, p: Params = DEFAULT) -> Column:
    """The last ``forecast`` values of the input part, taken as the forecast."""
    return F.slice(F.col(series), p.backcast - p.forecast + 1, p.forecast)


def mean_square(a: Column, b: Column) -> Column:
    sq = F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    return sq / F.size(a)


def forecast_loss(trend_pred: Column, season_pred: Column, trend: Column, season: Column) -> Column:
    return dynamic_loss(mean_square(trend_pred, trend), mean_square(season_pred, season))


def rolling_fit(folds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Loss per fold: least squares on the fold's training windows, scored on its validation part.

    ``folds``: windows with trend_norm, season_norm, fold and role. All folds are fitted in one
    pass per component.
    """
    parts = {}
    xy = folds.select(
        "fold", "role",
        *[F.slice(c, 1, p.backcast).alias(f"{c}_in") for c in ("trend_norm", "season_norm")],
        *[F.slice(c, p.backcast + 1, p.forecast).alias(f"{c}_out") for c in ("trend_norm", "season_norm")],
    )
    train, val = xy.where("role = 'train'"), xy.where("role = 'val'")
    for c in ("trend_norm", "season_norm"):
        parts[c] = predictor(coefficient_matrices(fit(train, "fold", f"{c}_in", f"{c}_out")))
    scored = val.withColumns(
        {
            "tp": parts["trend_norm"](F.col("fold").cast("long"), F.col("trend_norm_in")),
            "sp": parts["season_norm"](F.col("fold").cast("long"), F.col("season_norm_in")),
        }
    )
    loss = forecast_loss(F.col("tp"), F.col("sp"), F.col("trend_norm_out"), F.col("season_norm_out"))
    return scored.groupBy("fold").agg(F.avg(loss).alias("val_loss"), F.count(F.lit(1)).alias("windows"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("val_loss").alias("mean_loss"), F.stddev_pop("val_loss").alias("std_loss")
    )


def future_points(windows: DataFrame, labels: str, p: Params = DEFAULT, keys: Sequence[str] = ("grp", "building")) -> DataFrame:
    """One row per window and future step with features known at forecast time."""
    past_season = F.slice("season_norm", 1, p.backcast)
    spread = F.aggregate(past_season, F.lit(0.0), lambda s, v: s + F.abs(v)) / p.backcast
    naive = F.slice("season_norm", p.backcast - p.forecast + 1, p.forecast)
    naive_trend = F.slice("trend_norm", p.backcast - p.forecast + 1, p.forecast)
    truth = F.slice(F.col(labels), p.backcast + 1, p.forecast)
    return windows.select(
        *keys, "start", spread.alias("spread"), F.element_at("trend_norm", p.backcast).alias("last_trend"),
        F.posexplode(F.arrays_zip(naive.alias("a"), naive_trend.alias("b"), truth.alias("y"))).alias("h", "v"),
    ).select(
        *keys, "start", "h", "spread", "last_trend",
        F.col("v.a").alias("naive"), F.abs(F.col("v.a")).alias("naive_abs"), F.col("v.b").alias("naive_trend"),
        F.col("h").cast("double").alias("step"), F.col("v.y").cast("double").alias("label"),
    )


FEATURES = ("spread", "last_trend", "naive", "naive_abs", "naive_trend", "step")


def fit_classifier(points: DataFrame, max_iter: int = 20):
    """Weighted logistic regression; positives weigh as much as all negatives together."""
    n, pos = points.agg(F.count(F.lit(1)), F.sum("label")).first()
    weight = (n - max(pos or 0, 1)) / max(pos or 0, 1)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(points)
    ready = ready.withColumn("w", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    return LogisticRegression(weightCol="w", maxIter=max_iter, regParam=1e-4).fit(ready.select("features", "label", "w"))


def classify(model, points: DataFrame) -> DataFrame:
    """Add ``y_prob``."""
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(points)
    scored = model.transform(ready)
    return scored.withColumn("y_prob", vector_to_array("probability")[1]).select(*points.columns, "y_prob")


def federated_average(coefs: DataFrame) -> DataFrame:
    """Parameters averaged over clients, weighted by their examples."""
    return (
        coefs.select("key", "n", "horizon", F.posexplode("coef").alias("param", "v"))
        .groupBy("horizon", "param")
        .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("value"), F.count(F.lit(1)).alias("clients"))
    )


def federated_rounds(
    df: DataFrame, key: str, features: str, targets: str, rounds: int,
    rate: float = 0.1, local_steps: int = 1, proximal: float | None = None, start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Federated averaging of a linear model over several rounds: (losses, parameters).

    Each round every client starts from the averaged parameters of the round before and takes
    ``local_steps`` gradient steps on its own mean squared error, or, with ``proximal``, goes to the minimum of that
    error plus proximal / 2 times the squared distance from the start. Parameters are then averaged by
    examples. A client's data enter only as summed cross products, which are computed once and written; each
    round works on these small matrices and is written too, so a lost executor repeats one round.

    ``losses`` has (round, loss, clients, examples), the weighted mean squared error of the parameters after that
    round, round 0 being the start (zeros unless given); ``parameters`` has (round, horizon, param, value).
    """
    products = materialize(cross_products(df, key, features, targets, squares=True), "federated-products")
    size = products.agg((F.max("i") + 1).alias("d"), (F.max("j") + 1).alias("w")).first()
    d, horizons = size["d"] or 0, (size["w"] or 0) - (size["d"] or 0)
    now = start if start is not None else (
        df.sparkSession.range(d * horizons).select((F.col("id") % horizons).cast("int").alias("horizon"), F.floor(F.col("id") / horizons).cast("int").alias("param"), F.lit(0.0).alias("value"))
    )

    def local(steps: int, part: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((d, horizons))
        given = part[part["i"] == -2]
        w[given["j"].to_numpy() // horizons, given["j"].to_numpy() % horizons] = given["v"].to_numpy()
        own = part[part["i"] >= 0]
        m = np.zeros((d, d + horizons))
        m[own["i"].to_numpy(), own["j"].to_numpy()] = own["v"].to_numpy()
        yy = part[(part["i"] == -1) & (part["j"] >= d)]["v"].sum()
        n = m[0, 0]
        a, b = m[:, :d] / n, m[:, d:] / n
        error = yy / n - 2 * (w * b).sum() + (w * (a @ w)).sum()
        if steps and proximal is not None:
            w = np.linalg.solve(2 * a + proximal * np.eye(d), 2 * b + proximal * w)
        elif steps:
            for _ in range(steps):
                w = w - rate * 2 * (a @ w - b)
        i, j = np.indices(w.shape)
        return pd.DataFrame({"n": int(round(n)), "error": error / horizons, "horizon": j.ravel().astype(np.int32), "param": i.ravel().astype(np.int32), "v": w.ravel()})

    kinds = "n long, error double, horizon int, param int, v double"
    clients = products.select("key").distinct()
    losses, written = None, None
    for number in range(rounds + 1):
        # the averaged parameters go to every client as rows of its own group
        sent = clients.crossJoin(now.select(F.lit(-2).alias("i"), (F.col("param") * horizons + F.col("horizon")).cast("int").alias("j"), F.col("value").alias("v")))
        steps = local_steps if number < rounds else 0
        done = materialize(
            products.select("key", "i", "j", "v").unionByName(sent).groupBy("key").applyInPandas(partial(local, steps), kinds), "federated-round"
        )
        first = done.where("horizon = 0 AND param = 0")
        loss = first.agg((F.sum(F.col("error") * F.col("n")) / F.sum("n")).alias("loss"), F.count(F.lit(1)).alias("clients"), F.sum("n").alias("examples"))
        loss = loss.select(F.lit(number).alias("round"), "loss", "clients", "examples")
        losses = loss if losses is None else losses.unionByName(loss)
        tagged = now.select(F.lit(number).alias("round"), "horizon", "param", "value")
        written = tagged if written is None else written.unionByName(tagged)
        now = done.groupBy("horizon", "param").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("value"))
    return losses, written
