"""Queries for folds, sampling, scoring, metrics, baseline models and training history."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import scalars as SC
from wattloom.functions.arrays import remainder_score
from wattloom.operators import folds as FO
from wattloom.operators import history as H
from wattloom.operators import labels as L
from wattloom.operators import metrics as M
from wattloom.operators import models as MD
from wattloom.operators import sampling as SA
from wattloom.operators import windows as WN
from wattloom.plans import tables as T
from wattloom.plans.registry import query
from wattloom.plans.series_queries import FUSED_SQL, LABELS_SQL, PARTS_SQL, SUPPLIER_SQL, WINDOWS_SQL, P, rd, supplier_series
from wattloom.plans.sqltext import fused_sql, labels_sql, r, trend_sql, windows_sql
from wattloom.session import materialize


def supplier_windows(spark, sf_dir):
    return WN.make_windows(supplier_series(spark, sf_dir), P)


def bare_windows(spark, sf_dir):
    """Window positions only: from series lengths, no window content."""
    per = supplier_series(spark, sf_dir).groupBy("grp", "building").agg(F.max("n").alias("n"))
    last = SC.window_count(F.col("n"), P.window, P.stride) - 1
    return per.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "grp", "building", "n", (F.col("k") * P.stride).alias("start")
    )


# ---- folds ----------------------------------------------------------------------------------


def folds_sql(extra: str = "") -> str:
    return f"""{WINDOWS_SQL},
spans AS (SELECT grp, building, max(start) + {P.window} AS e FROM wins GROUP BY 1, 2),
c AS (SELECT grp, building, floor(e * {P.initial_frac}::DOUBLE)::BIGINT AS c0 FROM spans),
cut AS (SELECT w.grp, w.building, w.start, f.fold, c0 - c0 % {P.stride} + f.fold * {P.val_horizon} AS cutoff
        FROM wins w JOIN c USING (grp, building), range({P.n_folds}) f(fold)),
folds AS (
  SELECT *, 'train' AS role FROM cut WHERE start + {P.window} <= cutoff {extra}
  UNION ALL SELECT *, 'val' FROM cut
  WHERE start + {P.backcast} >= cutoff AND start + {P.window} <= cutoff + {P.val_horizon})"""


FOLD_COLS = "grp, building, start, fold::INT AS fold, cutoff, role"


@query("fold_expanding", f"WITH {folds_sql()} SELECT {FOLD_COLS} FROM folds")
def fold_expanding(spark, sf_dir):
    return FO.rolling_origin(bare_windows(spark, sf_dir), P).drop("n")


@query("fold_sliding", f"WITH {folds_sql('AND start >= cutoff - 240')} SELECT {FOLD_COLS} FROM folds")
def fold_sliding(spark, sf_dir):
    return FO.rolling_origin(bare_windows(spark, sf_dir), P.with_(train_span=240), "sliding").drop("n")


@query(
    "fold_counts",
    f"""WITH {folds_sql()} SELECT fold::INT AS fold, count(*) FILTER (WHERE role = 'train') AS train,
       count(*) FILTER (WHERE role = 'val') AS val FROM folds GROUP BY 1 HAVING train > 0 AND val > 0""",
)
def fold_counts(spark, sf_dir):
    return FO.fold_counts(FO.rolling_origin(bare_windows(spark, sf_dir), P))


HOLD_SQL = f"""{WINDOWS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, building ORDER BY start DESC) AS back,
                  count(*) OVER (PARTITION BY grp, building) AS total FROM wins),
held AS (SELECT *, back <= greatest(1, floor(total * {P.val_frac}::DOUBLE)) AS tail FROM ranked)"""


@query("hold_tail", f"WITH {HOLD_SQL} SELECT grp, building, start, NOT tail AS in_train, tail AS in_val FROM held")
def hold_tail(spark, sf_dir):
    return FO.hold_out(bare_windows(spark, sf_dir), P).drop("n")


@query("hold_head_compat", f"WITH {HOLD_SQL} SELECT grp, building, start, NOT tail AS in_train, NOT tail AS in_val FROM held")
def hold_head_compat(spark, sf_dir):
    return FO.hold_out(bare_windows(spark, sf_dir), P, "head").drop("n")


# ---- sampling -------------------------------------------------------------------------------


def seeded(seed: int, *cols: str) -> str:
    return f"md5(concat_ws('|', {', '.join(f'{c}::VARCHAR' for c in cols)}, '{seed}'))"


@query(
    "smp_stratified",
    f"""WITH {WINDOWS_SQL},
sizes AS (SELECT grp, count(*) AS ng FROM wins GROUP BY 1),
quota AS (SELECT grp, greatest(1, round_even(200 * ng::DOUBLE / (SELECT sum(ng) FROM sizes), 0))::BIGINT AS q FROM sizes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {seeded(42, 'grp', 'building', 'start')}, building, start) AS rk FROM wins)
SELECT grp, building, start FROM ranked JOIN quota USING (grp)
WHERE rk <= q OR (SELECT sum(ng) FROM sizes) <= 200 ORDER BY {seeded(43, 'grp', 'building', 'start')}, grp, building, start LIMIT 200""",
)
def smp_stratified(spark, sf_dir):
    items = bare_windows(spark, sf_dir).select("grp", "building", "start")
    return SA.stratified(items, "grp", ["grp", "building", "start"], 200, 42)


@query(
    "smp_even",
    f"""WITH {WINDOWS_SQL},
k AS (SELECT grp, building, start, start // {P.stride} AS idx, count(*) OVER (PARTITION BY grp, building) AS total FROM wins),
places AS (SELECT grp, building, CASE WHEN i = 6 THEN total - 1 ELSE floor(i * ((total - 1) / 6.0::DOUBLE)) END::BIGINT AS idx
           FROM (SELECT DISTINCT grp, building, total FROM k), range(7) r(i))
SELECT DISTINCT grp, building, start FROM k LEFT JOIN places USING (grp, building, idx) WHERE places.idx IS NOT NULL OR total <= 7""",
)
def smp_even(spark, sf_dir):
    w = bare_windows(spark, sf_dir).withColumns(
        {"idx": (F.col("start") / P.stride).cast("long"), "total": SC.window_count(F.col("n"), P.window, P.stride)}
    )
    return SA.evenly_spaced(w, "idx", "total", 7).select("grp", "building", "start")


@query("smp_prefix", f"WITH {WINDOWS_SQL} SELECT grp, building, start FROM wins WHERE start < {5 * P.stride}")
def smp_prefix(spark, sf_dir):
    w = bare_windows(spark, sf_dir).withColumn("idx", F.col("start") / P.stride)
    return SA.prefix(w, "idx", 5).select("grp", "building", "start")


@query("smp_random", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {seeded(7, 'o_orderkey')}, o_orderkey LIMIT 100")
def smp_random(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return SA.random_k(o, ["o_orderkey"], 100, 7)


@query(
    "smp_random_group",
    f"""SELECT event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {seeded(3, 'event_id')}, event_id) <= 12""",
)
def smp_random_group(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_type", "event_id")
    return SA.random_k_per_group(e, ["event_type"], ["event_id"], 12, 3)


@query(
    "smp_equalize",
    f"""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {seeded(5, 'event_id')}, event_id) AS rk FROM events)
SELECT event_type, event_id FROM r WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))""",
)
def smp_equalize(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_type", "event_id")
    return SA.equalize(e, "event_type", ["event_id"], 5)


@query(
    "smp_posweight",
    f"""WITH {LABELS_SQL} SELECT grp, sum(label)::BIGINT AS positives, count(*) AS points,
       {r('(count(*) - greatest(sum(label), 1))::DOUBLE / greatest(sum(label), 1)')} AS pos_weight
FROM labels WHERE pos >= {P.backcast} GROUP BY 1""",
)
def smp_posweight(spark, sf_dir):
    labeled = L.label_series(supplier_series(spark, sf_dir), P)
    out = SA.pos_weight(labeled, "labels", P.backcast, ["grp"])
    return out.withColumn("pos_weight", rd(F.col("pos_weight")))


@query(
    "smp_numexamples",
    f"""WITH {WINDOWS_SQL}, c AS (SELECT grp, building, count(*) AS c FROM wins GROUP BY 1, 2)
SELECT grp, sum(least(c, 18))::BIGINT AS num_examples FROM c GROUP BY 1""",
)
def smp_numexamples(spark, sf_dir):
    return SA.num_examples(bare_windows(spark, sf_dir), "grp", ["building"], 18)


# ---- scoring --------------------------------------------------------------------------------

MOMENTS_SQL = f"""{PARTS_SQL},
m AS (SELECT grp, building, start, avg(trend) AS tm, stddev_pop(trend) AS ts, avg(season) AS sm, stddev_pop(season) AS ss
      FROM parts GROUP BY 1, 2, 3),
normed AS (SELECT p.*, tm, ts, sm, ss, (trend - tm) / (ts + 1e-8) AS tn, (season - sm) / (ss + 1e-8) AS sn
           FROM parts p JOIN m USING (grp, building, start))"""
NAIVE_SQL = f"""{MOMENTS_SQL},
naive AS (
  SELECT a.grp, a.building, a.start, a.pos - {P.backcast} AS h, a.tm, a.ts, a.sm, a.ss,
         a.tn AS tt, a.sn AS st, b.tn AS tp, b.sn AS sp
  FROM normed a JOIN normed b ON a.grp = b.grp AND a.building = b.building AND a.start = b.start
   AND b.pos = a.pos - {P.forecast}
  WHERE a.pos >= {P.backcast})"""


def normed_windows(spark, sf_dir):
    return WN.standardize(WN.decompose(supplier_windows(spark, sf_dir), P), P)


def naive_points(spark, sf_dir):
    """Seasonal-naive forecast of both parts, one row per window and step."""
    w = normed_windows(spark, sf_dir)
    z = F.arrays_zip(
        MD.seasonal_naive("trend_norm", P).alias("tp"), F.slice("trend_norm", P.backcast + 1, P.forecast).alias("tt"),
        MD.seasonal_naive("season_norm", P).alias("sp"), F.slice("season_norm", P.backcast + 1, P.forecast).alias("st"),
    )
    return w.select("grp", "building", "start", "stats.*", F.posexplode(z).alias("h", "v")).select(
        "grp", "building", "start", F.col("h").cast("long").alias("h"), "tm", "ts", "sm", "ss", "v.*"
    )


SCORE_SQL = f"""{MOMENTS_SQL},
prob AS (SELECT grp, building, t, avg(abs(sn) / (1 + abs(sn))) AS y_prob FROM normed WHERE pos >= {P.backcast} GROUP BY 1, 2, 3)"""


def with_scores(spark, sf_dir):
    """Windows with a stand-in probability per future step: the size of the remainder."""
    z = F.transform(
        F.slice("season_norm", P.backcast + 1, P.forecast), lambda v: F.abs(v) / (1 + F.abs(v))
    )
    return normed_windows(spark, sf_dir).withColumn("prob", z)


@query(
    "scr_fuse_prob",
    f"""WITH {FUSED_SQL},{SCORE_SQL[len(PARTS_SQL) + 1:]}
SELECT grp, building, t, {r('y_prob', 4)} AS y_prob, anomaly AS y_true FROM prob JOIN fused USING (grp, building, t)""",
)
def scr_fuse_prob(spark, sf_dir):
    """Mean probability of overlapping forecasts and the fused label of a step, from one pass over the windows."""
    out = L.label_fused(supplier_series(spark, sf_dir), P, score=remainder_score).where("y_prob IS NOT NULL")
    return out.select("grp", "building", "t", rd(F.col("y_prob"), 4).alias("y_prob"), F.col("anomaly").alias("y_true"))


@query(
    "scr_fuse_windows",
    f"""WITH {FUSED_SQL},{SCORE_SQL[len(PARTS_SQL) + 1:]}
SELECT grp, building, t, {r('y_prob', 4)} AS y_prob, anomaly AS y_true FROM prob JOIN fused USING (grp, building, t)""",
)
def scr_fuse_windows(spark, sf_dir):
    """The same from a table of scored windows, as a stored forecast has them."""
    scored = with_scores(spark, sf_dir)
    out = M.with_truth(M.fuse_probabilities(scored, P), L.fuse(L.label_windows(scored, P), P))
    return out.select("grp", "building", "t", rd(F.col("y_prob"), 4).alias("y_prob"), "y_true")


P_OVERLAP = P.with_(stride=P.forecast // 2)
OVERLAP_SQL = f"{SUPPLIER_SQL},{windows_sql(P_OVERLAP)},{trend_sql(P_OVERLAP)},{labels_sql(P_OVERLAP)},{fused_sql()}"


@query(
    "scr_fuse_overlap",
    f"""WITH {OVERLAP_SQL},{SCORE_SQL[len(PARTS_SQL) + 1:]}
SELECT grp, building, t, {r('y_prob', 4)} AS y_prob, anomaly AS y_true FROM prob JOIN fused USING (grp, building, t)""",
)
def scr_fuse_overlap(spark, sf_dir):
    """Forecasts that overlap by half, so most steps have the mean of two."""
    out = L.label_fused(supplier_series(spark, sf_dir), P_OVERLAP, score=remainder_score).where("y_prob IS NOT NULL")
    return out.select("grp", "building", "t", rd(F.col("y_prob"), 4).alias("y_prob"), F.col("anomaly").alias("y_true"))


SCORED_SQL = "scored AS (SELECT event_type, (event_type = 'error')::INT AS y_true, value / (1 + value) AS y_prob FROM events)"
CONF_SQL = f"""{SCORED_SQL},
conf AS (
  SELECT count(*) FILTER (WHERE y_true = 1 AND y_prob >= 0.9) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_prob < 0.9) AS tn,
         count(*) FILTER (WHERE y_true = 0 AND y_prob >= 0.9) AS fp, count(*) FILTER (WHERE y_true = 1 AND y_prob < 0.9) AS fn
  FROM scored)"""


def scored_events(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return e.select(
        "user_id", (F.col("event_type") == "error").cast("int").alias("y_true"),
        (F.col("value") / (1 + F.col("value"))).alias("y_prob"),
    )


@query("met_confusion", f"WITH {CONF_SQL} SELECT tp, tn, fp, fn FROM conf")
def met_confusion(spark, sf_dir):
    return M.confusion(scored_events(spark, sf_dir), 0.9)


@query(
    "met_class",
    f"""WITH {CONF_SQL} SELECT tp + tn + fp + fn AS n_points, {r('tp::DOUBLE / (tp + fp)')} AS precision,
       {r('tp::DOUBLE / (tp + fn)')} AS recall, {r('2.0 * tp / (2 * tp + fp + fn)')}::DOUBLE AS f1,
       {r('(tp + tn)::DOUBLE / (tp + tn + fp + fn)')} AS accuracy, {r('(tp + fn)::DOUBLE / (tp + tn + fp + fn)')} AS anomaly_rate
FROM conf""",
)
def met_class(spark, sf_dir):
    out = M.classification(M.confusion(scored_events(spark, sf_dir), 0.9))
    cols = ("precision", "recall", "f1", "accuracy", "anomaly_rate")
    return out.select("n_points", *[rd(F.col(c)).alias(c) for c in cols])


@query(
    "met_confusion_pct",
    f"""WITH {CONF_SQL}, long AS (SELECT unnest(['TN', 'FP', 'FN', 'TP']) AS quadrant, unnest([tn, fp, fn, tp]) AS points FROM conf)
SELECT quadrant, points, {r('points::DOUBLE / sum(points) OVER ()')} AS share FROM long""",
)
def met_confusion_pct(spark, sf_dir):
    out = M.confusion_share(M.confusion(scored_events(spark, sf_dir), 0.9))
    return out.withColumn("share", rd(F.col("share")))


@query(
    "met_auroc",
    f"""WITH {SCORED_SQL}, ranked AS (
  SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2.0::DOUBLE AS rk FROM scored),
c AS (SELECT sum(rk) FILTER (WHERE y_true = 1) AS rs, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true = 0) AS q FROM ranked)
SELECT {r('(rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q)')} AS auroc, p AS positives, q AS negatives FROM c""",
)
def met_auroc(spark, sf_dir):
    return M.auroc(scored_events(spark, sf_dir)).withColumn("auroc", rd(F.col("auroc")))


# pairs: each value of a series against the value seven rows before it
PAIRS_SQL = f"""{SUPPLIER_SQL},
pairs AS (SELECT a.grp, a.building, a.t, a.t % 7 AS h, b.energy AS pred, a.energy AS obs
          FROM series a JOIN series b ON a.grp = b.grp AND a.building = b.building AND a.t = b.t + 7)"""


def pairs(spark, sf_dir):
    s = supplier_series(spark, sf_dir).select("grp", "building", "t", "energy")
    earlier = s.select("grp", "building", (F.col("t") + 7).alias("t"), F.col("energy").alias("pred"))
    return s.join(earlier, ["grp", "building", "t"]).select(
        "grp", "building", "t", (F.col("t") % 7).alias("h"), "pred", F.col("energy").alias("true")
    )


@query(
    "met_cvrmse",
    f"""WITH {PAIRS_SQL} SELECT grp, building, {r('sqrt(sum((pred - obs) ** 2) / count(*)) / (sum(obs) / count(*) + 1e-8)')} AS cvrmse
FROM pairs GROUP BY 1, 2""",
)
def met_cvrmse(spark, sf_dir):
    e = M.cvrmse(F.col("pred"), F.col("true"))
    return pairs(spark, sf_dir).groupBy("grp", "building").agg(rd(e).alias("cvrmse"))


@query(
    "met_nrmse",
    f"""WITH {PAIRS_SQL} SELECT grp, building,
       {r('100 / (avg(obs) + 1e-8) * sqrt(sum((pred - obs) ** 2) / (24 * (count(*) // 24)))')} AS nrmse,
       {r('sqrt(avg((pred - obs) ** 2)) / avg(obs)')} AS nrmse_mean,
       {r('sqrt(avg((pred - obs) ** 2)) / (max(obs) - min(obs) + 1e-8)')} AS nrmse_range
FROM pairs GROUP BY 1, 2""",
)
def met_nrmse(spark, sf_dir):
    a, b = F.col("pred"), F.col("true")
    return pairs(spark, sf_dir).groupBy("grp", "building").agg(
        rd(M.nrmse(a, b)).alias("nrmse"), rd(M.nrmse_mean(a, b)).alias("nrmse_mean"),
        rd(M.nrmse_range(a, b)).alias("nrmse_range"),
    )


BASIC_SQL = f"""{r('avg(abs(pred - obs))')} AS mae, {r('avg((pred - obs) ** 2)')} AS mse, {r('sqrt(avg((pred - obs) ** 2))')} AS rmse,
 {r('avg(abs((pred - obs) / obs))')} AS mape, {r('avg(((pred - obs) / obs) ** 2)')} AS mspe"""


@query("met_basic", f"WITH {PAIRS_SQL} SELECT grp, building, {BASIC_SQL} FROM pairs GROUP BY 1, 2")
def met_basic(spark, sf_dir):
    a, b = F.col("pred"), F.col("true")
    fns = {"mae": M.mae, "mse": M.mse, "rmse": M.rmse, "mape": M.mape, "mspe": M.mspe}
    return pairs(spark, sf_dir).groupBy("grp", "building").agg(*[rd(f(a, b)).alias(n) for n, f in fns.items()])


@query("met_bundle", f"WITH {PAIRS_SQL} SELECT {BASIC_SQL}, {r('sqrt(avg((pred - obs) ** 2)) / avg(obs)')} AS nrmse FROM pairs")
def met_bundle(spark, sf_dir):
    out = M.bundle(pairs(spark, sf_dir))
    return out.select(*[rd(F.col(c)).alias(c) for c in out.columns])


@query(
    "met_rse_corr",
    f"""WITH {PAIRS_SQL},
c AS (SELECT grp, avg(c) AS corr FROM (SELECT grp, h, corr(pred, obs) AS c FROM pairs GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT grp, sqrt(sum((obs - pred) ** 2)) / sqrt(var_pop(obs) * count(*)) AS rse FROM pairs GROUP BY 1)
SELECT grp, {r('rse')} AS rse, {r('corr')} AS corr FROM e JOIN c USING (grp)""",
)
def met_rse_corr(spark, sf_dir):
    p = pairs(spark, sf_dir)
    rse = p.groupBy("grp").agg(rd(M.rse(F.col("pred"), F.col("true"))).alias("rse"))
    corr = M.correlation_over_horizons(p, "h", ["grp"]).withColumn("corr", rd(F.col("corr")))
    return rse.join(corr, "grp")


BUILDING_SQL = f"""{NAIVE_SQL},
pts2 AS (
  SELECT *, tp * (ts + 1e-8) + tm + sp * (ss + 1e-8) + sm AS pred, tt * (ts + 1e-8) + tm + st * (ss + 1e-8) + sm AS obs FROM naive),
l AS (SELECT grp, building, start, avg((tp - tt) ** 2) AS lt, avg((sp - st) ** 2) AS ls FROM naive GROUP BY 1, 2, 3),
ml AS (SELECT grp, building, avg(CASE WHEN lt + ls = 0 THEN 0 ELSE ls / (lt + ls) * lt + lt / (lt + ls) * ls END) AS avg_test_loss FROM l GROUP BY 1, 2),
mb AS (
  SELECT grp, building, sqrt(avg((pred - obs) ** 2)) / (avg(obs) + 1e-8) AS cvrmse,
         100 / (avg(obs) + 1e-8) * sqrt(sum((pred - obs) ** 2) / (24 * (count(*) // 24))) AS nrmse,
         avg(abs(pred - obs)) AS mae, avg(abs(tp + sp - tt - st)) AS mae_norm,
         avg((pred - obs) ** 2) AS mse, avg((tp + sp - tt - st) ** 2) AS mse_norm
  FROM pts2 GROUP BY 1, 2)"""
BUILDING_COLS = ("cvrmse", "nrmse", "mae", "mae_norm", "mse", "mse_norm", "avg_test_loss")


@query(
    "met_building",
    f"""WITH {BUILDING_SQL} SELECT grp, building, {', '.join(f'{r(c, 4)} AS {c}' for c in BUILDING_COLS)}
FROM mb JOIN ml USING (grp, building)""",
)
def met_building(spark, sf_dir):
    out = M.building_metrics(naive_points(spark, sf_dir))
    return out.select("grp", "building", *[rd(F.col(c), 4).alias(c) for c in BUILDING_COLS])


REGION_COLS = ("nrmse", "mae", "mae_norm", "mse", "mse_norm")


@query(
    "met_region",
    f"WITH {BUILDING_SQL} SELECT grp, {', '.join(f'{r(f'quantile_cont({c}, 0.5)', 4)} AS {c}' for c in REGION_COLS)} FROM mb GROUP BY 1",
)
def met_region(spark, sf_dir):
    out = M.region_medians(M.building_metrics(naive_points(spark, sf_dir)))
    return out.select("grp", *[rd(F.col(c), 4).alias(c) for c in REGION_COLS])


@query(
    "loss_dynamic",
    f"""WITH {BUILDING_SQL} SELECT grp, building, start, {r('lt', 4)} AS loss_trend, {r('ls', 4)} AS loss_season,
       {r('CASE WHEN lt + ls = 0 THEN 0 ELSE 2 * lt * ls / (lt + ls) END', 4)} AS loss FROM l""",
)
def loss_dynamic(spark, sf_dir):
    sq = lambda a, b: F.avg(F.pow(F.col(a) - F.col(b), 2))
    per = naive_points(spark, sf_dir).groupBy("grp", "building", "start").agg(sq("tp", "tt").alias("lt"), sq("sp", "st").alias("ls"))
    return per.select(
        "grp", "building", "start", rd(F.col("lt"), 4).alias("loss_trend"), rd(F.col("ls"), 4).alias("loss_season"),
        rd(SC.dynamic_loss(F.col("lt"), F.col("ls")), 4).alias("loss"),
    )


@query(
    "loss_terms",
    f"""WITH {SCORED_SQL}, {PAIRS_SQL},
reg AS (SELECT avg((pred - obs) ** 2) AS mse,
               avg(CASE WHEN abs(pred - obs) <= 1 THEN 0.5::DOUBLE * (pred - obs) ** 2 ELSE abs(pred - obs) - 0.5::DOUBLE END) AS huber FROM pairs),
pw AS (SELECT (count(*) - sum(y_true))::DOUBLE / greatest(sum(y_true), 1) AS w FROM scored),
cls AS (SELECT avg(-(w * y_true * ln(y_prob) + (1 - y_true) * ln(1 - y_prob))) AS bce FROM scored, pw)
SELECT {r('mse')} AS mse, {r('huber')} AS huber, {r('bce')} AS bce, {r('mse + 1.0::DOUBLE * bce')} AS joint FROM reg, cls""",
)
def loss_terms(spark, sf_dir):
    scored = scored_events(spark, sf_dir)
    y = F.col("y_true")
    pos = F.greatest(F.sum("y_true"), F.lit(1))
    weight = scored.agg((F.count(F.lit(1)) - F.sum("y_true")) / pos).scalar()
    cls = scored.agg(F.avg(SC.bce(F.col("y_prob"), y, weight))).scalar()
    e = F.col("pred") - F.col("true")
    reg = pairs(spark, sf_dir).agg(F.avg(e * e).alias("mse"), F.avg(SC.huber(e)).alias("huber"))
    return reg.withColumn("bce", cls).select(
        rd(F.col("mse")).alias("mse"), rd(F.col("huber")).alias("huber"), rd(F.col("bce")).alias("bce"),
        rd(F.col("mse") + P.lambda_cls * F.col("bce")).alias("joint"),
    )


# ---- baseline models ------------------------------------------------------------------------


def normed_xy(spark, sf_dir):
    return WN.backcast_forecast(normed_windows(spark, sf_dir), ["trend_norm", "season_norm"], P)


@query("fit_forecast")
def fit_forecast(spark, sf_dir):
    """Least squares per part and horizon on the first 70 % of each building's windows; mean squared error on the rest beside seasonal-naive."""
    xy = FO.hold_out(normed_xy(spark, sf_dir).withColumn("one", F.lit(0).cast("long")), P.with_(val_frac=0.3))
    train = xy.where("in_train")
    models = {
        c: MD.predictor(MD.coefficient_matrices(MD.fit(train, "one", f"{c}_in", f"{c}_out"))) for c in ("trend_norm", "season_norm")
    }
    scored = xy.where("in_val").select(
        models["trend_norm"]("one", "trend_norm_in").alias("tp"), models["season_norm"]("one", "season_norm_in").alias("sp"),
        F.col("trend_norm_out").alias("tt"), F.col("season_norm_out").alias("st"),
        MD.seasonal_naive("trend_norm", P).alias("tnaive"), MD.seasonal_naive("season_norm", P).alias("snaive"),
    )
    pts = scored.select(F.posexplode(F.arrays_zip("tp", "sp", "tt", "st", "tnaive", "snaive")).alias("h", "v"))
    sq = lambda a, b: F.avg(F.pow(F.col(f"v.{a}") - F.col(f"v.{b}"), 2))
    return pts.groupBy("h").agg(
        sq("tp", "tt").alias("trend_mse"), sq("sp", "st").alias("season_mse"),
        sq("tnaive", "tt").alias("trend_naive_mse"), sq("snaive", "st").alias("season_naive_mse"),
    )


@query(
    "fit_naive",
    f"""WITH {NAIVE_SQL} SELECT h::INT AS h, {r('avg((tp - tt) ** 2)', 4)} AS trend_naive_mse, {r('avg((sp - st) ** 2)', 4)} AS season_naive_mse
FROM naive GROUP BY 1""",
)
def fit_naive(spark, sf_dir):
    sq = lambda a, b: rd(F.avg(F.pow(F.col(a) - F.col(b), 2)), 4)
    return naive_points(spark, sf_dir).groupBy(F.col("h").cast("int").alias("h")).agg(
        sq("tp", "tt").alias("trend_naive_mse"), sq("sp", "st").alias("season_naive_mse")
    )


@query("fit_classify")
def fit_classify(spark, sf_dir):
    """Weighted logistic regression on the first 70 % of each building's windows; scores on the rest. Labels are the fused ones on both sides."""
    fused = L.label_reprojected(supplier_series(spark, sf_dir), P).select("grp", "building", "start", "labels_fused")
    held = FO.hold_out(normed_windows(spark, sf_dir).join(fused, ["grp", "building", "start"]), P.with_(val_frac=0.3))
    # windows are cut and labelled once; counting, fitting and scoring read the written points
    points = materialize(MD.future_points(held, "labels_fused", P, ("grp", "building", "in_train", "in_val")), "points")
    model = MD.fit_classifier(points.where("in_train"))
    scored = MD.classify(model, points.where("in_val"))
    fused = scored.groupBy("grp", "building", (F.col("start") + P.backcast + F.col("h")).alias("t")).agg(
        F.avg("y_prob").alias("y_prob"), F.max("label").cast("int").alias("y_true")
    )
    return M.classification(M.confusion(fused))


@query("fit_rolling")
def fit_rolling(spark, sf_dir):
    folds = FO.rolling_origin(normed_windows(spark, sf_dir), P)
    per = MD.rolling_fit(folds, P)
    return MD.fold_summary(per)


@query("fed_weighted_params")
def fed_weighted_params(spark, sf_dir):
    """One local fit per device (region), parameters averaged by number of windows."""
    xy = normed_xy(spark, sf_dir)
    devices = T.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), (F.col("r_regionkey") + 1).alias("device"))
    local = MD.fit(xy.join(devices, "grp"), "device", "season_norm_in", "season_norm_out")
    return MD.federated_average(local)


FED_IN, FED_OUT, FED_RATE = 5, 3, 0.05
FED_SQL = f"""WITH RECURSIVE {MOMENTS_SQL},
cells AS (
  SELECT r_regionkey + 1 AS client, building, start, pos - {P.backcast - FED_IN} + 1 AS c, sn AS v
  FROM normed JOIN region ON r_name = grp WHERE pos BETWEEN {P.backcast - FED_IN} AND {P.backcast + FED_OUT - 1}
  UNION ALL SELECT DISTINCT r_regionkey + 1, building, start, 0, 1.0 FROM normed JOIN region ON r_name = grp),
prod AS (SELECT x.client, x.c AS i, y.c AS j, sum(x.v * y.v) AS v FROM cells x JOIN cells y USING (client, building, start) GROUP BY 1, 2, 3),
size AS (SELECT client, v AS n FROM prod WHERE i = 0 AND j = 0),
walk AS (
  SELECT 0 AS s, client, h, i, 0.0::DOUBLE AS w FROM size, range({FED_OUT}) t(h), range({FED_IN + 1}) u(i)
  UNION ALL
  SELECT s + 1, client, h, i, CASE WHEN s % 2 = 1 THEN sum(w * n) OVER (PARTITION BY h, i) / sum(n) OVER (PARTITION BY h, i) ELSE w END
  FROM (SELECT any_value(k.s) AS s, k.client, k.h, a.i, any_value(size.n) AS n,
               any_value(o.w) - {FED_RATE} * 2 * (sum(a.v * k.w) - any_value(b.v)) / any_value(size.n) AS w
        FROM walk k JOIN prod a ON a.client = k.client AND a.j = k.i AND a.i <= {FED_IN} JOIN walk o ON o.client = k.client AND o.h = k.h AND o.i = a.i
        JOIN prod b ON b.client = k.client AND b.i = a.i AND b.j = k.h + {FED_IN + 1} JOIN size ON size.client = k.client
        WHERE k.s < 8 GROUP BY k.client, k.h, a.i)),
after AS (SELECT s // 2 AS round, client, h, i, w FROM walk WHERE s % 2 = 0),
error AS (
  SELECT round, p.client, sum(e) AS e FROM (
    SELECT x.round, x.client, sum(x.w * y.w * a.v) AS e FROM after x JOIN after y ON y.round = x.round AND y.client = x.client AND y.h = x.h
      JOIN prod a ON a.client = x.client AND a.i = x.i AND a.j = y.i GROUP BY 1, 2
    UNION ALL SELECT x.round, x.client, -2 * sum(x.w * b.v) FROM after x JOIN prod b ON b.client = x.client AND b.i = x.i AND b.j = x.h + {FED_IN + 1} GROUP BY 1, 2
    UNION ALL SELECT r.round, c.client, sum(c.v) FROM (SELECT DISTINCT round FROM after) r, prod c WHERE c.i = c.j AND c.i > {FED_IN} GROUP BY 1, 2) p GROUP BY 1, 2)
SELECT round::INT AS round, {r(f'sum(e) / {FED_OUT} / sum(n)')} AS loss, count(*) AS clients, sum(n)::BIGINT AS examples
FROM error JOIN size USING (client) GROUP BY 1"""


@query("fed_rounds", FED_SQL)
def fed_rounds(spark, sf_dir):
    """Loss per round of federated averaging over four rounds, two local gradient steps each, one client per region."""
    windows = normed_windows(spark, sf_dir).select(
        "grp", F.slice("season_norm", P.backcast - FED_IN + 1, FED_IN).alias("x"), F.slice("season_norm", P.backcast + 1, FED_OUT).alias("y")
    )
    devices = T.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), (F.col("r_regionkey") + 1).alias("device"))
    losses, _ = MD.federated_rounds(windows.join(devices, "grp"), "device", "x", "y", rounds=4, rate=FED_RATE, local_steps=2)
    return losses.withColumn("loss", rd(F.col("loss")))


# ---- federated and history ------------------------------------------------------------------

CLIENT_SQL = """client AS (
  SELECT o_orderpriority AS client, (year(o_orderdate) - 1994)::INT AS round, 'price' AS metric,
         count(*) AS num_examples, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""


def client_metrics(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("client"), (F.year("o_orderdate") - 1994).alias("round"), F.lit("price").alias("metric")
    ).agg(F.count(F.lit(1)).alias("num_examples"), F.avg("o_totalprice").alias("value"))


WEIGHTED_SQL = f"""{CLIENT_SQL},
agg AS (SELECT round, metric, sum(value * num_examples) / sum(num_examples) AS value, sum(num_examples)::BIGINT AS num_examples
        FROM client GROUP BY 1, 2)"""


@query("fed_weighted_metrics", f"WITH {WEIGHTED_SQL} SELECT round, metric, {r('value', 4)} AS value, num_examples FROM agg")
def fed_weighted_metrics(spark, sf_dir):
    return H.weighted_metrics(client_metrics(spark, sf_dir)).withColumn("value", rd(F.col("value"), 4))


@query(
    "fed_epoch_curve",
    f"""WITH m AS (SELECT o_orderpriority AS client, year(o_orderdate) - 1994 AS round, month(o_orderdate) AS mo, avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2, 3),
e AS (SELECT *, row_number() OVER (PARTITION BY client, round ORDER BY mo) - 1 AS epoch FROM m)
SELECT client, round::INT AS round, epoch::INT AS epoch, {r('loss', 4)} AS loss, ((round - 1) * 12 + epoch)::INT AS global_step FROM e""",
)
def fed_epoch_curve(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    monthly = o.groupBy(
        F.col("o_orderpriority").alias("client"), (F.year("o_orderdate") - 1994).alias("round"), F.month("o_orderdate").alias("mo")
    ).agg(F.avg("o_totalprice").alias("loss"))
    # at most twelve months per (client, round)
    curves = monthly.groupBy("client", "round").agg(F.array_sort(F.collect_list(F.struct("mo", "loss"))).alias("m"))
    out = H.epoch_curve(curves.select("client", "round", F.col("m.loss").alias("curve")), 12)
    return out.withColumn("loss", rd(F.col("loss"), 4))


@query(
    "fed_best_round",
    f"""WITH {WEIGHTED_SQL}, b AS (SELECT *, min(value) OVER (PARTITION BY metric ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM agg)
SELECT round, metric, {r('value', 4)} AS value FROM b WHERE prev IS NULL OR value < prev""",
)
def fed_best_round(spark, sf_dir):
    best = H.best_rounds(H.weighted_metrics(client_metrics(spark, sf_dir)), ["metric"], "round", "value")
    return best.select("round", "metric", rd(F.col("value"), 4).alias("value"))


@query(
    "fed_overhead",
    f"""WITH c AS (SELECT o_orderstatus AS run, o_orderpriority AS client, sum(o_totalprice) AS wall FROM orders GROUP BY 1, 2),
s AS (SELECT o_orderstatus AS run, count(DISTINCT year(o_orderdate)) AS rounds, sum(o_totalprice) AS wall FROM orders GROUP BY 1),
m AS (SELECT run, max(wall) AS slow FROM c GROUP BY 1)
SELECT run, {r('wall / rounds', 2)} AS server_s_per_round, {r('slow / rounds', 2)} AS slowest_s_per_round, {r('(wall - slow) / rounds', 2)} AS overhead_s
FROM s JOIN m USING (run)""",
)
def fed_overhead(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").withColumn("run", F.col("o_orderstatus"))
    server = o.groupBy("run").agg(F.countDistinct(F.year("o_orderdate")).alias("rounds"), F.sum("o_totalprice").alias("wall_s"))
    clients = o.groupBy("run", F.col("o_orderpriority").alias("client")).agg(F.sum("o_totalprice").alias("wall_s"))
    out = H.overhead(server, clients)
    return out.select("run", *[rd(F.col(c), 2).alias(c) for c in out.columns if c != "run"])


MONTHLY_SQL = """monthly AS (
  SELECT o_orderpriority AS tag, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INT AS epoch, avg(o_totalprice) AS loss
  FROM orders GROUP BY 1, 2)"""


def monthly_loss(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    epoch = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return o.groupBy(F.col("o_orderpriority").alias("tag"), epoch.alias("epoch")).agg(F.avg("o_totalprice").alias("loss"))


@query(
    "hist_earlystop",
    f"""WITH {MONTHLY_SQL},
b AS (SELECT *, min(loss) OVER w AS best, min(loss) OVER (PARTITION BY tag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM monthly WINDOW w AS (PARTITION BY tag ORDER BY epoch)),
i AS (SELECT *, prev IS NULL OR loss < prev - 10.0 AS improved FROM b),
g AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY tag ORDER BY epoch) AS wait FROM i),
s AS (SELECT *, min(CASE WHEN wait >= 6 THEN epoch END) OVER (PARTITION BY tag) AS stop FROM g)
SELECT tag, epoch, {r('loss', 4)} AS loss, {r('best', 4)} AS best, improved, wait::INT AS wait, wait >= 6 AS stops
FROM s WHERE stop IS NULL OR epoch <= stop""",
)
def hist_earlystop(spark, sf_dir):
    out = H.early_stop(monthly_loss(spark, sf_dir), ["tag"], "epoch", "loss", patience=6, min_delta=10.0)
    return out.select(
        "tag", "epoch", rd(F.col("loss"), 4).alias("loss"), rd(F.col("best"), 4).alias("best"), "improved", "wait", "stops"
    )


@query(
    "hist_earlystop_steps",
    f"""WITH RECURSIVE {MONTHLY_SQL},
o AS (SELECT tag, epoch, loss, row_number() OVER (PARTITION BY tag ORDER BY epoch) AS k FROM monthly),
s AS (SELECT tag, epoch, loss, k, loss AS best, true AS improved, 0 AS wait FROM o WHERE k = 1
      UNION ALL
      SELECT o.tag, o.epoch, o.loss, o.k, CASE WHEN o.loss <= s.best - 2.0 THEN o.loss ELSE s.best END, o.loss <= s.best - 2.0,
             CASE WHEN o.loss <= s.best - 2.0 THEN 0 ELSE s.wait + 1 END
      FROM s JOIN o ON o.tag = s.tag AND o.k = s.k + 1 WHERE s.wait < 3)
SELECT tag, epoch, {r('loss', 4)} AS loss, {r('best', 4)} AS best, improved, wait, wait >= 3 AS stops FROM s""",
)
def hist_earlystop_steps(spark, sf_dir):
    """The rule whose best moves only when an epoch improves."""
    out = H.early_stop_stepwise(monthly_loss(spark, sf_dir), ["tag"], "epoch", "loss", patience=3, min_delta=2.0)
    return out.withColumns({c: rd(F.col(c), 4) for c in ("loss", "best")})


@query(
    "hist_lr",
    f"""WITH {MONTHLY_SQL} SELECT tag, epoch, 0.001::DOUBLE * 0.5::DOUBLE ** (epoch - 1) AS halved,
  CASE WHEN epoch >= 20 THEN 5e-8 WHEN epoch >= 15 THEN 1e-7 WHEN epoch >= 10 THEN 5e-7 WHEN epoch >= 8 THEN 1e-6
       WHEN epoch >= 6 THEN 5e-6 WHEN epoch >= 4 THEN 1e-5 WHEN epoch >= 2 THEN 5e-5 ELSE 0.001::DOUBLE END AS stepped
FROM monthly""",
)
def hist_lr(spark, sf_dir):
    m = monthly_loss(spark, sf_dir)
    stepped = H.effective_rate(m, ["tag"], "epoch", 0.001).withColumnRenamed("lr", "stepped")
    return stepped.select("tag", "epoch", H.learning_rate(F.col("epoch"), 0.001).alias("halved"), "stepped")
