"""Queries for cleaning, splitting, windows, decomposition and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions.arrays import unscale_array
from wattloom.operators import clean as C
from wattloom.operators import labels as L
from wattloom.operators import splitting as S
from wattloom.operators import windows as WN
from wattloom.plans import tables as T
from wattloom.plans.registry import query
from wattloom.plans.sqltext import OFF_HALF, fused_sql, labels_sql, r, trend_sql, windows_sql

P = T.SUPPLIER
PW = T.SUPPLIER_WIDE
PN = T.NATION


def rd(c, digits: int = 6):
    return F.round(c + F.lit(float(f"{OFF_HALF * 10.0**-digits:.3e}")), digits) + F.lit(0.0)


def supplier_series(spark, sf_dir, p=P):
    """Cleaned daily series per supplier. The view has one row per day, so dedup is skipped."""
    return C.zero_fill(C.min_length(C.index_series(T.daily(spark, sf_dir), p=p), p.min_len))


def nation_series(spark, sf_dir, p=PN):
    return C.min_length(C.index_series(T.daily(spark, sf_dir, "nation"), p=p), p.min_len)


SUPPLIER_SQL = f"{T.daily_sql()},{T.indexed_sql('daily', P.min_len)}"
WIDE_SQL = f"{T.daily_sql()},{T.indexed_sql('daily', PW.min_len)}"
NATION_SQL = f"{T.daily_sql('nation')},{T.indexed_sql('daily', PN.min_len)}"
DEDUP_SQL = f"""{T.RAW_EVENTS_SQL},
dedup AS (SELECT grp, building, ts, arg_min_null(energy, ord) AS energy FROM raw_events GROUP BY 1, 2, 3)"""
WINDOWS_SQL = f"{SUPPLIER_SQL},{windows_sql(P)}"
PARTS_SQL = f"{WINDOWS_SQL},{trend_sql(P)}"
LABELS_SQL = f"{PARTS_SQL},{labels_sql(P)}"
FUSED_SQL = f"{LABELS_SQL},{fused_sql()}"
WIDE_FUSED_SQL = f"{WIDE_SQL},{windows_sql(PW)},{trend_sql(PW)},{labels_sql(PW)},{fused_sql()}"


# ---- cleaning -------------------------------------------------------------------------------


@query("clean_dedup", f"WITH {DEDUP_SQL} SELECT grp, building, ts, energy FROM dedup")
def clean_dedup(spark, sf_dir):
    return C.dedup(T.raw_events(spark, sf_dir), ["ord"])


@query("clean_trim", f"WITH {DEDUP_SQL},{T.indexed_sql('dedup')} SELECT grp, building, ts, energy, t, n FROM series")
def clean_trim(spark, sf_dir):
    series = C.index_series(C.dedup(T.raw_events(spark, sf_dir), ["ord"]), p=T.HOURLY)
    return series.select("grp", "building", "ts", "energy", "t", "n")


CONCAT_SQL = f"""{T.RAW_EVENTS_SQL},
parts AS (SELECT *, 1 AS part FROM raw_events
          UNION ALL SELECT grp, building, ts + INTERVAL 30 DAY, energy + 1, ord, 2 FROM raw_events),
dedup AS (SELECT grp, building, ts, arg_min_null(energy, (part, ord)) AS energy FROM parts GROUP BY 1, 2, 3),
{T.indexed_sql('dedup', 200)}"""


@query("clean_concat", f"WITH {CONCAT_SQL} SELECT grp, building, t, n, {r('energy')} AS energy FROM series")
def clean_concat(spark, sf_dir):
    """Two parts of every building, the second 30 days later, cleaned as one series."""
    raw = T.raw_events(spark, sf_dir)
    later = raw.withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 30 DAYS"), "energy": F.col("energy") + 1}
    )
    both = raw.withColumn("part", F.lit(1)).unionByName(later.withColumn("part", F.lit(2)))
    out = C.clean(both, ["part", "ord"], p=T.HOURLY)
    return out.select("grp", "building", "t", "n", rd(F.col("energy")).alias("energy"))


@query(
    "clean_minlen",
    f"WITH {NATION_SQL} SELECT grp, building, count(*) AS rows_kept, sum(energy)::DOUBLE AS energy FROM series GROUP BY 1, 2",
)
def clean_minlen(spark, sf_dir):
    return nation_series(spark, sf_dir).groupBy("grp", "building").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.sum("energy").alias("energy")
    )


@query("clean_zero", f"WITH {T.RAW_EVENTS_SQL} SELECT grp, building, ord, coalesce(energy, 0) AS energy FROM raw_events")
def clean_zero(spark, sf_dir):
    return C.zero_fill(T.raw_events(spark, sf_dir)).select("grp", "building", "ord", "energy")


# ---- splits ---------------------------------------------------------------------------------

TEMPORAL_SQL = f"""{NATION_SQL},
cuts AS (SELECT *, floor(n * {PN.train_frac}::DOUBLE)::BIGINT AS cut FROM series),
splits AS (
  SELECT * FROM (
    SELECT grp, building, ts, energy, CASE WHEN t < cut THEN 'train' ELSE 'test' END AS split,
           CASE WHEN t < cut THEN t ELSE t - cut END AS t, CASE WHEN t < cut THEN cut ELSE n - cut END AS n
    FROM cuts) WHERE n >= {PN.window})"""


@query("split_temporal", f"WITH {TEMPORAL_SQL} SELECT grp, building, split, ts, t, n, energy FROM splits")
def split_temporal(spark, sf_dir):
    out = S.temporal(nation_series(spark, sf_dir), PN)
    return out.select("grp", "building", "split", "ts", "t", "n", "energy")


HASH_BUCKET_SQL = """(
  (('0x' || substr(h, 1, 15))::BIGINT % 100 * {a} + ('0x' || substr(h, 16, 15))::BIGINT % 100 * {b}
   + ('0x' || substr(h, 31, 2))::BIGINT) % 100)""".format(a=pow(16, 17, 100), b=pow(16, 2, 100))


@query(
    "split_hash",
    f"""WITH {SUPPLIER_SQL}, hashed AS (SELECT *, md5(grp || ':' || building) AS h FROM series WHERE n >= {P.window})
SELECT grp, building, CASE WHEN {HASH_BUCKET_SQL} < 85 THEN 'train' ELSE 'test' END AS split,
       count(*) AS row_count, sum(energy)::DOUBLE AS energy
FROM hashed GROUP BY ALL""",
)
def split_hash(spark, sf_dir):
    out = S.by_building(supplier_series(spark, sf_dir), P.with_(train_frac=0.85))
    return out.groupBy("grp", "building", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("energy").alias("energy")
    )


FIXED_SQL = f"""{NATION_SQL},
marks AS (
  SELECT *, CASE WHEN n < 1621 THEN floor(n / 2)::BIGINT ELSE 1080 END AS border,
         CASE WHEN n < 1621 THEN n ELSE 1620 END AS val_end FROM series),
placed AS (
  SELECT *, 'train' AS split, t AS pos FROM marks WHERE t < border
  UNION ALL SELECT *, 'val', t - border FROM marks WHERE t >= border AND t < val_end
  UNION ALL SELECT *, 'test', t - border FROM marks WHERE t >= border)"""


@query(
    "split_fixed",
    f"""WITH {FIXED_SQL} SELECT grp, building, split, count(*) AS row_count, sum(energy)::DOUBLE AS energy,
       sum(energy * pos)::DOUBLE AS moment FROM placed GROUP BY 1, 2, 3""",
)
def split_fixed(spark, sf_dir):
    out = S.fixed(nation_series(spark, sf_dir), train_len=1080, val_len=540)
    return out.groupBy("grp", "building", "split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("energy").alias("energy"),
        F.sum(F.col("energy") * F.col("t")).alias("moment"),
    )


@query(
    "split_boundary",
    f"""WITH {TEMPORAL_SQL},
b AS (SELECT grp, building, count(*) FILTER (WHERE split = 'train') AS boundary, count(*) AS total
      FROM splits GROUP BY 1, 2)
SELECT grp, building, boundary, total, {r('boundary::DOUBLE / total')} AS train_fraction,
       sum(CASE WHEN split = 'train' THEN t ELSE t + boundary END)::BIGINT AS position_sum,
       max(CASE WHEN split = 'train' THEN t ELSE t + boundary END) AS last_position
FROM splits JOIN b USING (grp, building) GROUP BY ALL""",
)
def split_boundary(spark, sf_dir):
    splits = S.temporal(nation_series(spark, sf_dir), PN)
    return (
        S.joined_series(splits, S.boundary(splits))
        .groupBy("grp", "building", "boundary", "total", rd(F.col("train_fraction")).alias("train_fraction"))
        .agg(F.sum("t").alias("position_sum"), F.max("t").alias("last_position"))
    )


@query(
    "split_summary",
    f"""WITH {T.daily_sql('nation')},{T.indexed_sql('daily')},
per AS (SELECT grp, building, n, floor(n * 0.85::DOUBLE)::BIGINT AS tr, n >= 720 AS kept FROM series GROUP BY 1, 2, 3)
SELECT grp, count(*) AS buildings, count(*) FILTER (WHERE kept) AS kept,
       count(*) FILTER (WHERE NOT kept) AS too_short, sum(n)::BIGINT AS rows_read,
       sum(CASE WHEN kept THEN (CASE WHEN tr >= 192 THEN tr ELSE 0 END)
                             + (CASE WHEN n - tr >= 192 THEN n - tr ELSE 0 END) ELSE 0 END)::BIGINT AS rows_written
FROM per GROUP BY 1""",
)
def split_summary(spark, sf_dir):
    return S.summary(C.index_series(T.daily(spark, sf_dir, "nation"), p=PN), PN)


@query(
    "flt_partition",
    f"""WITH {T.daily_sql()} SELECT grp, building, count(*) AS row_count, sum(energy)::DOUBLE AS energy
FROM daily WHERE grp IN (SELECT r_name FROM region WHERE r_regionkey + 1 = 2) GROUP BY 1, 2""",
)
def flt_partition(spark, sf_dir):
    devices = T.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("grp"), (F.col("r_regionkey") + 1).alias("device")
    )
    return C.in_groups(T.daily(spark, sf_dir), devices, 2).groupBy("grp", "building").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("energy").alias("energy")
    )


# ---- windows --------------------------------------------------------------------------------


def array_sum(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_moment(a):
    return F.aggregate(
        F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )


@query(
    "win_make",
    f"""WITH {WINDOWS_SQL} SELECT grp, building, start, sum(x)::DOUBLE AS total, sum(x * (pos + 1))::DOUBLE AS moment,
       arg_min(x, pos) AS first_x, arg_max(x, pos) AS last_x FROM pts GROUP BY 1, 2, 3""",
)
def win_make(spark, sf_dir):
    return WN.make_windows(supplier_series(spark, sf_dir), P).select(
        "grp", "building", "start",
        array_sum(F.col("x")).alias("total"),
        array_moment(F.col("x")).alias("moment"),
        F.element_at("x", 1).alias("first_x"),
        F.element_at("x", -1).alias("last_x"),
    )


@query(
    "win_count",
    f"""WITH {T.daily_sql()},{T.indexed_sql('daily')} SELECT grp, building, n,
       (CASE WHEN n < {P.window} THEN 0 ELSE (n - {P.window}) // {P.stride} + 1 END)::BIGINT AS n_windows
FROM series GROUP BY grp, building, n""",
)
def win_count(spark, sf_dir):
    per = T.daily(spark, sf_dir).groupBy("grp", "building").agg(F.count(F.lit(1)).alias("n"))
    return WN.with_window_count(per, P)


@query(
    "win_wavelet",
    f"WITH {PARTS_SQL} SELECT grp, building, start, pos, {r('trend', 4)} AS trend, {r('season', 4)} AS season FROM parts",
)
def win_wavelet(spark, sf_dir):
    parts = WN.decompose(WN.make_windows(supplier_series(spark, sf_dir), P), P)
    return parts.select(
        "grp", "building", "start", F.posexplode(F.arrays_zip("trend", "season")).alias("p", "v")
    ).select(
        "grp", "building", "start", F.col("p").cast("long").alias("pos"),
        rd(F.col("v.trend"), 4).alias("trend"), rd(F.col("v.season"), 4).alias("season"),
    )


@query(
    "scl_window",
    f"""WITH {PARTS_SQL},
m AS (SELECT grp, building, start, avg(trend) AS tm, stddev_pop(trend) AS ts, avg(season) AS sm, stddev_pop(season) AS ss
      FROM parts GROUP BY 1, 2, 3)
SELECT grp, building, start, {r('tm', 4)} AS tm, {r('ts', 4)} AS ts, {r('sm', 4)} AS sm, {r('ss', 4)} AS ss,
       {r('sum((trend - tm) / (ts + 1e-8) * (pos + 1))', 3)} AS trend_moment,
       {r('sum((season - sm) / (ss + 1e-8) * (pos + 1))', 3)} AS season_moment
FROM parts JOIN m USING (grp, building, start) GROUP BY grp, building, start, m.tm, m.ts, m.sm, m.ss""",
)
def scl_window(spark, sf_dir):
    parts = WN.decompose(WN.make_windows(supplier_series(spark, sf_dir), P), P)
    return WN.standardize(parts, P).select(
        "grp", "building", "start",
        *[rd(F.col(f"stats.{c}"), 4).alias(c) for c in ("tm", "ts", "sm", "ss")],
        rd(array_moment(F.col("trend_norm")), 3).alias("trend_moment"),
        rd(array_moment(F.col("season_norm")), 3).alias("season_moment"),
    )


@query(
    "scl_inverse",
    f"""WITH {PARTS_SQL} SELECT grp, building, start, {r('sum(trend * (pos + 1))', 2)} AS trend_moment,
       {r('sum(season * (pos + 1))', 2)} AS season_moment FROM parts GROUP BY 1, 2, 3""",
)
def scl_inverse(spark, sf_dir):
    """Scaled and unscaled again: must give back trend and season."""
    scaled = WN.standardize(WN.decompose(WN.make_windows(supplier_series(spark, sf_dir), P), P), P)
    back = scaled.select(
        "grp", "building", "start",
        unscale_array(F.col("trend_norm"), F.col("stats.tm"), F.col("stats.ts")).alias("trend"),
        unscale_array(F.col("season_norm"), F.col("stats.sm"), F.col("stats.ss")).alias("season"),
    )
    return back.select(
        "grp", "building", "start",
        rd(array_moment(F.col("trend")), 2).alias("trend_moment"),
        rd(array_moment(F.col("season")), 2).alias("season_moment"),
    )


@query(
    "scl_series",
    f"""WITH {SUPPLIER_SQL}, m AS (SELECT grp, building, avg(energy) AS mean, stddev_pop(energy) AS std FROM series GROUP BY 1, 2)
SELECT grp, building, t, {r('(energy - mean) / (std + 1e-8)')} AS energy_norm FROM series JOIN m USING (grp, building)""",
)
def scl_series(spark, sf_dir):
    return WN.standardize_series(supplier_series(spark, sf_dir)).select(
        "grp", "building", "t", rd(F.col("energy_norm")).alias("energy_norm")
    )


@query(
    "win_xy",
    f"""WITH {WINDOWS_SQL} SELECT grp, building, start,
       sum(x) FILTER (WHERE pos < {P.backcast})::DOUBLE AS sum_in,
       sum(x) FILTER (WHERE pos >= {P.backcast})::DOUBLE AS sum_out,
       arg_max(x, pos) FILTER (WHERE pos < {P.backcast}) AS last_in,
       arg_min(x, pos) FILTER (WHERE pos >= {P.backcast}) AS first_out FROM pts GROUP BY 1, 2, 3""",
)
def win_xy(spark, sf_dir):
    xy = WN.backcast_forecast(WN.make_windows(supplier_series(spark, sf_dir), P), ["x"], P)
    return xy.select(
        "grp", "building", "start",
        array_sum(F.col("x_in")).alias("sum_in"), array_sum(F.col("x_out")).alias("sum_out"),
        F.element_at("x_in", -1).alias("last_in"), F.element_at("x_out", 1).alias("first_out"),
    )


@query(
    "win_pick",
    f"""WITH {WINDOWS_SQL}, one AS (SELECT min((grp, building)) AS b FROM wins)
SELECT grp, building, start, sum(x)::DOUBLE AS total FROM pts, one
WHERE grp = b[1] AND building = b[2] AND start >= {2 * P.stride} AND start < {5 * P.stride} GROUP BY 1, 2, 3""",
)
def win_pick(spark, sf_dir):
    """Windows 2, 3 and 4 of the first building, cut from the rows under them alone."""
    series = supplier_series(spark, sf_dir)
    first = series.where(F.col("n") >= P.window).agg(F.min(F.struct("grp", "building")).alias("b")).select("b.grp", "b.building").first()
    wins = WN.pick(series, first["grp"], first["building"], 2, 3, P)
    return wins.select("grp", "building", "start", array_sum(F.col("x")).alias("total"))


@query("win_inventory", f"WITH {WINDOWS_SQL} SELECT grp, count(DISTINCT building) AS buildings, count(*) AS windows FROM wins GROUP BY 1")
def win_inventory(spark, sf_dir):
    return WN.inventory(WN.make_windows(supplier_series(spark, sf_dir), P))


@query(
    "win_frames",
    f"""WITH {SUPPLIER_SQL} SELECT grp, building, frame::INT AS frame, (24 + frame * {P.stride})::INT AS start,
       (24 + frame * {P.stride} + {P.backcast})::INT AS backcast_end,
       (24 + frame * {P.stride} + {P.backcast} + {P.val_horizon})::INT AS val_end,
       (24 + frame * {P.stride} + {P.window})::INT AS window_end
FROM (SELECT DISTINCT grp, building, n FROM series), range(4) f(frame) WHERE 24 + frame * {P.stride} + {P.window} <= n""",
)
def win_frames(spark, sf_dir):
    return WN.frames(supplier_series(spark, sf_dir), 24, 4, P)


@query("dec_wavelet_series")
def dec_wavelet_series(spark, sf_dir):
    """No SQL twin: the matrix depends on each series' length; tested against brute force."""
    out = WN.series_wavelet(supplier_series(spark, sf_dir))
    return out.select("grp", "building", "t", rd(F.col("trend"), 4).alias("trend"), rd(F.col("season"), 4).alias("season"))


ADDITIVE_SQL = f"""{SUPPLIER_SQL},
avgd AS (
  SELECT *, CASE WHEN t BETWEEN 12 AND n - 13 THEN
    (sum(energy) OVER (PARTITION BY grp, building ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
     - 0.5::DOUBLE * (lag(energy, 12) OVER (PARTITION BY grp, building ORDER BY t)
                      + lead(energy, 12) OVER (PARTITION BY grp, building ORDER BY t))) / 24 END AS mid
  FROM series WHERE n >= 48),
lines AS (
  SELECT grp, building, regr_slope(mid, t) FILTER (WHERE t BETWEEN 12 AND 35) AS hs,
         regr_intercept(mid, t) FILTER (WHERE t BETWEEN 12 AND 35) AS hi,
         regr_slope(mid, t) FILTER (WHERE t BETWEEN n - 36 AND n - 13) AS ls,
         regr_intercept(mid, t) FILTER (WHERE t BETWEEN n - 36 AND n - 13) AS li
  FROM avgd GROUP BY 1, 2),
additive AS (
  SELECT grp, building, t, energy, CASE WHEN mid IS NOT NULL THEN mid WHEN t < 12 THEN hs * t + hi ELSE ls * t + li END AS trend
  FROM avgd JOIN lines USING (grp, building))"""


@query("dec_additive", f"WITH {ADDITIVE_SQL} SELECT grp, building, t, {r('trend', 4)} AS trend, {r('energy - trend', 4)} AS season FROM additive")
def dec_additive(spark, sf_dir):
    out = WN.series_additive(supplier_series(spark, sf_dir))
    return out.select("grp", "building", "t", rd(F.col("trend"), 4).alias("trend"), rd(F.col("season"), 4).alias("season"))


# ---- labels ---------------------------------------------------------------------------------


@query("lab_window", f"WITH {LABELS_SQL} SELECT grp, building, start, pos, label FROM labels")
def lab_window(spark, sf_dir):
    labeled = L.label_series(supplier_series(spark, sf_dir), P)
    return labeled.select("grp", "building", "start", F.posexplode("labels").alias("p", "l")).select(
        "grp", "building", "start", F.col("p").cast("long").alias("pos"), F.col("l").cast("int").alias("label")
    )


@query(
    "lab_band",
    f"""WITH {LABELS_SQL} SELECT grp, building, start, t, {r('trend + lo', 4)} AS band_lo, {r('trend + hi', 4)} AS band_hi,
       label AS outside FROM labels""",
)
def lab_band(spark, sf_dir):
    out = L.band(L.label_series(supplier_series(spark, sf_dir), P))
    return out.select(
        "grp", "building", "start", "t", rd(F.col("band_lo"), 4).alias("band_lo"),
        rd(F.col("band_hi"), 4).alias("band_hi"), "outside",
    )


@query("lab_fuse", f"WITH {FUSED_SQL} SELECT grp, building, t, votes, cover, anomaly FROM fused")
def lab_fuse(spark, sf_dir):
    return L.label_fused(supplier_series(spark, sf_dir), P).select(
        "grp", "building", "t", "votes", "cover", "anomaly"
    )


@query("lab_fuse_windows", f"WITH {FUSED_SQL} SELECT grp, building, t, votes, cover, anomaly FROM fused")
def lab_fuse_windows(spark, sf_dir):
    """The same fusion from a table of labelled windows."""
    return L.fuse(L.label_series(supplier_series(spark, sf_dir), P), P).select(
        "grp", "building", "t", "votes", "cover", "anomaly"
    )


@query("lab_fuse_majority", f"WITH {LABELS_SQL},{fused_sql('majority')} SELECT grp, building, t, anomaly FROM fused")
def lab_fuse_majority(spark, sf_dir):
    return L.fuse(L.label_series(supplier_series(spark, sf_dir), P), P.with_(merge_rule="majority")).select(
        "grp", "building", "t", "anomaly"
    )


@query("lab_series", f"WITH {FUSED_SQL} SELECT grp, building, t, energy::DOUBLE AS energy, anomaly FROM fused")
def lab_series(spark, sf_dir):
    return L.label_fused(supplier_series(spark, sf_dir), P).select(
        "grp", "building", "t", "energy", "anomaly"
    )


@query(
    "lab_reproject",
    f"""WITH {FUSED_SQL} SELECT w.grp, w.building, w.start, sum(f.anomaly)::BIGINT AS anomalies,
       sum(f.anomaly * (f.t - w.start + 1))::BIGINT AS moment
FROM wins w JOIN fused f ON w.grp = f.grp AND w.building = f.building AND f.t >= w.start AND f.t < w.start + {P.window}
GROUP BY 1, 2, 3""",
)
def lab_reproject(spark, sf_dir):
    out = L.label_reprojected(supplier_series(spark, sf_dir), P)
    marks = F.transform("labels_fused", lambda v: v.cast("double"))
    return out.select(
        "grp", "building", "start",
        array_sum(marks).cast("long").alias("anomalies"), array_moment(marks).cast("long").alias("moment"),
    )


@query(
    "lab_joinback",
    f"""WITH {FUSED_SQL} SELECT s.grp, s.building, s.ts, s.t, s.energy, coalesce(f.anomaly, 0) AS anomaly
FROM series s LEFT JOIN fused f ON s.grp = f.grp AND s.building = f.building AND s.t = f.t""",
)
def lab_joinback(spark, sf_dir):
    series = supplier_series(spark, sf_dir)
    return L.join_back(series, L.label_fused(series, P)).select(
        "grp", "building", "ts", "t", "energy", "anomaly"
    )


RATE_SQL = """
per AS (SELECT grp, building, count(*) AS steps, sum(anomaly)::BIGINT AS anomalies, sum(cover)::BIGINT AS window_steps,
               sum(anomaly * cover)::BIGINT AS window_anomalies FROM fused GROUP BY 1, 2)"""


@query(
    "lab_rate",
    f"""WITH {FUSED_SQL},{RATE_SQL} SELECT grp, building, steps, anomalies,
       {r('anomalies::DOUBLE / steps')} AS series_rate, {r('window_anomalies::DOUBLE / window_steps')} AS window_rate FROM per""",
)
def lab_rate(spark, sf_dir):
    out = L.rates(L.label_fused(supplier_series(spark, sf_dir), P))
    return out.select(
        "grp", "building", "steps", "anomalies",
        rd(F.col("series_rate")).alias("series_rate"), rd(F.col("window_rate")).alias("window_rate"),
    )


@query(
    "lab_rate_group",
    f"""WITH {FUSED_SQL},{RATE_SQL} SELECT grp, count(*) AS buildings, {r('sum(anomalies)::DOUBLE / sum(steps)')} AS series_rate,
       {r('sum(window_anomalies)::DOUBLE / sum(window_steps)')} AS window_rate,
       {r('avg(anomalies::DOUBLE / steps)')} AS mean_building_rate FROM per GROUP BY 1""",
)
def lab_rate_group(spark, sf_dir):
    out = L.group_rates(L.rates(L.label_fused(supplier_series(spark, sf_dir), P)))
    cols = ("series_rate", "window_rate", "mean_building_rate")
    return out.select("grp", "buildings", *[rd(F.col(c)).alias(c) for c in cols])


RUNTIME_P = P.with_(train_frac=0.5)
RUNTIME_SQL = f"""{T.daily_sql()},{T.indexed_sql('daily', P.min_len).replace('series AS', 'whole AS')},
series AS (SELECT grp, building, ts, energy, t - floor(n * 0.5::DOUBLE)::BIGINT AS t, n - floor(n * 0.5::DOUBLE)::BIGINT AS n
           FROM whole WHERE t >= floor(n * 0.5::DOUBLE)::BIGINT AND n - floor(n * 0.5::DOUBLE)::BIGINT >= {P.window}),
{windows_sql(P)},{trend_sql(P)},{labels_sql(P)},{fused_sql()}"""


@query("lab_runtime", f"WITH {RUNTIME_SQL} SELECT grp, building, t, energy::DOUBLE AS energy, anomaly FROM fused")
def lab_runtime(spark, sf_dir):
    """The test half labelled by the same functions that label the training half."""
    test = S.temporal(supplier_series(spark, sf_dir), RUNTIME_P).where("split = 'test'")
    return L.label_fused(test, P).select("grp", "building", "t", "energy", "anomaly")


@query(
    "flow_labeled_wide",
    f"""WITH {WIDE_FUSED_SQL},{RATE_SQL} SELECT grp, building, steps, anomalies, {r('anomalies::DOUBLE / steps')} AS series_rate FROM per""",
)
def flow_labeled_wide(spark, sf_dir):
    """The whole path at the default window: clean, cut, decompose, label, fuse, rate."""
    series = supplier_series(spark, sf_dir, PW)
    out = L.rates(L.label_fused(series, PW))
    return out.select("grp", "building", "steps", "anomalies", rd(F.col("series_rate")).alias("series_rate"))
