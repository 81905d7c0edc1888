"""Queries for exploratory analysis, interval overlap, map data and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import scalars as SC
from wattloom.operators import dims as D
from wattloom.operators import eda as E
from wattloom.operators import geo as G
from wattloom.operators import intervals as IV
from wattloom.operators import splitting as S
from wattloom.plans import tables as T
from wattloom.plans.learning_queries import seeded
from wattloom.plans.registry import query
from wattloom.plans.series_queries import TEMPORAL_SQL, PN, nation_series, rd
from wattloom.plans.sqltext import r

H = T.HOURLY_SQL
SPAN = 4096 * 3600


# ---- profiles -------------------------------------------------------------------------------


@query(
    "eda_merge_mean",
    f"WITH {T.RAW_EVENTS_SQL} SELECT grp, building, ts, {r('avg(energy)')} AS energy FROM raw_events GROUP BY 1, 2, 3",
)
def eda_merge_mean(spark, sf_dir):
    return E.merge_mean(T.raw_events(spark, sf_dir)).withColumn("energy", rd(F.col("energy")))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "eda_pivot",
    f"""WITH {T.RAW_EVENTS_SQL} SELECT ts, {', '.join(f"{r(f"avg(energy) FILTER (WHERE building = '{t}')")} AS {t}" for t in TYPES)}
FROM raw_events GROUP BY 1""",
)
def eda_pivot(spark, sf_dir):
    wide = E.pivot(T.raw_events(spark, sf_dir), TYPES)
    return wide.select("ts", *[rd(F.col(t)).alias(t) for t in TYPES])


STEP_SQL = """
tss AS (SELECT DISTINCT grp, ts FROM {src}),
gaps AS (SELECT grp, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY grp ORDER BY ts) AS g FROM tss),
step AS (SELECT grp, CASE WHEN count(*) < 3 THEN 1.0 ELSE quantile_cont(g / 3.6e9::DOUBLE, 0.5) END AS step_hours FROM gaps GROUP BY 1)"""


@query("eda_step", f"WITH {H},{STEP_SQL.format(src='hourly')} SELECT grp, {r('step_hours')} AS step_hours FROM step")
def eda_step(spark, sf_dir):
    return E.step_hours(T.hourly(spark, sf_dir), SPAN).withColumn("step_hours", rd(F.col("step_hours")))


@query(
    "eda_slice",
    f"""WITH {T.USERS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, building ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY grp, building) AS n FROM users),
mid AS (SELECT grp, building, date_trunc('day', ts) AS a FROM ranked WHERE k = n // 2)
SELECT grp, building, ts, {r('energy')} AS energy FROM users JOIN mid USING (grp, building) WHERE ts BETWEEN a AND a + INTERVAL 3 DAY""",
)
def eda_slice(spark, sf_dir):
    out = E.slice_days(T.users(spark, sf_dir), 3, SPAN)
    return out.select("grp", "building", "ts", rd(F.col("energy")).alias("energy"))


SAMPLE_SQL = """
names AS (SELECT DISTINCT grp, building FROM {src}),
sampled AS (SELECT grp, building FROM names QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {h}, building) <= {k})"""


def sample_sql(src: str, k: int, seed: int) -> str:
    return SAMPLE_SQL.format(src=src, k=k, h=seeded(seed, "building"))


@query(
    "eda_slice_sample",
    f"""WITH {T.USERS_SQL},{sample_sql('users', 3, 1)},
sub AS (SELECT users.* FROM users JOIN sampled USING (grp, building)),
ranked AS (SELECT grp, ts, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, ts FROM sub)),
mid AS (SELECT grp, date_trunc('day', ts) AS a FROM ranked WHERE k = n // 2)
SELECT grp, building, ts, {r('energy')} AS energy FROM sub JOIN mid USING (grp) WHERE ts BETWEEN a AND a + INTERVAL 3 DAY""",
)
def eda_slice_sample(spark, sf_dir):
    out = E.slice_sample(T.users(spark, sf_dir), 3, 3, 1, SPAN)
    return out.select("grp", "building", "ts", rd(F.col("energy")).alias("energy"))


STATS_SQL = f"""{T.USERS_SQL},{STEP_SQL.format(src='users')},
span AS (SELECT grp, count(*) AS n_ts, min(ts) AS a, max(ts) AS z,
                greatest(1, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000) AS days FROM tss GROUP BY 1),
stats AS (
  SELECT grp, building, max(energy) AS peak, avg(energy) AS mean, sum(energy) * any_value(step_hours) AS energy_total,
         sum(energy) * any_value(step_hours) * 365 / any_value(days) AS energy_annualized,
         sum(energy) * any_value(step_hours) * 365 / any_value(days) / nullif(max(energy), 0) AS energy_to_peak_h_per_year,
         count(energy)::DOUBLE / any_value(n_ts) AS completeness, count(energy) AS n_obs
  FROM users JOIN step USING (grp) JOIN span USING (grp) GROUP BY 1, 2)"""
STAT_COLS = ("peak", "mean", "energy_total", "energy_annualized", "energy_to_peak_h_per_year", "completeness")


@query(
    "eda_building_stats",
    f"WITH {STATS_SQL} SELECT grp, building, {', '.join(f'{r(c, 8 if c == "mean" else 4)} AS {c}' for c in STAT_COLS)}, n_obs FROM stats",
)
def eda_building_stats(spark, sf_dir):
    out = E.building_stats(T.users(spark, sf_dir), SPAN)
    return out.select("grp", "building", *[rd(F.col(c), 8 if c == "mean" else 4).alias(c) for c in STAT_COLS], "n_obs")


@query(
    "eda_summary",
    f"""WITH {STATS_SQL},
m AS (SELECT grp, count(*) AS n_buildings, sum(n_obs)::BIGINT AS n_obs, quantile_cont(peak, 0.5) AS p,
             quantile_cont(energy_to_peak_h_per_year, 0.5) AS e, quantile_cont(completeness, 0.5) AS c FROM stats GROUP BY 1)
SELECT grp, n_buildings, n_ts AS n_timestamps, n_obs, a AS "start", z AS "end", {r('step_hours')} AS step_hours,
       {r('p', 4)} AS median_peak, {r('e', 4)} AS median_energy_to_peak_h, {r('c', 4)} AS median_completeness
FROM m JOIN span USING (grp) JOIN step USING (grp)""",
)
def eda_summary(spark, sf_dir):
    out = E.dataset_summary(T.users(spark, sf_dir), SPAN)
    med = ("median_peak", "median_energy_to_peak_h", "median_completeness")
    return out.select(
        "grp", "n_buildings", "n_timestamps", "n_obs", "start", "end", rd(F.col("step_hours")).alias("step_hours"),
        *[rd(F.col(c), 4).alias(c) for c in med],
    )


@query(
    "eda_availability",
    f"""WITH {T.USERS_SQL},
wk AS (SELECT *, (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS week FROM users),
slots AS (SELECT grp, week, count(DISTINCT ts) AS slots FROM wk GROUP BY 1, 2),
grid AS (SELECT b.building, s.* FROM (SELECT DISTINCT grp, building FROM users) b JOIN slots s USING (grp)),
seen AS (SELECT grp, building, week, count(energy) AS seen FROM wk GROUP BY 1, 2, 3)
SELECT grp, building, week, {r('coalesce(seen, 0)::DOUBLE / slots')} AS share FROM grid LEFT JOIN seen USING (grp, building, week)""",
)
def eda_availability(spark, sf_dir):
    return E.availability(T.users(spark, sf_dir)).withColumn("share", rd(F.col("share")))


LOAD_SQL = f"{H}, load AS (SELECT grp, ts, avg(energy) AS mean_load FROM hourly GROUP BY 1, 2)"


@query("eda_mean_load", f"WITH {LOAD_SQL} SELECT grp, ts, {r('mean_load')} AS mean_load FROM load")
def eda_mean_load(spark, sf_dir):
    return E.mean_load(T.hourly(spark, sf_dir)).withColumn("mean_load", rd(F.col("mean_load")))


@query(
    "eda_daily_profile",
    f"""WITH {LOAD_SQL} SELECT grp, isodow(ts) >= 6 AS weekend, hour(ts) + minute(ts) / 60.0::DOUBLE AS hour,
       {r('avg(mean_load)', 4)} AS mean, {r('quantile_cont(mean_load, 0.25)', 7)} AS q25, {r('quantile_cont(mean_load, 0.75)', 7)} AS q75
FROM load GROUP BY 1, 2, 3""",
)
def eda_daily_profile(spark, sf_dir):
    out = E.daily_profile(E.mean_load(T.hourly(spark, sf_dir)))
    digits = {"mean": 4, "q25": 7, "q75": 7}
    return out.select("grp", "weekend", "hour", *[rd(F.col(c), d).alias(c) for c, d in digits.items()])


HOUR_COLS = [f"h{h:02d}" for h in range(24)]


@query(
    "eda_month_hour",
    f"""WITH {LOAD_SQL} SELECT grp, month(ts)::INT AS month,
       {', '.join(f"{r(f'avg(mean_load) FILTER (WHERE hour(ts) = {h})', 4)} AS {c}" for h, c in enumerate(HOUR_COLS))}
FROM load GROUP BY 1, 2""",
)
def eda_month_hour(spark, sf_dir):
    out = E.month_hour(E.mean_load(T.hourly(spark, sf_dir)))
    return out.select("grp", "month", *[rd(F.col(str(h)), 4).alias(c) for h, c in enumerate(HOUR_COLS)])


@query(
    "eda_daily_energy",
    f"""WITH {T.daily_sql('nation')},{STEP_SQL.format(src='daily')},
per AS (SELECT grp, ts::DATE AS day, sum(energy) AS e FROM daily GROUP BY 1, 2),
ends AS (SELECT grp, min(day) AS a, max(day) AS z FROM per GROUP BY 1),
spine AS (SELECT grp, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM ends),
full_days AS (SELECT grp, day, coalesce(e, 0) * step_hours AS energy FROM spine LEFT JOIN per USING (grp, day) JOIN step USING (grp)),
sm AS (SELECT *, avg(energy) OVER w AS a, count(*) OVER w AS c FROM full_days
       WINDOW w AS (PARTITION BY grp ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
SELECT grp, day, {r('energy', 4)} AS energy, {r('CASE WHEN c = 30 THEN a END', 4)} AS smoothed FROM sm""",
)
def eda_daily_energy(spark, sf_dir):
    src = T.daily(spark, sf_dir, "nation")
    out = E.daily_energy(src, E.step_hours(src, 366 * 86400))
    return out.select("grp", "day", rd(F.col("energy"), 4).alias("energy"), rd(F.col("smoothed"), 4).alias("smoothed"))


CORR_SQL = f"""{T.daily_sql()},{sample_sql('daily', 60, 7)},
sub AS (SELECT daily.* FROM daily JOIN sampled USING (grp, building)),
pairs AS (SELECT x.grp, x.building AS a, y.building AS b, count(*) AS n, corr(x.energy, y.energy) AS corr
          FROM sub x JOIN sub y ON x.grp = y.grp AND x.ts = y.ts AND x.building < y.building GROUP BY 1, 2, 3)"""


def sampled_correlation(spark, sf_dir):
    """At most 60 buildings of each group, as the exploratory definition samples them."""
    daily = T.daily(spark, sf_dir)
    return E.correlation(daily, E.sample_buildings(daily, 60, 7))


@query("eda_corr", f"WITH {CORR_SQL} SELECT grp, a, b, n, {r('corr')} AS corr FROM pairs")
def eda_corr(spark, sf_dir):
    return sampled_correlation(spark, sf_dir).withColumn("corr", rd(F.col("corr")))


@query(
    "eda_corr_dist",
    f"""WITH {CORR_SQL}, c AS (SELECT grp, round(corr, 6) AS v FROM pairs WHERE corr IS NOT NULL),
e AS (SELECT grp, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5) AS med FROM c GROUP BY 1)
SELECT grp, least(39, floor((v - lo) / ((hi - lo) / 40)))::INT AS bin, count(*) AS "rows", {r('any_value(med)', 5)} AS median
FROM c JOIN e USING (grp) GROUP BY 1, 2""",
)
def eda_corr_dist(spark, sf_dir):
    corr = sampled_correlation(spark, sf_dir).select("grp", F.round("corr", 6).alias("v")).where("v IS NOT NULL")
    med = corr.groupBy("grp").agg(rd(F.percentile("v", 0.5), 5).alias("median"))  # at most one row per sampled pair
    return E.histogram(corr, "v", 40, ["grp"]).join(med, "grp").select("grp", "bin", "rows", "median")


@query(
    "eda_hist",
    f"""WITH {T.daily_sql()}, e AS (SELECT grp, min(energy) AS lo, max(energy) AS hi FROM daily GROUP BY 1)
SELECT grp, least(39, floor((energy - lo) / ((hi - lo) / 40)))::INT AS bin, {r('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 40')} AS "left", count(*) AS "rows"
FROM daily JOIN e USING (grp) GROUP BY 1, 2""",
)
def eda_hist(spark, sf_dir):
    out = E.histogram(T.daily(spark, sf_dir), "energy", 40, ["grp"])
    return out.withColumn("left", rd(F.col("left")))


@query(
    "eda_hist_log",
    f"""WITH v AS (SELECT log10(1 + o_totalprice) AS x FROM orders), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT least(39, floor((x - lo) / ((hi - lo) / 40)))::INT AS bin, count(*) AS "rows" FROM v, e GROUP BY 1""",
)
def eda_hist_log(spark, sf_dir):
    v = T.table(spark, sf_dir, "orders").select(F.log10(1 + F.col("o_totalprice")).alias("x"))
    return E.histogram(v, "x", 40).select("bin", "rows")


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "eda_col_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, {r(f'avg({c})', 4)} AS mean,
  {r(f'stddev_pop({c})', 4)} AS std, min({c}) AS "min", max({c}) AS "max" FROM lineitem""" for c in NUMERIC
    ),
)
def eda_col_stats(spark, sf_dir):
    out = E.column_stats(T.table(spark, sf_dir, "lineitem"), NUMERIC)
    return out.select("column_name", "n", "nulls", rd(F.col("mean"), 4).alias("mean"), rd(F.col("std"), 4).alias("std"), "min", "max")


TOTAL_SQL = "total AS (SELECT " + " + ".join(f"coalesce({c}, 0)" for c in NUMERIC) + " AS v, l_orderkey, l_linenumber FROM lineitem)"


@query("eda_row_total", f"WITH {TOTAL_SQL} SELECT l_orderkey, l_linenumber, {r('v', 4)} AS total FROM total")
def eda_row_total(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", rd(E.row_total(NUMERIC), 4).alias("total"))


@query(
    "eda_quantiles",
    f"WITH {TOTAL_SQL} SELECT 'total' AS metric, {', '.join(f'{r(f'quantile_cont(v, {q})', 4)} AS {n}' for n, q in E.QUANTILES.items())} FROM total",
)
def eda_quantiles(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(E.row_total(NUMERIC).alias("total"))
    out = E.quantiles(li, "total")
    return out.select("metric", *[rd(F.col(n), 4).alias(n) for n in E.QUANTILES])


@query("eda_quantiles_approx")
def eda_quantiles_approx(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(E.row_total(NUMERIC).alias("total"))
    return E.approx_quantiles(li, "total")


@query("eda_dow_hour", f"SELECT (isodow(ts) - 1)::INT AS dow, hour(ts)::INT AS hour, {r('avg(value)', 4)} AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def eda_dow_hour(spark, sf_dir):
    return E.dow_hour(T.table(spark, sf_dir, "events"), "value").withColumn("mean", rd(F.col("mean"), 4))


@query("eda_month", f"SELECT month(l_shipdate)::INT AS month, {r('avg(l_extendedprice)', 2)} AS mean, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def eda_month(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "ts")
    return E.by_month(li, "l_extendedprice").withColumn("mean", rd(F.col("mean"), 2))


@query("eda_distinct_ids", "SELECT count(DISTINCT user_id) AS distinct_ids FROM events")
def eda_distinct_ids(spark, sf_dir):
    return E.distinct_ids(T.table(spark, sf_dir, "events"), "user_id")


@query(
    "eda_sample_series",
    f"""WITH {T.USERS_SQL},{sample_sql('users', 20, 3)}
SELECT grp, building, {r('max(energy + energy)', 4)} AS peak FROM users JOIN sampled USING (grp, building) GROUP BY 1, 2""",
)
def eda_sample_series(spark, sf_dir):
    """Two value columns per row, summed; twenty sampled series; their peaks."""
    two = T.users(spark, sf_dir).withColumn("energy_b", F.col("energy"))
    out = E.peaks(E.sample_series(two, ["energy", "energy_b"], 20, 3))
    return out.withColumn("peak", rd(F.col("peak"), 4))


# ---- interval overlap -----------------------------------------------------------------------


def periods(spark, sf_dir):
    """One collection period per market segment and nation."""
    o = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    per = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"), F.count(F.lit(1)).alias("c"))
    cu = T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na, re = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    full = (
        per.join(cu, F.col("o_custkey") == F.col("c_custkey")).join(na, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(re, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return full.groupBy(
        F.concat_ws("/", "c_mktsegment", "n_name").alias("alias"), F.col("c_mktsegment").alias("type"),
        F.col("n_name").alias("location"), F.col("r_name").alias("iso"),
    ).agg(
        F.min("a").alias("start"), F.max("z").alias("end"), F.sum("c").alias("n_obs"), F.count(F.lit(1)).alias("n_buildings")
    )


PERIODS_SQL = """
periods AS (
  SELECT c_mktsegment || '/' || n_name AS alias, c_mktsegment AS type, n_name AS location, r_name AS iso,
         min(o_orderdate) AS s, max(o_orderdate) AS e, count(*) AS n_obs, count(DISTINCT o_custkey) AS n_buildings
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def customer_periods(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("customer_"), F.col("o_custkey")).alias("alias")).agg(
        F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")
    )


CUSTOMER_SQL = """
cust AS (SELECT 'customer_' || o_custkey AS alias, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1)"""


@query("ovl_intervals", f"""WITH {CUSTOMER_SQL} SELECT alias, s AS "start", e AS "end", e > s AS valid FROM cust""")
def ovl_intervals(spark, sf_dir):
    iv = customer_periods(spark, sf_dir)
    return IV.valid_intervals(iv).withColumn("valid", F.lit(True)).unionByName(
        IV.rejected_intervals(iv).withColumn("valid", F.lit(False))
    )


@query("ovl_intervals_type", f"""WITH {PERIODS_SQL} SELECT alias, s AS "start", e AS "end" FROM periods WHERE e > s AND lower(type) = 'building'""")
def ovl_intervals_type(spark, sf_dir):
    return IV.valid_intervals(periods(spark, sf_dir), "Building").select("alias", "start", "end")


SEGMENTS_SQL = f"""{PERIODS_SQL},
bounds AS (SELECT DISTINCT tp FROM (SELECT s AS tp FROM periods UNION ALL SELECT e FROM periods)),
base AS (SELECT tp AS a, lead(tp) OVER (ORDER BY tp) AS z FROM bounds),
sets AS (SELECT a, z, list_sort(list(alias)) AS ds FROM base JOIN periods ON s <= a AND e >= z WHERE z IS NOT NULL AND e > s GROUP BY 1, 2),
flags AS (SELECT *, CASE WHEN lag(ds) OVER (ORDER BY a) = ds AND lag(z) OVER (ORDER BY a) = a THEN 0 ELSE 1 END AS f FROM sets),
runs AS (SELECT *, sum(f) OVER (ORDER BY a) AS run FROM flags),
segs AS (SELECT min(a) AS a, max(z) AS z, ds, len(ds) AS n, date_diff('day', min(a), max(z)) AS days FROM runs GROUP BY run, ds)"""


@query(
    "ovl_segments",
    f"""WITH {SEGMENTS_SQL} SELECT a AS "start", z AS "end", n::INT AS n_datasets, array_to_string(ds, '; ') AS datasets, days AS duration_days FROM segs""",
)
def ovl_segments(spark, sf_dir):
    out = IV.segments(IV.valid_intervals(periods(spark, sf_dir)))
    return out.withColumn("datasets", F.array_join("datasets", "; "))


@query(
    "ovl_merge",
    f"""WITH {CUSTOMER_SQL},
marks AS (SELECT tp, sum(d)::BIGINT AS d FROM (SELECT s AS tp, 1 AS d FROM cust WHERE e > s UNION ALL SELECT e, -1 FROM cust WHERE e > s) GROUP BY 1),
cnt AS (SELECT tp, lead(tp) OVER (ORDER BY tp) AS z, sum(d) OVER (ORDER BY tp) AS n FROM marks)
SELECT tp AS seg_start, z AS seg_end, n::BIGINT AS n_datasets FROM cnt WHERE n > 0 AND z IS NOT NULL""",
)
def ovl_merge(spark, sf_dir):
    """Segments of constant count over all customers' periods."""
    return IV.steps(IV.valid_intervals(customer_periods(spark, sf_dir)))


RANK_SQL = f"""{SEGMENTS_SQL},
cand AS (SELECT *, row_number() OVER (ORDER BY n DESC, days DESC, a) AS pos FROM segs WHERE days >= 2)"""


@query(
    "ovl_distinct",
    f"""WITH {RANK_SQL} SELECT a AS "start", z AS "end", n::INT AS n_datasets FROM cand x
WHERE NOT EXISTS (SELECT 1 FROM cand y WHERE y.pos < x.pos AND list_has_all(y.ds, x.ds))""",
)
def ovl_distinct(spark, sf_dir):
    seg = IV.segments(IV.valid_intervals(periods(spark, sf_dir)))
    return IV.distinct_sets(seg.where("duration_days >= 2")).select("start", "end", "n_datasets")


@query(
    "ovl_rank",
    f"""WITH {RANK_SQL},
best AS (SELECT *, row_number() OVER (ORDER BY pos) AS rk FROM cand WHERE true ORDER BY pos LIMIT 10),
env AS (SELECT rk, min(s) AS lo, max(e) AS hi FROM (SELECT rk, unnest(ds) AS alias FROM best) JOIN periods USING (alias) GROUP BY 1)
SELECT rk::INT AS rank, a AS overlap_start, z AS overlap_end, days AS overlap_days, {r('days / 365.25::DOUBLE', 2)} AS overlap_years,
       n::INT AS n_datasets, lo AS group_min_start, hi AS group_max_end, array_to_string(ds, '; ') AS datasets FROM best JOIN env USING (rk)""",
)
def ovl_rank(spark, sf_dir):
    iv = IV.valid_intervals(periods(spark, sf_dir))
    return IV.rank_overlaps(IV.segments(iv), iv, 10, 2, distinct=False)


@query(
    "ovl_envelope",
    f"""WITH {SEGMENTS_SQL}, m AS (SELECT a, z, unnest(ds) AS alias FROM segs)
SELECT a AS "start", z AS "end", min(s) AS group_min_start, max(e) AS group_max_end FROM m JOIN periods USING (alias) GROUP BY 1, 2""",
)
def ovl_envelope(spark, sf_dir):
    iv = IV.valid_intervals(periods(spark, sf_dir))
    return IV.envelope(IV.segments(iv), iv).select("start", "end", "group_min_start", "group_max_end")


COVER_SQL = f"""{CUSTOMER_SQL},
marks AS (SELECT tp, sum(d)::BIGINT AS d FROM (SELECT s AS tp, 1 AS d FROM cust WHERE e > s UNION ALL SELECT e, -1 FROM cust WHERE e > s) GROUP BY 1),
cnt AS (SELECT tp, lead(tp) OVER (ORDER BY tp) AS z, sum(d) OVER (ORDER BY tp) AS n FROM marks),
st AS (SELECT * FROM cnt WHERE n > 0 AND z IS NOT NULL)"""


@query("ovl_coverage", f"""WITH {COVER_SQL} SELECT tp AS "at", n::BIGINT AS n_datasets FROM st UNION ALL SELECT z, n::BIGINT FROM st""")
def ovl_coverage(spark, sf_dir):
    return IV.coverage(IV.valid_intervals(customer_periods(spark, sf_dir)))


@query("ovl_peak", f"WITH {COVER_SQL} SELECT n::BIGINT AS n_datasets, tp AS peak_start FROM st ORDER BY n DESC, tp LIMIT 1")
def ovl_peak(spark, sf_dir):
    return IV.coverage_peak(IV.valid_intervals(customer_periods(spark, sf_dir)))


# ---- map data -------------------------------------------------------------------------------

PLACES = {"nation_1": (10.0, 20.0), "nation_2": (30.0, 40.0)}
COUNTRIES = {"REGION_0": (1.0, 2.0), "REGION_1": (3.0, 4.0), "AFRICA": (5.0, 6.0), "AMERICA": (7.0, 8.0)}
ABSENT = ("BUILDING/NATION_3", "MACHINERY/NATION_4")


def metadata(spark, sf_dir):
    """Metadata rows as text would hold them: counts with thousands separators, some missing."""
    per = periods(spark, sf_dir)
    return per.withColumns(
        {
            "n_obs": F.when(F.col("n_obs") % 11 == 0, F.lit("NA")).otherwise(F.format_number("n_obs", 0)),
            "n_buildings": F.format_number("n_buildings", 0),
        }
    )


META_SQL = f"""{PERIODS_SQL},
meta AS (SELECT alias, type, location, iso, CASE WHEN n_obs % 11 <> 0 THEN n_obs::DOUBLE END AS n_obs, n_buildings::DOUBLE AS n_buildings FROM periods)"""


def numeric_metadata(spark, sf_dir):
    num = lambda c: SC.loose_number(F.col(c))
    return metadata(spark, sf_dir).withColumns({"n_obs": num("n_obs"), "n_buildings": num("n_buildings")})


ABSENT_SQL = ", ".join(f"'{a}'" for a in ABSENT)


@query("geo_exclude", f"WITH {META_SQL} SELECT alias, n_obs FROM meta WHERE alias NOT IN ({ABSENT_SQL})")
def geo_exclude(spark, sf_dir):
    return G.exclude(numeric_metadata(spark, sf_dir), ABSENT).select("alias", "n_obs")


@query("geo_excluded", f"WITH {META_SQL} SELECT count(*) AS excluded, coalesce(sum(n_obs), 0) AS excluded_obs FROM meta WHERE alias IN ({ABSENT_SQL})")
def geo_excluded(spark, sf_dir):
    return G.excluded_total(metadata(spark, sf_dir), ABSENT)


@query("geo_number", f"WITH {META_SQL} SELECT alias, n_obs, coalesce(n_obs, 0) AS n_obs_or_zero, n_buildings FROM meta")
def geo_number(spark, sf_dir):
    return numeric_metadata(spark, sf_dir).select(
        "alias", "n_obs", F.coalesce("n_obs", F.lit(0.0)).alias("n_obs_or_zero"), "n_buildings"
    )


def coordinate_sql(i: int) -> str:
    arms = "".join(f" WHEN contains(lower(location), '{k}') THEN {v[i]}::DOUBLE" for k, v in PLACES.items())
    arms += "".join(f" WHEN upper(iso) = '{k}' THEN {v[i]}::DOUBLE" for k, v in COUNTRIES.items())
    return f"CASE{arms} END"


GEO_SQL = f"{META_SQL}, located AS (SELECT *, {coordinate_sql(0)} AS lat, {coordinate_sql(1)} AS lon FROM meta)"


def geocoded(spark, sf_dir):
    return G.geocode(numeric_metadata(spark, sf_dir), PLACES, COUNTRIES)


@query("geo_code", f"WITH {GEO_SQL} SELECT alias, location, iso, lat, lon FROM located")
def geo_code(spark, sf_dir):
    return geocoded(spark, sf_dir).select("alias", "location", "iso", "lat", "lon")


@query("geo_missing", f"WITH {GEO_SQL} SELECT alias, location, iso FROM located WHERE lat IS NULL")
def geo_missing(spark, sf_dir):
    return G.not_located(geocoded(spark, sf_dir))


LOCATION_SQL = f"""{GEO_SQL},
places AS (SELECT location, iso, lat, lon, sum(n_obs) AS n_obs, sum(n_buildings) AS n_buildings, count(alias) AS n_datasets,
                  string_agg(alias, '; ' ORDER BY alias) AS datasets
           FROM located WHERE lat IS NOT NULL AND n_obs IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("geo_by_location", f"WITH {LOCATION_SQL} SELECT * FROM places")
def geo_by_location(spark, sf_dir):
    return G.by_location(geocoded(spark, sf_dir))


def shift_sql(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 2 - 1) * 2.5::DOUBLE"


@query(
    "geo_jitter",
    f"""WITH {LOCATION_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY lat, lon) AS k FROM places)
SELECT location, {r(f"lat + CASE WHEN k > 1 THEN {shift_sql('location', 'lat')} ELSE 0 END")} AS lat,
       {r(f"lon + CASE WHEN k > 1 THEN {shift_sql('location', 'lon')} ELSE 0 END")} AS lon FROM c""",
)
def geo_jitter(spark, sf_dir):
    out = G.jitter(G.by_location(geocoded(spark, sf_dir)), "location")
    return out.select("location", rd(F.col("lat")).alias("lat"), rd(F.col("lon")).alias("lon"))


@query(
    "geo_weight",
    f"""WITH {LOCATION_SQL}, w AS (SELECT *, log10(greatest(n_obs, 1)) AS w FROM places)
SELECT location, {r('2500 * (w / max(w) OVER ()) ** 2 + 15', 4)} AS area, {r('w')} AS colour,
       {r('30 + 3500 * sqrt(n_obs / max(n_obs) OVER ())', 4)} AS root_area FROM w""",
)
def geo_weight(spark, sf_dir):
    places = G.by_location(geocoded(spark, sf_dir))
    root = G.root_weight(places).select("location", rd(F.col("area"), 4).alias("root_area"))
    return G.bubble_weight(places).select("location", rd(F.col("area"), 4).alias("area"), rd(F.col("colour")).alias("colour")).join(root, "location")


# ---- dimensions -----------------------------------------------------------------------------


def subsets(spark, sf_dir):
    """Suppliers as data sets: sector by key parity, country by nation, present with a positive balance."""
    su, na = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    return su.join(na, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("alias"),
        F.when(F.col("s_suppkey") % 2 == 0, "Commercial").otherwise("Residential").alias("sector"),
        F.col("n_name").alias("country"), (F.col("s_acctbal") > 0).alias("present"),
    )


def devices(spark, sf_dir):
    """Country -> device by region; a country with a large supplier is also held by a sixth device."""
    su, na = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation")
    per = su.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"), F.max("s_acctbal").alias("x"))
    joined = na.join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    usual = joined.where(F.coalesce("m", F.lit(9e9)) > 3000).select((F.col("n_regionkey") + 1).alias("device"), F.col("n_name").alias("country"))
    return usual.unionByName(joined.where(F.col("x") > 9500).select(F.lit(6).alias("device"), F.col("n_name").alias("country")))


DIM_SQL = """
subsets AS (SELECT s_name AS alias, CASE WHEN s_suppkey % 2 = 0 THEN 'Commercial' ELSE 'Residential' END AS sector,
                   n_name AS country, s_acctbal > 0 AS present FROM supplier JOIN nation ON s_nationkey = n_nationkey),
per AS (SELECT s_nationkey, avg(s_acctbal) AS m, max(s_acctbal) AS x FROM supplier GROUP BY 1),
devices AS (
  SELECT n_regionkey + 1 AS device, n_name AS country FROM nation LEFT JOIN per ON n_nationkey = s_nationkey WHERE coalesce(m, 9e9) > 3000
  UNION ALL SELECT 6, n_name FROM nation JOIN per ON n_nationkey = s_nationkey WHERE x > 9500)"""


@query("dim_groups", f"WITH {DIM_SQL} SELECT device, country, sector || '/' || alias AS grp FROM subsets JOIN devices USING (country) WHERE present")
def dim_groups(spark, sf_dir):
    return D.device_groups(subsets(spark, sf_dir), devices(spark, sf_dir))


@query(
    "dim_checks",
    f"""WITH {DIM_SQL}, p AS (SELECT DISTINCT country FROM subsets WHERE present), h AS (SELECT DISTINCT country FROM devices)
SELECT 'duplicate' AS problem, country FROM devices GROUP BY country HAVING count(*) > 1
UNION ALL (SELECT 'missing', country FROM p EXCEPT SELECT 'missing', country FROM h)
UNION ALL (SELECT 'extra', country FROM h EXCEPT SELECT 'extra', country FROM p)""",
)
def dim_checks(spark, sf_dir):
    return D.checks(subsets(spark, sf_dir), devices(spark, sf_dir))


@query("dim_unassigned", f"WITH {DIM_SQL} SELECT n_name AS country, coalesce(device, 0) AS device FROM nation LEFT JOIN devices ON n_name = country")
def dim_unassigned(spark, sf_dir):
    return D.device_of(T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("country")), devices(spark, sf_dir))


def region_devices(spark, sf_dir):
    return T.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("device"), F.col("r_name").alias("grp"))


@query(
    "dim_preflight",
    f"""WITH {TEMPORAL_SQL}, items AS (SELECT DISTINCT grp, building, split FROM splits),
dev AS (SELECT r_regionkey + 1 AS device, r_name AS grp FROM region),
c AS (SELECT device, split, count(*) AS items FROM items JOIN dev USING (grp) GROUP BY 1, 2),
spine AS (SELECT device, unnest(['train', 'test']) AS split FROM dev)
SELECT device, split, coalesce(items, 0) AS items, coalesce(items, 0) = 0 AS error FROM spine LEFT JOIN c USING (device, split)""",
)
def dim_preflight(spark, sf_dir):
    items = S.temporal(nation_series(spark, sf_dir), PN).select("grp", "building", "split").distinct()
    return D.preflight(items, region_devices(spark, sf_dir))


@query(
    "dim_balance",
    f"""WITH {T.daily_sql()}, v AS (SELECT grp, count(*) AS w FROM daily GROUP BY 1),
d AS (SELECT r_regionkey + 1 AS device, sum(w)::BIGINT AS windows FROM v JOIN region ON grp = r_name GROUP BY 1)
SELECT device, windows, {r('windows::DOUBLE / sum(windows) OVER ()')} AS share, {r('windows::DOUBLE / max(windows) OVER ()')} AS of_largest, windows > 11000 AS over_cap FROM d""",
)
def dim_balance(spark, sf_dir):
    volumes = T.daily(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("windows"))
    out = D.balance(volumes, region_devices(spark, sf_dir), 11_000)
    return out.withColumns({c: rd(F.col(c)) for c in ("share", "of_largest")})
