"""Queries for run-log analytics, loss curves and resource samples.

The log lines are written from the events table in the run-log format and parsed back; the SQL
twins compute the same numbers straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import scalars as SC
from wattloom.operators import runlog as RL
from wattloom.operators.ordered import time_bucket
from wattloom.plans import tables as T
from wattloom.plans.registry import query
from wattloom.plans.series_queries import rd
from wattloom.plans.sqltext import r

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def log_lines(spark, sf_dir):
    """One line per event; the kind of line depends on the event's number."""
    ev = T.table(spark, sf_dir, "events")
    ev = ev.withColumns(
        {
            "kind": F.col("event_id") % 6,
            "s": F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.expr(EPOCH).cast("timestamp"))) / 1e6).cast("long"),
        }
    ).withColumns({"ep": F.floor(F.col("s") / 864000) + 1, "es": F.col("s") % 864000, "fold": F.floor(F.col("s") / 691200) + 1})
    unit = F.when(F.col("user_id") % 2 == 0, "MB").otherwise("GB")
    snap = F.format_string(
        "  [recursos @ ctx_%d] RSS=%.2f%s | RAM_disp=%.2fGB | load=1.0/0.5/0.2 | disco_livre=%.2fTB | gpu=- | t+%s",
        "user_id", "value", unit, F.col("value") / 10, F.col("value"), SC.duration_text(F.col("s").cast("double")),
    )
    shard = F.format_string(
        "[step6:fit] ep %d/4 shard %d/200 | train=0.5 val=0.4 (%s, lr=0.001)",
        "ep", F.floor(F.col("es") / 4320), SC.duration_text(F.col("es").cast("double")),
    )
    fold = F.format_string(
        "[step6:tune] fold %d/5 ep %d: train=0.5 val=0.4 (%s)",
        "fold", (F.col("event_id") % 9) + 1, SC.duration_text(F.floor("value") + 60.0),
    )
    done = F.format_string("[step6:fit] === época %d completa: val=0.4 ===", "ep")
    closing = F.when(F.col("user_id") % 3 == 0, F.lit("# fim: resumo")).otherwise(F.lit("# cabeçalho"))
    line = (
        F.when(F.col("kind") <= 1, snap).when(F.col("kind") == 2, shard).when(F.col("kind") == 3, fold)
        .when(F.col("kind") == 4, done).otherwise(closing)
    )
    return ev.select(F.col("event_type").alias("log"), F.col("event_id").alias("ord"), line.alias("line"))


EV_SQL = """
ev AS (SELECT event_type AS log, event_id AS ord, event_id % 6 AS kind, user_id, value,
              (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS s FROM events),
snaps AS (SELECT log, ord, 'ctx_' || user_id AS context, CASE WHEN user_id % 2 = 0 THEN value / 1024 ELSE value END AS rss,
                 round(value / 10, 2) AS ram, value * 1024 AS disk, s::DOUBLE AS t FROM ev WHERE kind <= 1),
folds AS (SELECT log, ord, (s // 691200 + 1)::INT AS fold, (ord % 9 + 1)::INT AS ep, floor(value) + 60 AS sec FROM ev WHERE kind = 3),
shards AS (SELECT log, ord, (s // 864000 + 1)::INT AS ep, (s % 864000 // 4320)::INT AS sh, (s % 864000)::DOUBLE AS sec FROM ev WHERE kind = 2)"""


@query(
    "log_snapshots",
    f"""WITH {EV_SQL} SELECT log, ord, context, {r('rss')} AS rss_gb, {r('disk', 4)} AS disk_free_gb, t AS elapsed_s FROM snaps""",
)
def log_snapshots(spark, sf_dir):
    out = RL.snapshots(log_lines(spark, sf_dir))
    return out.select(
        "log", "ord", "context", rd(F.col("rss_gb")).alias("rss_gb"), rd(F.col("disk_free_gb"), 4).alias("disk_free_gb"), "elapsed_s"
    )


@query(
    "log_duration",
    """WITH d AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
                        WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || '.0s' END AS text,
       s::DOUBLE AS seconds,
       CASE WHEN s >= 86400 THEN (s // 86400) || 'd' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm'
            WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE (s // 60) || 'm' END AS days_text
FROM d""",
)
def log_duration(spark, sf_dir):
    s = T.table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("s"))
    text = SC.duration_text(F.col("s"))
    return s.select(
        "o_orderkey", text.alias("text"), SC.duration_seconds(text).alias("seconds"), SC.duration_days_text(F.col("s")).alias("days_text")
    )


@query(
    "log_status",
    f"""WITH {EV_SQL} SELECT log, count(*) AS lines, count(*) FILTER (WHERE kind = 5) AS header_lines,
       bool_or(kind = 5 AND user_id % 3 = 0) AS finished FROM ev GROUP BY 1""",
)
def log_status(spark, sf_dir):
    return RL.status(log_lines(spark, sf_dir)).drop("last_line")


@query(
    "log_rss",
    f"""WITH {EV_SQL}, g AS (SELECT *, lag(rss) OVER (PARTITION BY log ORDER BY ord) AS p FROM snaps)
SELECT log, count(*) AS snapshots, {r('arg_min(rss, ord)')} AS rss_first, {r('arg_max(rss, ord)')} AS rss_last,
       {r('arg_max(rss, ord) - arg_min(rss, ord)')} AS rss_delta, count(*) >= 3 AND bool_and(p IS NULL OR p <= rss) AS growing,
       arg_max(ram, ord) < 5 AS low_ram FROM g GROUP BY 1""",
)
def log_rss(spark, sf_dir):
    out = RL.rss_growth(RL.snapshots(log_lines(spark, sf_dir)))
    return out.withColumns({c: rd(F.col(c)) for c in ("rss_first", "rss_last", "rss_delta")})


@query(
    "log_trend",
    f"""WITH {EV_SQL}, p AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY log ORDER BY ord DESC) <= 12),
k AS (SELECT log, count(*) AS points, regr_slope(ram, t) AS k, arg_max(ram, ord) AS final FROM p GROUP BY 1 HAVING count(*) >= 4)
SELECT log, points, {r('k * 60', 4)} AS gb_per_min,
       CASE WHEN abs(k * 60) < 0.05 THEN 'stable' WHEN k >= 0 THEN 'recovering' WHEN final / -k < 864000 THEN 'falling' ELSE 'falling slowly' END AS state FROM k""",
)
def log_trend(spark, sf_dir):
    out = RL.memory_trend(RL.snapshots(log_lines(spark, sf_dir)))
    return out.select("log", "points", rd(F.col("gb_per_min"), 4).alias("gb_per_min"), "state")


@query(
    "log_eta_fold",
    f"""WITH {EV_SQL},
f AS (SELECT log, fold, sum(sec) AS s FROM folds GROUP BY 1, 2),
c AS (SELECT log, max(fold) AS fold, arg_max(s, fold) AS cur, sum(s) AS total, count(*) - 1 AS closed FROM f GROUP BY 1),
m AS (SELECT *, CASE WHEN closed > 0 THEN (total - cur) / closed ELSE cur END AS mean FROM c)
SELECT log, 'tune' AS stage, fold, 5::INT AS folds, closed AS closed_folds, cur AS elapsed_current, {r('mean', 4)} AS mean_fold,
       {r('greatest(0, mean - cur) + greatest(0, 5 - fold) * mean', 4)} AS eta_s FROM m""",
)
def log_eta_fold(spark, sf_dir):
    out = RL.eta_folds(RL.fold_progress(log_lines(spark, sf_dir)))
    return out.withColumns({c: rd(F.col(c), 4) for c in ("mean_fold", "eta_s")})


@query(
    "log_eta_epoch",
    f"""WITH {EV_SQL},
e AS (SELECT log, ep, count(*) AS n, regr_slope(sh, sec) AS slope, arg_max(sh, ord) AS sh, arg_max(sec, ord) AS sec FROM shards GROUP BY 1, 2),
c AS (SELECT log, max(ep) AS ep, arg_max(sh, ep) AS sh, arg_max(sec, ep) AS sec, arg_max(CASE WHEN n >= 2 THEN slope ELSE sh / sec END, ep) AS rate,
             sum(sec) AS total, count(*) - 1 AS closed FROM e GROUP BY 1),
w AS (SELECT *, CASE WHEN closed > 0 THEN (total - sec) / closed ELSE 200 / rate END AS whole FROM c WHERE rate > 0)
SELECT log, 'fit' AS stage, ep AS epoch, 4::INT AS epochs, sh AS shard, 200::INT AS shards, {r('rate * 60', 4)} AS shards_per_min,
       {r('(200 - sh) / rate', 2)} AS epoch_left_s, {r('whole', 2)} AS epoch_s, {r('(200 - sh) / rate + greatest(0, 4 - ep) * whole', 2)} AS eta_s FROM w""",
)
def log_eta_epoch(spark, sf_dir):
    out = RL.eta_epochs(RL.shard_progress(log_lines(spark, sf_dir)))
    digits = {"shards_per_min": 4, "epoch_left_s": 2, "epoch_s": 2, "eta_s": 2}
    return out.withColumns({c: rd(F.col(c), d) for c, d in digits.items()})


@query(
    "log_tail",
    f"""WITH {EV_SQL}, h AS (SELECT log, ord, CASE WHEN kind IN (2, 3) THEN 'training' ELSE 'epoch_done' END AS event FROM ev WHERE kind IN (2, 3, 4)),
k AS (SELECT *, row_number() OVER (PARTITION BY log, event ORDER BY ord DESC) AS rk, count(*) OVER (PARTITION BY log, event) AS events FROM h)
SELECT log, event, ord, events FROM k WHERE rk <= 8""",
)
def log_tail(spark, sf_dir):
    return RL.event_tail(log_lines(spark, sf_dir)).select("log", "event", "ord", "events")


# ---- loss curves ----------------------------------------------------------------------------


def losses(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), "ts", F.col("user_id").alias("step"), F.col("value").alias("loss"), "event_id"
    )


LOSS_SQL = "l AS (SELECT event_type AS tag, ts, user_id AS step, value AS loss, event_id FROM events)"


@query(
    "loss_steps",
    f"""WITH {LOSS_SQL}, p AS (SELECT *, lag(step) OVER w AS p, min(ts) OVER (PARTITION BY tag) AS t0 FROM l WINDOW w AS (PARTITION BY tag ORDER BY ts, step)),
o AS (SELECT *, sum(CASE WHEN step <= p THEN p + 1 ELSE 0 END) OVER (PARTITION BY tag ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS off FROM p)
SELECT tag, event_id, (step + off)::BIGINT AS global_step, {r('(epoch_us(ts) - epoch_us(t0)) / 6e7::DOUBLE', 8)} AS minutes FROM o""",
)
def loss_steps(spark, sf_dir):
    out = RL.global_steps(losses(spark, sf_dir))
    return out.select("tag", "event_id", "global_step", rd(F.col("minutes"), 8).alias("minutes"))


@query(
    "loss_smooth",
    f"""WITH {LOSS_SQL} SELECT tag, event_id, {r('avg(loss) OVER (PARTITION BY tag ORDER BY ts, step ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 7)} AS smoothed FROM l""",
)
def loss_smooth(spark, sf_dir):
    out = RL.moving_loss(losses(spark, sf_dir), 7)
    return out.select("tag", "event_id", rd(F.col("smoothed"), 7).alias("smoothed"))


@query(
    "loss_label",
    """WITH s AS (SELECT o_orderpriority AS parent, o_orderstatus AS tag, CASE WHEN o_totalprice > 400000 THEN 'evaluate' ELSE 'fit' END AS stage FROM orders),
g AS (SELECT parent, tag, list_sort(list(DISTINCT stage)) AS st FROM s GROUP BY 1, 2)
SELECT parent, tag, parent || ':' || tag || CASE WHEN st = ['fit'] THEN '' ELSE ' (' || array_to_string(st, ',') || ')' END AS label FROM g""",
)
def loss_label(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("tag"),
        F.when(F.col("o_totalprice") > 400000, "evaluate").otherwise("fit").alias("stage"),
    )
    return RL.series_labels(o)


# ---- resource samples -----------------------------------------------------------------------

SUMMARY_COLS = ("cpu_pct_avg", "cpu_pct_max", "load1_avg", "ram_used_gb_avg", "ram_used_gb_max", "rss_gb_avg", "rss_gb_max")


def resource_summary(spark, sf_dir):
    """Samples from events: counters grow with the event number and the user."""
    ev = T.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), "ts", (F.col("event_id") * 3 + F.col("user_id") % 3).alias("busy"),
        (F.col("event_id") * 4).alias("total"), (F.col("value") / 100).alias("load1"),
        (F.col("value") / 8).alias("ram_used_gb"), (F.col("value") / 16).alias("rss_gb"),
    )
    return RL.resource_summary(ev, time_bucket("ts", 86_400))


MON_SQL = f"""
s AS (SELECT event_type AS tag, ts, event_id * 3 + user_id % 3 AS busy, event_id * 4 AS total, value FROM events),
d AS (SELECT *, busy - lag(busy) OVER w AS db, total - lag(total) OVER w AS dt FROM s WINDOW w AS (PARTITION BY tag ORDER BY ts)),
mon AS (SELECT tag, avg(CASE WHEN dt > 0 THEN 100.0::DOUBLE * db / dt END) AS cpu_pct_avg, max(CASE WHEN dt > 0 THEN 100.0::DOUBLE * db / dt END) AS cpu_pct_max,
  avg(value / 100) AS load1_avg, avg(value / 8) AS ram_used_gb_avg, max(value / 8) AS ram_used_gb_max, avg(value / 16) AS rss_gb_avg,
  max(value / 16) AS rss_gb_max, count(*) AS n_samples FROM d GROUP BY 1),
rmon AS (SELECT tag, {', '.join(f'{r(c, 7)} AS {c}' for c in SUMMARY_COLS)}, n_samples FROM mon)"""


@query("mon_summary", f"WITH {MON_SQL} SELECT * FROM rmon")
def mon_summary(spark, sf_dir):
    out = resource_summary(spark, sf_dir)
    return out.select("tag", *[rd(F.col(c), 7).alias(c) for c in SUMMARY_COLS], "n_samples")


PROGRESS_SQL = """
progress AS (SELECT o_orderpriority AS host, count(*) AS done_units, 4000::BIGINT AS total_units, sum(o_totalprice) / 1e6 AS elapsed_s FROM orders GROUP BY 1),
eta AS (SELECT *, done_units / (elapsed_s / 60) AS units_per_min, greatest(0, total_units - done_units) / (done_units / (elapsed_s / 60)) * 60 AS eta_s FROM progress)"""


def progress(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("host")).agg(
        F.count(F.lit(1)).alias("done_units"), F.lit(4000).cast("long").alias("total_units"),
        (F.sum("o_totalprice") / 1e6).alias("elapsed_s"),
    )


@query("mon_eta", f"WITH {PROGRESS_SQL} SELECT host, done_units, total_units, {r('units_per_min', 4)} AS units_per_min, {r('eta_s', 4)} AS eta_s FROM eta")
def mon_eta(spark, sf_dir):
    out = RL.rate_and_eta(progress(spark, sf_dir))
    return out.select("host", "done_units", "total_units", rd(F.col("units_per_min"), 4).alias("units_per_min"), rd(F.col("eta_s"), 4).alias("eta_s"))


@query(
    "mon_merge",
    f"""WITH {MON_SQL}, res AS (SELECT event_type AS tag, count(*) AS points, max(user_id) AS max_user FROM events GROUP BY 1)
SELECT res.*, {', '.join(f'{c} AS mon_{c}' for c in (*SUMMARY_COLS, 'n_samples'))} FROM res LEFT JOIN rmon USING (tag)""",
)
def mon_merge(spark, sf_dir):
    results = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(
        F.count(F.lit(1)).alias("points"), F.max("user_id").alias("max_user")
    )
    return RL.attach_summary(results, mon_summary(spark, sf_dir))


@query(
    "mon_extrapolate",
    f"""WITH {PROGRESS_SQL}, fu AS (SELECT o_orderpriority AS host, count(DISTINCT o_custkey) * 10 AS full_units FROM orders GROUP BY 1),
h AS (SELECT host, full_units / units_per_min * 60 AS t FROM eta JOIN fu USING (host))
SELECT arg_max(host, t) AS straggler, {r('max(t) * 2 + 30', 4)} AS t_round_s, {r('(max(t) * 2 + 30) * 10', 3)} AS t_total_s FROM h""",
)
def mon_extrapolate(spark, sf_dir):
    full = T.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("host")).agg(
        (F.countDistinct("o_custkey") * 10).alias("full_units")
    )
    _, total = RL.extrapolate(RL.rate_and_eta(progress(spark, sf_dir)), full, rounds=10, local_epochs=2)
    return total.select("straggler", rd(F.col("t_round_s"), 4).alias("t_round_s"), rd(F.col("t_total_s"), 3).alias("t_total_s"))
