"""Run-log analytics over lines (log, ord, line); ``ord`` orders the lines of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.fixed_values import LOG_END_MARK, LOG_EVENTS, LOG_FOLD_PROGRESS, LOG_SHARD_PROGRESS, LOG_SNAPSHOT
from wattloom.functions.scalars import duration_seconds, unit_to_gb
from wattloom.operators.history import smoothed
from wattloom.operators.ordered import int_bucket, time_bucket, with_index, with_lag, with_running

LINES_PER_BUCKET = 65_536


def _groups(lines: DataFrame, hint: str, pattern: str, groups: int) -> DataFrame:
    """Lines that hold ``hint`` and match; ``__g`` has their groups, from one pass of the pattern."""
    mark = "\x01"
    joined = F.regexp_replace("line", f"^.*?{pattern}.*$", mark.join(f"${i}" for i in range(1, groups + 1)))
    split = lines.where(F.col("line").contains(hint)).withColumn("__g", F.split(joined, mark))
    return split.where(F.size("__g") == groups)


def _group(i: int) -> Column:
    """Group i of a line, null when it is empty."""
    return F.nullif(F.get("__g", i - 1), F.lit(""))


def snapshots(lines: DataFrame) -> DataFrame:
    """Resource snapshots: context, resident and free memory, load, free disk (GB), elapsed seconds."""
    g = _group
    return _groups(lines, "[recursos @ ", LOG_SNAPSHOT, 9).select(
        "log", "ord", g(1).alias("context"),
        unit_to_gb(g(2), g(3)).alias("rss_gb"), unit_to_gb(g(4), g(5)).alias("ram_free_gb"),
        g(6).alias("load"), unit_to_gb(g(7), g(8)).alias("disk_free_gb"),
        duration_seconds(g(9)).alias("elapsed_s"),
    )


def status(lines: DataFrame) -> DataFrame:
    """Per log: lines, header lines, whether it ended properly, its last non-empty line."""
    filled = F.length(F.trim("line")) > 0
    return lines.groupBy("log").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("line").startswith("#")).alias("header_lines"),
        F.bool_or(F.col("line").contains(LOG_END_MARK)).alias("finished"),
        F.trim(F.max_by("line", F.when(filled, F.col("ord")))).alias("last_line"),
    )


def _slice_of(lines: DataFrame) -> Column:
    """Slices of a log's order axis: ``ord`` is a number, or file, block and line as the log reader gives them."""
    if not dict(lines.dtypes)["ord"].startswith("struct"):
        return int_bucket("ord", LINES_PER_BUCKET)
    return F.struct("ord.f", "ord.b", F.floor(F.col("ord.i") / LINES_PER_BUCKET).alias("i"))


def rss_growth(snaps: DataFrame) -> DataFrame:
    """First and last resident memory, whether it never fell (3 or more snapshots), low memory at the end."""
    linked = with_lag(snaps, ["log"], [F.col("ord")], _slice_of(snaps), {"__p": "rss_gb"})
    return linked.groupBy("log").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.min_by("rss_gb", "ord").alias("rss_first"), F.max_by("rss_gb", "ord").alias("rss_last"),
        (F.max_by("rss_gb", "ord") - F.min_by("rss_gb", "ord")).alias("rss_delta"),
        ((F.count(F.lit(1)) >= 3) & F.bool_and(F.col("__p").isNull() | (F.col("__p") <= F.col("rss_gb")))).alias("growing"),
        (F.max_by("ram_free_gb", "ord") < 5).alias("low_ram"),
    )


def last_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Last k rows per key; ranks beyond k are dropped before the shuffle."""
    by = W.partitionBy(*keys).orderBy(F.col("ord").desc())
    return df.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k).drop("__r")


def memory_trend(snaps: DataFrame, points: int = 12, dead_band: float = 0.05, alarm_days: float = 10.0) -> DataFrame:
    """Slope of free memory over the last points (4 or more), what it means, seconds until it is gone."""
    recent = last_k(snaps.where(F.col("elapsed_s").isNotNull()), ["log"], points)
    fitted = recent.groupBy("log").agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.regr_slope("ram_free_gb", "elapsed_s"), F.lit(0.0)).alias("__k"),
        F.max_by("ram_free_gb", "ord").alias("__last"),
    ).where(F.col("points") >= 4)
    per_min = F.col("__k") * 60
    falling = (F.abs(per_min) >= dead_band) & (per_min < 0)
    zero = F.when(falling, F.col("__last") / -F.col("__k"))
    return fitted.select(
        "log", "points", per_min.alias("gb_per_min"),
        F.when(F.abs(per_min) < dead_band, "stable").when(per_min >= 0, "recovering")
        .when(zero < alarm_days * 86400, "falling").otherwise("falling slowly").alias("state"),
        zero.alias("seconds_to_zero"),
    )


def fold_progress(lines: DataFrame) -> DataFrame:
    g = _group
    out = _groups(lines, " fold ", LOG_FOLD_PROGRESS, 5).select(
        "log", "ord", g(1).alias("stage"), g(2).cast("int").alias("fold"), g(3).cast("int").alias("folds"),
        g(4).cast("int").alias("epoch"), duration_seconds(g(5)).alias("seconds"),
    )
    return out.where(F.col("seconds").isNotNull())


def eta_folds(progress: DataFrame) -> DataFrame:
    """Remaining time from whole-fold durations: the mean of closed folds, or the current one alone."""
    per = progress.groupBy("log", "fold").agg(
        F.sum("seconds").alias("s"), F.max("ord").alias("o"),
        F.max_by(F.struct("stage", "folds", "epoch"), "ord").alias("last"),
    )
    cur = per.groupBy("log").agg(
        F.max("fold").alias("fold"), F.max_by("s", "fold").alias("elapsed_current"),
        F.sum("s").alias("__all"), F.count(F.lit(1)).alias("__n"), F.max_by("last", "o").alias("last"),
    )
    closed = F.col("__n") - 1
    mean = F.when(closed > 0, (F.col("__all") - F.col("elapsed_current")) / closed).otherwise(F.col("elapsed_current"))
    left = F.greatest(F.lit(0.0), F.col("mean_fold") - F.col("elapsed_current"))
    after = F.greatest(F.lit(0), F.col("last.folds") - F.col("fold"))
    return cur.withColumn("mean_fold", mean).select(
        "log", F.col("last.stage").alias("stage"), "fold", F.col("last.folds").alias("folds"),
        closed.alias("closed_folds"), "elapsed_current", "mean_fold", (left + after * F.col("mean_fold")).alias("eta_s"),
    )


def shard_progress(lines: DataFrame) -> DataFrame:
    g = _group
    out = _groups(lines, " shard ", LOG_SHARD_PROGRESS, 6).select(
        "log", "ord", g(1).alias("stage"), g(2).cast("int").alias("epoch"), g(3).cast("int").alias("epochs"),
        g(4).cast("int").alias("shard"), g(5).cast("int").alias("shards"), duration_seconds(g(6)).alias("seconds"),
    )
    return out.where(F.col("seconds").isNotNull())


def eta_epochs(progress: DataFrame) -> DataFrame:
    """Remaining time from the shard rate of the current epoch and the length of closed ones."""
    per = progress.groupBy("log", "epoch").agg(
        F.count(F.lit(1)).alias("points"), F.max("ord").alias("o"),
        F.regr_slope("shard", "seconds").alias("slope"),
        F.max_by(F.struct("seconds", "shard", "stage", "epochs", "shards"), "ord").alias("last"),
    )
    cur = per.groupBy("log").agg(
        F.max_by(F.struct("epoch", "points", "slope", "last"), "epoch").alias("c"),
        F.max_by("last", "o").alias("l"), F.sum("last.seconds").alias("__all"), F.count(F.lit(1)).alias("__n"),
    )
    sec, shard = F.col("c.last.seconds"), F.col("c.last.shard")
    rate = F.when(F.col("c.points") >= 2, F.coalesce("c.slope", F.lit(0.0))).otherwise(shard / F.greatest(sec, F.lit(1e-9)))
    closed = F.col("__n") - 1
    out = cur.withColumn("rate", rate).where(F.col("rate") > 0)
    rest = (F.col("l.shards") - shard) / F.col("rate")
    whole = F.when(closed > 0, (F.col("__all") - sec) / closed).otherwise(F.col("l.shards") / F.col("rate"))
    after = F.greatest(F.lit(0), F.col("l.epochs") - F.col("c.epoch"))
    return out.select(
        "log", F.col("l.stage").alias("stage"), F.col("c.epoch").alias("epoch"), F.col("l.epochs").alias("epochs"),
        shard.alias("shard"), F.col("l.shards").alias("shards"), (F.col("rate") * 60).alias("shards_per_min"),
        rest.alias("epoch_left_s"), whole.alias("epoch_s"), (rest + after * whole).alias("eta_s"),
    )


def event_classes() -> Column:
    """Classes a line belongs to; a line may be in several."""
    tests = []
    for name, choices in LOG_EVENTS.items():
        hit = F.lit(False)
        for ignore_case, phrases in choices:
            line = F.lower("line") if ignore_case else F.col("line")
            every = F.lit(True)
            for phrase in phrases:
                every = every & line.contains(phrase)
            hit = hit | every
        tests.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*tests))


def event_tail(lines: DataFrame, k: int = 8) -> DataFrame:
    """Per log and event class: how many lines, and the last k of them."""
    hits = lines.withColumn("event", F.explode(event_classes()))
    counts = hits.groupBy("log", "event").agg(F.count(F.lit(1)).alias("events"))
    tail = last_k(hits, ["log", "event"], k).select("log", "event", "ord", F.trim("line").alias("line"))
    return tail.join(counts, ["log", "event"])


# ---- loss curves ------------------------------------------------------------------------------


def global_steps(loss: DataFrame, key: str = "tag", order: str = "ts", bucket: Column | None = None) -> DataFrame:
    """Steps that never restart: whenever a step does not exceed the one before, the earlier ones
    are added. Also the minutes since the series began."""
    bucket = time_bucket(order, 86_400) if bucket is None else bucket
    order_cols = [F.col(order), F.col("step")]
    linked = with_lag(loss, [key], order_cols, bucket, {"__p": "step"})
    jump = F.when(F.col("step") <= F.col("__p"), F.col("__p") + 1).otherwise(0).cast("long")
    run = with_running(
        linked.withColumn("__j", jump).withColumn("__us", F.unix_micros(F.col(order).cast("timestamp"))),
        [key], order_cols, bucket, {"__off": ("sum", "__j"), "__t0": ("min", "__us")},
    )
    return run.select(
        *loss.columns, (F.col("step") + F.col("__off")).alias("global_step"),
        ((F.col("__us") - F.col("__t0")) / 6e7).alias("minutes"),
    )


def moving_loss(loss: DataFrame, k: int, key: str = "tag", order: str = "ts", span_seconds: int = 86_400) -> DataFrame:
    """Trailing mean of up to k points in time order."""
    ix = with_index(loss, [key], [F.col(order), F.col("step")], time_bucket(order, span_seconds))
    return smoothed(ix, [key], "t", "loss", k)


def series_labels(records: DataFrame) -> DataFrame:
    """Per file: "parent:tag", with the stages unless the only one is fit.

    ``records``: parent, tag, stage.
    """
    per = records.groupBy("parent", "tag").agg(
        F.array_sort(F.collect_set(F.coalesce("stage", F.lit("?")))).alias("s")
    )
    base = F.concat(F.col("parent"), F.lit(":"), F.col("tag"))
    stages = F.concat(F.lit(" ("), F.array_join("s", ","), F.lit(")"))
    plain = F.col("s") == F.array(F.lit("fit"))
    return per.select("parent", "tag", F.when(plain, base).otherwise(F.concat(base, stages)).alias("label"))


# ---- resource samples and run summaries -------------------------------------------------------


def resource_summary(samples: DataFrame, bucket: Column, key: str = "tag") -> DataFrame:
    """Mean and peak of CPU, load and memory. CPU percent comes from differences of two counters.

    ``samples``: key, ts, busy, total (counters), load1, ram_used_gb, rss_gb.
    """
    linked = with_lag(samples, [key], [F.col("ts")], bucket, {"__pb": "busy", "__pt": "total"})
    dt = F.col("total") - F.col("__pt")
    cpu = F.when(dt > 0, 100.0 * (F.col("busy") - F.col("__pb")) / dt)
    return linked.withColumn("cpu", cpu).groupBy(key).agg(
        F.avg("cpu").alias("cpu_pct_avg"), F.max("cpu").alias("cpu_pct_max"), F.avg("load1").alias("load1_avg"),
        F.avg("ram_used_gb").alias("ram_used_gb_avg"), F.max("ram_used_gb").alias("ram_used_gb_max"),
        F.avg("rss_gb").alias("rss_gb_avg"), F.max("rss_gb").alias("rss_gb_max"), F.count(F.lit(1)).alias("n_samples"),
    )


def rate_and_eta(progress: DataFrame) -> DataFrame:
    """units per minute and seconds left; null before anything is done.

    ``progress``: elapsed_s, done_units, total_units.
    """
    ok = (F.col("elapsed_s") > 0) & (F.col("done_units") > 0)
    rate = F.when(ok, F.col("done_units") / (F.col("elapsed_s") / 60.0))
    left = F.greatest(F.lit(0), F.col("total_units") - F.col("done_units"))
    return progress.withColumn("units_per_min", rate).withColumn(
        "eta_s", F.when(F.col("total_units") > 0, left / F.col("units_per_min") * 60.0)
    )


def attach_summary(results: DataFrame, summaries: DataFrame, key: str = "tag", prefix: str = "mon_") -> DataFrame:
    """Result rows with the run summary of the same tag as prefixed columns."""
    renamed = summaries.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in summaries.columns if c != key])
    return results.join(renamed, key, "left")


def extrapolate(
    summaries: DataFrame, full_units: DataFrame, rounds: int, local_epochs: int = 1, overhead_s: float = 30.0
) -> tuple[DataFrame, DataFrame]:
    """Full-epoch time per host, and the round and total time set by the slowest host.

    ``summaries``: host, units_per_min; ``full_units``: host, full_units.
    """
    epoch = F.when(
        (F.col("units_per_min") > 0) & (F.col("full_units") > 0), F.col("full_units") / F.col("units_per_min") * 60.0
    )
    hosts = summaries.join(full_units, "host", "left").withColumn("t_full_epoch_s", epoch)
    slow = hosts.agg(
        F.max_by("host", F.struct(F.col("t_full_epoch_s"), "host")).alias("straggler"), F.max("t_full_epoch_s").alias("__m")
    )
    per_round = F.col("__m") * local_epochs + overhead_s
    total = slow.where(F.col("__m").isNotNull()).select(
        "straggler", per_round.alias("t_round_s"), (per_round * rounds).alias("t_total_s")
    )
    return hosts, total
