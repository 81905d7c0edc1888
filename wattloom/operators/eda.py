"""Exploratory analysis of load series (keys: grp = data set, building)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.functions.scalars import seeded_order
from wattloom.operators.clean import KEYS, mean_duplicates
from wattloom.operators.ordered import grouped_percentile, time_bucket, with_halo, with_index, with_lag
from wattloom.session import materialize

DAY_SECONDS = 86_400
SPAN = 4096 * DAY_SECONDS // 24


def merge_mean(df: DataFrame) -> DataFrame:
    """Overlapping parts of a building: readings at the same time are averaged."""
    return mean_duplicates(df)


def pivot(df: DataFrame, buildings: Sequence[str]) -> DataFrame:
    """One column per named building. Only for output: everything else stays long."""
    return df.groupBy("ts").pivot("building", list(buildings)).agg(F.avg("energy"))


def timestamps(df: DataFrame) -> DataFrame:
    """Distinct timestamps of each data set."""
    return df.select("grp", "ts").distinct()


def step_hours(df: DataFrame, span_seconds: int = SPAN) -> DataFrame:
    """Median distance between neighbouring timestamps of a data set; 1.0 below three of them."""
    lagged = with_lag(timestamps(df), ["grp"], [F.col("ts")], time_bucket("ts", span_seconds), {"prev": "ts"})
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))) / 3.6e9
    # gaps take few distinct values, which is all percentile keeps
    return lagged.withColumn("gap", gap).groupBy("grp").agg(
        F.when(F.count(F.lit(1)) < 3, F.lit(1.0)).otherwise(F.percentile("gap", 0.5)).alias("step_hours")
    )


def _from_middle(rows: DataFrame, keys: Sequence[str], span_seconds: int) -> DataFrame:
    ix = with_index(rows, keys, [F.col("ts")], time_bucket("ts", span_seconds))
    middle = ix.where(F.col("t") == F.floor(F.col("n") / 2))
    return middle.select(*keys, F.date_trunc("day", "ts").cast("timestamp_ntz").alias("__from"))


def _cut(df: DataFrame, start: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    upper = F.col("__from") + F.expr(f"INTERVAL {days} DAYS")
    return df.join(start, list(keys)).where(F.col("ts").between(F.col("__from"), upper)).drop("__from")


def slice_days(df: DataFrame, days: int = 3, span_seconds: int = SPAN) -> DataFrame:
    """Per building: from midnight of its middle reading, ``days`` on, upper end included."""
    valid = df.where(F.col("energy").isNotNull())
    return _cut(valid, _from_middle(valid, KEYS, span_seconds), KEYS, days)


def sample_buildings(df: DataFrame, k: int, seed: int) -> DataFrame:
    """k buildings of each data set by seeded hash."""
    per = df.select("grp", "building").distinct().withColumn("__h", seeded_order(F.col("building"), seed=seed))
    rank = F.row_number().over(W.partitionBy("grp").orderBy("__h", "building"))
    return per.withColumn("__r", rank).where(F.col("__r") <= k).select("grp", "building")


def slice_sample(df: DataFrame, k: int, days: int = 3, seed: int = 1, span_seconds: int = SPAN) -> DataFrame:
    """k sampled buildings on one common range, around the middle of their joint timestamps."""
    sub = df.join(sample_buildings(df, k, seed), ["grp", "building"], "left_semi").where(F.col("energy").isNotNull())
    return _cut(sub, _from_middle(timestamps(sub), ["grp"], span_seconds), ["grp"], days)


def dataset_span(df: DataFrame) -> DataFrame:
    """Per data set: number of timestamps, first, last, whole days between them (at least 1)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    per = timestamps(df).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_timestamps"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    days = F.floor((micros(F.col("end")) - micros(F.col("start"))) / (DAY_SECONDS * 1e6)).cast("long")
    return per.withColumn("span_days", F.greatest(days, F.lit(1).cast("long")))


def building_stats(df: DataFrame, span_seconds: int = SPAN) -> DataFrame:
    """peak, mean, energy, annual energy, energy / peak in hours per year, completeness, n_obs."""
    per = df.groupBy("grp", "building").agg(
        F.max("energy").alias("peak"), F.avg("energy").alias("mean"),
        F.sum("energy").alias("__sum"), F.count("energy").alias("n_obs"),
    )
    sets = dataset_span(df).join(step_hours(df, span_seconds), "grp")
    joined = per.join(sets, "grp")
    energy = F.coalesce("__sum", F.lit(0.0)) * F.col("step_hours")
    yearly = energy * 365.0 / F.col("span_days")
    return joined.select(
        "grp", "building", "peak", "mean",
        energy.alias("energy_total"), yearly.alias("energy_annualized"),
        (yearly / F.nullif(F.col("peak"), F.lit(0.0))).alias("energy_to_peak_h_per_year"),
        (F.col("n_obs") / F.col("n_timestamps")).alias("completeness"), "n_obs",
    )


def dataset_summary(df: DataFrame, span_seconds: int = SPAN) -> DataFrame:
    """One row per data set: sizes, range, step, medians of the building statistics."""
    stats = materialize(building_stats(df, span_seconds), "building-stats")
    med = grouped_percentile(stats, ["grp"], ["peak", "energy_to_peak_h_per_year", "completeness"], {"m": 0.5})
    pick = lambda c: F.max(F.when(F.col("metric") == c, F.col("m")))
    medians = med.groupBy("grp").agg(
        pick("peak").alias("median_peak"), pick("energy_to_peak_h_per_year").alias("median_energy_to_peak_h"),
        pick("completeness").alias("median_completeness"),
    )
    counts = stats.groupBy("grp").agg(F.count(F.lit(1)).alias("n_buildings"), F.sum("n_obs").alias("n_obs"))
    sets = dataset_span(df).drop("span_days").join(step_hours(df, span_seconds), "grp")
    return sets.join(counts, "grp").join(medians, "grp")


def week_end(ts: str) -> Column:
    """The Sunday that closes the week of a timestamp."""
    return (F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")).cast("date")


def availability(df: DataFrame) -> DataFrame:
    """Weekly share of non-null readings per building, among the data set's own timestamps."""
    weeks = timestamps(df).groupBy("grp", week_end("ts").alias("week")).agg(F.count(F.lit(1)).alias("slots"))
    got = df.groupBy("grp", "building", week_end("ts").alias("week")).agg(F.count("energy").alias("seen"))
    # a calendar of weeks per data set, unfolded per building
    calendar = weeks.groupBy("grp").agg(F.collect_list(F.struct("week", "slots")).alias("cal"))
    grid = (
        df.select("grp", "building").distinct().join(calendar, "grp")
        .select("grp", "building", F.explode("cal").alias("w")).select("grp", "building", "w.*")
    )
    return grid.join(got, ["grp", "building", "week"], "left").select(
        "grp", "building", "week", (F.coalesce("seen", F.lit(0)) / F.col("slots")).alias("share")
    )


def mean_load(df: DataFrame) -> DataFrame:
    return df.groupBy("grp", "ts").agg(F.avg("energy").alias("mean_load"))


def day_hour(ts: str) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def daily_profile(load: DataFrame) -> DataFrame:
    """Mean and quartiles of the mean load by hour of day, working days and weekends apart."""
    return load.groupBy("grp", (F.weekday("ts") >= 5).alias("weekend"), day_hour("ts").alias("hour")).agg(
        F.avg("mean_load").alias("mean"), F.percentile("mean_load", 0.25).alias("q25"),
        F.percentile("mean_load", 0.75).alias("q75"),
    )


def month_hour(load: DataFrame, hours: Sequence[int] = tuple(range(24))) -> DataFrame:
    """Mean load, one row per month and one column per hour."""
    by_hour = load.withColumn("hour", F.hour("ts")).groupBy("grp", F.month("ts").alias("month"))
    return by_hour.pivot("hour", list(hours)).agg(F.avg("mean_load"))


def daily_energy(df: DataFrame, hours_per_step: DataFrame, half: int = 15) -> DataFrame:
    """Energy per day (days without data count 0) and its centred mean over 2 * half days."""
    day = F.date_trunc("day", "ts").cast("date")
    sums = df.groupBy("grp", day.alias("day")).agg(F.sum("energy").alias("__s"))
    spine = sums.groupBy("grp").agg(F.min("day").alias("__a"), F.max("day").alias("__z")).select(
        "grp", "__a", F.explode(F.sequence("__a", "__z", F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    days = (
        spine.join(sums, ["grp", "day"], "left").join(hours_per_step, "grp")
        .select(
            "grp", "day", F.datediff("day", "__a").cast("long").alias("t"),
            (F.coalesce("__s", F.lit(0.0)) * F.col("step_hours")).alias("energy"),
        )
    )
    near = W.partitionBy("grp", "__blk").orderBy("t").rowsBetween(-half, half - 1)
    placed = with_halo(days, "t", 4096, before=half, after=half - 1)
    full = F.count(F.lit(1)).over(near) == 2 * half
    return placed.withColumn("smoothed", F.when(full, F.avg("energy").over(near))).where("__own").drop("__own", "__blk", "t")


def correlation(df: DataFrame, buildings: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of the listed buildings (grp, building) over the timestamps both have (a < b).

    Without a list every building takes part; the pairs of a group grow with the square of its list, so a
    large group wants ``sample_buildings`` first.
    Each task adds up cross sums over its own timestamps and emits one row per pair, so the
    shuffle does not grow with the number of readings.
    """
    if buildings is not None:
        df = df.join(buildings.select("grp", "building").distinct(), ["grp", "building"], "left_semi")
    per_ts = (
        df.where(F.col("energy").isNotNull())
        .groupBy("grp", "ts").agg(F.collect_list(F.struct("building", "energy")).alias("cells"))
        .select("grp", F.col("cells.building").alias("names"), F.col("cells.energy").alias("v"))
    )
    cols = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            coded = batch.column(1).flatten().dictionary_encode()
            code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            value = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            for g in set(groups.tolist()):
                index, sums = found.setdefault(g, ({}, np.zeros((6, 0, 0))))
                mine = (groups == g)[row]
                own = np.unique(code[mine])
                place = np.zeros(len(names), dtype=np.int64)
                place[own] = [index.setdefault(names[c], len(index)) for c in own.tolist()]
                line = np.cumsum(groups == g) - 1
                x, m = np.zeros((2, int((groups == g).sum()), len(index)))
                x[line[row[mine]], place[code[mine]]] = value[mine]
                m[line[row[mine]], place[code[mine]]] = 1.0
                part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
                part[:, : sums.shape[1], : sums.shape[2]] += sums
                found[g] = (index, part)
        for g, (index, sums) in found.items():
            names = np.array(list(index), dtype=object)
            order = np.argsort(names)  # a pair is written with its smaller name first
            i, j = np.triu_indices(len(names), k=1)
            i, j = order[i], order[j]
            keep = sums[0][i, j] > 0
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(i), type=pa.string()), pa.array(names[i], type=pa.string()), pa.array(names[j], type=pa.string()),
                 *[pa.array(p[i, j]) for p in sums]],
                names=["grp", "a", "b", *cols],
            )

    pairs = per_ts.mapInArrow(
        partial, "grp string, a string, b string, " + ", ".join(f"{c} double" for c in cols)
    ).groupBy("grp", "a", "b").agg(*[F.sum(c).alias(c) for c in cols])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.pow("sx", 2), n * F.col("syy") - F.pow("sy", 2)
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    corr = F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return pairs.select("grp", "a", "b", n.cast("long").alias("n"), corr.alias("corr"))


def histogram(df: DataFrame, column: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the smallest and the largest value; the top edge is in the last bin."""
    by = list(by)
    v = F.col(column).cast("double")
    valid = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("__v"))
    ends = valid.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    flat = F.col("__lo") == F.col("__hi")
    ends = ends.select(
        *by,
        F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("lo"),
        F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("hi"),
    )
    if by:
        placed = valid.join(ends, by)
    else:
        placed = valid.withColumns({"lo": ends.select("lo").scalar(), "hi": ends.select("hi").scalar()})
    bin_no = F.floor((F.col("__v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")
    counted = placed.groupBy(*by, "lo", "hi", F.least(bin_no, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "rows")


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, nulls, mean, population deviation, min and max of each column; non-finite counts as missing."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        inf = F.lit(float("inf"))
        fin = F.when(~F.isnan(v) & (v != inf) & (v != -inf), v)
        aggs += [
            F.count(fin).alias(f"{c}__n"), F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}__nulls"),
            F.avg(fin).alias(f"{c}__mean"), F.stddev_pop(fin).alias(f"{c}__std"),
            F.min(fin).alias(f"{c}__min"), F.max(fin).alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    fields = ("n", "nulls", "mean", "std", "min", "max")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns
    ])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def row_total(columns: Sequence[str]) -> Column:
    """Sum of the columns, missing values left out."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return total


QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """Exact quantiles."""
    return grouped_percentile(df, [], [column], QUANTILES)


def approx_quantiles(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """One-pass quantiles from a mergeable sketch."""
    sketch = df.agg(F.percentile_approx(column, list(QUANTILES.values()), accuracy).alias("q"))
    return sketch.select(*[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)])


def dow_hour(df: DataFrame, value: str) -> DataFrame:
    """Mean by day of week (0 = Monday) and hour."""
    return df.where(F.col("ts").isNotNull()).groupBy(F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )


def by_month(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("ts").isNotNull()).groupBy(F.month("ts").alias("month")).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )


def distinct_ids(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    count = F.count_distinct(F.col(column)) if exact else F.approx_count_distinct(column, 0.01)
    return df.agg(count.alias("distinct_ids"))


def sample_series(df: DataFrame, columns: Sequence[str], k: int, seed: int = 3) -> DataFrame:
    """k sampled series, value columns summed per row and averaged per timestamp."""
    picked = df.join(sample_buildings(df, k, seed), ["grp", "building"], "left_semi")
    return picked.groupBy("grp", "building", "ts").agg(F.avg(row_total(columns)).alias("energy"))


def peaks(df: DataFrame) -> DataFrame:
    return df.groupBy("grp", "building").agg(F.max("energy").alias("peak"))
