"""Overlap of collection periods: which data sets were active together, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.operators.ordered import time_bucket, with_running

DAY_MICROS = 86_400_000_000
YEAR_SECONDS = 366 * 86_400


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def is_valid():
    return F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))


def valid_intervals(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Intervals with start before end, of one type if given."""
    out = df.where(is_valid())
    return out if kind is None else out.where(F.lower("type") == kind.lower())


def rejected_intervals(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(is_valid(), F.lit(False)))


def steps(iv: DataFrame) -> DataFrame:
    """Elementary segments between neighbouring boundaries with the number of active intervals.

    A running sum of +1 and -1: linear in the number of intervals, no set is built. A boundary at
    which an alias both ends and starts again is none, so touching intervals of one alias merge.
    """
    ends = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("d")),
    )
    per_alias = iv.select("alias", F.explode(ends).alias("m")).groupBy("alias", "m.at").agg(F.sum("m.d").alias("d"))
    marks = per_alias.where("d <> 0").groupBy("at").agg(F.sum("d").alias("d"))
    # the segment that ends at a boundary starts at the one before it
    linked = with_running(
        marks, [], [F.col("at")], time_bucket("at", YEAR_SECONDS),
        {"n_datasets": ("sum", "d", "before")}, {"seg_start": "at"},
    )
    return linked.where(F.col("n_datasets") > 0).select("seg_start", F.col("at").alias("seg_end"), "n_datasets")


def coverage(iv: DataFrame) -> DataFrame:
    """Step function of the active count: two points per segment."""
    pts = F.array(F.col("seg_start"), F.col("seg_end"))
    return steps(iv).select(F.explode(pts).alias("at"), "n_datasets")


def coverage_peak(iv: DataFrame) -> DataFrame:
    """Highest active count and where it is first reached."""
    key = F.struct(F.col("n_datasets"), -_micros(F.col("seg_start")))
    best = steps(iv).agg(F.max_by(F.struct("n_datasets", "seg_start"), key).alias("b"))
    return best.select("b.n_datasets", F.col("b.seg_start").alias("peak_start"))


def segments(iv: DataFrame, bin_days: int = 31) -> DataFrame:
    """Maximal segments with a constant set of active intervals.

    Segments and intervals meet through shared time bins, an equi join instead of a range join.
    One alias may have several intervals as long as they do not overlap.
    """
    width = bin_days * DAY_MICROS
    placed = steps(iv).select("seg_start", "seg_end").withColumn(
        "__bin", F.floor(_micros(F.col("seg_start")) / width).cast("long")
    )
    lo, hi = F.floor(_micros(F.col("start")) / width).cast("long"), F.floor((_micros(F.col("end")) - 1) / width).cast("long")
    spread = iv.select("alias", "start", "end", F.explode(F.sequence(lo, hi)).alias("__bin"))
    active = placed.join(spread, "__bin").where(
        (F.col("start") <= F.col("seg_start")) & (F.col("seg_start") < F.col("end"))
    )
    sets = active.groupBy("seg_start", "seg_end").agg(F.array_sort(F.collect_set("alias")).alias("datasets"))
    days = F.floor((_micros(F.col("seg_end")) - _micros(F.col("seg_start"))) / DAY_MICROS).cast("long")
    return sets.select(
        F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.size("datasets").alias("n_datasets"),
        "datasets", days.alias("duration_days"),
    )


def distinct_sets(cand: DataFrame) -> DataFrame:
    """Drop a segment whose set is contained in that of a better-ranked one.

    Better: more data sets, then more days, then earlier. Containment is transitive, so comparing
    with all better ones equals comparing with those kept. A superset must hold the set's rarest
    member, so candidates meet through that one member only.
    """
    id_ = F.struct("start", "end")
    members = cand.select(id_.alias("id"), F.explode("datasets").alias("m"))
    freq = members.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    rare = members.join(freq, "m").groupBy("id").agg(F.min_by("m", F.struct("f", "m")).alias("m"))
    rank = lambda c: F.struct(-F.col(f"{c}.n_datasets"), -F.col(f"{c}.duration_days"), F.col(f"{c}.start"))
    a = cand.withColumn("id", id_).join(rare, "id").alias("a")
    b = cand.withColumn("m", F.explode("datasets")).alias("b")
    beaten = (F.col("a.m") == F.col("b.m")) & (rank("b") < rank("a")) & (
        F.size(F.array_except("a.datasets", "b.datasets")) == 0
    )
    return a.join(b, beaten, "left_anti").select(*cand.columns)


def rank_overlaps(seg: DataFrame, iv: DataFrame, top: int, min_days: int = 0, distinct: bool = True) -> DataFrame:
    """The best overlaps: most data sets first, then longest; with the envelope of their members."""
    cand = seg.where(F.col("duration_days") >= min_days)
    cand = distinct_sets(cand) if distinct else cand
    best = cand.orderBy(F.col("n_datasets").desc(), F.col("duration_days").desc(), "start").limit(top)
    order = W.orderBy(F.col("n_datasets").desc(), F.col("duration_days").desc(), "start")  # at most ``top`` rows
    ranked = best.withColumn("rank", F.row_number().over(order))
    return envelope(ranked, iv).select(
        "rank", F.col("start").alias("overlap_start"), F.col("end").alias("overlap_end"),
        F.col("duration_days").alias("overlap_days"), F.round(F.col("duration_days") / 365.25, 2).alias("overlap_years"),
        "n_datasets", "group_min_start", "group_max_end", F.array_join("datasets", "; ").alias("datasets"),
    )


def envelope(seg: DataFrame, iv: DataFrame) -> DataFrame:
    """Add the earliest start and latest end of the members."""
    members = seg.select("start", "end", F.explode("datasets").alias("alias"))
    spans = iv.select("alias", F.col("start").alias("__s"), F.col("end").alias("__e"))
    per = members.join(spans, "alias").groupBy("start", "end").agg(
        F.min("__s").alias("group_min_start"), F.max("__e").alias("group_max_end")
    )
    return seg.join(per, ["start", "end"])
