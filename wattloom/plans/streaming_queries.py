"""Streaming queries, run over all available input; their twins are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.plans import tables as T
from wattloom.plans.registry import query
from wattloom.plans.series_queries import array_moment, rd
from wattloom.plans.sqltext import labels_sql, r, trend_sql, windows_sql
from wattloom.session import materialize, scratch_path
from wattloom.streaming import operators as SO
from wattloom.streaming.runner import run_available

P = T.HOURLY


def event_stream(spark, sf_dir):
    schema = T.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def plain_time(df, column):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query("stm_profiles", f"SELECT (isodow(ts) - 1)::INT AS dow, hour(ts)::INT AS hour, {r('avg(value)', 4)} AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def stm_profiles(spark, sf_dir):
    out = run_available(SO.profiles(event_stream(spark, sf_dir), "value"), "profiles", "complete")
    return out.withColumn("mean", rd(F.col("mean"), 4))


@query(
    "stm_progress",
    "SELECT event_type AS tag, date_trunc('minute', ts) AS minute, arg_max(value, ts) AS last_loss, count(*) AS units FROM events GROUP BY 1, 2",
)
def stm_progress(spark, sf_dir):
    loss = event_stream(spark, sf_dir).select(F.col("event_type").alias("tag"), "ts", F.col("value").alias("loss"))
    return plain_time(run_available(SO.progress(loss), "progress", "update", ["tag", "minute"]), "minute")


@query("stm_ingest", "SELECT event_type AS building, date_trunc('hour', ts) AS ts, min(value) AS energy FROM events GROUP BY 1, 2")
def stm_ingest(spark, sf_dir):
    """The least reading of a slot is sent first and once more at the end: it stays, the later ones go."""
    events = T.table(spark, sf_dir, "events")
    slot = [F.col("event_type").alias("building"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("slot")]
    rows = events.select(*slot, F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("energy"))
    path = scratch_path(spark, "ingest-source")
    least = rows.groupBy("building", "slot").agg(F.min("energy").alias("energy"))
    least.select("building", F.col("slot").alias("ts"), "energy").write.mode("append").parquet(path)
    rows.select("building", "ts", "energy").write.mode("append").parquet(path)
    readings = spark.readStream.schema("building string, ts timestamp, energy double").option("maxFilesPerTrigger", 1).parquet(path)
    return plain_time(run_available(SO.ingest(readings, "365 days"), "ingest"), "ts")


STREAM_SQL = f"""{T.HOURLY_SQL}, {T.indexed_sql('hourly')},{windows_sql(P)},{trend_sql(P)},{labels_sql(P)}"""


@query(
    "stm_windows",
    f"""WITH {STREAM_SQL} SELECT building, start, sum(label)::BIGINT AS anomalies, sum(label * (pos + 1))::BIGINT AS moment,
       {r('sum(x)', 4)} AS total FROM labels GROUP BY 1, 2""",
)
def stm_windows(spark, sf_dir):
    """Several files whose rows overlap in time, one or two in each micro-batch, then a heartbeat that ends the stream."""
    path = scratch_path(spark, "hourly")
    hourly = T.hourly(spark, sf_dir).select("building", "ts", "energy")
    delayed = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("building", "ts"), F.lit(24 * 3600))
    parted = materialize(hourly.withColumn("part", F.floor(delayed / (8 * 24 * 3600))), "hourly-parts")
    for (part,) in parted.select("part").distinct().orderBy("part").collect():  # one for each eight days
        parted.where(F.col("part") == part).select(hourly.columns).write.mode("append").parquet(path)
    beat = parted.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    beat.select(F.lit(None).cast("string").alias("building"), "ts", F.lit(None).cast("double").alias("energy")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(hourly.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = run_available(SO.label_windows(stream, P, "10 days"), "windows")
    marks = F.transform("labels", lambda v: v.cast("double"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return out.select(
        "building", "start", F.aggregate(marks, F.lit(0.0), lambda s, v: s + v).cast("long").alias("anomalies"),
        array_moment(marks).cast("long").alias("moment"), rd(total, 4).alias("total"),
    )
