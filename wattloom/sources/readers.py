"""Readers. Every reader returns lazy DataFrames; nothing is read on the driver but schemas."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.scalars import loose_number, safe_name, to_number, to_time, us_date
from wattloom.sources.files import ANY_CASE, READING, file_stem, footers, group_of, list_files, plain_path
from wattloom.sources.roles import Layout, data_columns, detect_eda, is_number, layout
from wattloom.sources.tree import read_tree

__all__ = [
    "combine", "eda_readings", "file_stem", "footers", "group_of", "list_files", "read_any", "read_log", "read_loss", "read_metadata",
    "read_summaries", "read_tree", "row_positions", "schema_census", "to_readings",
]
log = logging.getLogger(__name__)


def schema_census(inventory: DataFrame) -> DataFrame:
    """How many files share each schema."""
    return inventory.where("columns IS NOT NULL").groupBy("columns").agg(F.count(F.lit(1)).alias("files"))


def read_any(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Parquet or csv files with helper columns ``__file`` and ``__row`` (position in the source).

    A list names files of one schema whose footers could be read, so a damaged block is an error; below
    a folder, files that can't be read at all are skipped. The suffix counts in any case. Text stays text.
    """
    if kind not in ANY_CASE:
        raise ValueError(f"unknown file kind {kind!r}")
    reader = spark.read.option("recursiveFileLookup", True)
    if isinstance(path, str):
        reader = reader.option("ignoreCorruptFiles", True).option("pathGlobFilter", ANY_CASE[kind])
    if kind == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
        place = F.struct(F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("line"))
    else:
        df = reader.option("header", True).csv(path)
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", plain_path(F.col("_metadata.file_path")).alias("__file"), place.alias("__row"))


def to_readings(
    df: DataFrame, grp: Column, file: Column, row: Column,
    source: str = "real", resolution: str = "Hourly", shape: Layout | None = None,
) -> DataFrame:
    """Any layout -> one long table of readings. Only the columns in use are read.

    ``timed`` is false where the source has no time column at all; there the order is that of file and row.
    """
    shape = shape or layout(df.schema)
    r = shape.roles
    if not shape.resolved:
        log.warning("no measure column found in %s; every number is taken as a building", df.columns)
    # digits as a time are read as text (20240101), whatever type holds them
    digits = r.time is not None and is_number(df.schema[r.time].dataType)
    ts = to_time(F.col(r.time).cast("long").cast("string") if digits else F.col(r.time)) if r.time else F.lit(None).cast("timestamp_ntz")
    base = {"grp": grp, "ts": ts, "file": file, "row": row, "timed": F.lit(r.time is not None)}
    head = [c.alias(k) for k, c in base.items()]
    if shape.kind == "long":
        out = df.select(*head, safe_name(F.col(r.id)).alias("building"), to_number(F.col(r.value)).alias("energy"))
    elif shape.kind == "single":
        out = df.select(*head, safe_name(file_stem(file)).alias("building"), to_number(F.col(r.value)).alias("energy"))
    else:
        numbers = df.select(*head, *[to_number(F.col(f"`{c}`")).alias(c) for c in shape.buildings])
        out = numbers.unpivot(list(base), list(shape.buildings), "building", "energy")
        out = out.withColumn("building", safe_name(F.col("building")))
    return out.withColumns({"source": F.lit(source), "resolution": F.lit(resolution)}).select(*READING)


def eda_readings(df: DataFrame, grp: str) -> DataFrame:
    """Readings by the exploratory column rule; rows without a time are dropped."""
    r = detect_eda(df.schema)
    if r.time is None or r.value is None:
        raise ValueError(f"time or value not found in {df.columns}")
    if r.id is None:
        # without an id every number is a building; a single one is named after its file
        numbers = [c for c in data_columns(df.schema) if c != r.time and is_number(df.schema[c].dataType)] or [r.value]
        stem = file_stem(F.col("__file")) if "__file" in df.columns else F.lit(grp)
        wide = df.select(to_time(F.col(r.time)).alias("ts"), stem.alias("__stem"), *[to_number(F.col(f"`{c}`")).alias(c) for c in numbers])
        out = wide.unpivot(["ts", "__stem"], numbers, "building", "energy").where("ts IS NOT NULL")
        name = F.col("__stem") if len(numbers) == 1 else F.col("building")
        return out.select(F.lit(grp).alias("grp"), name.alias("building"), "ts", "energy")
    return df.select(
        F.lit(grp).alias("grp"), F.col(r.id).cast("string").alias("building"), to_time(F.col(r.time)).alias("ts"),
        to_number(F.col(r.value)).alias("energy"),
    ).where("ts IS NOT NULL")


def combine(**sources: DataFrame) -> DataFrame:
    """Several sources in one table, each tagged with its name."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def row_positions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """File, position in the file and the wanted columns of parquet files."""
    return spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("rn"), *columns
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Data-set metadata csv: tidy headers, counts as numbers, dates in either year form, NA as null."""
    raw = spark.read.option("header", True).option("nullValue", "NA").option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    pick = lambda name: F.col(f"`{name}`")
    return raw.select(
        pick("Alias").alias("alias"), pick("Type").alias("type"),
        us_date(pick("Start")).alias("start"), us_date(pick("End")).alias("end"),
        loose_number(pick("No. of Obs")).alias("n_obs"), loose_number(pick("No. of Buildings")).alias("n_buildings"),
        pick("Location").alias("location"), pick("iso").alias("iso"),
    )


LOSS_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()), T.StructField("stage", T.StringType()), T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()), T.StructField("round", T.LongType()), T.StructField("epoch", T.LongType()),
        T.StructField("n_windows", T.LongType()), T.StructField("shard", T.StringType()),
    ]
)


def read_loss(spark: SparkSession, path: str) -> DataFrame:
    """Loss records, one JSON object per line; unreadable lines and records without loss or time go."""
    raw = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).schema(LOSS_SCHEMA).json(path)
    return raw.where("loss IS NOT NULL AND ts IS NOT NULL").select("*", F.col("_metadata.file_path").alias("file"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their order: file, block and line number inside the scan; no file is read whole."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("ord"),
        F.col("value").alias("line"),
    )


SUMMARY_SCHEMA = (
    "tag string, hostname string, started_at double, wall_time_s double, done_units long, total_units long, "
    "units_per_min double, eta_s_at_end double, cpu_pct_avg double, cpu_pct_max double, load1_avg double, "
    "ram_used_gb_avg double, ram_used_gb_max double, ram_total_gb double, rss_gb_avg double, rss_gb_max double, n_samples long"
)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, one JSON document per file; unreadable ones are skipped."""
    return (
        spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
        .schema(SUMMARY_SCHEMA).json(path)
    )
