"""Sinks. Output is partitioned by its pruning columns; a manifest table makes steps resumable."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.scalars import safe_name
from wattloom.params import DEFAULT, Params


def _balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of one output folder together, but large folders spread over several tasks."""
    return df.hint("rebalance", *columns)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _balanced(df, "resolution", "split", "grp").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        "resolution", "split", "grp"
    ).parquet(path)


def write_windows(df: DataFrame, path: str, p: Params = DEFAULT, mode: str = "overwrite") -> None:
    """Window table; no file holds more than ``max_windows_per_file`` windows, buildings stay in order."""
    _balanced(df, "split", "grp").sortWithinPartitions("split", "grp", "building", "start").write.mode(mode).option(
        "maxRecordsPerFile", p.max_windows_per_file
    ).option("partitionOverwriteMode", "dynamic").partitionBy("split", "grp").parquet(path)


def write_labeled(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _balanced(df, "grp").write.mode(mode).option("compression", "zstd").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("grp").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """A small result table as csv or json."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")


MANIFEST_SCHEMA = "step string, split string, grp string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Finished (step, split, grp); empty when nothing was written yet."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def pending(df: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """Rows of groups the step has not finished."""
    return df.join(done.where(F.col("step") == step).select("split", "grp"), ["split", "grp"], "left_anti")


def run_step(df: DataFrame, step: str, out: str, manifest_path: str) -> None:
    """Write the unfinished groups and record them.

    Groups are recorded only after their data is committed; a group interrupted in between is
    written again over its own folders.
    """
    spark = df.sparkSession
    todo = pending(df, manifest(spark, manifest_path), step)
    groups = todo.select(F.lit(step).alias("step"), "split", "grp").distinct()
    # fixed before the write; one row per group
    names = spark.createDataFrame(groups.collect(), MANIFEST_SCHEMA)
    _balanced(todo, "split", "grp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "split", "grp"
    ).parquet(out)
    names.write.mode("append").parquet(manifest_path)


def adopt(spark: SparkSession, out: str, step: str, manifest_path: str) -> None:
    """Record the groups an earlier run already wrote, except the last unrecorded (split, grp), which may be partial."""
    found = spark.read.parquet(out).select("split", F.col("grp").cast("string").alias("grp")).distinct()
    done = manifest(spark, manifest_path).where(F.col("step") == step).select("split", "grp")
    new = found.join(done, ["split", "grp"], "left_anti")
    last = new.agg(F.max(F.struct("split", "grp"))).first()[0]
    if last is None:
        return
    new = new.where(F.struct("split", "grp") < F.struct(F.lit(last["split"]), F.lit(last["grp"])))
    new.select(F.lit(step).alias("step"), "split", "grp").write.mode("append").parquet(manifest_path)


def write_single(df: DataFrame, root: str, key: str, columns: list[str]) -> DataFrame:
    """One parquet file for each value of ``key``, named after it: (file, n_rows) of every file.

    Rows are streamed from sorted partitions, so no series is held. A file is written under another name and
    moved when it is whole, so a repeated task replaces it and readers never see a part of one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        store.create_dir(folder)
        task = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        now, writer, handle, done, n = None, None, None, [], 0

        def close():
            if writer is not None:
                writer.close()
                handle.close()
                store.move(f"{folder}/_{task}", f"{folder}/{now}.parquet")
                done.append((f"{folder}/{now}.parquet", n))

        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = batch.select(columns)
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != now:
                    close()
                    now, n = names[at], 0
                    handle = store.open_output_stream(f"{folder}/_{task}")
                    writer = pq.ParquetWriter(handle, rows.schema)
                writer.write_batch(rows.slice(at, end - at))
                n += end - at
                at = end
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["file", "n_rows"])

    named = df.select(safe_name(F.col(key)).alias("__name"), *columns)
    return named.repartition("__name").sortWithinPartitions("__name", *columns).mapInArrow(write, "file string, n_rows long")
