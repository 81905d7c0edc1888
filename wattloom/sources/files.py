"""Files below a folder: listing, footers and headers. No content is read here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READING = ("source", "resolution", "grp", "building", "ts", "energy", "file", "row", "timed")
ANY_CASE = {"parquet": "*.[pP][aA][rR][qQ][uU][eE][tT]", "csv": "*.[cC][sS][vV]"}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every parquet and csv file below root: path, grp (its folder), size_mb. No content is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(ANY_CASE.values()) + "}").load(root)
    )
    return files.select("path", group_of(F.col("path"), root).alias("grp"), (F.col("length") / 1e6).alias("size_mb"))


def plain_path(path: Column) -> Column:
    """File metadata escapes special characters in paths; this undoes it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def group_of(path: Column, root: str) -> Column:
    """Folder of a file relative to root; "." for files directly in it."""
    base = root.split("://", 1)[-1].rstrip("/").lstrip("/")
    inner = F.regexp_replace(F.substring_index(path, base + "/", -1), r"/?[^/]+$", "")
    return F.coalesce(F.nullif(inner, F.lit("")), F.lit("."))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def footers(files: DataFrame) -> DataFrame:
    """Rows, columns, row groups, column names and types of each parquet file, from its footer only."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        import pyarrow.parquet as pq
        from pyarrow import fs

        for part in parts:
            rows = []
            for path, size in zip(part["path"], part["size_mb"]):
                try:
                    store, inner = fs.FileSystem.from_uri(quote(path, safe="/:=@+,"))
                    with store.open_input_file(inner) as handle:
                        meta = pq.ParquetFile(handle)
                        names = " | ".join(meta.schema_arrow.names)
                        types = " | ".join(str(f.type) for f in meta.schema_arrow)
                        m = meta.metadata
                        rows.append((path, size, m.num_rows, len(meta.schema_arrow.names), m.num_row_groups, names, types, None))
                except Exception as e:  # an unreadable file is a row of the inventory
                    rows.append((path, size, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "size_mb", "n_rows", "n_cols", "n_row_groups", "columns", "types", "error"]).astype(
                {"n_rows": "Int64", "n_cols": "Int64", "n_row_groups": "Int64"}
            )

    return files.select("path", "size_mb").mapInPandas(
        read, "path string, size_mb double, n_rows long, n_cols long, n_row_groups long, columns string, types string, error string"
    )
