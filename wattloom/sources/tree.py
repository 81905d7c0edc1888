"""One scan over a tree of files of any number of schemas.

Folders are listed in tasks, level by level; footers and headers are read in tasks; the work list, one row
for each row group or range of a csv file, is a written table. One stage then opens the pieces and
unfolds each by its own file's layout. File names and schemas never pass through the driver, and the
plan has the same size for one schema or for thousands.
"""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from wattloom.functions.scalars import null_if_nan, safe_name, to_number, to_time
from wattloom.session import materialize
from wattloom.sources.files import READING, file_stem, group_of
from wattloom.sources.roles import Layout, is_number, layout

log = logging.getLogger(__name__)

SPLIT = 64 << 20
CHUNK = 1 << 20
ROWS = 8192


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe="/:=@+,%") if "://" in path else path)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every parquet and csv file below root, in any case of the suffix. Hidden names are skipped.

    One job for each level of folders; a task lists its share of a level's folders.
    """
    store, inner = _open(root)
    if store.get_file_info(inner).type == fs.FileType.File:
        return spark.createDataFrame([(root, store.get_file_info(inner).size)], "path string, size long")

    def listing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder in part["path"]:
                store, inner = _open(folder)
                start = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
                rows = []
                for info in store.get_file_info(fs.FileSelector(inner)):
                    name = info.base_name
                    if name.startswith(".") or (name.startswith("_") and "=" not in name):
                        continue
                    is_folder = info.type == fs.FileType.Directory
                    if is_folder or name.lower().endswith((".parquet", ".csv")):
                        rows.append((start + info.path, None if is_folder else info.size))
                yield pd.DataFrame(rows, columns=["path", "size"]).astype({"size": "Int64"})

    level, found = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while True:
        seen = materialize(level.mapInPandas(listing, "path string, size long"), "listing")
        files, folders = seen.where("size IS NOT NULL"), seen.where("size IS NULL").select("path")
        found = files if found is None else found.unionByName(files)
        n = folders.count()
        if not n:
            return found
        level = folders.repartition(min(n, 16 * spark.sparkContext.defaultParallelism))


def _file_layout(path: str) -> tuple[str, Layout, list[tuple[int, int, int]], str]:
    """Kind, layout, pieces (start, length, rows before) and a text that names the schema."""
    store, inner = _open(path)
    if not path.lower().endswith(".csv"):
        with store.open_input_file(inner) as handle:
            file = pq.ParquetFile(handle)
            schema, meta, pieces, before = file.schema_arrow, file.metadata, [], 0
            for k in range(meta.num_row_groups):
                pieces.append((k, 1, before))
                before += meta.row_group(k).num_rows
            return "parquet", layout(from_arrow_schema(schema)), pieces, str([(f.name, str(f.type)) for f in schema])
    names = _csv_names(store, inner)
    size = store.get_file_info(inner).size
    shape = layout(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return "csv", shape, [(at, min(SPLIT, size - at), 0) for at in range(0, size, SPLIT)], "csv" + str(names)


def _csv_names(store: fs.FileSystem, inner: str) -> list[str]:
    with store.open_input_stream(inner) as handle:
        head = b""
        while b"\n" not in head and (more := handle.read(4096)):
            head += more
    line = head.split(b"\n", 1)[0].decode("utf-8-sig", "replace").strip("\r")
    return [name or f"_c{k}" for k, name in enumerate(next(csv.reader([line]), []))]


def work_list(files: DataFrame) -> DataFrame:
    """(path, kind, start, length, before, schema, open_text, bytes, error): the pieces to read.

    ``open_text`` says that only the data can tell whether the file's text columns are buildings.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "start", "length", "before", "schema", "open_text", "bytes", "error"]
        for part in parts:
            rows = []
            for path, size in zip(part["path"], part["size"]):
                try:
                    kind, shape, pieces, schema = _file_layout(path)
                    text = shape.kind == "wide" and bool(set(shape.text) - set(shape.buildings))
                    rows += [(path, kind, *piece, schema, text, size // max(1, len(pieces)), None) for piece in pieces]
                except Exception as e:  # an unreadable file is a row of the list
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("start", "length", "before", "bytes")} | {"open_text": "boolean"})

    listed = files.mapInPandas(
        read, "path string, kind string, start long, length long, before long, schema string, open_text boolean, bytes long, error string"
    )
    return listed.withColumn("schema", F.xxhash64("schema"))


def _parquet_batches(path: str, group: int, before: int, wanted: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    store, inner = _open(path)
    with store.open_input_file(inner) as handle:
        for batch in pq.ParquetFile(handle, buffer_size=CHUNK).iter_batches(ROWS, row_groups=[group], columns=wanted):
            yield before, batch
            before += batch.num_rows


def _csv_batches(path: str, start: int, length: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows whose first byte lies in the range; the header is no row. Values hold no line breaks, as in a split csv scan."""
    store, inner = _open(path)
    names = _csv_names(store, inner)
    with store.open_input_file(inner) as handle:
        at = max(0, start - 1)
        handle.seek(at)
        held, line, end, skip = b"", 0, start + length, True  # the first line is the header, or began in the range before
        while at < end and (more := handle.read(min(CHUNK, end - at))):
            at += len(more)
            held += more
            if at >= end and not held.endswith(b"\n"):
                while (more := handle.read(4096)):
                    cut = more.find(b"\n")
                    held += more if cut < 0 else more[: cut + 1]
                    if cut >= 0:
                        break
            whole = len(held) if at >= end else held.rfind(b"\n") + 1
            data, held = held[:whole], held[whole:]
            if skip and data:
                data, skip = data[data.find(b"\n") + 1 :] if b"\n" in data else b"", False
            if data.strip():
                batch = _parse_csv(data, names)
                for k in range(0, batch.num_rows, ROWS):
                    yield line + k, batch.slice(k, ROWS)
                line += batch.num_rows


def _parse_csv(data: bytes, names: list[str]) -> pa.RecordBatch:
    """All values as text, nothing as null. Short rows are filled up and long ones cut."""
    unique = [f"{k}" for k in range(len(names))]
    ragged: list = []
    try:
        table = pacsv.read_csv(
            io.BytesIO(data), pacsv.ReadOptions(column_names=unique, use_threads=False),
            pacsv.ParseOptions(invalid_row_handler=lambda row: ragged.append(1) or "skip"),
            pacsv.ConvertOptions(column_types=dict.fromkeys(unique, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
        ).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    except pa.ArrowInvalid:
        ragged.append(1)
    if ragged:
        n = len(names)
        rows = [(r + [None] * n)[:n] for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if r]
        columns = [pa.array([v or None for v in c], pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * n
    return pa.RecordBatch.from_arrays(columns, names=names)


def _as_text(column: pa.Array) -> pa.Array:
    """Values as the text that a cast in SQL gives; whole floating-point numbers without their fraction where they stand for digits."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_integer(column.type) or pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.cast(pa.string())
    return pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())


def _times(column: pa.Array | None, n: int, zone: str) -> tuple[pa.Array, pa.Array]:
    """Times as wall-clock microseconds, and as text where only text or digits say them."""
    none_t, none_s = pa.nulls(n, pa.timestamp("us")), pa.nulls(n, pa.string())
    if column is None:
        return none_t, none_s
    if pa.types.is_timestamp(column.type):
        if column.type.tz is not None:
            column = column.cast(pa.timestamp("us", zone), safe=False)
            column = column.cast(pa.timestamp("us")) if zone.upper() in ("UTC", "GMT", "Z") else pc.local_timestamp(column)
        return column.cast(pa.timestamp("us"), safe=False), none_s
    if pa.types.is_date(column.type):
        return column.cast(pa.timestamp("us"), safe=False), none_s
    if pa.types.is_floating(column.type):
        return none_t, pa.array([None if v is None else str(int(v)) if v == v and abs(v) < 1e15 and v == int(v) else str(v) for v in column.to_pylist()], pa.string())
    return none_t, _as_text(column)


def _numbers(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Values as numbers, and as text where only text says them."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if is_number(from_arrow_schema(pa.schema([("v", column.type)]))["v"].dataType) or pa.types.is_boolean(column.type):
        return column.cast(pa.float64(), safe=False), pa.nulls(len(column), pa.string())
    return pa.nulls(len(column), pa.float64()), _as_text(column)


CELLS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType()), T.StructField("timed", T.BooleanType()),
    T.StructField("wall", T.TimestampNTZType()), T.StructField("time_text", T.StringType()), T.StructField("building", T.StringType()),
    T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("open_schema", T.LongType()),
])


def cells(pieces: DataFrame, zone: str) -> DataFrame:
    """Every cell of every piece as one row, by the layout of its own file. Only the columns in use are read.

    ``grp`` and ``stem`` (folder and tidied name of the file) come with the piece, so they are not worked out for each row.
    ``building`` is null where the file's name is the building; ``open_schema`` is set for cells of text columns
    of wide files. A batch of one column leaves the task at a time, so a file may have any number of columns.
    """
    names = CELLS.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in batches:
            for row in work.to_pylist():
                path, kind, schema = row["path"], row["kind"], row["schema"]
                _, shape, _, _ = _file_layout(path)
                r = shape.roles
                text = [c for c in shape.text if c not in shape.buildings] if shape.kind == "wide" else []
                values = [*shape.buildings, *text] if shape.kind == "wide" else [r.value]
                wanted = list(dict.fromkeys(c for c in (r.time, r.id if shape.kind == "long" else None, *values) if c is not None))
                if kind == "parquet":
                    parts, block = _parquet_batches(path, row["start"], row["before"], wanted), 0
                else:
                    parts, block = _csv_batches(path, row["start"], row["length"]), row["start"]
                for first, batch in parts:
                    n, at = batch.num_rows, {name: k for k, name in enumerate(batch.schema.names)}
                    get = lambda c: batch.column(at[c])  # noqa: B023, E731
                    wall, time_text = _times(get(r.time) if r.time else None, n, zone)
                    same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: B023, E731
                    head = [*[same(row[c], pa.string()) for c in ("path", "grp", "stem")], same(block, pa.int64()), pa.array(range(first, first + n), pa.int64()), same(r.time is not None, pa.bool_()), wall, time_text]
                    for c in values:
                        number, number_text = _numbers(get(c))
                        if shape.kind == "long":
                            building = pc.fill_null(_as_text(get(r.id)), "")
                        else:
                            building = same(c if shape.kind == "wide" else None, pa.string())
                        open_ = same(schema if c in text else None, pa.int64())
                        yield pa.RecordBatch.from_arrays([*head, building, number, number_text, open_], names=names)

    return pieces.select("path", "grp", "stem", "kind", "start", "length", "before", "schema").mapInArrow(read, CELLS)


def read_tree(spark: SparkSession, root: str, source: str = "real", resolution: str = "Hourly") -> DataFrame:
    """All readings below root, whatever the schemas of its files, in one scan.

    Unreadable files are skipped with a warning. Text columns of wide files count as buildings if any
    file of their schema holds a number in them; only where there are such files is a second scan needed. Ids
    and times of csv files stay as they are written. ``timed`` is false where a file has no time column
    at all; there the order is that of file and row.
    """
    work = materialize(work_list(walk(spark, root).repartition(spark.sparkContext.defaultParallelism)), "work-list")
    seen = work.agg(
        F.count_if(F.col("error").isNull()).alias("pieces"), F.count("error").alias("broken"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_or("open_text"), F.lit(False)).alias("open_text"),
    ).first()
    if seen["broken"]:
        some = work.where("error IS NOT NULL").select("path", "error").limit(5).collect()
        log.warning("skipping %d unreadable files, among them %s", seen["broken"], [tuple(r) for r in some])
    if not seen["pieces"]:
        raise FileNotFoundError(f"no readable parquet or csv file below {root}")
    tasks = min(seen["pieces"], max(spark.sparkContext.defaultParallelism, seen["bytes"] // SPLIT))
    pieces = work.where("error IS NULL").withColumns({"grp": group_of(F.col("path"), root), "stem": safe_name(file_stem(F.col("path")))})
    found = cells(pieces.repartition(tasks), spark.conf.get("spark.sql.session.timeZone"))
    number = F.coalesce(null_if_nan(F.col("number")), to_number(F.col("text")))
    named = F.when(F.col("building").isNull(), F.col("stem")).otherwise(safe_name(F.col("building")))
    out = found.select(
        "grp", F.coalesce("wall", to_time(F.col("time_text"))).alias("ts"), "file",
        F.struct("block", "line").alias("row"), "timed", named.alias("building"), number.alias("energy"),
        F.lit(source).alias("source"), F.lit(resolution).alias("resolution"), "open_schema", F.col("building").alias("__column"),
    )
    if seen["open_text"]:
        numeric = out.where("open_schema IS NOT NULL").groupBy("open_schema", "__column").agg(F.count("energy").alias("n")).where("n > 0")
        text = out.where("open_schema IS NOT NULL").join(numeric, ["open_schema", "__column"], "left_semi")
        out = out.where("open_schema IS NULL").unionByName(text)
    return out.select(*READING)
