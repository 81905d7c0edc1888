"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# The white space of the query contracts, as a regular expression class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``, is 0. A null id counts as training data."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % modulus == 0, F.lit(False))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters outside the contracts' white space."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ``lower`` does the same where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def inline_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-made table as a literal inside the plan, so no Python worker is needed to read it."""
    literal = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(literal))


def map_texts(df: DataFrame, text: str, make: Callable, added: str, keep: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """Columns computed from a text column, one Arrow batch at a time; the kept columns pass through untouched.

    ``make()`` runs once per task and returns a function from a list of texts (or nulls) to a dict of the
    columns that ``added`` declares. Ids therefore never turn into floats where some are null. With ``most_bytes`` a
    batch is worked on in slices of about so many bytes, which bounds what a task holds beside the batch itself.
    """
    keep = list(df.columns if keep is None else keep)
    new = T.StructType.fromDDL(added)
    names = [*keep, *new.fieldNames()]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            step = whole.num_rows or 1
            if most_bytes is not None:
                step = max(1, int(step * min(1.0, most_bytes / max(1, whole.nbytes))))
            for at in range(0, max(1, whole.num_rows), step):
                batch = whole.slice(at, step)
                got = work(batch.column(batch.schema.get_field_index(text)).to_pylist())
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                columns += [pa.array(got[name], type=kind, from_pandas=True) for name, kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + new.fields))
