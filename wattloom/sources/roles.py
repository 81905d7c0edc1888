"""Which column is the time, the building and the measure; decided from the schema alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from wattloom import fixed_values as V


@dataclass(frozen=True)
class Roles:
    time: str | None
    id: str | None
    value: str | None


@dataclass(frozen=True)
class Layout:
    """kind: long (id, value), single (value; building is the file) or wide (a column per building).

    ``text`` lists a wide table's text columns; whether they hold numbers only the data can tell.
    """

    kind: str
    roles: Roles
    buildings: tuple[str, ...] = ()
    resolved: bool = True
    text: tuple[str, ...] = ()


def find_column(columns: Sequence[str], names: Sequence[str], partial: bool = False) -> str | None:
    """First name, in order of preference, that a column has; with ``partial`` a part is enough."""
    tidy = {c.lower().strip().replace(" ", "_") if partial else c.lower().strip(): c for c in columns}
    for name in names:
        if name in tidy:
            return tidy[name]
    if partial:
        for key, column in tidy.items():
            if any(name in key for name in names):
                return column
    return None


def data_columns(schema: T.StructType) -> list[str]:
    """Columns without helper columns and without the ghost index some writers leave behind."""
    return [f.name for f in schema.fields if not f.name.startswith("__")]


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def detect(schema: T.StructType) -> Roles:
    cols = data_columns(schema)
    time = find_column(cols, V.TIME_NAMES)
    if time is None:
        kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
        time = next((c for c in cols if isinstance(schema[c].dataType, kinds)), None)
    rest = [c for c in cols if c != time]
    return Roles(time, find_column(rest, V.ID_NAMES), find_column(rest, V.VALUE_NAMES))


def detect_eda(schema: T.StructType) -> Roles:
    """The exploratory rule: names may match in part; without a value the first number is taken."""
    cols = data_columns(schema)
    time = find_column(cols, V.EDA_TIME_NAMES, partial=True)
    rest = [c for c in cols if c != time]
    ident = find_column(rest, V.EDA_ID_NAMES, partial=True)
    rest = [c for c in rest if c != ident]
    value = find_column(rest, V.EDA_VALUE_NAMES, partial=True)
    if value is None:
        value = next((c for c in rest if is_number(schema[c].dataType)), None)
    return Roles(time, ident, value)


def layout(schema: T.StructType) -> Layout:
    roles = detect(schema)
    rest = [c for c in data_columns(schema) if c != roles.time]
    if roles.value is not None:
        return Layout("single" if roles.id is None else "long", roles)
    if roles.id is not None:
        left = [c for c in rest if c != roles.id]
        if len(left) == 1:
            return Layout("long", Roles(roles.time, roles.id, left[0]))
    numbers = tuple(c for c in rest if is_number(schema[c].dataType))
    text = tuple(c for c in rest if isinstance(schema[c].dataType, T.StringType) and c != roles.id)
    return Layout("wide", roles, numbers, resolved=roles.id is None, text=text)
