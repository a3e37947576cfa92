"""Typed point tables: a DataFrame plus the meaning of its columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER, STRING, DATE, BOOLEAN = "number", "string", "date", "boolean"
KINDS = (NUMBER, STRING, DATE, BOOLEAN)


@dataclass(frozen=True)
class Field:
    """One attribute and its kind."""

    name: str
    kind: str

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"Unknown attribute kind {self.kind}")


def quote(name: str) -> str:
    """Back-quote a column name; joined tables have dots in theirs."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    """A double as a SQL literal, exact to the last bit."""
    return f"({float(value)!r}D)"


def unique_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_2``, ``name_3``, … when it is already taken."""
    taken = set(taken)
    result, suffix = name, 2
    while result in taken:
        result, suffix = f"{name}_{suffix}", suffix + 1
    return result


def kind_of(data_type: T.DataType) -> str:
    """The kind that a Spark type stands for."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    return STRING


@dataclass(frozen=True)
class PointTable:
    """A DataFrame of observations with identity, position and typed attributes.

    ``row`` orders the observations of one load and never repeats. ``domains``
    remembers full-table statistics, so several charts over one load share them.
    """

    df: DataFrame
    fields: tuple[Field, ...]
    row: str = "row_id"
    id: str = "point_id"
    lon: str = "lon"
    lat: str = "lat"
    name: str = "Dataset"
    time_field: str = ""
    domains: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def identity(self) -> tuple[str, str, str, str]:
        return (self.row, self.id, self.lon, self.lat)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for candidate in self.fields:
            if candidate.name == name:
                return candidate
        raise ValueError(f"Unknown attribute {name}")

    def has(self, name: str, kind: str | None = None) -> bool:
        return any(f.name == name and kind in (None, f.kind) for f in self.fields)

    def col(self, name: str) -> Column:
        return F.col(quote(name))

    def with_df(self, df: DataFrame) -> "PointTable":
        """The same description over other rows; statistics start afresh."""
        return replace(self, df=df, domains={})


def describe(df: DataFrame, *, row: str, id: str, lon: str, lat: str, attributes: Sequence[str] | None = None,
             name: str = "Dataset", time_field: str = "") -> PointTable:
    """Describe an already clean DataFrame without touching its columns.

    Leaving the columns bare keeps Parquet filters and pruning intact.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in (row, id, lon, lat) if c not in types]
    if missing:
        raise ValueError(f"Missing identity columns {missing}")
    names = list(attributes) if attributes is not None else [n for n in df.columns if n not in (row, id, lon, lat)]
    fields = tuple(Field(n, kind_of(types[n])) for n in names)
    return PointTable(df, fields, row, id, lon, lat, name, time_field)


def conform(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bring columns to the four storage types; run once, when data is loaded.

    Numbers become finite doubles or null, dates become timestamps cut to whole
    milliseconds, and nested values become JSON text.
    """
    chosen = set(columns if columns is not None else df.columns)
    out = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if f.name in chosen:
            kind = kind_of(f.dataType)
            if kind == NUMBER:
                v = c.cast("double")
                # NaN fails the comparison too, because it sorts above every number.
                c = F.when(F.abs(v) <= F.lit(1.7976931348623157e308), v)
            elif kind == DATE:
                c = F.timestamp_millis(F.unix_millis(c.cast("timestamp")))
            elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
                c = F.to_json(c)
            elif kind == STRING:
                c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
