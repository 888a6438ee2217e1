"""Logical types: their Spark types, defaults, literals, and the slot sizes that cost estimates are made from."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import AnalysisError

INT, VARCHAR, BOOL, DATE, LONG, SHORT, OTHER = "int", "varchar", "bool", "date", "long", "short", "other"

#: Bytes and alignment of a stored field; a VARCHAR(n) takes 4 + 4 n. Fixed values.
SIZES = {INT: (8, 8), LONG: (8, 8), DATE: (8, 8), SHORT: (2, 2), BOOL: (1, 1), OTHER: (8, 8)}
FLAG_BYTES = 8

_SPARK = {
    INT: T.IntegerType(),
    VARCHAR: T.StringType(),
    BOOL: T.BooleanType(),
    DATE: T.TimestampNTZType(),
    LONG: T.LongType(),
    SHORT: T.ShortType(),
}
_DEFAULTS = {INT: 0, VARCHAR: "", BOOL: False, DATE: dt.datetime(1, 1, 1), LONG: 0, SHORT: 0}
#: Types that compare with each other.
_FAMILY = {INT: "number", LONG: "number", SHORT: "number", VARCHAR: "string", BOOL: "bool", DATE: "date", OTHER: "other"}


@dataclass(frozen=True)
class Field:
    """A column: its name, kind, and for VARCHAR the most characters it takes (0: no bound)."""

    name: str
    kind: str
    length: int = 0
    spark: str = ""

    @property
    def spark_type(self) -> T.DataType:
        return T._parse_datatype_string(self.spark) if self.kind == OTHER else _SPARK[self.kind]

    @property
    def default(self):
        return _DEFAULTS.get(self.kind)


def kind_of(spark_type: T.DataType) -> str:
    """The kind of a Spark type; date and timestamp types are DATE, what the dialect lacks is OTHER and passes through."""
    for kind, known in _SPARK.items():
        if spark_type == known:
            return kind
    if isinstance(spark_type, T.DateType | T.TimestampType):
        return DATE
    if isinstance(spark_type, T.VarcharType | T.CharType):
        return VARCHAR
    return OTHER


def family_of(spark_type: T.DataType) -> str:
    """Types of one family compare; doubles and decimals are numbers."""
    return "number" if isinstance(spark_type, T.NumericType) else _FAMILY[kind_of(spark_type)]


def fields_of(schema: T.StructType) -> list[Field]:
    """The fields of a Spark schema, names in lower case."""
    out = []
    for f in schema.fields:
        kind = kind_of(f.dataType)
        out.append(Field(f.name.lower(), kind, getattr(f.dataType, "length", 0), f.dataType.simpleString() if kind == OTHER else ""))
    return out


def spark_schema(fields: Iterable[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.spark_type, True) for f in fields])


def size_of(field: Field) -> tuple[int, int]:
    """Bytes and alignment of a stored field."""
    return (4 + 4 * field.length, 1) if field.kind == VARCHAR else SIZES[field.kind]


def layout(fields: Iterable[Field]) -> tuple[dict[str, int], int]:
    """(offset of each field, bytes of a slot): a flag, then the fields by falling alignment, padded."""
    placed = sorted(fields, key=lambda f: -size_of(f)[1])
    offsets, at = {}, FLAG_BYTES
    for f in placed:
        size, align = size_of(f)
        at += -at % align
        offsets[f.name] = at
        at += size
    widest = max((size_of(f)[1] for f in placed), default=1)
    return offsets, at + -at % widest


def stored_value(field: Field, value):
    """``value`` as it is stored in ``field``; an error if its type differs, it overflows or is too long."""
    ok = {
        INT: isinstance(value, int) and not isinstance(value, bool),
        LONG: isinstance(value, int) and not isinstance(value, bool),
        SHORT: isinstance(value, int) and not isinstance(value, bool),
        VARCHAR: isinstance(value, str),
        BOOL: isinstance(value, bool),
        DATE: isinstance(value, dt.date),
    }.get(field.kind, True)
    if not ok:
        raise AnalysisError(f"type mismatch for field {field.name}: {value!r} is not {field.kind}")
    bits = {INT: 31, SHORT: 15, LONG: 63}.get(field.kind)
    if bits and not -(1 << bits) <= value < 1 << bits:
        raise AnalysisError(f"{value} overflows field {field.name}")
    if field.kind == VARCHAR and field.length and len(value) > field.length:
        raise AnalysisError(f"value for field {field.name} exceeds {field.length} characters")
    if field.kind == DATE and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    return value
