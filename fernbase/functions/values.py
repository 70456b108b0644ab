"""Python values as typed Catalyst literals, and the brackets of types that compare with each other."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, DATE, BYTES, ARRAY, OBJECT, NOTHING = "number", "string", "boolean", "date", "bytes", "array", "object", "null"


def bracket_of_value(value: Any) -> str:
    """The bracket of a Python value. A bool is no number."""
    if value is None:
        return NOTHING
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float, decimal.Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (dt.datetime, dt.date)):
        return DATE
    if isinstance(value, (bytes, bytearray, memoryview)):
        return BYTES
    if isinstance(value, (list, tuple)):
        return ARRAY
    if isinstance(value, dict):
        return OBJECT
    raise TypeError(f"no bracket for {type(value).__name__}")


def bracket_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    if isinstance(kind, T.BinaryType):
        return BYTES
    if isinstance(kind, T.ArrayType):
        return ARRAY
    if isinstance(kind, T.StructType):
        return OBJECT
    return NOTHING


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def scalar(value: Any, kind: T.DataType) -> Column:
    """A literal to compare with a column of this type: no cast on the column, so that filters push down."""
    if isinstance(value, bool) or value is None:
        return F.lit(value)
    if isinstance(value, (int, float)) and is_float(kind):
        return F.lit(float(value))
    if isinstance(value, float) and value.is_integer() and isinstance(kind, T.IntegralType) and abs(value) < 2**53:
        return F.lit(int(value))
    if isinstance(value, dt.datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, (bytearray, memoryview)):
        return F.lit(bytes(value))
    return F.lit(value)


def infer_type(value: Any) -> T.DataType:
    """The column type that a new field gets for this value."""
    kind = bracket_of_value(value)
    if kind == BOOLEAN:
        return T.BooleanType()
    if kind == NUMBER:
        if isinstance(value, decimal.Decimal):
            return T.DecimalType(38, max(0, -value.as_tuple().exponent))
        return T.DoubleType() if isinstance(value, float) else T.LongType() if abs(value) < 2**63 else T.DecimalType(38, 0)
    if kind == STRING:
        return T.StringType()
    if kind == DATE:
        return T.TimestampType() if isinstance(value, dt.datetime) else T.DateType()
    if kind == BYTES:
        return T.BinaryType()
    if kind == ARRAY:
        found = next((infer_type(x) for x in value if x is not None), T.StringType())
        return T.ArrayType(found)
    if kind == OBJECT:
        return T.StructType([T.StructField(k, infer_type(v)) for k, v in value.items() if v is not None])
    return T.StringType()


def literal(value: Any, kind: T.DataType) -> Column:
    """A value of any shape as a column of exactly this type. Fields that the type lacks are refused."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"an array is needed, not {value!r}")
        return F.array(*[literal(x, kind.elementType) for x in value]).cast(kind) if value else F.array().cast(kind)
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict) or not value.keys() <= set(kind.names):
            raise TypeError(f"{value!r} does not fit {kind.simpleString()}")
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.create_map(*[x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]).cast(kind)
    if bracket_of_value(value) != bracket_of_type(kind) and not isinstance(kind, T.NullType):
        raise TypeError(f"{value!r} does not fit {kind.simpleString()}")
    return F.lit(bytes(value) if isinstance(value, (bytearray, memoryview)) else value).cast(kind)


def is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)
