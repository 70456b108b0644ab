"""Update documents compiled to new column expressions.

``apply`` gives the schema after the update and, for each top-level column, its value after the update of a
matching row. Operators run in a fixed order whatever the order of their names, and a later operator sees
what an earlier one did. A field that the schema lacks is added with the type of the first value set.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import values as V
from . import filters

ORDER = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$push", "$addToSet", "$pop", "$pull")
INSERT_ONLY = "$setOnInsert"


def check(update: dict[str, Any]) -> dict[str, Any]:
    if not isinstance(update, dict) or not update:
        raise QueryError("an update is an object of operators")
    unknown = [k for k in update if k not in ORDER and k != INSERT_ONLY]
    if unknown:
        raise QueryError(f"unknown update operators: {unknown}")
    return update


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            kind = kind.elementType
        else:
            return None
    return kind


def with_path(kind: T.DataType, parts: list[str], leaf: T.DataType) -> T.DataType:
    """The type with a nullable field at the path; what is there stays."""
    if not parts:
        return leaf
    if isinstance(kind, T.ArrayType) and parts[0].isdigit():
        return T.ArrayType(with_path(kind.elementType, parts[1:], leaf))
    if not isinstance(kind, T.StructType):
        raise QueryError(f"{'.'.join(parts)} lies below a value that is no object")
    fields, found = [], False
    for f in kind.fields:
        if f.name == parts[0]:
            found = True
            fields.append(T.StructField(f.name, with_path(f.dataType, parts[1:], leaf) if len(parts) > 1 else f.dataType, True))
        else:
            fields.append(f)
    if not found:
        new = leaf
        for name in reversed(parts[1:]):
            new = T.StructType([T.StructField(name, new)])
        fields.append(T.StructField(parts[0], new))
    return T.StructType(fields)


def conform(column: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A column in a type that has more fields: the new ones are null."""
    if kind == to:
        return column
    if isinstance(to, T.StructType) and isinstance(kind, T.StructType):
        parts = [(conform(column.getField(f.name), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(to, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: conform(x, kind.elementType, to.elementType))
    return column.cast(to)


def widen(schema: T.StructType, update: dict[str, Any]) -> T.StructType:
    """The schema with the fields that an update's values need."""
    for op in ("$set", "$inc", "$mul", "$min", "$max", "$push", "$addToSet", INSERT_ONLY):
        for path, value in (update.get(op) or {}).items():
            if op in ("$push", "$addToSet"):
                value = value["$each"] if isinstance(value, dict) and "$each" in value else [value]
                if not value:
                    continue
            if type_at(schema, path) is None and value is not None:
                schema = with_path(schema, path.split("."), V.infer_type(value))
            elif isinstance(value, dict) and op in ("$set", INSERT_ONLY):
                for sub in value:
                    if value[sub] is not None and type_at(schema, f"{path}.{sub}") is None:
                        schema = with_path(schema, f"{path}.{sub}".split("."), V.infer_type(value[sub]))
    for source, target in (update.get("$rename") or {}).items():
        kind = type_at(schema, source)
        if kind is not None and type_at(schema, target) is None:
            schema = with_path(schema, target.split("."), kind)
    return schema


def extended(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the wider schema."""
    have = df.schema
    if have == schema:
        return df
    return df.select(*[(conform(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


class State:
    """The top-level columns as they are after the operators so far."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.columns: dict[str, Column] = {}

    def top(self, name: str) -> Column:
        return self.columns.get(name, F.col(f"`{name}`"))

    def get(self, path: str) -> Column:
        parts = path.split(".")
        column, kind = self.top(parts[0]), self.schema[parts[0]].dataType
        for part in parts[1:]:
            if isinstance(kind, T.ArrayType):
                column, kind = F.get(column, F.lit(int(part))), kind.elementType
            else:
                column, kind = column.getField(part), kind[part].dataType
        return column

    def change(self, path: str, new: Callable[[Column], Column]) -> None:
        """Replace the value at a path. Objects on the way that are null are made, but only for a value."""
        parts = path.split(".")
        self.columns[parts[0]] = _rebuilt(self.top(parts[0]), self.schema[parts[0]].dataType, parts[1:], new)


def _rebuilt(column: Column, kind: T.DataType, parts: list[str], new: Callable[[Column], Column]) -> Column:
    if not parts:
        return new(column)
    if isinstance(kind, T.ArrayType):
        at = int(parts[0])
        return F.transform(column, lambda x, i: F.when(i == at, _rebuilt(x, kind.elementType, parts[1:], new)).otherwise(x))
    inner = kind[parts[0]].dataType
    changed = _rebuilt(column.getField(parts[0]), inner, parts[1:], new)
    fields = [(changed if f.name == parts[0] else column.getField(f.name)).alias(f.name) for f in kind.fields]
    return F.when(column.isNotNull() | changed.isNotNull(), F.struct(*fields))


def _number(value: Any, path: str) -> None:
    if V.bracket_of_value(value) != V.NUMBER:
        raise QueryError(f"a number is needed for {path}")


def apply(schema: T.StructType, update: dict[str, Any]) -> dict[str, Column]:
    """The changed top-level columns of a matching row. ``schema`` comes from :func:`widen`."""
    state = State(schema)
    for op in ORDER:
        entries = update.get(op)
        if entries is None:
            continue
        if op == "$unset":
            for path in entries:
                if type_at(schema, path) is not None:
                    state.change(path, lambda c, k=type_at(schema, path): F.lit(None).cast(k))
        elif op == "$rename":
            for source, target in entries.items():
                kind = type_at(schema, source)
                if kind is None:
                    continue
                if type_at(schema, target) != kind:
                    raise QueryError(f"{source} cannot take the place of {target}: their types differ")
                moved = state.get(source)
                state.change(target, lambda c, m=moved: F.coalesce(m, c))
                state.change(source, lambda c, k=kind: F.lit(None).cast(k))
        else:
            for path, value in entries.items():
                kind = type_at(schema, path)
                if kind is None:
                    if op in ("$set", "$min", "$max") and value is None or op in ("$pop", "$pull", "$push", "$addToSet"):
                        continue
                    raise QueryError(f"no field {path}")
                state.change(path, HANDLERS[op](kind, value, path))
    return state.columns


Change = Callable[[Column], Column]


def _set(kind: T.DataType, value: Any, path: str) -> Change:
    return lambda c: V.literal(value, kind)


def _inc(kind: T.DataType, value: Any, path: str) -> Change:
    _number(value, path)
    if V.bracket_of_type(kind) != V.NUMBER:
        return lambda c: c
    return lambda c: F.coalesce((c + V.scalar(value, kind)).cast(kind), V.literal(value, kind))


def _mul(kind: T.DataType, value: Any, path: str) -> Change:
    _number(value, path)
    if V.bracket_of_type(kind) != V.NUMBER:
        return lambda c: c
    return lambda c: F.coalesce((c * V.scalar(value, kind)).cast(kind), F.lit(0).cast(kind))


def _bound(least: bool) -> Callable[[T.DataType, Any, str], Change]:
    def handler(kind: T.DataType, value: Any, path: str) -> Change:
        if V.bracket_of_value(value) != V.bracket_of_type(kind):
            return lambda c: c
        pick = F.least if least else F.greatest
        return lambda c: pick(c, V.literal(value, kind))

    return handler


def _push(kind: T.DataType, value: Any, path: str) -> Change:
    if not isinstance(kind, T.ArrayType):
        return lambda c: c
    spec = value if isinstance(value, dict) and "$each" in value else {"$each": [value]}
    if not spec["$each"]:
        return lambda c: c
    new = V.literal(list(spec["$each"]), kind)

    def change(c: Column) -> Column:
        old = F.coalesce(c, F.array().cast(kind))
        if spec.get("$position") is not None:
            at, size = int(spec["$position"]), F.size(old)
            # as a splice: a negative place counts from the end, one too large is the end
            place = F.least(F.lit(at), size) if at >= 0 else F.greatest(size + at, F.lit(0))
            out = F.concat(F.slice(old, F.lit(1), place), new, F.slice(old, place + 1, size))
        else:
            out = F.concat(old, new)
        if spec.get("$slice") is not None:
            out = _sliced(out, int(spec["$slice"]), kind)
        return out

    return change


def _sliced(c: Column, n: int, kind: T.DataType) -> Column:
    if n == 0:
        return F.array().cast(kind)
    if n > 0:
        return F.slice(c, 1, n)
    size = F.size(c)
    return F.slice(c, F.greatest(size + n, F.lit(0)) + 1, F.lit(-n))


def _add(kind: T.DataType, value: Any, path: str) -> Change:
    if not isinstance(kind, T.ArrayType):
        return lambda c: c
    each = value["$each"] if isinstance(value, dict) and "$each" in value else [value]
    items = V.literal(list(each), kind)

    def change(c: Column) -> Column:
        old = F.coalesce(c, F.array().cast(kind))
        return F.aggregate(items, old, lambda acc, x: F.when(F.exists(acc, lambda y: y.eqNullSafe(x)), acc).otherwise(F.array_append(acc, x)))

    return change


def _pop(kind: T.DataType, value: Any, path: str) -> Change:
    if not isinstance(kind, T.ArrayType) or value not in (1, -1):
        return lambda c: c
    if value == -1:
        return lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(0)))
    return lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def _pull(kind: T.DataType, value: Any, path: str) -> Change:
    if not isinstance(kind, T.ArrayType):
        return lambda c: c
    element = kind.elementType

    def hit(x: Column) -> Column:
        if filters.is_operator(value):
            return filters._condition(filters.Field(x, element), value, False)
        if isinstance(value, dict) and isinstance(element, T.StructType):
            return filters._document(value, {f.name: filters.Field(x.getField(f.name), f.dataType) for f in element.fields}, False)
        return filters.same(x, element, value)

    return lambda c: F.filter(c, lambda x: ~filters.two_valued(hit(x)))


HANDLERS: dict[str, Callable[[T.DataType, Any, str], Change]] = {
    "$set": _set, "$inc": _inc, "$mul": _mul, "$min": _bound(True), "$max": _bound(False), "$push": _push, "$addToSet": _add, "$pop": _pop, "$pull": _pull,
}
