"""Filters compiled to Catalyst columns.

A filter is a dict: field conditions, ``$and``, ``$or``, ``$nor`` and ``$not``. Negations are pushed to the leaves
while compiling, and each leaf has a form of its own for either sign, because a filter wrapped in coalesce
or NOT does not reach the Parquet reader. The result may be NULL where it means false: every caller uses it
to filter, or goes through :func:`two_valued`.

In typed columns a missing field and a null are the same. Values only compare within their bracket:
numbers, strings, booleans, dates, bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import values as V

RANGES = ("$gt", "$gte", "$lt", "$lte")
OPERATORS = {"$eq", "$ne", *RANGES, "$in", "$nin", "$exists", "$regex", "$like", "$elemMatch", "$size", "$all", "$not"}
LOGIC = {"$and", "$or", "$nor", "$not"}


@dataclass
class Field:
    """What a path stands for: a column, its type, whether it gathers values through an array; ``column`` is
    None where the schema has no such field."""

    column: Column | None
    kind: T.DataType
    gathered: bool = False


def fields_of(schema: T.StructType) -> dict[str, Field]:
    return {f.name: Field(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}


def resolve(path: str, root: dict[str, Field]) -> Field:
    """The field at a dotted path. Numbers index arrays; a name goes through an array to its elements."""
    if path in root:
        return root[path]
    head, _, rest = path.partition(".")
    if head not in root:
        return Field(None, T.NullType())
    field = root[head]
    return _step(field.column, field.kind, rest.split(".")) if rest else field


def _step(column: Column, kind: T.DataType, parts: list[str]) -> Field:
    if not parts:
        return Field(column, kind)
    part, rest = parts[0], parts[1:]
    if isinstance(kind, T.ArrayType):
        if part.isdigit():
            return _step(F.get(column, F.lit(int(part))), kind.elementType, rest)
        probe = _step(F.lit(None).cast(kind.elementType), kind.elementType, parts)
        if probe.column is None:
            return Field(None, T.NullType())
        gathered = F.transform(column, lambda x: _step(x, kind.elementType, parts).column)
        if probe.gathered:  # values gathered further in are spliced; a leaf that is an array stays one value
            gathered = F.flatten(F.filter(gathered, lambda x: x.isNotNull()))
        out = probe.kind if probe.gathered else T.ArrayType(probe.kind)
        return Field(F.filter(gathered, lambda x: x.isNotNull()), out, True)
    if isinstance(kind, T.StructType):
        if part in kind.names:
            return _step(column.getField(part), kind[part].dataType, rest)
        return Field(None, T.NullType())
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _step(F.try_element_at(column, F.lit(part)), kind.valueType, rest)
    if isinstance(kind, T.VariantType):
        return Field(column, Variant(parts))
    return Field(None, T.NullType())


class Variant(T.VariantType):
    """A path inside a variant column; its type is that of the value it is compared with."""

    def __init__(self, parts: list[str]):
        super().__init__()
        self.path = "$" + "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' if re.search(r"\W", p) else f".{p}" for p in parts)


def _truth(value: bool) -> Column:
    return F.lit(value)


def two_valued(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_operator(condition: Any) -> bool:
    """Whether a condition is an object of operators; one that mixes them with plain names is refused."""
    if not isinstance(condition, dict) or not condition:
        return False
    marked = [k.startswith("$") for k in condition]
    if any(marked) and not all(marked):
        raise QueryError(f"operators and fields are mixed: {sorted(condition)}")
    return all(marked)


def compile_filter(filter_: dict[str, Any] | None, schema: T.StructType) -> Column:
    """The condition of a filter over a schema, for ``DataFrame.filter``."""
    return _document(filter_ or {}, fields_of(schema), False)


def compile_not(filter_: dict[str, Any] | None, schema: T.StructType) -> Column:
    """The condition for all rows that the filter does not match."""
    return _document(filter_ or {}, fields_of(schema), True)


def _fold(conditions: list[Column], every: bool) -> Column:
    """AND (or OR) of conditions; true (or false) if there are none."""
    if not conditions:
        return _truth(every)
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if every else out | c
    return out


def _document(filter_: Any, root: dict[str, Field], negate: bool) -> Column:
    if not isinstance(filter_, dict):
        raise QueryError(f"a filter is an object, not {filter_!r}")
    return _fold([_entry(k, v, root, negate) for k, v in filter_.items()], not negate)


def _entry(key: str, condition: Any, root: dict[str, Field], negate: bool) -> Column:
    if key == "$not":
        return _document(condition, root, not negate)
    if key in ("$and", "$or", "$nor"):
        if not isinstance(condition, (list, tuple)):
            return _truth(negate)
        inner = negate != (key == "$nor")
        return _fold([_document(f, root, inner) for f in condition], (key == "$and") != inner)
    if key.startswith("$"):
        raise QueryError(f"unknown operator {key}")
    if key in ("id", "_id"):
        condition = _as_key(key, condition, root)
    return _condition(resolve(key, root), condition, negate)


def _as_key(key: str, condition: Any, root: dict[str, Field]) -> Any:
    """Ids are strings: numbers become their text. ``_id`` is a number: numeric text becomes one."""
    if isinstance(condition, dict):
        return {k: _as_key(key, v, root) for k, v in condition.items()}
    if isinstance(condition, (list, tuple)):
        return [_as_key(key, v, root) for v in condition]
    kind = root[key].kind if key in root else None
    if key == "id" and isinstance(kind, T.StringType) and isinstance(condition, (int, float)) and not isinstance(condition, bool):
        return str(int(condition)) if float(condition).is_integer() else str(condition)
    if key == "_id" and isinstance(condition, str) and re.fullmatch(r"-?\d+", condition):
        return int(condition)
    return condition


def _condition(field: Field, condition: Any, negate: bool) -> Column:
    if not is_operator(condition):
        return equal(field, condition, negate, implicit=True)
    return _fold([_operator(field, op, value, negate) for op, value in condition.items()], not negate)


def _operator(field: Field, op: str, value: Any, negate: bool) -> Column:
    if op not in OPERATORS:
        raise QueryError(f"unknown operator {op}")
    if op == "$not":
        return _condition(field, value, not negate)
    if isinstance(field.kind, Variant):
        field = _typed(field, op, value)
    if op == "$eq":
        return equal(field, value, negate)
    if op == "$ne":
        if value is None and isinstance(field.kind, T.ArrayType) and field.column is not None:
            return _any(field, lambda x: x.isNotNull(), negate)
        return equal(field, value, not negate)
    if op in RANGES:
        return _range(field, op, value, negate)
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            return _truth(negate)
        return _within(field, list(value), negate != (op == "$nin"))
    if op == "$exists":
        wanted = bool(value) != negate
        if field.column is None:
            return _truth(not wanted)
        return field.column.isNotNull() if wanted else field.column.isNull()
    if op in ("$regex", "$like"):
        return _text(field, value if op == "$regex" else like_pattern(value), negate)
    if op == "$elemMatch":
        return _element(field, value, negate)
    if op == "$size":
        if not isinstance(field.kind, T.ArrayType) or field.column is None:
            return _truth(negate)
        size = Field(F.when(field.column.isNotNull(), F.size(field.column)), T.IntegerType())
        return _condition(size, value, negate)
    return _all(field, value, negate)


def _typed(field: Field, op: str, value: Any) -> Field:
    """A variant path as a column of the bracket that the operator compares with."""
    column, path = field.column, field.kind.path
    found = F.try_variant_get(column, path, "variant")
    shape = F.schema_of_variant(found)
    if op == "$exists":
        # a stored null exists in a variant, a missing field does not
        return Field(found, T.VariantType())
    if op in ("$size", "$all", "$elemMatch"):
        return Field(F.try_variant_get(column, path, "array<variant>"), T.ArrayType(T.VariantType()))
    some = next((x for x in value if x is not None), None) if op in ("$in", "$nin") and isinstance(value, (list, tuple)) else value
    kind = STRING_KINDS.get(V.bracket_of_value(some) if op not in ("$regex", "$like") else V.STRING)
    if kind is None:
        return Field(F.when(shape != "VOID", F.lit(True)), T.BooleanType()) if some is None else Field(None, T.NullType())
    sql, pattern, out = kind
    cast = F.try_variant_get(column, path, sql)
    # values also convert from other types, which must not match
    return Field(F.when(shape.rlike(pattern), cast), out)


STRING_KINDS = {
    V.NUMBER: ("double", "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", T.DoubleType()),
    V.STRING: ("string", "^STRING$", T.StringType()),
    V.BOOLEAN: ("boolean", "^BOOLEAN$", T.BooleanType()),
    V.DATE: ("timestamp", "^(TIMESTAMP|DATE)", T.TimestampType()),
}


def _any(field: Field, test: Any, negate: bool) -> Column:
    """Whether any element of an array passes a test; a null array has none."""
    found = F.exists(field.column, lambda x: two_valued(test(x)))
    return ~two_valued(found) if negate else two_valued(found)


def equal(field: Field, value: Any, negate: bool, implicit: bool = False) -> Column:
    """Equality, deep and strict in types. An array holds what equals an element; compared with a list the
    whole array decides, and if ``implicit`` an element that is an array too."""
    if isinstance(field.kind, Variant):
        field = _typed(field, "$eq", value)
    column, kind = field.column, field.kind
    if column is None:
        return _truth((value is None) != negate)
    if isinstance(kind, T.ArrayType):
        if value is None:
            hit = column.isNull() | F.exists(column, lambda x: x.isNull())
            return (column.isNotNull() & ~F.exists(column, lambda x: x.isNull())) if negate else hit
        if isinstance(value, (list, tuple)):
            whole = two_valued(same(column, kind, value))
            if implicit and value and isinstance(kind.elementType, T.ArrayType):
                whole = whole | two_valued(F.exists(column, lambda x: two_valued(same(x, kind.elementType, value))))
            return ~whole if negate else whole
        return _any(field, lambda x: same(x, kind.elementType, value), negate)
    if value is None:
        return column.isNotNull() if negate else column.isNull()
    if V.bracket_of_value(value) != V.bracket_of_type(kind) or V.is_nan(value):
        return _truth(negate)
    if isinstance(kind, T.StructType):
        whole = two_valued(same(column, kind, value))
        return ~whole if negate else whole
    lit = V.scalar(value, kind)
    return (column != lit) | column.isNull() if negate else column == lit


def same(column: Column, kind: T.DataType, value: Any) -> Column:
    """Deep equality with a value; the order of an object's names does not count, and null equals missing."""
    if value is None:
        return column.isNull()
    if V.bracket_of_value(value) != V.bracket_of_type(kind):
        return _truth(False)
    if isinstance(kind, T.StructType):
        extra = [k for k, v in value.items() if k not in kind.names and v is not None]
        if extra:
            return _truth(False)
        return column.isNotNull() & _fold([two_valued(same(column.getField(f.name), f.dataType, value.get(f.name))) for f in kind.fields], True)
    if isinstance(kind, T.ArrayType):
        parts = [two_valued(same(F.get(column, F.lit(i)), kind.elementType, x)) for i, x in enumerate(value)]
        return _fold([column.isNotNull() & (F.size(column) == len(value)), *parts], True)
    return column.eqNullSafe(V.scalar(value, kind))


def _range(field: Field, op: str, value: Any, negate: bool) -> Column:
    column, kind = field.column, field.kind
    array = isinstance(kind, T.ArrayType)
    element = kind.elementType if array else kind
    bracket = V.bracket_of_value(value)
    if column is None or bracket not in (V.NUMBER, V.STRING, V.BOOLEAN, V.DATE) or bracket != V.bracket_of_type(element) or V.is_nan(value):
        return _truth(negate)
    lit = V.scalar(value, element)

    def test(x: Column) -> Column:
        hit = {"$gt": x > lit, "$gte": x >= lit, "$lt": x < lit, "$lte": x <= lit}[op]
        # NaN is above every number here, but compares with none
        return hit & ~F.isnan(x) if V.is_float(element) and op in ("$gt", "$gte") else hit

    if array:
        return _any(field, test, negate)
    if not negate:
        return test(column)
    miss = {"$gt": column <= lit, "$gte": column < lit, "$lt": column >= lit, "$lte": column > lit}[op]
    out = miss | column.isNull()
    return out | F.isnan(column) if V.is_float(element) and op in ("$gt", "$gte") else out


def _within(field: Field, options: list[Any], negate: bool) -> Column:
    column, kind = field.column, field.kind
    null = any(x is None for x in options)
    if column is None:
        return _truth(null != negate)
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        tests = [same(column, kind, x) for x in options if isinstance(x, (list, tuple))]
        fitting = [x for x in options if x is None or V.bracket_of_value(x) == V.bracket_of_type(element)]
        hit = _fold([two_valued(t) for t in tests], False)
        if fitting:
            hit = hit | two_valued(F.exists(column, lambda x: _fold([two_valued(same(x, element, o)) for o in fitting], False)))
        if null:
            hit = hit | column.isNull()
        return ~hit if negate else hit
    plain = [x for x in options if x is not None and V.bracket_of_value(x) == V.bracket_of_type(kind) and not V.is_nan(x)]
    if isinstance(kind, T.StructType):
        hit = _fold([two_valued(same(column, kind, x)) for x in plain] + ([column.isNull()] if null else []), False)
        return ~hit if negate else hit
    listed = column.isin(*[V.scalar(x, kind) for x in plain]) if plain else None
    if negate:
        out = _truth(True) if listed is None else ~listed
        if null:
            return out & column.isNotNull() if listed is not None else column.isNotNull()
        return out | column.isNull() if listed is not None else _truth(True)
    if listed is None:
        return column.isNull() if null else _truth(False)
    return listed | column.isNull() if null else listed


def like_pattern(pattern: Any) -> str:
    """``%`` stands for any characters of one line, everything else for itself; the whole text must match."""
    if not isinstance(pattern, str):
        raise QueryError(f"$like takes a string, not {pattern!r}")
    return "\\A" + "[^\\n\\r\\u2028\\u2029]*".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in pattern.split("%")) + "\\z"


#: Syntax that JavaScript's expressions have and Java's do not, or read otherwise.
_FOREIGN = re.compile(r"\(\?<[A-Za-z]\w*_\w*>|\\u\{|\\[pP]\{(?:Script|sc)=|\[\^\]|\\c[^A-Za-z]")


def java_pattern(pattern: Any) -> str:
    """A search pattern, given as text, compiled pattern, or (source, flags)."""
    flags = ""
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
        pattern = pattern.pattern
    elif isinstance(pattern, (list, tuple)) and len(pattern) == 2:
        pattern, flags = pattern
    if not isinstance(pattern, str):
        raise QueryError(f"$regex takes a pattern, not {pattern!r}")
    if _FOREIGN.search(pattern):
        raise QueryError(f"this pattern means something else here: {pattern}")
    kept = "".join(f for f in flags if f in "ims")
    return f"(?{kept}){pattern}" if kept else pattern


def _text(field: Field, pattern: Any, negate: bool) -> Column:
    column, kind = field.column, field.kind
    java = java_pattern(pattern)
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if column is None or V.bracket_of_type(element) != V.STRING:
        return _truth(negate)
    if isinstance(kind, T.ArrayType):
        return _any(field, lambda x: x.rlike(java), negate)
    return ~column.rlike(java) | column.isNull() if negate else column.rlike(java)


def _element(field: Field, sub: Any, negate: bool) -> Column:
    column, kind = field.column, field.kind
    if not isinstance(kind, T.ArrayType) or column is None:
        return _truth(negate)
    element = kind.elementType
    if is_operator(sub) and not sub.keys() & {"$and", "$or", "$nor"}:
        return _any(field, lambda x: _condition(Field(x, element), sub, False), negate)
    if not isinstance(element, T.StructType):
        return _truth(negate)
    return _any(field, lambda x: _document(sub, {f.name: Field(x.getField(f.name), f.dataType) for f in element.fields}, False), negate)


def _all(field: Field, required: Any, negate: bool) -> Column:
    column, kind = field.column, field.kind
    if not isinstance(kind, T.ArrayType) or column is None or not isinstance(required, (list, tuple)) or not required:
        return _truth(negate)
    hit = _fold([_any(field, lambda x: same(x, kind.elementType, r), False) for r in required], True)  # noqa: B023  used at once
    return ~hit if negate else hit


def mentions(filter_: dict[str, Any] | None, name: str) -> bool:
    """Whether a filter names a field at its top level or directly under ``$not``."""
    filter_ = filter_ or {}
    return name in filter_ or (isinstance(filter_.get("$not"), dict) and name in filter_["$not"])


def paths(filter_: dict[str, Any] | None) -> set[str]:
    """The fields that a filter names, inside logical operators too."""
    out: set[str] = set()
    for key, value in (filter_ or {}).items():
        if not key.startswith("$"):
            out.add(key)
            continue
        for part in value if isinstance(value, (list, tuple)) else [value]:
            out |= paths(part) if isinstance(part, dict) else set()
    return out


def visible(filter_: dict[str, Any] | None, hide_deleted: bool) -> dict[str, Any]:
    """The filter with soft-deleted rows hidden, unless it speaks of them itself. The input is not changed."""
    filter_ = dict(filter_ or {})
    if hide_deleted and not mentions(filter_, "_isDeleted"):
        filter_["_isDeleted"] = {"$ne": True}
    return filter_
