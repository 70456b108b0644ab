"""Schemaless documents: types that JSON lacks, filters and updates evaluated on Python values.

This is the dynamic mode. Documents are kept as tagged JSON in a string column; where a filter cannot be
compiled to columns, it is evaluated here, in Arrow batches on the executors. A stored null and a missing
field differ here.
"""

from __future__ import annotations

import base64
import copy
import datetime as dt
import decimal
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.code import ship

TAG = "\0$t"
MISSING = type("Missing", (), {"__repr__": lambda self: "MISSING", "__bool__": lambda self: False})()


@dataclass(frozen=True)
class Pattern:
    source: str
    flags: str = ""


@dataclass
class Entries:
    """A map: entries in order, keys of any type."""

    items: list[tuple[Any, Any]] = field(default_factory=list)


@dataclass
class Distinct:
    """A set: values in order."""

    items: list[Any] = field(default_factory=list)


@dataclass
class Blob:
    """Bytes with what they are: ``uint8array`` and the like, or ``blob`` and ``file`` with name, type and time."""

    data: bytes
    kind: str = "arraybuffer"
    name: str | None = None
    type: str | None = None
    modified: int | None = None


@dataclass
class Failure:
    """An error with its causes."""

    name: str
    message: str
    stack: str | None = None
    cause: Any = None


def pack(value: Any) -> Any:
    """A value as JSON with tags for the types that JSON lacks. Integers beyond 2**53 are tagged as well."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return value if abs(value) < 2**53 else {TAG: "n", "v": str(value)}
    if isinstance(value, float):
        return value if math.isfinite(value) else {TAG: "f", "v": "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"}
    if isinstance(value, decimal.Decimal):
        return {TAG: "D", "v": str(value)}
    if isinstance(value, dt.datetime):
        return {TAG: "d", "v": value.isoformat()}
    if isinstance(value, dt.date):
        return {TAG: "day", "v": value.isoformat()}
    if isinstance(value, Pattern):
        return {TAG: "r", "s": value.source, "f": value.flags}
    if isinstance(value, re.Pattern):
        return pack(Pattern(value.pattern, "i" if value.flags & re.I else ""))
    if isinstance(value, Entries):
        return {TAG: "m", "v": [[pack(k), pack(v)] for k, v in value.items]}
    if isinstance(value, (Distinct, set, frozenset)):
        return {TAG: "s", "v": [pack(x) for x in (value.items if isinstance(value, Distinct) else value)]}
    if isinstance(value, (bytes, bytearray, memoryview)):
        return {TAG: "b", "v": base64.b64encode(bytes(value)).decode(), "ct": "bytes"}
    if isinstance(value, Blob):
        out = {TAG: "b", "v": base64.b64encode(value.data).decode(), "ct": value.kind}
        return out | {k: v for k, v in (("name", value.name), ("type", value.type), ("lm", value.modified)) if v is not None}
    if isinstance(value, Failure):
        return {TAG: "e", "name": value.name, "message": value.message, "stack": value.stack, "cause": pack(value.cause)}
    if isinstance(value, (list, tuple)):
        return [pack(x) for x in value]
    if isinstance(value, dict):
        out = {k: pack(v) for k, v in value.items()}
        return {TAG: "o", "v": out} if TAG in out else out  # a user's key that looks like the tag
    raise TypeError(f"{type(value).__name__} cannot be stored")


def unpack(value: Any) -> Any:
    if isinstance(value, list):
        return [unpack(x) for x in value]
    if not isinstance(value, dict):
        return value
    if TAG not in value:
        return {k: unpack(v) for k, v in value.items()}
    return _UNPACK[value[TAG]](value)


_UNPACK = {
    "n": lambda x: int(x["v"]),
    "f": lambda x: float(x["v"].replace("Infinity", "inf")),
    "D": lambda x: decimal.Decimal(x["v"]),
    "d": lambda x: dt.datetime.fromisoformat(x["v"]),
    "day": lambda x: dt.date.fromisoformat(x["v"]),
    "r": lambda x: Pattern(x["s"], x["f"]),
    "m": lambda x: Entries([(unpack(k), unpack(v)) for k, v in x["v"]]),
    "s": lambda x: Distinct([unpack(v) for v in x["v"]]),
    "b": lambda x: base64.b64decode(x["v"]) if x["ct"] == "bytes" else Blob(base64.b64decode(x["v"]), x["ct"], x.get("name"), x.get("type"), x.get("lm")),
    "e": lambda x: Failure(x["name"], x["message"], x["stack"], unpack(x["cause"])),
    "o": lambda x: {k: unpack(v) for k, v in x["v"].items()},
}


def dumps(doc: dict[str, Any]) -> str:
    return json.dumps(pack(doc), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def loads(text: str) -> dict[str, Any]:
    return unpack(json.loads(text))


def rank(value: Any) -> int:
    """Types in the order in which mixed values sort."""
    if value is None or value is MISSING:
        return 0
    if isinstance(value, bool):
        return 2
    if isinstance(value, (int, float, decimal.Decimal)):
        return 1
    return 3 if isinstance(value, str) else 4 if isinstance(value, (dt.datetime, dt.date)) else 5


def alike(a: Any, b: Any) -> bool:
    """Deep equality, strict in types; the order of an object's names does not count."""
    if a is b:
        return True
    if a is None or b is None or a is MISSING or b is MISSING or isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(alike(v, b[k]) for k, v in a.items())
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(alike, a, b))
    return rank(a) == rank(b) and type(a) is type(b) and a == b if rank(a) == 5 else rank(a) == rank(b) and a == b


class Many(list):
    """Values that a path gathered through an array."""


def at_path(doc: Any, path: str) -> Any:
    parts = path.split(".")
    for i, part in enumerate(parts):
        if part.isdigit() and isinstance(doc, list):
            k = int(part)
            doc = doc[k] if k < len(doc) else MISSING
        elif isinstance(doc, list):
            out = Many()
            for x in doc:
                found = at_path(x, ".".join(parts[i:]))
                if isinstance(found, Many):
                    out.extend(found)
                elif found is not MISSING:
                    out.append(found)
            return out
        elif isinstance(doc, dict):
            doc = doc.get(part, MISSING)
        else:
            return MISSING
    return doc


def matches(doc: Any, filter_: dict[str, Any]) -> bool:
    return all(_entry(doc, k, v) for k, v in filter_.items())


def _entry(doc: Any, key: str, want: Any) -> bool:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(want, list):
            return False
        found = (matches(doc, f) for f in want)
        return all(found) if key == "$and" else any(found) if key == "$or" else not any(found)
    if key == "$not":
        return not matches(doc, want)
    if key.startswith("$"):
        raise ValueError(f"unknown operator {key}")
    return satisfies(at_path(doc, key), want)


def satisfies(value: Any, want: Any) -> bool:
    if isinstance(want, dict) and want and all(k.startswith("$") for k in want):
        return all(_operator(value, k, v) for k, v in want.items())
    if want is None:
        return any(x is None for x in value) if isinstance(value, list) else value is None or value is MISSING
    if isinstance(value, list):
        if isinstance(want, list):
            return alike(value, want) or bool(want) and any(alike(x, want) for x in value)
        return any(alike(x, want) for x in value)
    return alike(value, want)


def _compare(op: str, a: Any, b: Any) -> bool:
    if a is None or b is None or a is MISSING or rank(a) != rank(b) or rank(a) == 5:
        return False
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def _operator(value: Any, op: str, want: Any) -> bool:
    many = value if isinstance(value, list) else None
    if op == "$eq":
        if many is not None and not isinstance(want, list):
            return any(x is None if want is None else alike(x, want) for x in many)
        return value is None or value is MISSING if want is None else alike(value, want)
    if op == "$ne":
        if want is None:
            return any(x is not None for x in many) if many is not None else value is not None and value is not MISSING
        return not _operator(value, "$eq", want)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return any(_compare(op, x, want) for x in many) if many is not None else _compare(op, value, want)
    if op in ("$in", "$nin"):
        if not isinstance(want, list):
            return False
        hit = any(alike(x, w) for x in (many if many is not None else [value]) for w in want)
        return hit == (op == "$in")
    if op == "$exists":
        return (value is not MISSING) == bool(want)
    if op in ("$regex", "$like"):
        pattern = _python_pattern(op, want)
        return any(isinstance(x, str) and pattern.search(x) is not None for x in (many if many is not None else [value]))
    if op == "$elemMatch":
        if many is None:
            return False
        plain = want and all(k.startswith("$") for k in want) and not want.keys() & {"$and", "$or", "$nor"}
        return any(satisfies(x, want) if plain else matches(x, want) for x in many)
    if op == "$size":
        return many is not None and (len(many) == want if isinstance(want, (int, float)) else satisfies(len(many), want))
    if op == "$all":
        return many is not None and isinstance(want, list) and bool(want) and all(any(alike(x, w) for x in many) for w in want)
    if op == "$not":
        return not satisfies(value, want)
    raise ValueError(f"unknown operator {op}")


def _python_pattern(op: str, want: Any) -> re.Pattern:
    if op == "$like":
        return re.compile("\\A" + "[^\\n\\r\\u2028\\u2029]*".join(map(re.escape, want.split("%"))) + "\\Z")
    if isinstance(want, Pattern):
        return re.compile(want.source, sum(getattr(re, f.upper()) for f in want.flags if f in "ims"))
    return re.compile(want)


def put(doc: Any, path: str, value: Any) -> None:
    *way, last = path.split(".")
    for part in way:
        if isinstance(doc, list):
            doc = doc[int(part)]
        else:
            if not isinstance(doc.get(part), (dict, list)):
                doc[part] = {}
            doc = doc[part]
    if isinstance(doc, list):
        k = int(last)
        doc.extend([None] * (k + 1 - len(doc)))
        doc[k] = value
    else:
        doc[last] = value


def take(doc: Any, path: str) -> None:
    way, _, last = path.rpartition(".")
    at = at_path(doc, way) if way else doc
    if isinstance(at, dict):
        at.pop(last, None)


def updated(doc: dict[str, Any], op: dict[str, Any]) -> dict[str, Any]:
    """The document after an update; the input stays as it is."""
    doc = copy.deepcopy(doc)
    for path, v in (op.get("$set") or {}).items():
        put(doc, path, v)
    for path in op.get("$unset") or ():
        take(doc, path)
    for path, v in (op.get("$inc") or {}).items():
        now = at_path(doc, path)
        if now is MISSING:
            put(doc, path, v)
        elif rank(now) == 1:
            put(doc, path, now + v)
    for path, v in (op.get("$mul") or {}).items():
        now = at_path(doc, path)
        if now is MISSING:
            put(doc, path, 0)
        elif rank(now) == 1:
            put(doc, path, now * v)
    for name, less in (("$min", True), ("$max", False)):
        for path, v in (op.get(name) or {}).items():
            now = at_path(doc, path)
            now = 0 if now is None and rank(v) == 1 else now
            if now is MISSING or rank(now) == rank(v) and (v < now if less else v > now):
                put(doc, path, v)
    for path, to in (op.get("$rename") or {}).items():
        now = at_path(doc, path)
        if now is not MISSING:
            take(doc, path)
            put(doc, to, now)
    for path, v in (op.get("$push") or {}).items():
        _push(doc, path, v)
    for path, v in (op.get("$addToSet") or {}).items():
        now = at_path(doc, path)
        if now is MISSING or isinstance(now, list):
            now = [] if now is MISSING else now
            for x in v["$each"] if isinstance(v, dict) and "$each" in v else [v]:
                if not any(alike(x, y) for y in now):
                    now.append(x)
            put(doc, path, now)
    for path, v in (op.get("$pop") or {}).items():
        now = at_path(doc, path)
        if isinstance(now, list) and now and v in (1, -1):
            now.pop(-1 if v == 1 else 0)
    for path, v in (op.get("$pull") or {}).items():
        now = at_path(doc, path)
        if isinstance(now, list):
            put(doc, path, [x for x in now if not (matches(x, v) if isinstance(v, dict) and isinstance(x, dict) and not all(k.startswith("$") for k in v) else satisfies(x, v))])
    return doc


def _push(doc: dict[str, Any], path: str, spec: Any) -> None:
    now = at_path(doc, path)
    if now is not MISSING and not isinstance(now, list):
        return
    spec = spec if isinstance(spec, dict) and "$each" in spec else {"$each": [spec]}
    if not spec["$each"]:
        return
    now = [] if now is MISSING else list(now)
    at = spec.get("$position")
    at = len(now) if at is None else at if at >= 0 else max(0, len(now) + at)
    now[at:at] = spec["$each"]
    if (n := spec.get("$slice")) is not None:
        now = [] if n == 0 else now[:n] if n > 0 else now[n:]
    put(doc, path, now)


def deep_merged(old: Any, new: Any) -> Any:
    """Objects field by field, arrays united, an object with ``__overwrite__`` in place of the old one."""
    if isinstance(new, dict) and new.get("__overwrite__"):
        return {k: v for k, v in new.items() if k != "__overwrite__"}
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: deep_merged(old.get(k, MISSING), v) for k, v in new.items()}}
    if isinstance(old, list) and isinstance(new, list):
        out = list(old)
        for x in new:
            if not any(alike(x, y) for y in out):
                out.append(x)
        return out
    return new


def _may_match(filter_: dict[str, Any], column: str) -> Column:
    """A condition that every matching document meets: what the JVM can tell of top-level conditions by strings and
    numbers (equal, in a list, in a range). Values that are missing, arrays or objects are left to the evaluator."""
    out = F.lit(True)
    for key, want in filter_.items():
        if not re.fullmatch(r"\w+(\.[A-Za-z_]\w*)*", key):
            continue
        text = F.get_json_object(column, f"$.{key}")
        number = text.try_cast("double")
        for op, value in (want.items() if isinstance(want, dict) else [("$eq", want)]):
            values = value if op == "$in" and isinstance(value, list) else [value]
            plain = [not isinstance(v, bool) and (isinstance(v, str) and "\0" not in v or isinstance(v, int) and abs(v) < 1 << 1000 or isinstance(v, float) and math.isfinite(v)) for v in values]
            if not values or not all(plain):
                continue
            # doubles of two numbers keep their order or are equal, so ranges take their ends in
            if op in ("$eq", "$in"):
                one = [text == v if isinstance(v, str) else number == float(v) for v in values]
            elif op in ("$gt", "$gte") and not isinstance(value, str):
                one = [number >= float(value)]
            elif op in ("$lt", "$lte") and not isinstance(value, str):
                one = [number <= float(value)]
            else:
                continue
            may = text.isNull() | text.startswith("[") | text.startswith("{")
            for c in one:
                may = may | F.coalesce(c, F.lit(False))
            out = out & may
    return out


def filter_documents(df: DataFrame, filter_: dict[str, Any], column: str = "data") -> DataFrame:
    """Rows whose tagged JSON document matches. What the JVM can tell reduces the rows before the evaluator sees them."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [x is not None and matches(loads(x), filter_) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield batch.filter(pa.array(hit, pa.bool_()))

    return df.where(_may_match(filter_, column)).mapInArrow(run, df.schema)


def update_documents(df: DataFrame, filter_: dict[str, Any], op: dict[str, Any], column: str = "data") -> DataFrame:
    """All rows, with matching documents updated. Those that the JVM can tell apart are not looked into."""
    ship(df.sparkSession)
    marked = df.withColumn("__may", _may_match(filter_, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may, batch = batch.column(batch.num_columns - 1).to_pylist(), batch.select(batch.schema.names[:-1])
            at = batch.schema.get_field_index(column)
            out = []
            for text, look in zip(batch.column(at).to_pylist(), may, strict=True):
                doc = loads(text) if look and text is not None else None
                out.append(dumps(updated(doc, op)) if doc is not None and matches(doc, filter_) else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return marked.mapInArrow(run, df.schema)


def merge_documents(old: DataFrame, new: DataFrame, key: str = "id", column: str = "data") -> DataFrame:
    """Upsert by deep merge of tagged JSON documents."""
    ship(old.sparkSession)
    both = old.select(key, F.col(column).alias("o")).join(new.select(key, F.col(column).alias("n")), key, "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            out = [o if n is None else n if o is None else dumps(deep_merged(loads(o), loads(n))) for o, n in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, column])

    return both.mapInArrow(run, f"{key} {old.schema[key].dataType.simpleString()}, {column} string")


def sort_documents(df: DataFrame, path: str, descending: bool = False, column: str = "data") -> DataFrame:
    """Rows by a path of their documents, types in the order of :func:`rank`, values in theirs; nulls first."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, numbers, strings = [], [], []
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                v = at_path(loads(text), path) if text is not None else None
                r = rank(v)
                ranks.append(r)
                numbers.append(float(v) if r in (1, 2) else v.timestamp() if isinstance(v, dt.datetime) else None)
                strings.append(v if r == 3 else json.dumps(pack(v), sort_keys=True) if r == 5 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int32()), pa.array(numbers, pa.float64()), pa.array(strings, pa.string())], [*batch.schema.names, "__r", "__n", "__s"])

    keyed = df.mapInArrow(run, _with_keys(df))
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in ("__r", "__n", "__s")]
    return keyed.orderBy(*keys).drop("__r", "__n", "__s")


def _with_keys(df: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField("__r", T.IntegerType()), T.StructField("__n", T.DoubleType()), T.StructField("__s", T.StringType())])
