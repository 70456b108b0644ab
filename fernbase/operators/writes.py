"""Write verbs as frames: the state before, and the state after.

Nothing is changed in place. Ids decide which rows are the same; every join is on the id, so the planner
may shuffle or broadcast either side. ``clock`` is the one time that all rows of a call get.
"""

from __future__ import annotations

import datetime as dt
import itertools
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import values as V
from ..plans import filters, updates
from ..sources.scratch import settled
from .find import ROW, Sort, order_columns

CREATED, UPDATED, DELETED, GONE = "_createDate", "_updateDate", "_deleteDate", "_isDeleted"


def new_id() -> str:
    return uuid.uuid4().hex


#: Hidden columns of documents that are to be set: the paths with dots that each one names, and its fields that are null.
PATHS, NULLS = "__paths", "__nulls"


def patch_rows(spark: Any, docs: list[dict[str, Any]], schema: T.StructType | None = None) -> DataFrame:
    """Documents for :func:`set_many`, which besides their fields tell which of them are paths with dots, and which
    are null: a path changes what lies at it and nothing beside it, a null empties the field."""
    paths = [sorted(k for k in d if "." in k) for d in docs]
    nulls = [sorted(k for k, v in d.items() if v is None and "." not in k and k != "id") for d in docs]
    fields = list(schema.fields) if schema else []
    marks = [(PATHS, paths)] * any(paths) + [(NULLS, nulls)] * any(nulls)
    if not marks:
        return rows_of(spark, docs, schema)
    wide = T.StructType([*fields, *[T.StructField(name, T.ArrayType(T.StringType())) for name, _ in marks]])
    marked = [{**d, **{name: values[k] for name, values in marks}} for k, d in enumerate(docs)]
    out = rows_of(spark, marked, wide)
    every = sorted({p for some in paths for p in some})
    return out.withColumn(PATHS, F.col(PATHS).alias(PATHS, metadata={"paths": every})) if every else out


def rows_of(spark: Any, docs: list[dict[str, Any]], schema: T.StructType | None = None) -> DataFrame:
    """Documents as a frame, in the types of ``schema`` where it has the field; a missing id gets a new one. A key
    with dots is a path: its value lies in objects of these names."""
    docs = [_unfolded(d) for d in docs]
    fields: dict[str, T.DataType] = {f.name: f.dataType for f in schema.fields} if schema else {}
    kind = T.StructType([T.StructField(n, t) for n, t in fields.items() if n != ROW])
    if "id" not in fields:
        kind = T.StructType([T.StructField("id", T.StringType()), *kind.fields])
    for doc in docs:
        for name, value in doc.items():
            if value is not None:
                kind = _wide(kind, name, value)
    kind = _filled(kind)
    made = [_fitted({"id": None, **d, **({"id": str(d["id"])} if d.get("id") is not None else {"id": new_id()})} if isinstance(kind["id"].dataType, T.StringType) else d, kind) for d in docs]
    return spark.createDataFrame(made, kind)


def _unfolded(doc: dict[str, Any]) -> dict[str, Any]:
    if not any("." in k for k in doc):
        return doc
    out: dict[str, Any] = {k: dict(v) if isinstance(v, dict) else v for k, v in doc.items() if "." not in k}
    for path, value in doc.items():
        if "." in path:
            _put(out, path, value)
    return out


def _filled(kind: Any) -> Any:
    """The type without objects that have no fields, which cannot be stored."""
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, _filled(f.dataType)) for f in kind.fields]
        return T.StructType([f for f in fields if f.dataType != T.StructType([])])
    return T.ArrayType(_filled(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _wide(kind: T.StructType, path: str, value: Any) -> T.StructType:
    have = updates.type_at(kind, path)
    if have is None:
        return updates.with_path(kind, path.split("."), V.infer_type(value))
    if isinstance(value, dict) and isinstance(have, T.StructType):
        for k, v in value.items():
            if v is not None:
                kind = _wide(kind, f"{path}.{k}", v)
    return kind


def _fitted(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fitted(x, kind.elementType) for x in value]
    if V.is_float(kind) and isinstance(value, int):
        return float(value)
    return value


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames in the schema that has the fields of either; the first one's types and order lead."""
    schema = left.schema
    for f in right.schema.fields:
        schema = _merged(schema, f)
    return updates.extended(left, schema), updates.extended(right, schema)


def _merged(schema: T.StructType, field: T.StructField) -> T.StructType:
    if field.name not in schema.names:
        return T.StructType([*schema.fields, T.StructField(field.name, field.dataType, True)])
    have = schema[field.name].dataType
    if isinstance(have, T.StructType) and isinstance(field.dataType, T.StructType):
        inner = have
        for f in field.dataType.fields:
            inner = _merged(inner, f)
        return T.StructType([T.StructField(f.name, inner, True) if f.name == field.name else f for f in schema.fields])
    return schema


def first_of_each(docs: DataFrame, key: str = "id", last: bool = False) -> DataFrame:
    """Of rows with one id the first (or last) by their order in ``docs``, or by a column ``__at`` of it."""
    return _first(_placed(docs), key, last).drop("__at").select(*[c for c in docs.columns if c != "__at"])


def _placed(docs: DataFrame) -> DataFrame:
    return docs if "__at" in docs.columns else docs.withColumn("__at", F.monotonically_increasing_id())


def _first(docs: DataFrame, key: str, last: bool = False) -> DataFrame:
    pick = F.max_by if last else F.min_by
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != key])
    return docs.groupBy(key).agg(pick(body, F.col("__at")).alias("__b")).select(key, "__b.*")


def numbered_after(df: DataFrame, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """New rows with insertion numbers that follow the table's, in the order given or that of the rows.

    Numbers go up with the partition and the row in it, so nothing is gathered in one task; they may have gaps.
    """
    if ROW not in df.columns:
        return new.drop(ROW)
    most = df.agg(F.coalesce(F.max(ROW), F.lit(0)).alias("__most"))
    new = new.drop(ROW)
    if order:
        new = new.orderBy(*order)
    return new.withColumn("__seq", F.monotonically_increasing_id()).crossJoin(F.broadcast(most)).withColumn(ROW, F.col("__most") + 1 + F.col("__seq")).drop("__seq", "__most")


def _stamped(df: DataFrame, clock: dt.datetime | None, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.lit(clock).cast("timestamp"))
    return df


def insert_many(df: DataFrame, docs: DataFrame, unique: list[list[str]] | None = None, clock: dt.datetime | None = None) -> DataFrame:
    """Documents whose id (or other unique key) is not there yet are added; of several the first."""
    new = _first(_placed(docs), "id")
    if clock is not None:
        new = _stamped(new, clock, CREATED, UPDATED)
    new = new.join(df.select("id"), "id", "left_anti")
    for keys in unique or []:
        if keys == ["id"]:
            continue
        some = [F.col(f"`{k}`").isNotNull() for k in keys]
        if any(k not in new.columns for k in keys):
            continue
        blank = new.where(~filters._fold(some, True))
        full = _first(new.where(filters._fold(some, True)).withColumn("__k", F.struct(*keys)), "__k").drop("__k")
        if all(k in df.columns for k in keys):
            full = full.join(df.select(*keys).where(filters._fold(some, True)).distinct(), keys, "left_anti")
        new = blank.unionByName(full)
    have, new = aligned(df, numbered_after(df, new.drop("__at")))
    return have.unionByName(new)


def set_many(
    df: DataFrame,
    docs: DataFrame,
    *,
    overwrite: bool = False,
    merge: bool = False,
    insert_only: bool = False,
    update_only: bool = False,
    set_on_insert: dict[str, Any] | None = None,
    present: list[str] | None = None,
    clock: dt.datetime | None = None,
) -> DataFrame:
    """Upsert by id. Of documents with one id the last counts, each applied to the state before.

    By default the documents' fields replace the stored ones: those named in ``present``, all of the frame's
    by default, of which a null leaves what is there; frames of :func:`patch_rows` also set nulls, and change
    what lies at a path with dots and nothing beside it. ``merge`` goes into objects and unites arrays;
    ``overwrite`` replaces whole rows but keeps the creation date where a clock is given.
    """
    paths = docs.schema[PATHS].metadata["paths"] if PATHS in docs.columns else []
    marks = first_of_each(docs, last=True).select("id", *[c for c in (PATHS, NULLS) if c in docs.columns]) if {PATHS, NULLS} & set(docs.columns) else None
    docs = docs.drop(PATHS, NULLS)
    new = first_of_each(docs, last=True)
    if clock is not None:
        new = _stamped(new, clock, UPDATED)
    have, new = aligned(df, new)
    fields = [c for c in have.columns if c not in ("id", ROW)]
    touched = set(present if present is not None else docs.columns) | ({UPDATED} if clock is not None else set())
    fresh_side = new.select("id", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("n"))
    if marks is not None:
        fresh_side = fresh_side.join(marks, "id")
    both = have.select("id", F.struct(*[F.col(f"`{c}`") for c in have.columns if c != "id"]).alias("o")).join(fresh_side, "id", "left")
    matched = F.col("n").isNotNull()

    def patched(c: str, old: Column, fresh: Column, after: Column, kind: T.DataType) -> Column:
        mine = [p for p in paths if p.split(".")[0] == c]
        if mine:  # a field that only comes by paths is changed at these, else taken whole
            at = old
            for p in mine:
                value_at = fresh
                for part in p.split(".")[1:]:
                    value_at = value_at.getField(part)
                at = F.when(F.array_contains(PATHS, p), updates._rebuilt(at, kind, p.split(".")[1:], lambda _, v=value_at: v)).otherwise(at)
            after = F.when(F.arrays_overlap(F.col(PATHS), F.array(*[F.lit(p) for p in mine])), at).otherwise(after)
        return F.when(F.array_contains(NULLS, c), F.lit(None)).otherwise(after) if marks is not None and NULLS in marks.columns else after

    def value(c: str) -> Column:
        old, fresh = F.col("o").getField(c), F.col("n").getField(c)
        kind = have.schema[c].dataType
        if overwrite:
            after = F.coalesce(old, fresh) if clock is not None and c == CREATED else fresh
        elif merge:
            after = merged(old, fresh, kind) if c in touched else old
        else:
            after = patched(c, old, fresh, F.coalesce(fresh, old) if c in touched else old, kind)
        return F.when(matched, after).otherwise(old)

    kept = both.select("id", *[(F.col("o").getField(c) if c == ROW or insert_only else value(c)).alias(c) for c in have.columns if c != "id"]).select(*have.columns)
    if update_only:
        return kept
    added = new.drop(ROW).join(df.select("id"), "id", "left_anti")
    for name, default in (set_on_insert or {}).items():
        added = added.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(default)) if name in added.columns else F.lit(default))
    if clock is not None:
        added = _stamped(added, clock, CREATED)
    kept, added = aligned(kept, numbered_after(df, added))
    return kept.unionByName(added)


def merged(old: Column, new: Column, kind: T.DataType) -> Column:
    """Deep merge: objects field by field, arrays united by deep equality in their order, else the new value.
    An object with a true ``__overwrite__`` replaces the old one."""
    if isinstance(kind, T.StructType):
        parts = [merged(old.getField(f.name), new.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        deep = F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.struct(*parts))
        return F.when(F.coalesce(new.getField("__overwrite__"), F.lit(False)), new).otherwise(deep) if "__overwrite__" in kind.names else deep
    if isinstance(kind, T.ArrayType):
        united = F.aggregate(new, old, lambda acc, x: F.when(F.exists(acc, lambda y: y.eqNullSafe(x)), acc).otherwise(F.array_append(acc, x)))
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(united)
    return F.coalesce(new, old)


def set_doc(df: DataFrame, docs: DataFrame, clock: dt.datetime | None = None) -> DataFrame:
    """Replace or insert whole documents by id; with a clock they are merged at the top level instead."""
    return set_many(df, docs, clock=clock) if clock is not None else set_many(df, docs, overwrite=True)


def upsert_row(filter_: dict[str, Any], update: dict[str, Any]) -> dict[str, Any]:
    """The document that an upsert inserts: the filter's equal fields, the update's values, insert-only values."""
    doc = {k: v for k, v in filter_.items() if not k.startswith("$") and "." not in k and not filters.is_operator(v)}
    for op in ("$set", "$inc", "$min", "$max", updates.INSERT_ONLY):
        for path, value in (update.get(op) or {}).items():
            _put(doc, path, value)
    for path in update.get("$mul") or {}:
        _put(doc, path, 0)
    for op in ("$push", "$addToSet"):
        for path, value in (update.get(op) or {}).items():
            _put(doc, path, list(value["$each"]) if isinstance(value, dict) and "$each" in value else [value])
    doc.setdefault("id", new_id())
    return doc


def _put(doc: dict[str, Any], path: str, value: Any) -> None:
    *way, last = path.split(".")
    for part in way:
        if not isinstance(doc.get(part), dict):
            doc[part] = {}
        doc = doc[part]
    doc[last] = value


def update_many(df: DataFrame, filter_: dict[str, Any] | None, update: dict[str, Any], *, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    """All matching rows with the update applied; no shuffle."""
    matched = filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema)
    return _changed(df, matched, update, clock)


def _with_clock(update: dict[str, Any], clock: dt.datetime | None) -> dict[str, Any]:
    return {**update, "$set": {**(update.get("$set") or {}), UPDATED: clock}} if clock is not None else update


def _changed(df: DataFrame, matched: Column, update: dict[str, Any], clock: dt.datetime | None) -> DataFrame:
    update = _with_clock(updates.check(update), clock)
    schema = updates.widen(df.schema, update)
    wide = updates.extended(df, schema).withColumn("__hit", filters.two_valued(matched))
    new = updates.apply(schema, update)
    return wide.select(*[(F.when(F.col("__hit"), new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")).alias(c) for c in schema.names])


def first_match(df: DataFrame, filter_: dict[str, Any] | None, sort: Sort = None, hide_deleted: bool = False) -> DataFrame:
    """The id of the first matching row, by the sort or by insertion."""
    out = df.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema))
    keys = order_columns(df, sort) or [F.col("id").asc()]
    return out.orderBy(*keys).limit(1).select("id")


def update_one(df: DataFrame, filter_: dict[str, Any] | None, update: dict[str, Any], *, sort: Sort = None, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    one = first_match(df, filter_, sort, hide_deleted).select(F.col("id").alias("__one"))
    marked = df.join(F.broadcast(one), df["id"] == F.col("__one"), "left")
    schema = updates.widen(df.schema, _with_clock(updates.check(update), clock))
    out = _changed(marked, F.col("__one").isNotNull(), update, clock)
    return out.select(*schema.names)


def update_counts(df: DataFrame, filter_: dict[str, Any] | None, update: dict[str, Any], *, one: bool = False, sort: Sort = None, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    """One row (matched, modified): the rows that an update finds, and those that it really changes. A scan, no join."""
    rows = df.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema))
    if one:
        rows = rows.orderBy(*(order_columns(df, sort) or [F.col("id").asc()])).limit(1)
    update = _with_clock(updates.check(update), clock)
    schema = updates.widen(df.schema, update)
    new = updates.apply(schema, update)
    same = filters._fold([F.col(f"`{c}`").eqNullSafe(v) for c, v in new.items()], True)
    return updates.extended(rows, schema).agg(F.count("*").alias("matched"), F.count_if(~same).alias("modified"))


def bulk_update(df: DataFrame, items: list[dict[str, Any]], *, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    """A list of ``{filter, update, options}``, each an update_one on what the ones before it left.

    Items that name one id each, whatever their updates, are one join and one scan for a stretch of them: a
    row meets its own items in their order. Other items pick their row by a filter, which may depend on any
    item before; each is a step of its own, and every few steps are written out, so that plans stay small.
    """
    alike = _by_id(items)
    if alike is not None and not hide_deleted:
        return _set_by_id(df, alike, clock)
    steps = 0
    for named, group in itertools.groupby(items, key=_names_id):
        group = list(group)
        for at in range(0, len(group), STRETCH if named else 1):
            part = group[at : at + STRETCH] if named else [group[at]]
            df = _each_by_id(df, part, hide_deleted, clock) if named else _one_by_filter(df, part[0], hide_deleted, clock)
            steps += 1
            if steps % 8 == 0:
                df = settled(df)
    return df


#: Items by id that one plan applies.
STRETCH = 200


def _names_id(item: dict[str, Any]) -> bool:
    f = item["filter"]
    return set(f) == {"id"} and not isinstance(f["id"], (dict, list)) and f["id"] is not None


def _one_by_filter(df: DataFrame, item: dict[str, Any], hide_deleted: bool, clock: dt.datetime | None) -> DataFrame:
    options = item.get("options") or {}
    after = update_one(df, item["filter"], item["update"], sort=options.get("sort"), hide_deleted=hide_deleted, clock=clock)
    return _upserted(df, after, item["filter"], item["update"], hide_deleted, clock) if options.get("upsert") else after


def _each_by_id(df: DataFrame, items: list[dict[str, Any]], hide_deleted: bool, clock: dt.datetime | None) -> DataFrame:
    """Items by id in one plan: each row is joined to the numbers of its updates, and these are applied in turn. The
    first upsert of an id that is not there makes its row, which then meets the items after it."""
    spark, found = df.sparkSession, []
    turns: dict[str, list[int]] = {}
    after: dict[str, list[int]] = {}
    made: list[dict[str, Any]] = []
    for item in items:
        update = updates.check(item["update"])
        if update not in found:
            found.append(update)
        id_, n = str(item["filter"]["id"]), found.index(update)
        turns.setdefault(id_, []).append(n)
        if id_ in after:
            after[id_].append(n)
        elif (item.get("options") or {}).get("upsert"):
            after[id_] = []
            made.append({**upsert_row(item["filter"], update), "id": id_})
    schema = df.schema
    for update in found:
        schema = updates.widen(schema, _with_clock(update, clock))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id string, __turns array<int>")
    rows = updates.extended(df, schema)
    if "id" in schema.names and not isinstance(schema["id"].dataType, T.StringType):
        raise QueryError("ids are texts")
    rows = rows.join(frame(turns), "id", "left")
    if made:
        new = rows_of(spark, made, schema)
        if clock is not None:
            new = _stamped(new, clock, CREATED, UPDATED)
        new = numbered_after(df, new.join(df.select("id"), "id", "left_anti"))
        left, new = aligned(rows, new.join(frame(after), "id"))
        rows, schema = left.unionByName(new), T.StructType([f for f in left.schema.fields if f.name != "__turns"])
    seen = filters.two_valued(filters.compile_filter(filters.visible({}, hide_deleted), schema))
    for k in range(max(map(len, turns.values()))):
        turn = F.when(seen, F.get("__turns", k))
        cases: dict[str, list[tuple[int, Column]]] = {}
        for n, update in enumerate(found):
            if any(k < len(t) and t[k] == n for t in (*turns.values(), *after.values())):
                for c, new in updates.apply(schema, _with_clock(update, clock)).items():
                    cases.setdefault(c, []).append((n, new))

        def value(c: str) -> Column:
            out = F.col(f"`{c}`")
            for n, new in cases.get(c, ()):
                out = F.when(turn == n, new).otherwise(out)
            return out.alias(c)

        rows = rows.select(*[value(c) for c in schema.names], "__turns")
    return rows.select(*schema.names)


def _by_id(items: list[dict[str, Any]]) -> list[dict[str, Any]] | None:
    """The rows that plain ``$set`` updates by id amount to, the last of an id winning; None if they are others."""
    rows: dict[str, dict[str, Any]] = {}
    for item in items:
        u = item["update"]
        if not _names_id(item) or set(u) != {"$set"} or (item.get("options") or {}).get("upsert"):
            return None
        if any("." in k or k == "id" or v is None for k, v in u["$set"].items()):
            return None
        rows.setdefault(str(item["filter"]["id"]), {}).update(u["$set"])
    return [{"id": k, **v} for k, v in rows.items()]


def _set_by_id(df: DataFrame, rows: list[dict[str, Any]], clock: dt.datetime | None) -> DataFrame:
    docs = rows_of(df.sparkSession, rows, T.StructType([f for f in df.schema.fields if f.name in {k for r in rows for k in r}]))
    return set_many(df, docs, update_only=True, clock=clock)


def _upserted(before: DataFrame, after: DataFrame, filter_: dict[str, Any], update: dict[str, Any], hide_deleted: bool, clock: dt.datetime | None) -> DataFrame:
    """The frame with the upsert's row added where nothing had matched."""
    row = upsert_row(filter_, update)
    new = rows_of(before.sparkSession, [row], after.schema)
    if clock is not None:
        new = _stamped(new, clock, CREATED, UPDATED)
    found = before.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), before.schema)).limit(1).agg(F.count("*").alias("__found"))
    new = new.crossJoin(F.broadcast(found)).where("__found = 0").drop("__found")
    left, right = aligned(after, numbered_after(before, new))
    return left.unionByName(right)


def upsert_many(df: DataFrame, filter_: dict[str, Any], update: dict[str, Any], *, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    return _upserted(df, update_many(df, filter_, update, hide_deleted=hide_deleted, clock=clock), filter_, update, hide_deleted, clock)


def upsert_one(df: DataFrame, filter_: dict[str, Any], update: dict[str, Any], *, sort: Sort = None, hide_deleted: bool = False, clock: dt.datetime | None = None) -> DataFrame:
    return _upserted(df, update_one(df, filter_, update, sort=sort, hide_deleted=hide_deleted, clock=clock), filter_, update, hide_deleted, clock)


def delete_many(df: DataFrame, filter_: dict[str, Any] | None, *, hide_deleted: bool = False) -> DataFrame:
    """The rows that the filter does not match: the negated filter, not a filter's negation."""
    return df.filter(filters.compile_not(filters.visible(filter_, hide_deleted), df.schema))


def delete_one(df: DataFrame, filter_: dict[str, Any] | None, *, sort: Sort = None, hide_deleted: bool = False) -> DataFrame:
    return df.join(F.broadcast(first_match(df, filter_, sort, hide_deleted)), "id", "left_anti").select(*df.columns)


def deletion(clock: dt.datetime) -> dict[str, Any]:
    """The update that marks a row as deleted."""
    return {"$set": {GONE: True, DELETED: clock, UPDATED: clock}}


def soft_delete_many(df: DataFrame, filter_: dict[str, Any] | None, clock: dt.datetime) -> DataFrame:
    return update_many(df, filter_, deletion(clock), hide_deleted=True)


def soft_delete_one(df: DataFrame, filter_: dict[str, Any] | None, clock: dt.datetime, sort: Sort = None) -> DataFrame:
    return update_one(df, filter_, deletion(clock), sort=sort, hide_deleted=True)


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """How many rows a write inserted, removed and really modified: one row of counts."""
    left, right = aligned(before, after)
    names = [c for c in left.columns if c not in (key, ROW)]
    a = left.select(key, F.struct(*[F.col(f"`{c}`") for c in names]).alias("a"), F.lit(1).alias("in_a"))
    b = right.select(key, F.struct(*[F.col(f"`{c}`") for c in names]).alias("b"), F.lit(1).alias("in_b"))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("in_a").isNull()).alias("inserted"),
        F.count_if(F.col("in_b").isNull()).alias("removed"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("modified"),
    )


def broken_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a unique index that several rows have; rows with a null key are free."""
    return df.where(filters._fold([F.col(f"`{k}`").isNotNull() for k in keys], True)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
