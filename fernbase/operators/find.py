"""Find, sort, project, page: DataFrame in, DataFrame out."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans import filters

ROW = "_id"
Sort = list[str] | dict[str, int] | None
Projection = list[str] | dict[str, Any] | None


def sort_keys(sort: Sort) -> list[tuple[str, bool]]:
    """(path, descending) of ``["a", "-b"]`` or ``{"a": 1, "b": -1}``."""
    if not sort:
        return []
    if isinstance(sort, dict):
        for path, way in sort.items():
            if way not in (1, -1):
                raise QueryError(f"the order of {path} is 1 or -1")
        return [(path, way == -1) for path, way in sort.items()]
    return [(s[1:], True) if s.startswith("-") else (s, False) for s in sort]


def _padded(column: Column) -> Column:
    """Text whose runs of digits begin with their length, so that 2 comes before 10; leading zeros do not count."""

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(column, F.lit("([0-9]+|[^0-9]+)"), 1), one), "")


def order_columns(df: DataFrame, sort: Sort, natural: bool = False, case_sensitive: bool = True, numeric: bool = False) -> list[Column]:
    """Nulls first ascending, last descending; ties and no sort at all go by the insertion number if there is one."""
    root, out = filters.fields_of(df.schema), []
    for path, down in sort_keys(sort):
        found = filters.resolve(path, root)
        if found.column is None:
            continue
        column = found.column
        if isinstance(found.kind, T.StringType):
            if numeric or natural:
                column = _padded(column)
            if not case_sensitive:
                column = F.collate(column, "UNICODE_CI" if not natural else "zh_CI")
            elif natural:
                column = F.collate(column, "zh")
        out.append(column.desc_nulls_last() if down else column.asc_nulls_first())
    if ROW in df.columns and ROW not in [p for p, _ in sort_keys(sort)]:
        out.append(F.col(ROW).asc())
    return out


def _bounded(name: str, value: Any) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise QueryError(f"{name} is a whole number of zero or more, not {value!r}")
    return value


def project(df: DataFrame, projection: Projection, keep_row: bool = False) -> DataFrame:
    """Inclusion by list or ``{f: 1}``, exclusion by 0, false or -1; paths with dots cut objects down.
    The insertion number is left out unless it is asked for by name."""
    if not projection:
        return df if keep_row or ROW not in df.columns else df.drop(ROW)
    spec = dict.fromkeys(projection, 1) if isinstance(projection, (list, tuple)) else dict(projection)
    out = {k for k, v in spec.items() if v in (0, False, -1)}
    wanted = [k for k in spec if k not in out]
    if out - {ROW, "id"} and wanted:
        raise QueryError("a projection includes or excludes, not both")
    if wanted:
        trees: dict[str, Any] = {}
        for path in wanted:
            at = trees
            parts = path.split(".")
            for part in parts[:-1]:
                nxt = at.get(part)
                if nxt is True:
                    break
                at = at.setdefault(part, {})
            else:
                at[parts[-1]] = True
        columns = [_cut(F.col(f"`{n}`"), df.schema[n].dataType, t).alias(n) for n, t in trees.items() if n in df.columns and n not in out]
        if keep_row and ROW in df.columns and ROW not in trees:
            columns.append(F.col(ROW))
        return df.select(*columns)
    gone = {k for k in out if "." not in k} | (set() if keep_row or ROW in spec and ROW not in out else {ROW})
    df = df.drop(*[g for g in gone if g in df.columns])
    for path in out:
        head, _, rest = path.partition(".")
        if rest and head in df.columns and filters.resolve(path, filters.fields_of(df.schema)).column is not None:
            df = df.withColumn(head, F.col(f"`{head}`").dropFields(rest))
    return df


def _cut(column: Column, kind: T.DataType, tree: Any) -> Column:
    if tree is True:
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _cut(x, kind.elementType, tree))
    if not isinstance(kind, T.StructType):
        return column
    parts = [_cut(column.getField(n), kind[n].dataType, t).alias(n) for n, t in tree.items() if n in kind.names]
    return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.lit(None)


def find_many(
    df: DataFrame,
    filter_: dict[str, Any] | None = None,
    *,
    sort: Sort = None,
    limit: int | None = None,
    offset: int | None = None,
    projection: Projection = None,
    natural_sort: bool = False,
    case_sensitive: bool = True,
    numeric_ordering: bool = False,
    hide_deleted: bool = False,
    keep_row: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Filter, sort, offset and limit, project. A limit of 0 is none. Without a sort, a limit and an offset count by
    insertion; rows without any of these come in no order, unless ``ordered`` asks for that of insertion."""
    limit, offset = _bounded("limit", limit), _bounded("offset", offset)
    out = df.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema))
    keys = order_columns(df, sort, natural_sort, case_sensitive, numeric_ordering)
    if keys and (sort or limit or offset or ordered):
        out = out.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return project(out, projection, keep_row)


def find_one(df: DataFrame, filter_: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    return find_many(df, filter_, **{**options, "limit": 1})


def count(df: DataFrame, filter_: dict[str, Any] | None = None, hide_deleted: bool = False) -> DataFrame:
    return df.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema)).agg(F.count("*").alias("count"))


def get(df: DataFrame, id_: Any, hide_deleted: bool = False) -> DataFrame:
    return find_many(df, {"id": id_}, limit=1, hide_deleted=hide_deleted)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among those of another frame: a semi-join, for lists too long for ``$in``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


@dataclass
class Page:
    """A page of rows; ``total`` only if asked for, ``next_cursor`` only from cursors."""

    rows: list[Row]
    page_size: int
    has_next: bool
    page_index: int | None = None
    total: int | None = None
    next_cursor: Any = None
    sort_key: str | None = None
    frame: DataFrame | None = field(default=None, repr=False)


def page_frame(df: DataFrame, filter_: dict[str, Any] | None = None, *, page_index: int = 1, page_size: int = 20, **options: Any) -> DataFrame:
    """One page and the row after it, which tells whether there is another page."""
    if page_index < 1 or page_size < 1:
        raise QueryError("pages are counted from 1, and hold a row at least")
    return find_many(df, filter_, limit=page_size + 1, offset=(page_index - 1) * page_size, **options)


def list_paging(df: DataFrame, filter_: dict[str, Any] | None = None, *, page_index: int = 1, page_size: int = 20, get_total: bool = False, joins: Any = None, **options: Any) -> Page:
    """A page by number. Joins are applied to the page's rows only."""
    hide = options.get("hide_deleted", False)
    frame = page_frame(df, filter_, page_index=page_index, page_size=page_size, **options)
    rows = frame.collect()
    page = Page(rows[:page_size], page_size, len(rows) > page_size, page_index)
    if get_total:
        page.total = count(df, filter_, hide).first()[0]
    return _joined(page, frame, joins)


def _joined(page: Page, frame: DataFrame, joins: Any) -> Page:
    if joins:
        from .lookup import lookup_all

        local = frame.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(page.rows)], T.StructType([T.StructField("__at", T.LongType()), *frame.schema.fields]))
        joined = lookup_all(local, joins, bounded=True).orderBy("__at").drop("__at")
        page.frame = joined
        page.rows = joined.collect()
    return page


def cursor_frame(df: DataFrame, filter_: dict[str, Any] | None = None, *, page_size: int = 20, cursor: Any = None, sort_key: str = ROW, descending: bool = False, projection: Projection = None, hide_deleted: bool = False) -> DataFrame:
    """The rows after a cursor, one more than a page, by key and insertion number: no offset is counted off.

    A cursor is a value of the key, which skips all of its rows, or (value, number), which skips just those
    up to that row; a null key is a value like any other, and comes first ascending. A table without
    insertion numbers goes by ``id`` instead.
    """
    if filters.mentions(filter_, sort_key):
        raise QueryError(f"the filter must leave {sort_key} to the cursor")
    found = filters.resolve(sort_key, filters.fields_of(df.schema))
    if found.column is None:
        raise QueryError(f"no field {sort_key}")
    out = df.filter(filters.compile_filter(filters.visible(filter_, hide_deleted), df.schema))
    tie_key = ROW if ROW in df.columns or "id" not in df.columns else "id"
    tie = tie_key in df.columns and sort_key != tie_key
    column = found.column
    if cursor is not None:
        value, row = cursor if isinstance(cursor, (tuple, list)) else (cursor, None)
        if value is None:
            after = F.lit(False) if descending else column.isNotNull()
            equal_key = column.isNull()
        else:
            after = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
            equal_key = column == F.lit(value)
        if row is not None and tie:
            after = after | (equal_key & (F.col(tie_key) > F.lit(row)))
        out = out.filter(after)
    keys = [column.desc_nulls_last() if descending else column.asc_nulls_first(), *([F.col(tie_key).asc()] if tie else [])]
    out = out.orderBy(*keys).limit(page_size + 1).withColumn("__key", column)
    if tie_key in df.columns:
        out = out.withColumn("__row", F.col(tie_key))
    if projection:
        spec = dict.fromkeys(projection, 1) if isinstance(projection, (list, tuple)) else dict(projection)
        if any(v not in (0, False, -1) for v in spec.values()):
            spec |= {c: 1 for c in ("__key", "__row") if c in out.columns}
        projection = spec
    return project(out, projection)


def list_paging_by_cursor(df: DataFrame, filter_: dict[str, Any] | None = None, *, page_size: int = 20, joins: Any = None, **options: Any) -> Page:
    """A page by cursor; ``next_cursor`` is (key, insertion number) of its last row, None after the last page."""
    frame = cursor_frame(df, filter_, page_size=page_size, **options)
    rows = frame.collect()
    names = [c for c in frame.columns if c not in ("__key", "__row")]
    more = len(rows) > page_size
    last = rows[page_size - 1] if more else None
    cursor = None
    if last is not None:
        cursor = (last["__key"], last["__row"]) if "__row" in frame.columns and options.get("sort_key", ROW) != ROW else last["__key"]
    shown = frame.select(*[F.col(f"`{n}`") for n in names])
    page = Page([Row(*names)(*[r[n] for n in names]) for r in rows[:page_size]], page_size, more, next_cursor=cursor, sort_key=options.get("sort_key", ROW))
    return _joined(page, shown, joins)


def each_batch(df: DataFrame, filter_: dict[str, Any] | None, work: Callable[[list[Row], Callable[[], None], int], None], *, page_size: int = 100, sort: Sort = None, **options: Any) -> int:
    """Call ``work(rows, stop, number)`` for each batch of one streamed result, in the order of the sort or of
    insertion; the number of batches. The plan runs once; the driver holds one partition at a time, not the result."""
    stopped: list[bool] = []
    number = 0
    for rows in _batches(find_many(df, filter_, sort=sort, **{"ordered": True, **options}).toLocalIterator(prefetchPartitions=True), page_size):
        number += 1
        work(rows, lambda: stopped.append(True), number)
        if stopped:
            break
    return number


def _batches(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def for_each(df: DataFrame, filter_: dict[str, Any] | None, work: Callable[[Row, int], None], **options: Any) -> None:
    """Call ``work(row, number)`` for each row, in the order of the sort or of insertion."""
    for i, row in enumerate(find_many(df, filter_, **{"ordered": True, **options}).toLocalIterator(prefetchPartitions=True)):
        work(row, i)


def explain(df: DataFrame, filter_: dict[str, Any] | None = None, analyze: bool = False, **options: Any) -> dict[str, Any]:
    """What runs for a query: the physical plan, the filters that the reader gets, whether all is scanned and why, and
    how long planning took. ``analyze`` also runs it: its rows and how long that took."""
    began = time.perf_counter()
    out = find_many(df, filter_, **options)
    plan = out._jdf.queryExecution().executedPlan().toString()
    planned = time.perf_counter()
    pushed = [x for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for x in re.split(r", (?=[A-Z])", m) if x]
    read = re.findall(r"ReadSchema: (\S+)", plan)
    reasons = []
    for path in sorted(filters.paths(filter_)):
        found = filters.resolve(path, filters.fields_of(df.schema))
        if found.column is None:
            reasons.append(f"{path}: no such field")
        elif isinstance(found.kind, (T.ArrayType, T.VariantType)):
            reasons.append(f"{path}: values of type {found.kind.simpleString()} are looked at row by row")
        elif not any(re.search(rf"\b{re.escape(path)}\b", p) for p in pushed):
            reasons.append(f"{path}: no condition on it that a reader takes")
    if not filter_:
        reasons.append("there is no filter")
    report = {"strategy": "columns", "plan": plan, "pushed_filters": pushed, "read_schema": read, "full_scan": not pushed, "reasons": reasons, "plan_ms": round(1000 * (planned - began), 3)}
    if analyze:
        report["rows"] = out.count()
        report["run_ms"] = round(1000 * (time.perf_counter() - planned), 3)
    return report
