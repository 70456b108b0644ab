"""A named table of documents: reads, writes, hooks and transactions over versioned snapshots."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError, UniqueError
from .operators import find, lookup, tree, writes
from .plans import filters, updates
from .sources import backup
from .sources.store import Store

_LOCKS: dict[str, threading.RLock] = {}
_TABLES: dict[tuple[str, str], DocTable] = {}


@dataclass
class Hooks:
    """Callbacks that may replace what they are given; None leaves it."""

    check_filter: Callable[[dict[str, Any]], dict[str, Any] | None] | None = None
    check_find_options: Callable[[dict[str, Any]], dict[str, Any] | None] | None = None
    check_update: Callable[[dict[str, Any]], dict[str, Any] | None] | None = None
    check_input: Callable[[DataFrame], DataFrame | None] | None = None
    check_output: Callable[[DataFrame], DataFrame | None] | None = None


def _hooked(hook: Callable[[Any], Any] | None, value: Any) -> Any:
    made = hook(value) if hook else None
    return value if made is None else made


@dataclass
class Options:
    """``mark_delete`` marks rows instead of taking them out; ``auto_metadata`` keeps creation and update times;
    ``unique`` lists the keys of unique indexes; ``presets`` are named projections."""

    mark_delete: bool = False
    auto_metadata: bool = False
    unique: list[list[str]] = field(default_factory=list)
    indexes: list[dict[str, Any]] = field(default_factory=list)
    presets: dict[str, find.Projection] = field(default_factory=dict)
    compression: str = "snappy"


class DocTable:
    """A table at a path. Every write makes one new snapshot; a writer that lost a race gets an error."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None, options: Options | None = None, hooks: Hooks | None = None, now: Callable[[], dt.datetime] | None = None):
        self.spark, self.options, self.hooks = spark, options or Options(), hooks or Hooks()
        self.store = Store(spark, path, self.options.compression)
        self.now = now or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self._staged: DataFrame | None = None
        self._depth = 0
        self._base = 0
        if not self.store.version():
            kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or T.StructType([])
            fields = [T.StructField(find.ROW, T.LongType()), *([] if "id" in kind.names else [T.StructField("id", T.StringType())]), *kind.fields]
            self.store.commit(spark.createDataFrame([], T.StructType(fields)), 0, self._meta())

    def _meta(self) -> dict[str, Any]:
        return {"indexes": self.options.indexes, "unique": self.options.unique}

    # reading

    @property
    def df(self) -> DataFrame:
        """The rows, insertion numbers and deleted ones included."""
        return self._staged if self._staged is not None else self.store.read()

    def _filter(self, filter_: dict[str, Any] | None) -> dict[str, Any]:
        return _hooked(self.hooks.check_filter, dict(filter_ or {}))

    def _hide(self, ignore_mark_delete: bool) -> bool:
        return self.options.mark_delete and not ignore_mark_delete

    def _options(self, options: dict[str, Any]) -> dict[str, Any]:
        options = _hooked(self.hooks.check_find_options, dict(options))
        if "skip" in options:
            raise QueryError("offset is the name of that option")
        if isinstance(options.get("projection"), str):
            options["projection"] = self.preset(options["projection"])
        options["hide_deleted"] = self._hide(options.pop("ignore_mark_delete", False))
        return options

    def preset(self, name: str) -> find.Projection:
        if name not in self.options.presets:
            raise QueryError(f"no projection is named {name}")
        return self.options.presets[name]

    def find(self, filter_: dict[str, Any] | None = None, **options: Any) -> DataFrame:
        """Matching rows as a frame: nothing runs yet. An index on a field that the filter fixes narrows the rows first."""
        filter_ = self._filter(filter_)
        return _hooked(self.hooks.check_output, find.find_many(self._narrowed(filter_), filter_, **self._options(options)))

    def _narrowed(self, filter_: dict[str, Any]) -> DataFrame:
        """The rows that an index leaves to look at: a semi-join on the ids that a side table has for the values."""
        side = self._probe(filter_)
        if side is None:
            return self.df
        return self.df.join(side[1], "id", "left_semi")

    def _probe(self, filter_: dict[str, Any]) -> tuple[str, DataFrame] | None:
        """The first index that has values for an equality or ``$in`` of the filter, and the ids that it gives."""
        if self._staged is not None:
            return None
        for index in self.options.indexes:
            key = index["keys"][0] if index.get("side") else None
            if key is None or key not in filter_:
                continue
            wanted = filter_[key].get("$in") if isinstance(filter_[key], dict) else [filter_[key]]
            path = f"{self.store.root}/x-{self.store.version()}-{key}"
            if not wanted or any(not isinstance(v, (str, int, float)) or isinstance(v, bool) for v in wanted) or not self.store.has(path):
                continue
            rows = self.spark.read.parquet(path)
            text = isinstance(rows.schema["val"].dataType, T.StringType)
            if all(isinstance(v, str) == text for v in wanted):
                return key, rows.where(F.col("val").isin(list(wanted))).select("id").distinct()
        return None

    def _write_sides(self, version: int) -> None:
        """The side tables of a version: (val, id) of each element of an indexed field, sorted by value, so that a
        reader prunes files and row groups by it."""
        rows = self.store.read(version)
        for index in self.options.indexes:
            key = index["keys"][0]
            if not index.get("side") or key not in rows.columns:
                continue
            kind = rows.schema[key].dataType
            value = F.explode(F.array_distinct(F.col(f"`{key}`"))) if isinstance(kind, T.ArrayType) else F.col(f"`{key}`")
            pairs = rows.select(value.alias("val"), "id").where("val IS NOT NULL")
            pairs.repartitionByRange("val", "id").sortWithinPartitions("val").write.mode("overwrite").parquet(f"{self.store.root}/x-{version}-{key}")

    def find_many(self, filter_: dict[str, Any] | None = None, **options: Any) -> list[Row]:
        """Matching rows as a list, in the order of the sort or of insertion."""
        return self.find(filter_, **{"ordered": True, **options}).collect()

    def find_one(self, filter_: dict[str, Any] | None = None, **options: Any) -> Row | None:
        return self.find(filter_, **{**options, "limit": 1}).first()

    def get(self, id_: Any, ignore_mark_delete: bool = False) -> Row | None:
        return self.find_one({"id": id_}, ignore_mark_delete=ignore_mark_delete)

    def has(self, id_: Any, ignore_mark_delete: bool = False) -> bool:
        return not find.get(self.df, id_, self._hide(ignore_mark_delete)).isEmpty()

    def count(self, filter_: dict[str, Any] | None = None, ignore_mark_delete: bool = False) -> int:
        return find.count(self.df, self._filter(filter_), self._hide(ignore_mark_delete)).first()[0]

    def list_paging(self, filter_: dict[str, Any] | None = None, **options: Any) -> find.Page:
        return find.list_paging(self.df, self._filter(filter_), **self._options(options))

    def list_paging_by_cursor(self, filter_: dict[str, Any] | None = None, **options: Any) -> find.Page:
        return find.list_paging_by_cursor(self.df, self._filter(filter_), **self._options(options))

    def each_batch(self, filter_: dict[str, Any] | None, work: Callable[..., None], **options: Any) -> int:
        return find.each_batch(self.df, self._filter(filter_), work, **self._options(options))

    def for_each(self, filter_: dict[str, Any] | None, work: Callable[[Row, int], None], **options: Any) -> None:
        find.for_each(self.df, self._filter(filter_), work, **self._options(options))

    def explain(self, filter_: dict[str, Any] | None = None, analyze: bool = False, **options: Any) -> dict[str, Any]:
        filter_ = self._filter(filter_)
        side = self._probe(filter_)
        report = find.explain(self._narrowed(filter_), filter_, analyze, **self._options(options))
        return {**report, "index": side[0] if side else None, "full_scan": report["full_scan"] and side is None}

    def as_lookup(self, local_key: str, target_key: str, as_: str | None = None, projection: find.Projection = None) -> lookup.Lookup:
        return lookup.Lookup(self.df, local_key, target_key, as_, projection, self.options.mark_delete)

    # writing

    @contextmanager
    def transaction(self) -> Iterator[DocTable]:
        """Writes inside become one snapshot, or none if an error leaves the block; blocks may nest."""
        lock = _LOCKS.setdefault(self.store.root, threading.RLock())
        with lock:
            if self._depth == 0:
                self._base = self.store.version()
            self._depth += 1
            try:
                yield self
                if self._depth == 1 and self._staged is not None:
                    self._write_sides(self.store.commit(self._staged, self._base, self._meta(), check=self._check_unique))
            finally:
                self._depth -= 1
                if self._depth == 0:
                    self._staged = None

    def _check_unique(self, df: DataFrame) -> None:
        for keys in [["id"], *self.options.unique]:
            if all(k in df.columns for k in keys) and (bad := writes.broken_unique(df, keys).first()) is not None:
                raise UniqueError(f"{keys} has a value that several rows have: {bad}")

    def _write(self, change: Callable[[DataFrame], DataFrame], count: Callable[[DataFrame], dict[str, int]] | None = None) -> dict[str, int]:
        """Stage what ``change`` makes of the rows, unless nothing changes. ``count`` tells that from the rows
        before, without a join; by default both states are compared."""
        with self.transaction():
            before = self.df
            after = change(before)
            counts = count(before) if count else writes.changes(before, after).first().asDict()
            if any(counts.values()) or before.schema != after.schema:
                self._staged = after
            return counts

    def _docs(self, docs: DataFrame | list[dict[str, Any]]) -> DataFrame:
        frame = docs if isinstance(docs, DataFrame) else writes.rows_of(self.spark, docs, self._typed(docs))
        return _hooked(self.hooks.check_input, frame)

    def _typed(self, docs: list[dict[str, Any]]) -> T.StructType:
        named = {k.split(".")[0] for d in docs for k in d} | {"id"}
        return T.StructType([f for f in self.df.schema.fields if f.name in named and f.name != find.ROW])

    def _clock(self) -> dt.datetime | None:
        return self.now() if self.options.auto_metadata else None

    def insert_many(self, docs: DataFrame | list[dict[str, Any]]) -> dict[str, int]:
        new = self._docs(docs)
        counts = self._write(lambda df: writes.insert_many(df, new, self.options.unique, self._clock()))
        return {"inserted": counts["inserted"], "skipped": new.count() - counts["inserted"]}

    def insert_one(self, doc: dict[str, Any]) -> dict[str, int]:
        return self.insert_many([doc])

    def set(self, id_: Any, doc: dict[str, Any]) -> dict[str, int]:
        new = self._docs([{**doc, "id": str(id_)}])
        return self._write(lambda df: writes.set_doc(df, new, self._clock()))

    def set_many(self, docs: DataFrame | list[dict[str, Any]], **options: Any) -> dict[str, int]:
        if not isinstance(docs, DataFrame) and not (options.get("merge") or options.get("overwrite")):
            docs = writes.patch_rows(self.spark, docs, self._typed(docs))
        new = self._docs(docs)
        return self._write(lambda df: writes.set_many(df, new, clock=self._clock(), **options))

    def _updated(self, filter_: dict[str, Any] | None, update: dict[str, Any], one: bool, upsert: bool, sort: find.Sort) -> dict[str, int]:
        update, filter_ = _hooked(self.hooks.check_update, updates.check(dict(update))), self._filter(filter_)
        options = {"hide_deleted": self._hide(False), "clock": self._clock()}
        chosen = {**options, "sort": sort} if one else options
        with self.transaction():
            found = writes.update_counts(self.df, filter_, update, one=one, sort=sort, **options).first().asDict()
            if upsert and not found["matched"]:
                work = writes.upsert_one if one else writes.upsert_many
                self._write(lambda df: work(df, filter_, update, **chosen), lambda df: {"inserted": 1})
                return {**found, "upserted": 1}
            work = writes.update_one if one else writes.update_many
            self._write(lambda df: work(df, filter_, update, **chosen), lambda df: {"modified": found["modified"]})
            return {**found, "upserted": 0}

    def update_one(self, filter_: dict[str, Any] | None, update: dict[str, Any], *, upsert: bool = False, sort: find.Sort = None) -> dict[str, int]:
        return self._updated(filter_, update, True, upsert, sort)

    def update_many(self, filter_: dict[str, Any] | None, update: dict[str, Any], *, upsert: bool = False) -> dict[str, int]:
        return self._updated(filter_, update, False, upsert, None)

    def bulk_update(self, items: list[dict[str, Any]]) -> dict[str, int]:
        return self._write(lambda df: writes.bulk_update(df, items, hide_deleted=self._hide(False), clock=self._clock()))

    def _deleted(self, filter_: dict[str, Any] | None, one: bool, sort: find.Sort, real: bool) -> int:
        filter_ = self._filter(filter_)
        hide = self._hide(real)
        with self.transaction():
            n = find.count(self.df, filter_, hide).first()[0]
            n = min(n, 1) if one else n
            if self.options.mark_delete and not real:
                clock = self.now()
                work = (lambda df: writes.soft_delete_one(df, filter_, clock, sort)) if one else (lambda df: writes.soft_delete_many(df, filter_, clock))
            else:
                work = (lambda df: writes.delete_one(df, filter_, sort=sort, hide_deleted=hide)) if one else (lambda df: writes.delete_many(df, filter_, hide_deleted=hide))
            self._write(work, lambda df: {"removed": n})
            return n

    def delete(self, id_: Any, *, real_delete: bool = False, read_delete: bool = False) -> int:
        return self._deleted({"id": id_}, False, None, real_delete or read_delete)

    def delete_one(self, filter_: dict[str, Any] | None, *, sort: find.Sort = None, real_delete: bool = False, read_delete: bool = False) -> int:
        return self._deleted(filter_, True, sort, real_delete or read_delete)

    def delete_many(self, filter_: dict[str, Any] | None, *, real_delete: bool = False, read_delete: bool = False) -> int:
        return self._deleted(filter_, False, None, real_delete or read_delete)

    def clear(self) -> None:
        self._write(lambda df: df.limit(0), lambda df: {"removed": 1})

    def clear_all(self) -> None:
        self.options.indexes, self.options.unique = [], []
        self.clear()

    def drop(self) -> None:
        self.store.drop()

    def compact(self, files: int | None = None) -> None:
        """Rewrite the rows into few files, by default of 128 MB, in the order of the first index: its keys' ranges
        then prune files and row groups, as an index would."""
        if files is None:
            files = 1 + int(str(self.store.read()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (128 << 20)
        keys = next((list(i["keys"]) for i in self.options.indexes if i.get("keys")), [])
        with self.transaction():
            base = self.store.version()
            rows = self.store.read()
            if keys:
                rows = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
            self._base = self.store.commit(rows, base, self._meta(), files)
            self._write_sides(self._base)

    def close(self) -> None:
        _TABLES.pop((self.spark.sparkContext.applicationId, self.store.root), None)

    def define_indexes(self, indexes: list[dict[str, Any]], rebuild: bool = False) -> None:
        """``{keys: [...], unique: bool, side: bool, disabled: bool}``. Unique ones are checked now and on every commit.
        With ``side`` a table of the first key's values, an array's elements each, is written beside every
        snapshot, and an equality or ``$in`` on it is answered from there; the others say how to sort."""
        found = ([] if rebuild else self.options.indexes) + [i for i in indexes if not i.get("disabled")]
        unique = [list(i["keys"]) for i in found if i.get("unique")]
        for keys in unique:
            if writes.broken_unique(self.df, keys).first() is not None:
                raise UniqueError(f"{keys} is not unique")
        self.options.indexes, self.options.unique = found, unique
        if self._depth == 0:
            self._write_sides(self.store.version())

    def drop_indexes(self) -> None:
        self.options.indexes, self.options.unique = [], []

    # backups

    def export_binary(self, out: BinaryIO, compress: bool = True) -> int:
        return backup.export_stream(self.df.drop(find.ROW), out, self.store.root.rsplit("/", 1)[-1], self.options.indexes, compress)

    def import_binary(self, data: BinaryIO, *, clear: bool = False, doc_ids: list[str] | None = None, ignore_indexes: bool = False) -> int:
        header, rows = backup.import_stream(self.spark, data, doc_ids)
        with self.transaction():
            if clear:
                self.clear()
            if not ignore_indexes and header["indexes"]:
                self.define_indexes(header["indexes"])
            self._write(lambda df: writes.set_many(df, rows, overwrite=True))
        return rows.count()

    def export_folder(self, path: str) -> None:
        backup.export_folder(self.df.drop(find.ROW), path, self.store.root.rsplit("/", 1)[-1], self.options.indexes)

    def import_folder(self, path: str, *, clear: bool = False, doc_ids: list[str] | None = None) -> None:
        _, rows = backup.import_folder(self.spark, path, doc_ids)
        with self.transaction():
            if clear:
                self.clear()
            self._write(lambda df: writes.set_many(df, rows, overwrite=True))


class TreeTable(DocTable):
    """A table whose rows are the nodes of a tree; every change keeps the roll-ups right."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, hooks: Hooks | None = None, now: Callable[[], dt.datetime] | None = None):
        marks = [T.StructField(writes.GONE, T.BooleanType()), T.StructField(writes.DELETED, T.TimestampType())]
        super().__init__(spark, path, T.StructType([*tree.SCHEMA.fields, *marks]), options, hooks, now)

    def _stamp(self) -> int:
        return int(self.now().replace(tzinfo=dt.UTC).timestamp() * 1000)

    def _change(self, work: Callable[[DataFrame, int], tree.Changed]) -> tree.Changed:
        with self.transaction():
            done = work(self.df, self._stamp())
            self._staged = done.tree
            return done

    def create_nodes(self, nodes: list[dict[str, Any]], parent_id: str = tree.ROOT, place: tree.Place | None = None) -> list[str]:
        return self._change(lambda t, m: tree.create_nodes(t, nodes, parent_id, m, place)).ids

    def update_nodes(self, filter_: dict[str, Any], update: dict[str, Any], deep: bool = False) -> None:
        self._change(lambda t, m: tree.update_nodes(t, filter_, update, m, deep))

    def set_nodes(self, nodes: list[dict[str, Any]], rule: tree.Conflicts | None = None, update_only: bool = False, place: tree.Place | None = None, set_mode: str = "default", presync: bool = False) -> tree.Changed:
        """``presync`` also tells which of the nodes that come with ``oldModif`` and ``oldCmodif`` are out of date or gone."""
        states = None
        if presync:
            seen = self.spark.createDataFrame([(str(n["id"]), n.get("oldModif"), n.get("oldCmodif")) for n in nodes if n.get("id")], "id string, modif long, cmodif long")
            states = {r["id"]: r["state"] for r in tree.presync(self.df, seen).collect()}
        plain = [{k: v for k, v in n.items() if k not in ("oldModif", "oldCmodif")} for n in nodes]
        done = self._change(lambda t, m: tree.set_nodes(t, plain, m, rule, update_only, not self.options.mark_delete, self.now(), place, set_mode))
        done.states = states
        return done

    def delete_nodes(self, ids: list[str], real_delete: bool = False) -> int:
        real = real_delete or not self.options.mark_delete
        return self._change(lambda t, m: tree.delete_nodes(t, ids, m, real, self.now())).deleted

    def undelete_nodes(self, ids: list[str]) -> None:
        self._change(lambda t, m: tree.undelete_nodes(t, ids, m))

    def move_nodes(self, ids: list[str], parent_id: str, rule: tree.Conflicts | None = None, place: tree.Place | None = None) -> list[str]:
        return self._change(lambda t, m: tree.move_nodes(t, ids, parent_id, m, rule, place, real_delete=not self.options.mark_delete, clock=self.now())).ids

    def copy_nodes(self, ids: list[str], parent_id: str, place: tree.Place | None = None) -> None:
        self._change(lambda t, m: tree.copy_nodes(t, ids, parent_id, m, place))

    def refresh_tree_metadata(self) -> None:
        self._change(lambda t, m: tree.Changed(tree.refreshed(t)))

    def clear_dead_nodes(self) -> None:
        self._change(lambda t, m: tree.Changed(tree.without_dead(t)))

    def list_nodes(self, parent_id: str, **options: Any) -> DataFrame:
        return tree.list_nodes(self.df, parent_id, **options)


_DEFAULT: dict[str, str] = {}


def define_default_root(root: str | None) -> None:
    """The folder of tables that are defined by a bare name; None for none."""
    _DEFAULT.pop("root", None)
    if root:
        _DEFAULT["root"] = root.rstrip("/")


def define_table(path: str, **settings: Any) -> Callable[[SparkSession], DocTable]:
    """A function that gives one and the same table for a session; a bare name lies in the default root."""

    def bound(spark: SparkSession) -> DocTable:
        full = path.rstrip("/")
        if "/" not in full:
            if "root" not in _DEFAULT:
                raise QueryError(f"{full} is a bare name, and no default root is defined")
            full = f"{_DEFAULT['root']}/{full}"
        key = (spark.sparkContext.applicationId, full)
        if key not in _TABLES:
            _TABLES[key] = DocTable(spark, full, **settings)
        return _TABLES[key]

    return bound


def hidden(filter_: dict[str, Any] | None) -> dict[str, Any]:
    """The filter as a table that marks deletions applies it."""
    return filters.visible(filter_, True)


def visible_rows(df: DataFrame) -> DataFrame:
    return df.filter(filters.compile_filter(hidden({}), df.schema)) if writes.GONE in df.columns else df.where(F.lit(True))
