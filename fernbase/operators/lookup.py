"""Lookup joins: documents of another table embedded by key."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..plans import filters
from ..sources.scratch import settled
from .find import ROW, Projection, project


@dataclass(frozen=True)
class Lookup:
    """Embed the documents of ``table`` whose ``target_key`` equals the local key (each of them, if it is an
    array) under ``as_``; without ``as_`` in the place of the key."""

    table: DataFrame
    local_key: str
    target_key: str
    as_: str | None = None
    projection: Projection = None
    hide_deleted: bool = False


def _target(spec: Lookup) -> DataFrame:
    """(__key, __doc): a row for each key; of documents that share one the last by insertion stays."""
    df = spec.table.filter(filters.compile_filter(filters.visible({}, spec.hide_deleted), spec.table.schema))
    key = filters.resolve(spec.target_key, filters.fields_of(df.schema)).column
    order = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    shown = project(df, spec.projection).columns
    cut = project(df.withColumns({"__key": key, "__order": order}), _with(spec.projection, shown))
    doc = F.struct(*[F.col(f"`{c}`") for c in cut.columns if c not in ("__key", "__order")])
    pairs = cut.where(F.col("__key").isNotNull()).select("__key", "__order", doc.alias("__doc"))
    return pairs.groupBy("__key").agg(F.max_by("__doc", "__order").alias("__doc"))


def _with(projection: Projection, shown: list[str]) -> Projection:
    if not projection:
        return None
    spec = dict.fromkeys(projection, 1) if isinstance(projection, (list, tuple)) else dict(projection)
    if any(v not in (0, False, -1) for v in spec.values()):
        spec |= {"__key": 1, "__order": 1}
    return spec


def lookup(df: DataFrame, spec: Lookup, bounded: bool = False) -> DataFrame:
    """One lookup join. Keys compare within their type; a null key probes nothing and stays as it is.

    With a scalar key and ``as_`` an unmatched row has null there; without ``as_`` the document takes the
    key's place, as ``{key, doc}`` would need two types: an unmatched key gives null, and the key itself
    remains under ``<local_key>_key``. An array key gives the documents in the order of its elements, repeated
    ones repeated, unmatched ones left out. ``bounded`` says that the left side is a page: its keys reduce
    the other table by a semi-join before documents are built.
    """
    key = filters.resolve(spec.local_key, filters.fields_of(df.schema))
    name = spec.as_ or spec.local_key
    right = _target(spec)
    right_kind = right.schema["__key"].dataType
    left_kind = key.kind.elementType if isinstance(key.kind, T.ArrayType) else key.kind
    if key.column is None:
        return df
    if V.bracket_of_type(left_kind) != V.bracket_of_type(right_kind):
        right = right.where(F.lit(False)).withColumn("__key", F.lit(None).cast(left_kind))
    if bounded:
        keys = df.select((F.explode(key.column) if isinstance(key.kind, T.ArrayType) else key.column).alias("__key")).distinct()
        right = right.join(keys, "__key", "left_semi")  # the planner sees how few they are
    if isinstance(key.kind, T.ArrayType):
        own = next((c for c in (ROW, "id") if c in df.columns), None)
        # without a number or id of its own a row gets one, written down so that both uses below see the same
        numbered = df.withColumn("__n", F.col(own)) if own else settled(df.withColumn("__n", F.monotonically_increasing_id()))
        probes = numbered.select("__n", F.posexplode(key.column).alias("__at", "__key"))
        found = probes.join(right, "__key").groupBy("__n").agg(F.array_sort(F.collect_list(F.struct("__at", "__doc"))).alias("__found"))
        doc_type = right.schema["__doc"].dataType
        listed = F.when(key.column.isNotNull(), F.coalesce(F.transform("__found", lambda x: x["__doc"]), F.array().cast(T.ArrayType(doc_type))))
        joined = numbered.join(found, "__n", "left").withColumn("__new", listed).drop("__n", "__found")
    else:
        joined = df.withColumn("__key", key.column).join(right, "__key", "left").drop("__key").withColumnRenamed("__doc", "__new")
        if spec.as_ is None and "." not in spec.local_key:
            joined = joined.withColumn(f"{spec.local_key}_key", F.col(f"`{spec.local_key}`"))
    return joined.drop(*([name] if name in df.columns else [])).withColumnRenamed("__new", name)


def lookup_all(df: DataFrame, specs: Any, bounded: bool = False) -> DataFrame:
    """Several lookups, each by the keys as they were before any of them."""
    specs = [specs] if isinstance(specs, Lookup) else list(specs)
    keep = {s.local_key for s in specs if "." not in s.local_key}
    out = df.withColumns({f"__from_{k}": F.col(f"`{k}`") for k in keep})
    for s in specs:
        original = f"__from_{s.local_key}" if s.local_key in keep else s.local_key
        if s.as_ is None and s.local_key in keep:
            made = lookup(out.drop(s.local_key), Lookup(s.table, original, s.target_key, s.local_key, s.projection, s.hide_deleted), bounded)
            out = made.withColumn(f"{s.local_key}_key", F.col(f"`{original}`")) if not isinstance(df.schema[s.local_key].dataType, T.ArrayType) else made
        else:
            out = lookup(out, Lookup(s.table, original, s.target_key, s.as_, s.projection, s.hide_deleted), bounded)
    return out.drop(*[f"__from_{k}" for k in keep])
