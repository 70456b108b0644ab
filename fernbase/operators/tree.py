"""Directory trees: nodes that name their parent, with counts and sizes rolled up to every directory.

A tree is a frame with ``id, parentId, name, isDir, index, size, modif`` and the managed columns ``cmodif,
childLastIndex, csize, ctotal, cftotal``; ``/`` is the parent of the top nodes.

Requests (ids, new nodes, places) are lists of what a caller names. The driver gathers no more than these
lists' rows: the named nodes, the directories above them, one conflict for each, the last key of each named
directory. Children, siblings and subtrees stay frames. Verbs expect managed columns that are right, as they
leave them: a change is added along the directories above it. Merges, restored subtrees and :func:`set_nodes`
work all roll-ups out anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import order_keys
from ..functions import names as file_names
from ..plans import filters
from ..sources.scratch import release, settled
from . import find, writes

ROOT = "/"
MANAGED = ("ctotal", "cftotal", "csize", "childLastIndex")
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.StringType()), ("parentId", T.StringType()), ("name", T.StringType()), ("type", T.StringType()), ("modif", T.LongType()), ("cmodif", T.LongType()), ("isDir", T.BooleanType()), ("index", T.StringType()), ("childLastIndex", T.StringType()), ("csize", T.LongType()), ("ctotal", T.LongType()), ("cftotal", T.LongType()), ("size", T.LongType()))]
)
MODES = ("replace", "skip", "merge", "mergeByModif", "newName")


def check_node(node: dict[str, Any]) -> dict[str, Any]:
    """A node with its defaults, or an error."""
    out = {"index": "", "size": 0, "isDir": False, **{k: v for k, v in node.items() if k not in MANAGED}}
    if not isinstance(out.get("id"), str) or not out["id"]:
        raise QueryError("a node needs an id")
    check_name(out.get("name"))
    check_size(out["size"])
    if not isinstance(out["isDir"], bool):
        raise QueryError("isDir is true or false")
    return out


def check_name(name: Any) -> None:
    if not isinstance(name, str) or not name or "/" in name:
        raise QueryError(f"{name!r} is no name of a node")


def check_size(size: Any) -> None:
    if isinstance(size, bool) or not isinstance(size, (int, float)) or not math.isfinite(size) or size < 0:
        raise QueryError(f"{size!r} is no size")


def _one(name: str, values: list[str], spark: Any) -> DataFrame:
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values) if v], f"{name} string")


def live(tree: DataFrame) -> DataFrame:
    """The nodes that are not marked as deleted."""
    return tree.where("_isDeleted IS NULL OR _isDeleted = false") if writes.GONE in tree.columns else tree


def list_nodes(tree: DataFrame, parent_id: str, *, only_types: list[str] | None = None, only_not_types: list[str] | None = None, filter_: dict[str, Any] | None = None, sort: find.Sort = None, **options: Any) -> DataFrame:
    """A directory's direct children in the order of their keys. ``only_types`` beats ``only_not_types``; the extra
    filter cannot change the parent."""
    parts: list[dict[str, Any]] = [{"parentId": parent_id}]
    if only_types:
        parts.append({"type": {"$in": list(only_types)}})
    elif only_not_types:
        parts.append({"type": {"$nin": list(only_not_types)}})
    if filter_:
        parts.append(filter_)
    return find.find_many(live(tree), {"$and": parts}, sort=sort or ["index", "id"], **options)


def _ids(values: list[str] | DataFrame, spark: Any) -> DataFrame:
    return values.select("id").distinct() if isinstance(values, DataFrame) else _one("id", values, spark)


def descendants(tree: DataFrame, roots: list[str] | DataFrame, include_self: bool = False) -> DataFrame:
    """All nodes below the roots that exist; a node that was met is not met again, so a cycle ends. Two levels are
    one job: the children of the last level, and theirs."""
    links = tree.select("id", "parentId")
    level = _ids(roots, tree.sparkSession).join(links.select("id"), "id", "left_semi")
    seen: list[DataFrame] = []
    while True:
        one = links.join(level.select(F.col("id").alias("parentId")), "parentId", "left_semi").select("id")
        two = links.join(one.select(F.col("id").alias("parentId")), "parentId", "left_semi").select("id")
        step = one.withColumn("far", F.lit(1)).unionByName(two.withColumn("far", F.lit(2)))
        if not seen:
            step = level.withColumn("far", F.lit(0)).unionByName(step)
        step = step.groupBy("id").agg(F.min("far").alias("far"))  # of a cycle's nodes the nearer place
        for s in seen:
            step = step.join(s, "id", "left_anti")
        seen.append(settled(step))
        level = seen[-1].where("far = 2")
        if level.isEmpty():
            break
    if not include_self:
        seen[0] = seen[0].where("far > 0")
    wanted = seen[0].select("id")
    for s in seen[1:]:
        wanted = wanted.unionByName(s.select("id"))
    return tree.join(wanted, "id", "left_semi")


def closure(tree: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of every node and each directory above it, by doubling: the rounds grow with the
    logarithm of the depth, the rows with nodes times depth. A cycle is an error."""
    pairs = settled(tree.where(F.col("parentId").isNotNull()).select("id", F.col("parentId").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while True:
        if not pairs.where("id = ancestor").isEmpty():
            raise QueryError("the nodes form a cycle")
        far = pairs.where(F.col("distance") == reach).select("id", F.col("ancestor").alias("middle"))
        more = far.join(pairs.select(F.col("id").alias("middle"), "ancestor", F.col("distance").alias("d")), "middle")
        more = settled(more.select("id", "ancestor", (F.col("d") + reach).alias("distance")))
        if more.isEmpty():
            return pairs
        pairs, reach = settled(pairs.unionByName(more)), 2 * reach


def chains(tree: DataFrame, ids: list[str]) -> dict[str, list[str]]:
    """The directories above each named node that exists, nearest first, ``/`` or a missing one last. Each job climbs
    two levels of all of them. A cycle is an error."""
    up = tree.select("id", "parentId")
    two = up.join(up.select(F.col("id").alias("parentId"), F.col("parentId").alias("next")), "parentId", "left")
    parent: dict[str, str | None] = {}
    ask = {i for i in ids if i}
    while ask:
        found = two.where(F.col("id").isin(list(ask))).select("id", "parentId", "next").collect()
        parent.update(dict.fromkeys(ask - {r["id"] for r in found}))
        for r in found:
            parent[r["id"]] = r["parentId"]
            if r["parentId"] is not None and (r["next"] is not None or r["parentId"] not in parent):
                parent[r["parentId"]] = r["next"]
        ask = {p for p in parent.values() if p is not None and p not in parent and p != ROOT}
    out = {}
    for i in dict.fromkeys(ids):
        if parent.get(i) is None:
            continue
        way, at = [], parent[i]
        while at is not None:
            if at == i or at in way:
                raise QueryError("the nodes form a cycle")
            way.append(at)
            at = parent.get(at)
        out[i] = way
    return out


def ancestors(tree: DataFrame, ids: list[str]) -> DataFrame:
    """(id, ancestor, distance) of the named nodes. A cycle is an error."""
    rows = [(i, a, k) for i, way in chains(tree, ids).items() for k, a in enumerate(way, 1)]
    return tree.sparkSession.createDataFrame(rows, "id string, ancestor string, distance int")


def top_selected(tree: DataFrame, ids: list[str]) -> DataFrame:
    """The named nodes that no other named node lies above."""
    return tree.where(F.col("id").isin(_tops(tree, ids)))


def _tops(tree: DataFrame, ids: list[str]) -> list[str]:
    ways, named = chains(tree, ids), set(ids)
    return [i for i in dict.fromkeys(ids) if i and not named & set(ways.get(i, ()))]


def roll_ups(tree: DataFrame) -> DataFrame:
    """(id, ctotal, cftotal, csize, childLastIndex) of every parent: the live nodes below it, the files among
    them, their sizes, and the last key of its direct children. Sums of zero are null.

    The children of each parent are added up once. After that only parents are left, each with a pointer
    to the one above. In round k a parent has the sums of the nodes at most 2**k levels below it and points
    2**k levels up; the sums of all that point to it complete the next 2**k levels. So the rounds grow with
    the logarithm of the depth, and each has one row a parent. Two rounds are one job. A cycle is an error.
    """
    nodes = live(tree)
    sums = ["ctotal", "cftotal", "csize"]
    direct = nodes.where(F.col("parentId").isNotNull()).groupBy(F.col("parentId").alias("id")).agg(
        F.count("*").alias("ctotal"),
        F.sum(F.when(F.col("isDir"), 0).otherwise(1)).cast("long").alias("cftotal"),
        F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("csize"),
        F.max(F.when(F.col("index") != "", F.col("index"))).alias("childLastIndex"),
    )
    at = settled(direct.join(nodes.select("id", F.col("parentId").alias("up")), "id", "left"))
    reach = 1
    while not at.where("up IS NOT NULL").isEmpty():
        if reach >= 256 and reach > 2 * at.count():  # no chain is longer than there are parents
            raise QueryError("the nodes form a cycle")
        before = at
        for _ in range(2):
            below = at.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
            further = at.select(F.col("id").alias("up"), F.col("up").alias("__up"))
            at = at.join(below, "id", "left").join(further, "up", "left")
            at = at.select("id", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums], "childLastIndex", F.col("__up").alias("up"))
        at = settled(at)
        release(before)
        reach *= 4
    return at.select("id", *[F.when(F.col(c) != 0, F.col(c)).alias(c) for c in sums], "childLastIndex")


def refreshed(tree: DataFrame) -> DataFrame:
    """The tree with all managed columns worked out anew."""
    sums = roll_ups(tree)
    rest = [c for c in tree.columns if c not in MANAGED]
    return tree.select(*rest).join(sums, "id", "left").select(*tree.columns, *[c for c in MANAGED if c not in tree.columns])


def wrong_roll_ups(tree: DataFrame) -> DataFrame:
    """Live nodes whose managed columns differ from what their descendants add up to."""
    right = roll_ups(tree).select("id", *[F.col(c).alias(f"__{c}") for c in MANAGED])
    differs = filters._fold([~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in MANAGED], False)
    return live(tree).join(right, "id", "left").where(differs).select("id")


@dataclass
class Place:
    """Where among its siblings a node goes: after, before or between nodes, or at either end."""

    previous: str | None = None
    next: str | None = None
    to_start: bool = False
    to_end: bool = False


@dataclass
class Conflicts:
    """What happens to a sibling with the same ``unique_by``."""

    unique_by: str = "id"
    mode: str = "replace"
    file_over_dir: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise QueryError(f"{self.mode} is none of {MODES}")


@dataclass
class Changed:
    """A tree after a change, and which nodes the change touched."""

    tree: DataFrame
    ids: list[str] = field(default_factory=list)
    deleted: int = 0
    states: dict[str, str] | None = None


def _key_of(tree: DataFrame, node: str, parent: str) -> str | None:
    row = live(tree).where(F.col("id") == node).select("parentId", "index").first()
    if row is None:
        raise QueryError(f"no node {node} to go by")
    if row["parentId"] != parent:
        raise QueryError(f"{node} is in another directory")
    return row["index"] or None


def _siblings(tree: DataFrame, parent: str) -> Any:
    """Of the keys of a directory's children: the first, the last, how many, how many different, the longest."""
    key = F.col("index")
    return live(tree).where((F.col("parentId") == parent) & (key != "")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.max(F.length(key)).alias("l")).first()


def _at_an_end(place: Place | None) -> bool:
    """Whether new keys go beyond all others, so that they repeat none."""
    return place is None or not (place.previous or place.next)


def keys_for(tree: DataFrame, parent: str, count: int, place: Place | None = None, state: Any = None) -> list[str]:
    """Order keys for new children. By default after the last one; empty where no child has a key."""
    place = place or Place()
    if place.previous and place.next:
        return order_keys.spread(_key_of(tree, place.previous, parent), _key_of(tree, place.next, parent), count)
    if place.previous:
        return order_keys.after(_key_of(tree, place.previous, parent), count)
    if place.next:
        return order_keys.before(_key_of(tree, place.next, parent), count)
    ends = state or _siblings(tree, parent)
    if place.to_start:
        return order_keys.before(ends["low"], count)
    if place.to_end:
        return order_keys.after(ends["high"], count)
    if parent != ROOT and ends["high"]:
        return order_keys.after(ends["high"], count)
    return [""] * count


def _parent_exists(tree: DataFrame, parent: str) -> None:
    if parent != ROOT and live(tree).where((F.col("id") == parent) & F.col("isDir")).isEmpty():
        raise QueryError(f"no directory {parent}")


def stamped_up(tree: DataFrame, parents: list[str], modif: int) -> DataFrame:
    """Directories, and all above them, with the time of the last change below them."""
    ways = chains(tree, [p for p in parents if p and p != ROOT])
    return _stamped_at(tree, {i for p, way in ways.items() for i in (p, *way)}, modif)


def _stamped_at(tree: DataFrame, ids: set[str], modif: int) -> DataFrame:
    if "cmodif" not in tree.columns:
        tree = tree.withColumn("cmodif", F.lit(None).cast("long"))
    if not ids:
        return tree
    return tree.withColumn("cmodif", F.when(F.col("id").isin(sorted(ids)), F.lit(modif)).otherwise(F.col("cmodif"))).select(*tree.columns)


def contribution() -> list[Column]:
    """What a node adds to the roll-ups of each directory above it."""
    old = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [(1 + old("ctotal")).alias("dt"), (F.when(F.col("isDir"), 0).otherwise(1) + old("cftotal")).alias("df"), (old("size") + old("csize")).cast("long").alias("ds")]


def shifted(tree: DataFrame, deltas: DataFrame, modif: int, refresh: list[str] | DataFrame) -> DataFrame:
    """The tree with (id, dt, df, ds) of ``deltas``, sums by direct parent, added to these directories and all above
    them, never below zero, and with ``cmodif``. The last key of the directories in ``refresh`` is looked up anew.

    The directories' chains are climbed as frames, two levels a job: nothing is gathered however many there are.
    """
    links = tree.select("id", F.col("parentId").alias("up"))
    size = ["dt", "df", "ds"]
    summed = lambda df: df.groupBy("id").agg(*[F.sum(c).cast("long").alias(c) for c in size])
    higher = lambda df: summed(df.where((F.col("up") != ROOT) & F.col("up").isNotNull()).select(F.col("up").alias("id"), *size)).join(links, "id")
    level = summed(deltas.where(F.col("id") != ROOT)).join(links, "id")
    every: list[DataFrame] = []
    while True:
        one = higher(level)
        two = higher(one).withColumn("far", F.lit(2))
        step = one.withColumn("far", F.lit(1)).unionByName(two)
        every.append(settled(step if every else level.withColumn("far", F.lit(0)).unionByName(step)))
        level = every[-1].where("far = 2").drop("far")
        if level.isEmpty():
            break
        if len(every) > 10_000:
            raise QueryError("the nodes form a cycle")
    total = every[0].select("id", *size)
    for e in every[1:]:
        total = total.unionByName(e.select("id", *size))
    return _with_sums(tree, summed(total), modif, refresh)


def _with_sums(tree: DataFrame, total: DataFrame, modif: int, refresh: list[str] | DataFrame) -> DataFrame:
    """The tree with (id, dt, df, ds) added to these nodes."""
    total = total.withColumn("__hit", F.lit(True))
    named = _ids(refresh, tree.sparkSession)
    last = live(tree).join(named.select(F.col("id").alias("parentId")), "parentId", "left_semi").groupBy(F.col("parentId").alias("id")).agg(F.max(F.when(F.col("index") != "", F.col("index"))).alias("__last"))
    last = named.join(last, "id", "left").withColumn("__again", F.lit(True))
    out = tree.join(total, "id", "left").join(last, "id", "left")
    for c, d in zip(("ctotal", "cftotal", "csize"), ("dt", "df", "ds"), strict=True):
        new = F.greatest(F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0)), F.lit(0))
        out = out.withColumn(c, F.when(F.col("__hit") & (new != 0), new.cast("long")).when(~F.coalesce("__hit", F.lit(False)), F.col(c)))
    out = out.withColumn("childLastIndex", F.when(F.col("__again"), F.col("__last")).otherwise(F.col("childLastIndex")))
    out = out.withColumn("cmodif", F.when(F.col("__hit"), F.lit(modif)).otherwise(F.col("cmodif")))
    return out.select(*tree.columns)


def _climbed(tree: DataFrame, changes: list[tuple[str, tuple[int, int, int]]], ways: dict[str, list[str]], modif: int, refresh: list[str]) -> DataFrame:
    """As :func:`shifted`, for changes (directory, sums) of a request, whose directories' chains are known."""
    sums: dict[str, list[int]] = {}
    for parent, change in changes:
        for at in (parent, *ways.get(parent, ())):
            if at != ROOT:
                held = sums.setdefault(at, [0, 0, 0])
                held[:] = [x + y for x, y in zip(held, change, strict=True)]
    total = tree.sparkSession.createDataFrame([(i, *v) for i, v in sums.items()], "id string, dt long, df long, ds long")
    return _with_sums(tree, total, modif, refresh)


def _weight(row: Any) -> tuple[int, int, int]:
    """:func:`contribution` of a row at hand."""
    return 1 + (row["ctotal"] or 0), (0 if row["isDir"] else 1) + (row["cftotal"] or 0), (row["size"] or 0) + (row["csize"] or 0)


WEIGHED = ["id", "parentId", "name", "isDir", "modif", "size", "ctotal", "cftotal", "csize"]


def _managed(tree: DataFrame) -> DataFrame:
    """The tree with all managed columns, null where it lacks them."""
    kinds = {"cmodif": "long", "ctotal": "long", "cftotal": "long", "csize": "long", "childLastIndex": "string"}
    return tree.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in tree.columns})


def create_nodes(tree: DataFrame, nodes: list[dict[str, Any]], parent_id: str, modif: int, place: Place | None = None) -> Changed:
    """New children of a directory; nodes whose id is there already stay as they are."""
    if not nodes:
        return Changed(tree)
    tree = _managed(tree)
    made = [check_node({"id": writes.new_id(), **n, "parentId": parent_id, "modif": n.get("modif", modif)}) for n in nodes]
    have = {r["id"]: r for r in tree.where(F.col("id").isin([parent_id, *[n["id"] for n in made]])).select("id", "isDir", *([writes.GONE] if writes.GONE in tree.columns else [])).collect()}
    if parent_id != ROOT and not (parent_id in have and have[parent_id]["isDir"] and not (writes.GONE in tree.columns and have[parent_id][writes.GONE])):
        raise QueryError(f"no directory {parent_id}")
    state = _siblings(tree, parent_id) if _at_an_end(place) and not any(n["index"] for n in made) else None
    keys = keys_for(tree, parent_id, len(made), place, state)
    for node, key in zip(made, keys, strict=True):
        node["index"] = node["index"] or key
    out = writes.insert_many(tree, writes.rows_of(tree.sparkSession, made, tree.schema))
    if state is None or _uneven(state, keys):
        out = rebalanced(out, parent_id)
    new = {n["id"]: n for n in reversed(made) if n["id"] not in have}  # of several with one id the first comes
    changes = [(parent_id, (1, 0 if n["isDir"] else 1, int(n["size"]))) for n in new.values()]
    ways = chains(live(tree), [parent_id])
    return Changed(_climbed(settled(out), changes, ways, modif, [parent_id]), [n["id"] for n in made])


def update_nodes(tree: DataFrame, filter_: dict[str, Any], update: dict[str, Any], modif: int, deep: bool = False) -> Changed:
    """Contents only: the place in the tree and managed columns cannot be set, an id even less. ``deep`` takes the
    nodes below along. The nodes that are hit stay a frame, whatever their number."""
    values = {k: v for k, v in (update.get("$set") or {}).items() if k not in ("parentId", *MANAGED)}
    if "id" in values:
        raise QueryError("a node keeps its id")
    if "name" in values:
        check_name(values["name"])
    if "size" in values:
        check_size(values["size"])
    if "isDir" in values and not isinstance(values["isDir"], bool):
        raise QueryError("isDir is true or false")
    tree = _managed(tree)
    nodes = live(tree)
    hit = nodes.filter(filters.compile_filter(filter_, nodes.schema)).select("id")
    if deep:
        hit = descendants(nodes, hit, include_self=True).select("id")
    hit = settled(hit)
    marked = tree.join(hit.withColumn("__hit_node", F.lit(True)), "id", "left")
    changed = writes.update_many(marked, {"__hit_node": True}, {**update, "$set": {"modif": modif, **values}})
    out = settled(changed.drop("__hit_node"))
    size = lambda df: df.join(hit, "id", "left_semi").select(F.col("parentId").alias("id"), *contribution())
    minus = size(tree).select("id", *[(-F.col(c)).alias(c) for c in ("dt", "df", "ds")])
    deltas = settled(size(out).unionByName(minus))
    return Changed(shifted(out, deltas, modif, deltas if "index" in values else []), [])


def delete_nodes(tree: DataFrame, ids: list[str] | DataFrame, modif: int, real: bool = True, clock: Any = None) -> Changed:
    """Subtrees, taken out or marked as deleted."""
    tree = _managed(tree)
    gone = descendants(tree, ids, include_self=True)
    if not real and writes.GONE in tree.columns:
        gone = live(gone)
    gone = settled(gone)
    n = gone.count()
    if not n:
        return Changed(tree)
    if real:
        out = tree.join(gone.select("id"), "id", "left_anti")
    else:
        marked = tree.join(gone.select("id", F.lit(True).alias("__gone")), "id", "left")
        out = writes.update_many(marked, {"__gone": True}, {"$set": {writes.GONE: True, writes.DELETED: clock, "modif": modif}}).drop("__gone")
    tops = live(gone).join(live(gone).select(F.col("id").alias("parentId")), "parentId", "left_anti")
    deltas = settled(tops.select(F.col("parentId").alias("id"), *contribution()).select("id", *[(-F.col(c)).alias(c) for c in ("dt", "df", "ds")]))
    return Changed(shifted(settled(out), deltas, modif, deltas), deleted=n)


def undelete_nodes(tree: DataFrame, ids: list[str], modif: int) -> Changed:
    """Subtrees that were marked as deleted, and the directories above them, are live again."""
    below = descendants(tree, ids, include_self=True).select("id")
    above = sorted({a for way in chains(tree, ids).values() for a in way})
    back = settled(below.unionByName(_one("id", above, tree.sparkSession)).distinct())
    marked = tree.join(back.withColumn("__back", F.lit(True)), "id", "left")
    columns = [c for c in (writes.GONE, writes.DELETED) if c in tree.columns]
    out = writes.update_many(marked, {"__back": True}, {"$unset": {c: 1 for c in columns}}).drop("__back")
    return Changed(stamped_up(settled(refreshed(settled(out))), ids, modif), ids)


def conflicts(tree: DataFrame, nodes: DataFrame, parent_id: str, unique_by: str) -> DataFrame:
    """(source, target) of nodes that would come to lie beside a live sibling with the same value."""
    if unique_by == "id":
        return nodes.select(F.col("id").alias("source"), F.col("id").alias("target")).limit(0)
    here = live(tree).where(F.col("parentId") == parent_id).join(nodes.select("id"), "id", "left_anti")
    value = lambda df: filters.resolve(unique_by, filters.fields_of(df.schema)).column
    a = nodes.select(F.col("id").alias("source"), value(nodes).alias("__v")).where("__v IS NOT NULL")
    b = here.select(F.col("id").alias("target"), value(here).alias("__v"))
    return a.join(b, "__v").select("source", "target")


def first_conflicts(tree: DataFrame, nodes: DataFrame, parent: str | Column, rule: Conflicts) -> DataFrame:
    """(source, parent, target, isDir, modif): for each node the first live sibling in its future directory that has
    the same value. ``nodes`` has the columns of the value's path, ``id``, and ``parent`` names the directory."""
    value = lambda df: filters.resolve(rule.unique_by, filters.fields_of(df.schema)).column
    here = live(tree).join(nodes.select("id"), "id", "left_anti")
    a = nodes.select(F.col("id").alias("source"), (F.lit(parent) if isinstance(parent, str) else parent).alias("parent"), value(nodes).alias("__v")).where("__v IS NOT NULL")
    b = here.select(F.col("parentId").alias("parent"), value(here).alias("__v"), F.struct(F.col("id").alias("target"), "isDir", "modif").alias("t"))
    return a.join(b, ["parent", "__v"]).groupBy("source", "parent").agg(F.min("t").alias("t")).select("source", "parent", "t.*")


def _gives_way(rule: Conflicts, node: Any, other: Any) -> str:
    """``stay`` (the node does not come), ``merge`` (two directories), or ``replace`` (the other one goes)."""
    if rule.mode == "skip":
        return "stay"
    if rule.mode in ("merge", "mergeByModif"):
        if node["isDir"] and other["isDir"]:
            return "merge"
        if rule.mode == "mergeByModif" and (other["modif"] or 0) > (node["modif"] or 0):
            return "stay"
    return "stay" if not rule.file_over_dir and not node["isDir"] and other["isDir"] else "replace"


def move_nodes(tree: DataFrame, ids: list[str], parent_id: str, modif: int, rule: Conflicts | None = None, place: Place | None = None, expect: dict[str, str] | None = None, real_delete: bool = True, clock: Any = None) -> Changed:
    """Nodes, with all below them, to another directory. Named nodes that lie below other named ones go along.

    ``expect`` gives the directory that a caller last saw each node in; a difference is an error.
    """
    rule = rule or Conflicts()
    tree = _managed(tree)
    nodes, named = live(tree), set(ids)
    ways = chains(nodes, [*ids, parent_id])
    tops = [i for i in dict.fromkeys(ids) if i and not named & set(ways.get(i, ()))]
    rows = {r["id"]: r for r in nodes.where(F.col("id").isin([*tops, parent_id])).select(*WEIGHED).collect()}
    if parent_id != ROOT and not (parent_id in rows and rows[parent_id]["isDir"]):
        raise QueryError(f"no directory {parent_id}")
    moving = [i for i in tops if i in rows]
    for i, parent in (expect or {}).items():
        if i in rows and rows[i]["parentId"] != parent:
            raise QueryError(f"{i} has been moved meanwhile")
    if not moving:
        return Changed(tree)
    if {parent_id, *ways.get(parent_id, ())} & set(moving):
        raise QueryError("a node cannot go into itself")
    names: dict[str, str] = {}
    merges: list[tuple[str, str]] = []
    if rule.mode == "newName" and rule.unique_by == "name":
        names = dict(zip(moving, free_names(tree, parent_id, [rows[i]["name"] for i in moving], moving), strict=True))
    elif rule.unique_by != "id":
        met = {r["source"]: r for r in first_conflicts(tree, nodes.where(F.col("id").isin(moving)), parent_id, rule).collect()}
        choice = {i: _gives_way(rule, rows[i], met[i]) for i in moving if i in met}
        merges = [(i, met[i]["target"]) for i, c in choice.items() if c == "merge"]
        gone = [met[i]["target"] for i, c in choice.items() if c == "replace"]
        moving = [i for i in moving if choice.get(i, "replace") == "replace"]
        if gone:
            tree = settled(delete_nodes(tree, gone, modif, real_delete, clock).tree)
    if merges:
        tree = settled(merged_directories(tree, tree.sparkSession.createDataFrame(merges, "source string, target string"), modif, rule, real_delete, clock))
    if not moving:
        return Changed(tree, [])
    state = _siblings(tree, parent_id) if _at_an_end(place) else None
    keys = keys_for(tree, parent_id, len(moving), place, state)
    moves = tree.sparkSession.createDataFrame([(i, parent_id, k, names.get(i, rows[i]["name"])) for i, k in zip(moving, keys, strict=True)], "id string, __p string, __k string, __n string")
    out = tree.join(moves, "id", "left")
    there = F.col("__p").isNotNull()
    for column, new in (("parentId", "__p"), ("index", "__k"), ("name", "__n")):
        out = out.withColumn(column, F.when(there, F.col(new)).otherwise(F.col(column)))
    out = out.withColumn("modif", F.when(there, F.lit(modif)).otherwise(F.col("modif"))).select(*tree.columns)
    if state is None or _uneven(state, keys):
        out = rebalanced(out, parent_id)
    above = {**ways, **{rows[i]["parentId"]: ways[i][1:] for i in moving}}
    changes = [(parent_id, _weight(rows[i])) for i in moving] + [(rows[i]["parentId"], tuple(-x for x in _weight(rows[i]))) for i in moving]
    parents = sorted({rows[i]["parentId"] for i in moving} | {parent_id})
    return Changed(_climbed(settled(out), changes, above, modif, parents), moving)


def merged_directories(tree: DataFrame, pairs: DataFrame, modif: int, rule: Conflicts, real_delete: bool = True, clock: Any = None) -> DataFrame:
    """The tree with each source directory's children moved into its target (source, target), and the source deleted
    with what stayed in it. Pairs of directories that meet on the way merge too, level by level: one join each."""
    value = lambda df: filters.resolve(rule.unique_by, filters.fields_of(df.schema)).column
    pairs = settled(pairs)
    sources, moves, gone = pairs.select(F.col("source").alias("id")), None, None
    while True:
        nodes = live(tree)
        kids = nodes.join(pairs.select(F.col("source").alias("parentId"), "target"), "parentId")
        kids = kids.select("id", "target", value(kids).alias("__v"), "isDir", "modif")
        there = nodes.join(pairs.select(F.col("target").alias("parentId")).distinct(), "parentId", "left_semi")
        there = there.select(F.col("parentId").alias("target"), value(there).alias("__v"), F.struct(F.col("id").alias("o"), F.col("isDir").alias("odir"), F.col("modif").alias("omodif")).alias("t"))
        met = kids.join(there.where("__v IS NOT NULL").groupBy("target", "__v").agg(F.min("t").alias("t")), ["target", "__v"], "left")
        both = F.col("isDir") & F.col("t.odir")
        newer = F.lit(rule.mode == "mergeByModif") & (F.coalesce("t.omodif", F.lit(0)) > F.coalesce("modif", F.lit(0)))
        kept = F.lit(not rule.file_over_dir) & ~F.col("isDir") & F.col("t.odir")
        what = F.when(F.col("t").isNull(), "move").when(both, "merge").when(newer | kept, "stay").otherwise("replace")
        level = settled(met.select("id", "target", F.col("t.o").alias("o"), what.alias("what")))
        come = level.where("what IN ('move', 'replace')").select("id", F.col("target").alias("__p"))
        moves = come if moves is None else moves.unionByName(come)
        away = level.where("what = 'replace'").select(F.col("o").alias("id"))
        gone = away if gone is None else gone.unionByName(away)
        pairs = level.where("what = 'merge'").select(F.col("id").alias("source"), F.col("o").alias("target"))
        if pairs.isEmpty():
            break
        sources = sources.unionByName(pairs.select(F.col("source").alias("id")))
    # new keys follow the target's last one
    last = live(tree).groupBy(F.col("parentId").alias("__p")).agg(F.max(F.when(F.col("index") != "", F.col("index"))).alias("__last"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("id"))
    key = F.when(F.col("__last").isNotNull(), F.concat("__last", _digits(rank.cast("long"), 5))).otherwise(F.lit(""))
    keyed = moves.join(last, "__p", "left").select("id", "__p", key.alias("__k"))
    out = tree.join(keyed, "id", "left")
    there = F.col("__p").isNotNull()
    out = out.withColumns({"parentId": F.coalesce("__p", "parentId"), "index": F.coalesce("__k", "index"), "modif": F.when(there, F.lit(modif)).otherwise(F.col("modif"))}).select(*tree.columns)
    out = delete_nodes(settled(out), settled(gone.unionByName(sources)), modif, real_delete, clock).tree
    return refreshed(settled(out))


def set_nodes(tree: DataFrame, nodes: list[dict[str, Any]], modif: int, rule: Conflicts | None = None, update_only: bool = False, real_delete: bool = True, clock: Any = None, place: Place | None = None, set_mode: str = "default") -> Changed:
    """Make the tree hold these nodes: conflicts give way, new ones are made, known ones are moved and updated,
    deleted ones come back. An id may not come twice. ``place`` is where the nodes of each directory go, by
    default after its last key; ``set_mode`` is that of :func:`writes.set_many`: ``default``, ``merge`` or
    ``overwrite``. The whole request is one plan: one join finds conflicts, one writes all nodes."""
    rule, spark = rule or Conflicts(), tree.sparkSession
    if set_mode not in ("default", "merge", "overwrite"):
        raise QueryError(f"{set_mode} is no way to set a node")
    ids = [n["id"] for n in nodes if n.get("id")]
    if len(ids) != len(set(ids)):
        raise QueryError("an id comes twice")
    if not nodes:
        return Changed(tree)
    tree = _managed(tree)
    known = {r["id"]: r.asDict(recursive=True) for r in tree.where(F.col("id").isin(ids)).collect()} if ids else {}
    full = []
    for n in nodes:
        old = known.get(n.get("id"), {})
        base = {"parentId": ROOT, "modif": modif, **{k: old[k] for k in ("parentId", "name", "isDir", "size", "index") if old.get(k) is not None}}
        full.append({**check_node({"id": writes.new_id(), **base, "modif": modif, **n}), "__given": n})
    if update_only:
        full = [n for n in full if n["id"] in known and not known[n["id"]].get(writes.GONE)]
    if not full:
        return Changed(tree)
    chosen = {n["id"] for n in full}
    gone: list[str] = []
    merged: dict[str, str] = {}
    if rule.mode == "newName" and rule.unique_by == "name":
        for parent in dict.fromkeys(n["parentId"] for n in full):
            group = [n for n in full if n["parentId"] == parent]
            for n, name in zip(group, free_names(tree, parent, [n["name"] for n in group], sorted(chosen)), strict=True):
                n["name"] = name
    elif rule.unique_by != "id":
        probe = writes.rows_of(spark, [{k: v for k, v in n.items() if k != "__given"} for n in full], tree.schema)
        met = {r["source"]: r for r in first_conflicts(tree, probe, F.col("parentId"), rule).collect()}
        choice = {n["id"]: _gives_way(rule, n, met[n["id"]]) for n in full if n["id"] in met}
        gone = [met[i]["target"] for i, c in choice.items() if c == "replace"]
        merged = {i: met[i]["target"] for i, c in choice.items() if c == "merge"}
        full = [n for n in full if choice.get(n["id"], "replace") == "replace"]
    for n in full:  # the children of a merged directory go into the one that was there
        n["parentId"] = merged.get(n["parentId"], n["parentId"])
    _check_parents(tree, full)
    if gone:
        tree = settled(delete_nodes(tree, gone, modif, real_delete, clock).tree)
    if old := [(i, t) for i, t in merged.items() if i in known]:
        tree = settled(merged_directories(tree, spark.createDataFrame(old, "source string, target string"), modif, rule, real_delete, clock))
    back = [n["id"] for n in full if (known.get(n["id"]) or {}).get(writes.GONE)]
    if back:
        tree = settled(undelete_nodes(tree, back, modif).tree)
    parents = sorted({n["parentId"] for n in full} | {known[n["id"]]["parentId"] for n in full if n["id"] in known})
    comers = [n for n in full if not n["__given"].get("index") and (n["id"] not in known or known[n["id"]]["parentId"] != n["parentId"] or place)]
    for parent in dict.fromkeys(n["parentId"] for n in comers):
        group = [n for n in comers if n["parentId"] == parent]
        for n, key in zip(group, keys_for(tree, parent, len(group), place or (Place(to_end=True) if any(n["id"] in known for n in group) else None)), strict=True):
            n["index"] = key
    docs = []
    for n in full:
        given = {k: v for k, v in n["__given"].items() if k not in MANAGED}
        values = {k: n[k] for k in ("id", "parentId", "name", "isDir", "index", "size", "modif")} if n["id"] not in known or set_mode == "overwrite" else {"id": n["id"], "parentId": n["parentId"], "index": n["index"], "modif": n["modif"], "name": n["name"]}
        docs.append({**given, **values})
    rows = writes.rows_of(spark, docs, tree.schema) if docs else None
    if rows is not None:
        kept = [c for c in rows.columns if c not in MANAGED and c not in (writes.GONE, writes.DELETED)]
        tree = writes.set_many(tree, rows.select(*kept), merge=set_mode == "merge", overwrite=set_mode == "overwrite")
        for parent in dict.fromkeys(n["parentId"] for n in comers):
            tree = rebalanced(tree, parent)
        tree = settled(tree)
    out = settled(refreshed(tree))
    chains(out, [n["id"] for n in full if n["id"] in known])  # a node that went below itself is an error
    return Changed(stamped_up(out, parents, modif), [*gone, *[n["id"] for n in full]])


def _check_parents(tree: DataFrame, nodes: list[dict[str, Any]]) -> None:
    """Every node's directory is there, or comes with it and hangs together with one that is."""
    new = {n["id"]: n for n in nodes}
    asked = {n["parentId"] for n in nodes} - {ROOT}
    have = {ROOT} | {r[0] for r in live(tree).where(F.col("id").isin(sorted(asked)) & F.col("isDir")).select("id").collect()} if asked else {ROOT}
    for n in nodes:
        met, at = set(), n["parentId"]
        while at not in have:
            if at in met or at not in new or not new[at]["isDir"]:
                raise QueryError(f"no directory {at}")
            met.add(at)
            at = new[at]["parentId"]


def free_names(tree: DataFrame, parent_id: str, wanted: list[str], without: list[str]) -> list[str]:
    """The names, numbered up where a live sibling (``without`` aside) or an earlier one of them has them.

    Siblings are asked in two ways only: which of the names are taken, and for each stem how many of its
    numbers are, by the count of free ones before them; so no more rows come back than names are wanted.
    """
    here = live(tree).where((F.col("parentId") == parent_id) & ~F.col("id").isin(without or [""])).select("name")
    taken = {r[0] for r in here.where(F.col("name").isin(list(dict.fromkeys(wanted)))).distinct().collect()}
    asked: dict[tuple[str, str, int], None] = {}
    for name in wanted:
        asked.setdefault(file_names.split(file_names.numbered(name)))
    if not taken and len(set(wanted)) == len(wanted):
        return list(wanted)
    m = len(wanted)
    probes = tree.sparkSession.createDataFrame(list(asked), "stem string, ext string, first long")
    numbers = here.distinct().select(F.regexp_extract("name", file_names.NUMBERED, 1).alias("stem"), F.regexp_extract("name", file_names.NUMBERED, 2).try_cast("long").alias("n"), F.regexp_extract("name", file_names.NUMBERED, 3).alias("ext")).where("n IS NOT NULL")
    met = numbers.join(F.broadcast(probes), ["stem", "ext"]).where("n >= first")
    before = F.row_number().over(Window.partitionBy("stem", "ext", "first").orderBy("n")) - 1
    free = met.withColumn("free", F.col("n") - F.col("first") - before).where(F.col("free") < m)
    gaps: dict[tuple[str, str, int], dict[int, int]] = {}
    for r in free.groupBy("stem", "ext", "first", "free").agg(F.count("*").alias("c")).collect():
        gaps.setdefault((r["stem"], r["ext"], r["first"]), {})[r["free"]] = r["c"]
    used, out = set(taken), []
    for name in wanted:
        if name in used:
            stem, ext, first = file_names.split(file_names.numbered(name))
            at, shift = 0, 0
            while True:
                shift += gaps.get((stem, ext, first), {}).get(at, 0)
                name = file_names.joined(stem, ext, first + at + shift)
                if name not in used:
                    break
                at += 1
        used.add(name)
        out.append(name)
    return out


#: Characters of the longest order key that is left as it is.
LONGEST_KEY = 32


def _uneven(state: Any, new: list[str], longest: int = LONGEST_KEY) -> bool:
    """Whether the keys of some siblings, with new ones that repeat none, repeat or have grown too long."""
    return bool(state["n"]) and (state["n"] != state["d"] or state["l"] > longest) or max(map(len, new), default=0) > longest


def rebalanced(tree: DataFrame, parent_id: str, longest: int = LONGEST_KEY) -> DataFrame:
    """The tree with new order keys for a directory's children where keys repeat or have grown too long.

    Keys follow the order of (key, time, id); children without keys keep theirs empty."""
    here = live(tree).where((F.col("parentId") == parent_id) & (F.col("index") != ""))
    state = _siblings(tree, parent_id)
    if not _uneven(state, [], longest):
        return tree
    width = max(2, math.ceil(math.log(state["n"] + 1, 62)) + 1)
    rank = F.row_number().over(Window.partitionBy("parentId").orderBy("index", "modif", "id"))
    new = here.select("id", _digits(rank.cast("long"), width).alias("__key"))
    return tree.join(new, "id", "left").withColumn("index", F.coalesce("__key", "index")).select(*tree.columns)


def _digits(number: Column, width: int) -> Column:
    """Fixed-width base 62 with a last digit that is not the smallest."""
    parts = [F.substring(F.lit(order_keys.DIGITS), (F.floor(number / F.lit(62**k)) % 62).cast("int") + 1, F.lit(1)) for k in range(width - 1, -1, -1)]
    return F.concat(*parts, F.lit(order_keys.DIGITS[31]))


def repaired_names(tree: DataFrame, parent_id: str) -> DataFrame:
    """The tree with numbered names where a directory's live children share one; the oldest keeps its name, the others
    get the least numbers that are free, by their age. All of it is two windows over the names' stems."""
    here = live(tree).where(F.col("parentId") == parent_id).select("id", "name", "modif")
    part = lambda k: F.regexp_extract("name", file_names.NUMBERED, k)
    plain = part(2) == ""
    stem = F.when(~plain, part(1)).otherwise(F.regexp_replace("name", file_names.EXTENSION, ""))
    ext = F.when(~plain, part(3)).otherwise(F.regexp_extract("name", file_names.EXTENSION, 1))
    rows = here.withColumn("__r", F.row_number().over(Window.partitionBy("name").orderBy("modif", "id"))).select("id", "name", "modif", "__r", stem.alias("stem"), ext.alias("ext"), part(2).try_cast("long").alias("n"))
    # numbers that are taken, by how many free ones lie below them; and names that are wanted, by their turn
    group = Window.partitionBy("stem", "ext")
    taken = rows.where("__r = 1 AND n >= 1").withColumn("at", F.col("n") - F.row_number().over(group.orderBy("n"))).select("stem", "ext", "at", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("id"))
    twice = rows.where("__r > 1").withColumn("at", F.row_number().over(group.orderBy("modif", "id")) - 1).select("stem", "ext", "at", F.lit(1).alias("turn"), "id")
    below = F.sum(1 - F.col("turn")).over(group.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    new = taken.unionByName(twice).withColumn("number", F.col("at") + 1 + below).where("id IS NOT NULL")
    new = new.select("id", F.concat("stem", F.lit(" ("), F.col("number").cast("string"), F.lit(")"), "ext").alias("__name"))
    return tree.join(new, "id", "left").withColumn("name", F.coalesce("__name", "name")).select(*tree.columns)


def copy_nodes(tree: DataFrame, ids: list[str], parent_id: str, modif: int, place: Place | None = None) -> Changed:
    """Deep copies under new ids; names are numbered where they are taken."""
    _parent_exists(tree, parent_id)
    tree = _managed(tree)
    nodes = live(tree)
    tops = {r["id"]: r for r in top_selected(nodes, ids).select(*WEIGHED).collect()}
    chosen = [i for i in dict.fromkeys(ids) if i in tops]
    if not chosen:
        return Changed(tree)
    names = free_names(tree, parent_id, [tops[i]["name"] for i in chosen], [])
    keys = keys_for(tree, parent_id, len(chosen), place)
    # a copy's id follows from the old one and the call: rows that are worked out again get the same id
    salt = writes.new_id()
    fresh = lambda c: F.md5(F.concat_ws("/", F.lit(salt), c))
    heads = tree.sparkSession.createDataFrame(list(zip(chosen, names, keys, strict=True)), "id string, __n string, __k string")
    copied = settled(descendants(nodes, chosen, include_self=True)).join(heads, "id", "left")
    copied = copied.withColumns(
        {
            "parentId": F.when(F.col("__n").isNotNull(), F.lit(parent_id)).otherwise(fresh(F.col("parentId"))),
            "name": F.coalesce("__n", "name"),
            "index": F.coalesce("__k", "index"),
            "modif": F.lit(modif),
            "id": fresh(F.col("id")),
        }
    ).select(*tree.columns)
    out = tree.unionByName(writes.numbered_after(tree, copied).select(*tree.columns))
    changes = [(parent_id, _weight(tops[i])) for i in chosen]
    return Changed(_climbed(settled(rebalanced(out, parent_id)), changes, chains(nodes, [parent_id]), modif, [parent_id]), chosen)


def list_by_cursor(tree: DataFrame, parent_id: str, **options: Any) -> find.Page:
    return find.list_paging_by_cursor(live(tree), {"parentId": parent_id}, **options)


def presync(tree: DataFrame, seen: DataFrame) -> DataFrame:
    """For each (id, modif, cmodif) that a client has: ``deleted``, ``stale`` where the tree's is newer, or ``same``."""
    have = live(tree).select("id", F.col("modif").alias("__m"), F.col("cmodif").alias("__c"), F.lit(True).alias("__there"))
    newer = (F.coalesce("__m", F.lit(0)) > F.coalesce("modif", F.lit(0))) | (F.coalesce("__c", F.lit(0)) > F.coalesce("cmodif", F.lit(0)))
    state = F.when(F.col("__there").isNull(), "deleted").when(newer, "stale").otherwise("same")
    return seen.join(have, "id", "left").select("id", state.alias("state"))


def would_overwrite(tree: DataFrame, nodes: DataFrame, parent_id: str, unique_by: str = "name") -> DataFrame:
    """A dry run: the live siblings that the nodes would run into."""
    return live(tree).join(conflicts(tree, nodes, parent_id, unique_by).select(F.col("target").alias("id")).distinct(), "id", "left_semi")


def dead_nodes(tree: DataFrame) -> DataFrame:
    """Nodes that do not hang together with ``/``, cycles among them."""
    tops = tree.where(F.col("parentId") == ROOT).select("id")
    return tree.join(descendants(tree, tops, include_self=True).select("id"), "id", "left_anti")


def without_dead(tree: DataFrame) -> DataFrame:
    return refreshed(tree.join(dead_nodes(tree).select("id"), "id", "left_anti"))
