"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame operations only.

Every input partition is a run: its entries, one for each digest with the best identifier and the number
of rows, sorted by digest and held as arrays, one for each range of digests (a block). Runs merge in
binomial rounds. In a round the runs whose numbers agree but for the lowest ``bits`` bits exchange their
entries: each cuts every block into ``2 ** bits`` narrower ones, and of the pieces of one narrow block, at
most ``2 ** bits`` sorted arrays, a multiway merge makes one: a sort that finds them in order and only
merges, after which neighbours with one digest become one entry with the smallest identifier and the sum
of the counts. So entries are never dealt out or sorted one by one again, arrays keep their size, and a
round's tasks are as many as the one's before. After the last round one entry per digest is left, and
the answer walks the same tree downwards: an entry of round r is joined to its at most ``2 ** bits``
children. So no task ever meets more than ``2 ** bits`` entries of one digest, however many copies a text
has; and only digests travel, never texts.

Two texts count as equal where SHA-256, a second independent 64-bit hash and the length of the
normalised texts all agree, at every level of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, free_name

#: The characters that a comparison ignores: space and \\x09 to \\x0D.
BLANKS = " \t\n\x0b\f\r"
KEY = ["sha", "check"]
#: Bits of a digest that blocks may be told apart by, and the entries of a block that a run begins with.
HEAD_BITS, BLOCK_ROWS = 56, 1024


def normalised(text: F.Column) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: digest, second hash, length, run and place in the run."""
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_points"),
    )
    return norm.select(
        "doc_id",
        "n_points",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        (F.xxhash64("norm").bitwiseXOR(F.octet_length("norm").cast("long"))).alias("check"),
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("place"),
    )


def _best() -> F.Column:
    # the most code points, then the smallest id, then the first of repeated rows
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")


def _block(head: F.Column, depth: int) -> F.Column:
    """The block of a digest where blocks are ranges told apart by its first ``depth`` bits."""
    return F.shiftright(head, HEAD_BITS - depth)


def first_runs(rows: DataFrame, depth: int) -> DataFrame:
    """(run, block, entries): each run's entries, sorted by digest."""
    entries = rows.groupBy("run", *KEY).agg(F.min(_best()).alias("best"), F.count("*").alias("n"))
    head = F.conv(F.hex(F.substring("sha", 1, HEAD_BITS // 8)), 16, 10).cast("long")
    entry = F.struct(head.alias("head"), *KEY, "best", "n").alias("entry")
    held = entries.select("run", entry).withColumn("block", _block(F.col("entry.head"), depth))
    return held.groupBy("run", "block").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def merge_round(below: DataFrame, bits: int, depth: int) -> DataFrame:
    """(run, block, entries) after the runs that differ in their lowest ``bits`` bits have merged, with blocks told
    apart by ``depth`` bits instead of ``depth - bits``."""
    parts = 1 << bits
    cut = lambda k: F.struct((F.col("block") * parts + k).alias("block"), F.filter("entries", lambda e: _block(e["head"], depth) == F.col("block") * parts + k).alias("piece"))
    pieces = below.select(F.shiftright("run", bits).alias("run"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), cut)).alias("p"))
    met = pieces.select("run", "p.block", "p.piece").where("size(piece) > 0").groupBy("run", "block").agg(F.sort_array(F.flatten(F.collect_list("piece"))).alias("all"))
    every = F.col("all")
    changes = lambda i: (F.get(every, i)["sha"] != F.get(every, i - 1)["sha"]) | (F.get(every, i)["check"] != F.get(every, i - 1)["check"])
    first = met.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (i == 0) | changes(i)))

    def entry(i: F.Column, k: F.Column) -> F.Column:
        e, after = F.get(every, i), F.coalesce(F.get("at", k + 1), F.size("all"))
        n = F.aggregate(F.slice("all", i + 1, after - i), F.lit(0).cast("long"), lambda total, x: total + x["n"])
        return F.struct(e["head"].alias("head"), *[e[c].alias(c) for c in KEY], e["best"].alias("best"), n.alias("n"))

    return first.select("run", "block", F.transform("at", entry).alias("entries"))


def tree_merge(rows: DataFrame, bits: int = 4, block_rows: int = BLOCK_ROWS) -> tuple[list[Written], DataFrame]:
    """``rows`` from :func:`digests`, already written. Returns the tables (run, block, entries) of all levels and,
    for the leaves (run, digest), the best entry of the whole input and the size of the group."""
    n, top = rows.agg(F.count("*"), F.coalesce(F.max("run"), F.lit(0))).first()
    depth = max(0, (n // (top + 1) // block_rows).bit_length())
    levels = [Written(first_runs(rows, depth), "dedup-level0", narrow=True)]
    while top:
        depth += bits
        levels.append(Written(merge_round(levels[-1].df, bits, depth), f"dedup-level{len(levels)}", narrow=True))
        top >>= bits
    answer = flat(levels[-1].df)
    for level in reversed(levels[:-1]):
        child = flat(level.df).select(F.col("run").alias("child"), F.shiftright("run", bits).alias("run"), *KEY)
        answer = child.join(answer, ["run", *KEY]).drop("run").withColumnRenamed("child", "run")
    return levels, answer


def flat(runs: DataFrame) -> DataFrame:
    """(run, sha, check, best, n): a row for each entry."""
    return runs.select("run", F.explode("entries").alias("e")).select("run", *[f"e.{c}" for c in KEY], "e.best", "e.n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the
    most code points in the original text stays, then the smallest id; ids that are null come last.
    Rows that repeat with the same id and text are told apart by their place in the input: exactly one
    has ``kept``. A null text counts as empty, texts of any length are read whole, an empty table gives an
    empty result, other columns of the input are ignored whatever their names.
    """
    rows = Written(digests(docs, id_col, text_col), "dedup-rows")
    _, answer = tree_merge(rows.df, bits)
    joined = rows.df.join(answer, ["run", *KEY])
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "place",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """The input without the rows that exact dedup drops, all columns as they were.

    Rows are dropped by id. Only where an id repeats, with some of its rows kept and some not, the
    digests decide as well, and of rows alike in id and digest the one with the most code points stays.
    """
    decided = Written(exact_dedup(docs, id_col, text_col, bits), "dedup-decided", narrow=True).df
    per_id = decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    gone = per_id.where("n_kept < n").select("doc_id")
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]), "left_anti")
    unclear = per_id.where("n_kept > 0 AND n_kept < n").select("doc_id")
    if unclear.isEmpty():
        return out
    sha = free_name(docs, "sha")
    some = docs.join(unclear, docs[id_col].eqNullSafe(unclear["doc_id"]), "left_semi").withColumn(sha, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    kept = decided.where("kept").select("doc_id", "text_sha256")
    some = some.join(kept, some[id_col].eqNullSafe(kept["doc_id"]) & (some[sha] == kept["text_sha256"]), "left_semi")
    row = free_name(docs, "row")
    best = F.max_by(F.struct(*docs.columns), F.coalesce(F.length(text_col), F.lit(0)))
    return out.unionByName(some.groupBy(id_col, sha).agg(best.alias(row)).select(f"{row}.*"))
