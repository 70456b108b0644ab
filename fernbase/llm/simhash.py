"""SimHash fingerprints, and near-duplicate groups by bit-sliced comparison.

Fingerprints are made where the text is. Only distinct fingerprints are compared. Two of them within the
radius r agree on at least ``blocks - r`` of their blocks of bits, so each is dealt out under every choice
of that many blocks; with 8 blocks and r = 2 a bucket shares 48 bits, and holds at most 2**16 distinct
fingerprints whatever the data. In a bucket the bit planes are stored vertically, 64 fingerprints to a
word; distances of many pairs are counted at once by bit-sliced counters: carry-save adders take two planes'
differences and a counter's bit to a sum and a carry for the next bit, and a block is abandoned once all of
its distances exceed the radius. A bucket gives a spanning star of each of
its linked sets, never all pairs. The stars are joined to components by alternating large-star and
small-star steps, written out after each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, begin, sub_batches, text_bytes
from .components import components

SEED = 42
#: Fingerprints of a bucket that are compared at once.
TILE = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every shingle: ``size`` words after lower-casing A-Z, joined by a space; all words if fewer; none if none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    ends.append(len(joined))
    starts = [0, *(e + 1 for e in ends[:-1])]
    view = memoryview(joined)
    return [xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority_bits(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of up to 255 rows fit a byte: add those first
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[full:].sum(0, dtype=np.int64)
    over = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits of each whole text as a long. A null text has no words."""
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            fp = np.array([majority_bits(shingle_hashes(t, size)) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray, planes: list[int]) -> np.ndarray:
    """One row a plane: bit k of word w is that plane's bit of fingerprint 64 w + k."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    rows = [np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for p in planes]
    return np.array(rows, np.uint64).reshape(len(planes), -1)


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bits of each lane as two: their sum modulo two, and the carry."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


class Counters:
    """Numbers in bit slices: word k holds bit k of 64 lanes' counts. Counts that no longer fit, all of them beyond
    ``most``, are only marked as such."""

    def __init__(self, cells: int, most: int):
        self.most = most
        self.bits = [np.zeros(cells, np.uint64) for _ in range(most.bit_length())]
        self.over = np.zeros(cells, np.uint64)

    def add(self, ones: list[np.ndarray]) -> None:
        """Add some one-bit numbers to each lane: pairs of them by an adder, a last one by itself."""
        for k in range(len(self.bits)):
            carries = []
            while len(ones) > 1:
                self.bits[k], carry = carry_save(self.bits[k], ones.pop(), ones.pop())
                carries.append(carry)
            if ones:
                one = ones.pop()
                carries.append(self.bits[k] & one)
                self.bits[k] = self.bits[k] ^ one
            ones = carries
        for carry in ones:
            self.over = self.over | carry

    def beyond(self) -> np.ndarray:
        """The lanes whose counts exceed ``most``."""
        more, equal = self.over, ~self.over
        for k in range(len(self.bits) - 1, -1, -1):
            if self.most >> k & 1:
                equal = equal & self.bits[k]
            else:
                more = more | (equal & self.bits[k])
                equal = equal & ~self.bits[k]
        return more

    def keep(self, cells: np.ndarray) -> None:
        self.bits, self.over = [b[cells] for b in self.bits], self.over[cells]


#: Planes whose differences are counted between two looks at which cells to abandon.
STEP = 4


def near_pairs(query: np.ndarray, stored: np.ndarray, radius: int, where: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all fingerprints query[i] and stored[j] that differ in at most ``radius`` bits.

    A cell is one query against one vertical word of 64 stored fingerprints. Every few planes the cells with
    all 64 beyond the radius are abandoned.
    """
    where = list(range(64)) if where is None else where
    planes = bit_planes(stored, where)
    words = planes.shape[1]
    row, word = np.repeat(np.arange(len(query)), words), np.tile(np.arange(words), len(query))
    counts = Counters(len(row), radius)
    for at in range(0, len(where), STEP):
        sign = [np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)) for p in where[at : at + STEP]]
        counts.add([planes[at + k][word] ^ s[row] for k, s in enumerate(sign)])
        alive = counts.beyond() != ALL
        if not alive.all():
            row, word = row[alive], word[alive]
            counts.keep(alive)
    near = np.unpackbits((~counts.beyond()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, bit = np.nonzero(near)
    i, j = row[cell], word[cell] * 64 + bit
    real = j < len(stored)
    return i[real], j[real]


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k]; ``label`` gives the smallest index of each one's set, before and after."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_block(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For each of some fingerprints the index of the first one it is linked to through others here."""
    label = np.arange(len(fps))
    for a in range(0, len(fps), tile):
        for b in range(a, len(fps), tile):
            i, j = near_pairs(fps[a : a + tile], fps[b : b + tile], radius)
            union(label, i + a, j + b)
    return label


def choices(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that a bucket shares: each choice of blocks - radius of the blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(parts[k] for k in some) for some in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2, blocks: int = 8) -> DataFrame:
    """(u, v), u > v as longs: links among distinct fingerprints (column fp) that connect exactly what
    the radius connects. A bucket's rows are compared in tiles; buckets alone in theirs are skipped."""
    spark = distinct.sparkSession
    begin(spark, 1 << 14)
    masks = [_signed(m) for m in choices(radius, blocks)]
    options = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    dealt = distinct.select("fp", F.explode(options).alias("x")).select("x.choice", "x.key", "fp")
    dealt = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def stars(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = link_block(fps.view(np.uint64), radius)
        at = np.flatnonzero(label != np.arange(len(fps)))
        if len(at):
            u, v = fps[at], fps[label[at]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        ready: list[np.ndarray] = []
        size = 0

        def take(rows: np.ndarray) -> None:
            """Put whole buckets of two or more into the tile that is being filled."""
            nonlocal size
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            alone = first.copy()
            alone[:-1] &= first[1:]
            if not alone.all():
                ready.append(rows[~alone, 2])
                size += len(ready[-1])

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            same = (rows[:, :2] == rows[-1, :2]).all(1)
            cut = len(rows) - int(same[::-1].cumprod().sum())  # the last bucket may go on in the next batch
            held = rows[cut:]
            take(rows[:cut])
            if size >= TILE:
                yield from stars(np.concatenate(ready))
                ready, size = [], 0
        if len(held):
            take(held)
        if size:
            yield from stars(np.concatenate(ready))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, blocks: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits, component_id is the smallest doc_id reachable.
    Texts without words, null texts among them, have fingerprint zero, which links like any other; texts of any
    length are read whole. Null ids are ignored as component ids; repeated rows repeat; an empty table gives
    no rows; columns other than id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    fp = Written(fingerprints(docs, size, id_col, text_col), "simhash-fp")
    first = Written(fp.df.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct", narrow=True)
    edges = Written(links(first.df.select("fp"), radius, blocks), "simhash-links")
    label = components(edges.df)
    rooted = first.df.join(label.df.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = Written(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-components", narrow=True)
    for done in (first, edges, label):
        done.drop()
    begin(spark)
    return fp.df.join(of_fp.df, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with the document of the smallest id of each near-duplicate group; rows as they were.

    Documents without words all share the fingerprint zero, and so one of them stays. Rows with a null id
    stay only in groups of null ids alone; of rows that repeat with one id, all that the id keeps stay.
    """
    found = near_duplicates(docs, size, radius, id_col=id_col, text_col=text_col)
    late = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = Written(found.where(late).select("doc_id").distinct(), "simhash-gone", narrow=True).df
    return docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]), "left_anti")
