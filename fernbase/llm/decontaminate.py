"""Benchmark decontamination by a generalised suffix automaton.

The normalised benchmark items are put into one suffix automaton over their words. Each document's words
are streamed through it: at every word the automaton's state and the length of the longest suffix that
occurs in some item are known. Where that length reaches the window's, the window's words are hit. The
automaton is of the benchmark's size, never of the corpus's. Items are dealt into blocks of at most
``most_words`` words; a longer item is cut into pieces that overlap by a window less a word. Tasks build the
blocks' automatons and write them to the shared folder; then one at a time comes to the driver, is
broadcast for a pass over the documents, and is destroyed. So what is held or sent at once has a fixed
bound however large the benchmark or an item of it. Documents never move.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, begin, free_name, repeatable, sub_batches, text_bytes

#: Words of the items of one automaton.
MOST_WORDS = 100_000
#: Word characters of the normal form: 0-9, a-z after lower-casing A-Z, and all bytes from 0x80.
_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_KEEP).split()


class ItemAutomaton:
    """The suffix automaton of several items; ``window`` words of an item, or all of a shorter one, are a window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: items that hold the window which ends in a state at its length; short: lengths of short items there
        self.full: dict[int, list] = {}
        self.short: dict[int, dict[int, list]] = {}
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        if not coded:
            self.vocabulary = {}
        self.least = min([window, *(len(c) for _, c in coded)])
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        for item, codes in coded:
            self._mark(item, codes)
        #: the nearest state on the way to the root, itself included, at which a short item ends; -1 if none
        self.near = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _mark(self, item: object, codes: list[int]) -> None:
        if len(codes) < self.window:
            state = 0
            for c in codes:
                state = self.next[state][c]
            held = self.short.setdefault(state, {}).setdefault(len(codes), [])
            if item not in held:
                held.append(item)
            return
        state, n = 0, 0
        for c in codes:
            state, n = self.step(state, n, c)
            at = self.at_window(state, n)
            if at >= 0 and (not (held := self.full.setdefault(at, [])) or held[-1] != item):
                held.append(item)

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """Read one word: the state and the longest matching length after it."""
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            n = self.length[state]
        to = nxt[state].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def at_window(self, state: int, n: int) -> int:
        """The state of the last ``window`` words, -1 if fewer match."""
        if n < self.window:
            return -1
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The spans of the words that are hit, and the items whose windows occur."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate(([0], (codes >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least  # a window lies within one run of known words
        spans: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = n = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                state, n = self.step(state, n, c)
                reach = 0
                if n >= self.window:
                    held = self.full.get(self.at_window(state, n))
                    if held:
                        items.update(held)
                        reach = self.window
                s = self.near[state]
                while s != -1:
                    for k, held in self.short[s].items():
                        if k <= n:
                            items.update(held)
                            reach = max(reach, k)
                    s = self.near[self.link[s]] if s else -1
                if reach:
                    if spans and spans[-1][1] >= i - reach:
                        spans[-1] = (min(spans[-1][0], i - reach), i)
                    else:
                        spans.append((i - reach, i))
        return spans, items


def pieces_of(words: list[bytes], window: int, most_words: int) -> list[list[bytes]]:
    """The words of an item in pieces of at most ``most_words`` (a window at least) that together hold its windows."""
    step = max(1, most_words - window + 1)
    return [words[k : k + step + window - 1] for k in range(0, max(1, len(words) - window + 1), step)]


def automatons(benchmark: DataFrame, window: int, item_col: str, text_col: str, most_words: int) -> Written:
    """A written table (automaton): one pickled automaton for each block of items, built where the items lie."""
    spark = benchmark.sparkSession
    begin(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, list[bytes]]] = []
        size = 0

        def build() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ItemAutomaton(held, window))], pa.binary())], ["automaton"])

        for batch in sub_batches(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text")), strict=True):
                for words in pieces_of(words_of(text), window, most_words):
                    if held and size + len(words) > most_words:
                        yield build()
                        held, size = [], 0
                    if words:
                        held.append((item, words))
                        size += len(words)
        if held:
            yield build()

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    items = items.coalesce(1 + size // (8 * most_words))  # so that a small benchmark makes one block, however many files it has
    return Written(items.mapInArrow(run, "automaton binary"), "benchmark-automatons")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


Scan = tuple[list[bytes], list[tuple[int, int]], set]
FOUND = "doc_id long, place long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """From texts to (words, merged spans, items), by a broadcast automaton or, without items, none."""

    def __init__(self, spark: SparkSession, automaton: bytes | None):
        self.sent = spark.sparkContext.broadcast(pickle.loads(automaton)) if automaton else None

    def __call__(self, texts: list[bytes]) -> Iterator[Scan]:
        for text in texts:
            words = words_of(text)
            spans, items = self.sent.value.scan(words) if self.sent else ([], set())
            yield words, merged(spans), items

    def close(self) -> None:
        if self.sent:
            self.sent.destroy()


def _found(ids: pa.Array, places: pa.Array, n_words: list[int], items: list[set], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids,
            places,
            pa.array(n_words, pa.int64()),
            pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            pa.array([sorted(x - {None}) + [None] * (None in x) for x in items], pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
        ],
        ["doc_id", "place", "n_words", "n_hit", "items", "spans"],
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """doc_id, place (of the row in the input), n_words, n_hit, items (array<string>, sorted as strings, null last),
    spans (array of [start, end) in words).

    A window is ``window`` consecutive words of an item, or the whole of an item that is shorter but not
    empty. Null texts have no words; items without words are ignored, items without an id count as one; an
    empty benchmark hits nothing, an empty table gives no rows; repeated rows repeat; texts and items of any
    length are read whole. Columns other than the named ones are not read, whatever their names. With one
    block of items the result is one lazy pass; with more, each block's pass is written before the next.
    """
    spark = docs.sparkSession
    blocks = automatons(benchmark, window, item_col, item_text_col, most_words)
    n = blocks.df.count()
    begin(spark)
    docs = repeatable(docs) if n > 1 else docs
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))

    def one_pass(scan: Scanner, every: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sub_batches(batches, "text"):
                words, spans, items = zip(*scan(text_bytes(batch.column("text"))), strict=True)
                out = _found(batch.column("doc_id"), batch.column("place"), list(map(len, words)), items, spans)
                yield out if every else out.filter(pa.array([bool(s) for s in spans]))

        return rows.mapInArrow(run, FOUND)

    automaton = (r["automaton"] for r in blocks.df.toLocalIterator())
    if n <= 1:
        out = one_pass(Scanner(spark, next(automaton, None)), True)
        blocks.drop()
        return out
    passes = []
    for k, block in enumerate(automaton):
        scan = Scanner(spark, bytes(block))
        passes.append(Written(one_pass(scan, k == 0), "contamination"))  # further passes only add hits
        scan.close()
    blocks.drop()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(n).to_pylist() for n in ("n_words", "items", "spans")}
            spans = [merged([(y["start"], y["end"]) for y in s]) for s in x["spans"]]
            yield _found(batch.column("doc_id"), batch.column("place"), x["n_words"], [set(i) for i in x["items"]], spans)

    every = passes[0].df
    for other in passes[1:]:
        every = every.unionByName(other.df)
    grouped = every.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return grouped.mapInArrow(combine, FOUND)


def is_contaminated(share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per document: counts, the items whose windows occur, and whether it counts as contaminated. Nulls, empty
    tables and the like are as in :func:`find_contamination`."""
    found = find_contamination(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """The input without contaminated documents, whole rows as they were, repeated ones and null ids included. A null
    or empty text is clean, an empty table stays empty, an empty benchmark leaves all. With one block of items
    each row is decided on its own and nothing moves."""
    spark = docs.sparkSession
    blocks = automatons(benchmark, window, item_col, item_text_col, most_words)
    if blocks.df.count() > 1:
        blocks.drop()
        docs = repeatable(docs)
        found = find_contamination(docs, benchmark, window, id_col, text_col, item_col, item_text_col, most_words)
        place = free_name(docs, "place")
        gone = found.where(is_contaminated()).select(F.col("place").alias(place))
        return docs.withColumn(place, F.monotonically_increasing_id()).join(gone, place, "left_anti").drop(place)
    one = blocks.df.first()
    blocks.drop()
    scan = Scanner(spark, bytes(one["automaton"]) if one else None)
    begin(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text_col):
            hits = [(sum(b - a for a, b in spans), len(words)) for words, spans, _ in scan(text_bytes(batch.column(text_col)))]
            yield batch.filter(pa.array([not (hit and 20 * hit >= n) for hit, n in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the normal form's words outside the spans of ``found``, joined by one space (``kept_text``).
    ``found`` comes from :func:`find_contamination` over the same input."""
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            kept = []
            for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                for s in reversed(spans or []):
                    del words[s["start"] : s["end"]]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "kept_text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    return rows.join(found.select("place", "spans"), "place").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept_text string")
