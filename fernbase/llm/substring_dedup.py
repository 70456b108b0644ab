"""Substring deduplication: words covered by a window of words that also starts in an earlier document.

Documents are cut into segments: runs of windows that have the same anchor, the smallest hash of the grams
(8 words) inside the window. Equal windows have equal anchors, so segments of different anchors never need
to meet. Only segments whose anchor occurs in several documents go on, and of segments with equal words
(hot passages, copies) only that of the smallest document: any other copy is covered as a whole. Words
count as equal by a 128-bit BLAKE2 digest of them here, and by themselves in a shard; the 64-bit hashes
only say which segments meet.

The words of these representatives are dealt out by anchor. In a shard the documents of an anchor are
split by their order, again and again: the words of each earlier half become an FM-index, and the later
half is streamed through it by backward search. Where the matching statistics reach the window's length,
the window also starts in an earlier document; such intervals come back as spans of words.

An anchor whose representatives hold many words is split further: they are cut into segments again, by
longer grams, and the parts go through the same steps. The last gram is the window itself, whose segments
are single windows: then no anchor has two different parts. So no task meets an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, begin, repeatable, sub_batches, text_bytes
from .fm_index import FMIndex
from .pieces import SpanHash

#: Words of the grams that anchors are taken from, those of hot anchors by the later ones.
GRAMS = (8, 16, 32)
#: Words that a shard gathers before it is searched, and words of one anchor beyond which it is split.
SHARD_WORDS = 250_000
HOT_WORDS = 16_384
#: Most windows of a segment, and most words of a document that are cut into segments at once.
MOST_WINDOWS = 1024
STRETCH = 1 << 20
#: Windows that are streamed as one.
CHAIN = 128
LAST_ID = (1 << 63) - 1
_TO_SPACE = bytes(0x20 if c in (0x20, *range(0x09, 0x0E)) else c for c in range(256))
_STEP = 0xD1342543DE82EF95
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_hash = SpanHash()


def squeezed(text: bytes) -> bytes:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, joined by one space."""
    text = text.translate(_TO_SPACE).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a squeezed text begin and end."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    if not text:
        return gaps, gaps
    return np.concatenate(([0], gaps + 1)), np.append(gaps, len(text))


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of a squeezed text; of words of 64 bytes or more by XXH64. A long text is
    taken in parts."""
    from xxhash import xxh64_intdigest

    raw = np.frombuffer(text, np.uint8)
    keys = np.empty(len(start), np.uint64)
    short = end - start < 64
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 19))))
        some = np.arange(at, to)[short[at:to]]
        if len(some):
            low = start[some[0]]
            keys[some] = _mixed(_hash(raw[low : end[some[-1]]], start[some] - low, end[some] - low))
        at = to
    for k in np.flatnonzero(~short).tolist():
        keys[k] = xxh64_intdigest(text[start[k] : end[k]], 1)
    return keys


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of hash times power, and the inverse powers: hashes of spans of words."""
    n = len(words)
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _STEP_BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return total, down


def segments(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of a document's segments; none if it has fewer words than a window."""
    out = []
    for at in range(0, max(0, len(words) - window + 1), STRETCH):
        part = words[at : at + STRETCH + window - 1]
        total, down = _prefix(part)
        n = len(part)
        anchor = _slide(_mixed((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1]), window - gram + 1)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(start, len(anchor)))
        parts = -(-count // MOST_WINDOWS)
        of = np.repeat(np.arange(len(start)), parts)
        step = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_WINDOWS
        out.append((start[of] + step + at, np.minimum(count[of] - step, MOST_WINDOWS), anchor[start[of]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, digests as two numbers each) of a text's segments."""
    text = squeezed(text)
    low, high = word_edges(text)
    start, count, anchor = segments(word_hashes(text, low, high), window, gram)
    view, digest = memoryview(text), hashlib.blake2b
    a, b = low[start].tolist(), high[start + count + window - 2].tolist()
    digests = b"".join([digest(view[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)])
    return start, count, anchor, np.frombuffer(digests, np.int64).reshape(-1, 2)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(id_col).cast("long").alias("given"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))


#: What tells a segment's words: its anchor and the two halves of its digest.
CONTENT = ["anchor", "d1", "d2"]


def find_segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, d1, d2, doc_id, place, start, windows) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            found = [_cut(t, window, gram) for t in text_bytes(batch.column("text"))]
            n = [len(f[0]) for f in found]
            start, count, anchor, digest = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, places = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("doc_id", "place"))
            columns = (anchor.view(np.int64), digest[:, 0], digest[:, 1], ids, places, start.astype(np.int64), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], [*CONTENT, "doc_id", "place", "start", "windows"])

    return rows.select("doc_id", "place", "text").mapInArrow(run, "anchor long, d1 long, d2 long, doc_id long, place long, start long, windows int")


def _cover(begin: np.ndarray, window: int) -> list[dict[str, int]]:
    """Spans of the words that windows at these sorted places cover."""
    if not len(begin):
        return []
    cut = np.flatnonzero(np.diff(begin) > window)
    a = begin[np.concatenate(([0], cut + 1))]
    b = begin[np.concatenate((cut, [len(begin) - 1]))] + window
    return [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SPANS_SQL = "array<struct<a: long, b: long>>"


def search_shard(segments_of: list[bytes], anchor: np.ndarray, owner: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment (its words, joined by one space) the places of the windows that also begin in a segment of
    the same anchor and a smaller owner.

    The owners of an anchor are numbered by their order. For each bit of these numbers, owners that agree
    above it and have it clear are indexed, and those that have it set are streamed: so each two owners of an
    anchor meet once. A symbol of the index is a word within such a group, so groups do not match each other.
    """
    words = b" ".join(segments_of).split(b" ")
    code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    size = np.array([s.count(b" ") + 1 for s in segments_of])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    hit = np.zeros(len(code), bool)
    group = np.unique(anchor, return_inverse=True)[1]
    number = np.unique(np.stack([group, np.unique(owner, return_inverse=True)[1]]), axis=1, return_inverse=True)[1].ravel()
    lowest = np.full(group.max() + 1, len(size))
    np.minimum.at(lowest, group, number)
    number = number - lowest[group]
    windows = size - window + 1
    for bit in range(int(number.max()).bit_length() - 1, -1, -1):
        node = group * (len(size) + 1) + (number >> (bit + 1))
        later = (number >> bit & 1).astype(bool)
        done = np.add.reduceat(hit, first) == windows
        streamed = later & ~done & np.isin(node, node[~later])
        indexed = ~later & np.isin(node, node[streamed])
        if not streamed.any():
            continue
        name = node[of] * (len(words) + 1) + code
        inside = np.flatnonzero(indexed[of])
        known, symbol = np.unique(name[inside], return_inverse=True)
        text = np.zeros(len(inside) + int(indexed.sum()), np.int64)  # a zero ends each segment
        text[np.arange(len(inside)) + np.cumsum(indexed)[of[inside]] - 1] = symbol + 1
        there = np.minimum(np.searchsorted(known, name), len(known) - 1)
        query = np.where((known[there] == name) & streamed[of], there + 1, 0)
        # runs of known words in one segment; shorter ones than a window hold none
        edge = np.concatenate(([0], np.flatnonzero(((query[1:] > 0) != (query[:-1] > 0)) | (of[1:] != of[:-1])) + 1, [len(query)]))
        low, high = edge[:-1], edge[1:]
        run = (query[low] > 0) & (high - low >= window)
        low, high = low[run], high[run]
        # streamed in chains, each with the words that its last window reaches to; every other one at a time, as neighbours overlap
        chains = -(-(high - low - window + 1) // CHAIN)
        which = np.repeat(np.arange(len(low)), chains)
        ordinal = np.arange(len(which)) - np.repeat(np.cumsum(chains) - chains, chains)
        start = low[which] + ordinal * CHAIN
        stop = np.minimum(start + CHAIN + window - 1, high[which])
        index = FMIndex(text) if len(start) else None
        for odd in range(min(2, int(chains.max(initial=0)))):
            some = ordinal % 2 == odd
            hit |= index.statistics(query, start[some], stop[some]) >= window
    at = np.flatnonzero(hit)
    cut = np.searchsorted(at, np.append(first, len(code)))
    return [at[a:b] - f for a, b, f in zip(cut[:-1], cut[1:], first, strict=True)]


def search_segments(words: DataFrame, window: int) -> DataFrame:
    """``words``: (anchor, d1, d2, doc_id, body). The spans of each segment, counted from its start, that windows
    of smaller documents cover. Whole anchors, none of over HOT_WORDS words, are gathered to shards of about
    SHARD_WORDS words."""
    begin(words.sparkSession)
    dealt = words.repartition("anchor").sortWithinPartitions("anchor", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def search() -> pa.RecordBatch:
            found = search_shard([h[4] for h in held], np.array([h[0] for h in held]), np.array([h[3] for h in held]), window)
            spans = pa.array([_cover(f, window) for f in found], _SPANS)
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], pa.int64()) for k in range(3)] + [spans], [*CONTENT, "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*CONTENT, "doc_id", "body")), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield search()
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            yield search()

    return dealt.mapInArrow(run, f"anchor long, d1 long, d2 long, spans {_SPANS_SQL}")


def covered_spans(rows: DataFrame, window: int, grams: tuple[int, ...]) -> Written:
    """(place, spans): for each row (place, doc_id, text) the spans of words that a window covers which also starts
    in a row of a smaller doc_id. Rows without such spans are left out; spans may overlap. The frame must keep
    its rows when it runs again, as :func:`repeatable` frames do."""
    spark = rows.sparkSession
    begin(spark)
    made: list[Written] = []

    def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        made.append(Written(df, name, narrow))
        return made[-1].df

    found = written(find_segments(rows, window, grams[0]), "substring-segments")
    met = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    met = written(met, "substring-met", narrow=True)  # so that the join has two plain sides and a hot anchor's rows can be split
    shared = written(found.join(met, "anchor"), "substring-shared")
    for table in made[:2]:
        table.drop()
    del made[:2]
    best = F.min(F.struct("doc_id", "place", "start", "windows"))
    reps = written(shared.groupBy(*CONTENT).agg(best.alias("r")).select(*CONTENT, "r.*"), "substring-reps")
    # an anchor whose representatives are all of one document has nothing to look for
    sizes = reps.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.col("windows") + window - 1).alias("n")).where("lo < hi")
    split = (F.col("n") > HOT_WORDS) if len(grams) > 1 else F.lit(False)
    sizes = written(sizes.select("anchor", split.alias("hot")), "substring-sizes", narrow=True)
    wanted = reps.join(sizes, "anchor").groupBy("place").agg(F.collect_list(F.struct(*CONTENT, "doc_id", "start", "windows", "hot")).alias("wanted"))
    begin(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in sub_batches(batches, "text", 1 << 20):
            out: list[tuple] = []
            for text, some in zip(text_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                text = squeezed(text)
                low, high = word_edges(text)
                out += [(w["anchor"], w["d1"], w["d2"], w["doc_id"], w["hot"], text[low[w["start"]] : high[w["start"] + w["windows"] + window - 2]]) for w in some]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [*CONTENT, "doc_id", "hot", "body"])

    words = rows.select("place", "text").join(wanted, "place").select("text", "wanted").mapInArrow(fetch, "anchor long, d1 long, d2 long, doc_id long, hot boolean, body binary")
    if sizes.where("hot").isEmpty():
        spans = search_segments(words, window)
    else:
        words = written(words.withColumn("number", F.monotonically_increasing_id()), "substring-words")
        inner = covered_spans(words.where("hot").select(F.col("number").alias("place"), "doc_id", F.col("body").cast("string").alias("text")), window, grams[1:])
        made.append(inner)
        parts = words.where("hot").select(*CONTENT, F.col("number").alias("place")).join(inner.df, "place").select(*CONTENT, "spans")
        spans = search_segments(words.where("NOT hot").drop("hot", "number"), window).unionByName(parts)
    # written, so that the join below has two plain sides and a hot segment's copies can be split over tasks
    found = reps.select(*CONTENT, F.col("doc_id").alias("rep")).join(spans.where("size(spans) > 0"), CONTENT, "left")
    found = written(found, "substring-spans")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + window - 1).alias("b")))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    each = shared.join(found, CONTENT).select("place", F.when(F.col("doc_id") > F.col("rep"), whole).otherwise(moved).alias("spans")).where("size(spans) > 0")
    out = Written(each.groupBy("place").agg(F.flatten(F.collect_list("spans")).alias("spans")), "substring-covered", narrow=True)
    for table in made:
        table.drop()
    return out


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a window of ``window`` consecutive words covers it whose word sequence also starts in
    a document with a smaller doc_id; windows are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``,
    null texts have none, and texts shorter than a window lose nothing; texts of any length are read whole.
    Rows that repeat with one id never remove each other's words; a null id counts as larger than any other.
    An empty table gives no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    docs = repeatable(docs.select(id_col, text_col))
    rows = _rows(docs, id_col, text_col)
    spans = covered_spans(rows.select("place", "doc_id", "text"), window, (*[g for g in GRAMS if g < window], window)).df
    begin(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            n, removed, digests = [], [], []
            for text, some in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if some:
                    step = np.zeros(len(words) + 1, np.int32)
                    np.add.at(step, [s["a"] for s in some], 1)
                    np.add.at(step, [s["b"] for s in some], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    removed.append(0)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = rows.select("place", F.col("given").alias("doc_id"), "text")
    return rows.join(spans, "place", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
