"""Token ids in ORC files, and the encoder that fills them.

The files hold (doc_id, ids, tie) in ascending order of doc_id: file i holds smaller ids than file i + 1,
and rows are sorted inside each file. ORC run-length encodes the integers, keeps minimum and maximum
of doc_id for every row group and stripe, and a Bloom filter on doc_id, so that readers prune stripes by
metadata and read the rest stripe by stripe in parallel.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begin, fresh, partitions_for, sub_batches, text_bytes
from .pieces import DIGIT, LOWER, ODD, SPACE, Known, PieceTable, SpanHash, classes

_ENCODERS: dict[tuple[str, bool], "ChunkEncoder"] = {}


class ChunkEncoder:
    """A ``tokenizers`` vocabulary that drops white space, applied to each distinct piece of text once.

    Where white space is dropped, no token, normalisation or pre-token spans an ASCII blank. Text is cut
    at blanks, and where only ASCII and two-byte Latin letters occur also between letters, digits and
    signs, as the vocabulary's pattern does; a chunk with any other character, or with the string of an
    added token, stays whole. New pieces are encoded by the library. Known ones are found by a 64-bit hash
    in a table of bounded size and then compared byte for byte: a piece that shares another's hash goes to
    the library each time. The table is emptied when full: that costs time and changes no result. Pieces
    of 100 bytes or more are never kept.

    As in the library, the string of a special token in a text gives that token's id, unless ``plain_text``
    says that texts are nothing but text: then it is encoded like any other string.
    """

    LONG = 100

    def __init__(self, path: str, bits: int = 21, most_bytes: int = 1 << 19, plain_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_text
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.normalized or len(t.content.split()) != 1 for t in added):
            raise ValueError("an added token that reaches over blanks, or is looked for in normalised text, does not fit cutting at blanks")
        self.added = [t.content.encode() for t in added if not (plain_text and t.special)]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.most_bytes = most_bytes
        self.table, self.known = PieceTable(bits), Known()
        self.hash = SpanHash()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.known.clear()
        self.flat, self.ends = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.n_pieces = 0

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes], simple: list[bool]) -> list[list[int]]:
        """The ids of each piece; simple ones are one pre-token and go to the library many at a time, told
        apart by the marks of word ends."""
        ids: list[list[int] | None] = [None] * len(pieces)
        plain = [k for k, ok in enumerate(simple) if ok]
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            got = np.array(self._library([b" ".join([pieces[k] for k in part])])[0], np.int32)
            stops = np.flatnonzero(self.final[got]) + 1
            if len(stops) == len(part):
                got, a = got.tolist(), 0
                for k, b in zip(part, stops.tolist(), strict=True):
                    ids[k], a = got[a:b], b
        rest = [k for k, x in enumerate(ids) if x is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for k, got in zip(part, self._library([pieces[k] for k in part]), strict=True):
                ids[k] = got
        return ids

    def _keep(self, pieces: list[bytes], ids: list[list[int]]) -> np.ndarray:
        """Append pieces and their ids; the places of the pieces."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.add(pieces)
        at = int(self.ends[self.n_pieces])
        ends = at + np.cumsum(n)
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.ends) <= self.n_pieces + len(ids):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.flat[at : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        self.ends[self.n_pieces + 1 : self.n_pieces + 1 + len(ids)] = ends
        places = np.arange(self.n_pieces, self.n_pieces + len(ids), dtype=np.int32)
        self.n_pieces += len(ids)
        return places

    def _some(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a buffer, and the byte at which the piece of each begins."""
        given = np.frombuffer(data + b" " * 8, np.uint8)
        raw = LOWER[given]
        kind = classes(raw, fold=True)
        filled = kind != SPACE
        begins = filled.copy()
        begins[1:] &= ~filled[:-1]
        chunk = np.flatnonzero(begins)
        if not len(chunk):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        odd = np.flatnonzero(np.maximum.reduceat(kind, chunk) == ODD)
        if marked := self._with_added(data):
            odd = np.union1d(odd, np.searchsorted(chunk, marked, "right") - 1)
        if len(odd):
            stop = np.flatnonzero(filled & np.concatenate((~filled[1:], [True]))) + 1
            mark = np.zeros(len(kind) + 1, np.int32)
            mark[chunk[odd]] += 1
            mark[stop[odd]] -= 1
            whole = np.cumsum(mark[:-1]) > 0
            kind[whole] = ODD
            raw[whole] = given[whole]  # composition comes before lower case there
        begins[1:] |= filled[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        over = filled.copy()
        over[:-1] &= begins[1:] | ~filled[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(over) + 1
        place = self._places(raw, kind, start, end)
        low, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(low - before[:-1], n) + np.arange(before[-1])]
        return ids, np.repeat(start, n)

    def _with_added(self, data: bytes) -> list[int]:
        """Where the strings of added tokens begin."""
        return sorted(m.start() for t in self.added if t in data for m in re.finditer(re.escape(t), data))

    def _places(self, raw: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each span's piece; new pieces are learnt."""
        keys = self.hash(raw, start, end)
        short = end - start < self.LONG
        place = np.full(len(keys), -1, np.int32)
        place[short] = self.table.find(keys[short])
        body = raw.tobytes() if (place < 0).any() else b""

        def learn(which: np.ndarray) -> np.ndarray:
            cut = [body[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
            return self._keep(cut, self._encode_pieces(cut, (kind[start[which]] != ODD).tolist()))

        for again in (False, True):
            new = np.flatnonzero((place < 0) & short)
            first = new[np.unique(keys[new], return_index=True)[1]]
            if len(first) <= self.table.room() and self.n_pieces <= 1 << (self.table.bits + 1):
                break
            self._forget()
            body = body or raw.tobytes()
            place[:] = -1
            while again and len(first) > self.table.room():
                self.table.bits += 1
                self.table.clear()
        if len(first):
            self.table.add(keys[first], learn(first))
            place[new] = self.table.find(keys[new])
        # a hash says where to look, the bytes decide
        alike = np.zeros(len(keys), bool)
        alike[short] = self.known.same(raw, start[short], end[short], place[short])
        rest = np.flatnonzero(~alike)
        if len(rest):
            body = body or raw.tobytes()
            place[rest] = learn(rest)
        return place

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for at, buffer, inside in self._buffers(texts):
            ids, begin = self._some(buffer)
            parts.append(ids)
            edges = np.searchsorted(begin, inside)
            counts[at : at + len(inside)] += np.diff(np.append(edges, len(ids)))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), counts

    def _buffers(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
        """Texts joined by a blank into buffers of bounded size: the first text, the bytes, where each begins.
        A text that is longer goes in several parts, cut at blanks where it has any."""
        at, held, size = 0, [], 0
        for k, text in enumerate(texts):
            if held and size + len(text) > self.most_bytes:
                yield at, b" ".join(held), np.cumsum([0, *(len(t) + 1 for t in held[:-1])]).tolist()
                at, held, size = k, [], 0
            while len(text) > self.most_bytes:
                cut = max(text.rfind(b, 0, self.most_bytes) for b in (b" ", b"\n", b"\t", b"\r"))
                if cut <= 0:
                    break
                yield k, text[:cut], [0]
                text = text[cut:]
            held.append(text)
            size += len(text) + 1
        if held:
            yield at, b" ".join(held), np.cumsum([0, *(len(t) + 1 for t in held[:-1])]).tolist()


def encoder(path: str, plain_text: bool = False) -> ChunkEncoder:
    """One encoder a worker and file."""
    if (path, plain_text) not in _ENCODERS:
        _ENCODERS[path, plain_text] = ChunkEncoder(path, plain_text=plain_text)
    return _ENCODERS[path, plain_text]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after each document; and the documents' offsets."""
    offsets = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.empty(offsets[-1], np.int32)
    is_end = np.zeros(offsets[-1], bool)
    is_end[offsets[1:] - 1] = True
    out[is_end] = end_id
    out[~is_end] = ids
    return out, offsets


#: doc_id, its ids with the end id, and a hash of the text that orders rows with one id.
SCHEMA = "doc_id long, ids array<int>, tie long"


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_index_stride: int = 1000) -> None:
    """Write (doc_id, ids, tie) of every document to ORC files in ascending order of doc_id, null ids first.

    Texts, not ids, travel in the shuffle, as they are the smaller; the ranges' number follows from the
    input's bytes. Rows that repeat with one id are in the order of ``tie``, a hash of the text, so that an
    id (or no id) that many rows share is spread over several files. A null text counts as empty and gives
    the end id alone; texts of any length are encoded whole, in parts of bounded size; an empty table gives
    no rows; columns other than id and text are not read, whatever their names.
    """
    begin(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = partitions_for(docs)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie") if parts else rows.repartitionByRange("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in sub_batches(batches, "text", 2 << 20):
            ids, offsets = with_end(*enc.encode(text_bytes(batch.column("text"))), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, batch.column("tie")], ["doc_id", "ids", "tie"])

    (
        ordered.sortWithinPartitions("doc_id", "tie")
        .mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .orc(path)
    )


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the named documents. The ids reach the reader: stripes and row groups whose range or
    whose Bloom filter excludes them are not read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "ids")


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Each stripe is read on its own. ``start`` is a prefix scan: totals per file, scanned over the files in
    their order, plus a running sum inside each file. ids_crc32 is the unsigned CRC-32 of the ids as
    little-endian unsigned 32-bit integers. A file holds a bounded share of the input, so neither scan
    meets more than a file's rows or one row a file.
    """
    begin(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), batch.column("file"), n, pa.array(crc, pa.int64())], ["doc_id", "tie", "file", "n_tokens", "ids_crc32"])

    file_no = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(SCHEMA).orc(path).select("doc_id", "ids", "tie", file_no.alias("file"))
    rows = rows.mapInArrow(run, "doc_id long, tie long, file long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("file").orderBy("doc_id", "tie", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    across = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("before"))
    return placed.join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' ids to a new folder in the shared folder, and read them back."""
    path = fresh(docs.sparkSession, "tokens-orc")
    write_token_orc(docs, path, tokenizer_path, end_id)
    return read_token_orc(docs.sparkSession, path)
