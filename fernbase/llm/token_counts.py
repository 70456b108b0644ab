"""Token counts of documents in flat, unindexed token files, by a scan for the separators.

A file is nothing but little-endian unsigned integers; each document is followed by the end-of-document
id. Files are read in blocks of bytes, many at once, whatever documents they hold. A block's separators are
found by one vectorised comparison; documents that lie inside a block are measured there. A document that
crosses blocks is stitched: a prefix scan over each file's blocks gives every block the place of the
last separator before it, and the number of separators so far.

Files are read by byte range with ``pyarrow.fs``, so any of its file systems will do. The folder must be
one that all executors see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, begin, fresh, sub_batches, text_bytes
from .token_files import encoder, with_end

MARKS = "file string, block long, n long, at long, gap long"


def write_flat_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Write each partition's documents to one flat file of 16-bit ids, in the order of its rows.

    Nothing is shuffled. Texts are nothing but text here: the string of a special token in one is encoded
    like any other, so that no id inside a document is the separator. Each attempt of a task writes a file
    of its own name; those of attempts that Spark did not keep are deleted at the end. Returns the written
    table (file, ordinal, doc_id). A null text is written as the end id alone.
    """
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, plain_text=True)
        if len(enc.final) > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        fs, base = pa.fs.FileSystem.from_uri(folder)
        part = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        ordinal, stream = 0, None
        for batch in sub_batches(batches, "text"):
            if stream is None:
                fs.create_dir(base, recursive=True)
                stream = fs.open_output_stream(f"{base}/{part}")
            ids, offsets = with_end(*enc.encode(text_bytes(batch.column("text"))), end_id)
            stream.write(ids.astype("<u2").tobytes())
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
            ordinal += n
        if stream is not None:
            stream.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    written = Written(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-ids")
    kept = {r["file"] for r in written.df.select("file").distinct().collect()}  # one name a partition
    fs, base = pa.fs.FileSystem.from_uri(folder)
    for name in _files(fs, base):
        if name not in kept:
            fs.delete_file(f"{base}/{name}")
    return written


def _files(fs: pa.fs.FileSystem, base: str) -> dict[str, int]:
    """The names and sizes of a folder's files."""
    found = fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}


def scan_blocks(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, block, n, at, gap): a row for each separator, its number in the block, its place in the file
    in ids, and the ids since the block's previous separator (null for a block's first); and a row with a
    null ``n`` for each file's end."""
    fs, base = pa.fs.FileSystem.from_uri(folder)
    files = list(_files(fs, base).items())
    begin(spark, 1 << 14)
    step = block_bytes // width * width
    listed = spark.createDataFrame(files, "file string, size long")
    last = F.greatest(F.expr(f"(size - 1) div {step}"), F.lit(0))
    blocks = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, size, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                start = block * step
                with fs.open_input_file(f"{base}/{file}") as f:
                    f.seek(start)
                    data = f.read(min(step, size - start))
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                at = np.flatnonzero(ids == end_id) + start // width
                gap = pa.array(np.diff(at, prepend=0), mask=np.arange(len(at)) == 0)
                ends = start + step >= size
                n = pa.array([*range(len(at)), *([None] if ends else [])], pa.int64())
                place = pa.array(np.append(at, size // width) if ends else at, pa.int64())
                gap = pa.concat_arrays([gap.cast(pa.int64()), pa.nulls(1, pa.int64())]) if ends else gap.cast(pa.int64())
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.string()), pa.array([block] * k, pa.int64()), n, place, gap], ["file", "block", "n", "at", "gap"])

    return blocks.mapInArrow(run, MARKS)


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): one row per document of the files, in no order.

    ``n_tokens`` leaves the end id out, ``start`` is the document's first id in the file. Ids after a
    file's last separator are a document that has not ended; a file that ends in a separator has none. An
    empty file has no documents, two separators in a row enclose an empty one, no files give no rows.
    """
    marks = Written(scan_blocks(spark, folder, end_id, width, block_bytes), "token-marks").df
    of_block = marks.where("n is not null").groupBy("file", "block").agg(F.count("*").alias("n_block"), F.max("at").alias("last_at"))
    sofar = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = marks.where("n is null").select("file", F.col("block"), F.col("at").alias("size"))
    every = of_block.join(ends, ["file", "block"], "full")
    carry = every.select(
        "file",
        "block",
        "size",
        "last_at",
        F.coalesce("n_block", F.lit(0)).alias("n_block"),
        F.coalesce(F.sum("n_block").over(sofar), F.lit(0)).alias("before"),
        F.coalesce(F.max("last_at").over(sofar), F.lit(-1)).alias("last_before"),
    )
    inside = marks.where("n is not null").join(carry.select("file", "block", "before", "last_before"), ["file", "block"])
    gap = F.coalesce("gap", F.col("at") - F.col("last_before"))
    whole = inside.select("file", (F.col("before") + F.col("n")).alias("ordinal"), (F.col("at") - gap + 1).alias("start"), (gap - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    last = F.coalesce("last_at", "last_before")
    open_end = carry.where("size is not null").where(F.col("size") - last > 1)
    tail = open_end.select("file", (F.col("before") + F.col("n_block")).alias("ordinal"), (last + 1).alias("start"), (F.col("size") - last - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def document_token_counts(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents to flat files in the shared folder, and count their tokens by scanning these.

    One row per input row: doc_id, n_tokens (without the end id), file, start. Null texts have no tokens,
    repeated rows repeat, texts of any length are written whole, an empty table gives no rows; columns other
    than id and text are not read, whatever their names. Strings of special tokens count as ordinary text.
    """
    spark = docs.sparkSession
    folder = fresh(spark, "tokens-flat")
    ids = write_flat_tokens(docs, folder, tokenizer_path, end_id)
    counts = count_tokens(spark, folder, end_id)
    return ids.df.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
