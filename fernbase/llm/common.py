"""Helpers the training-data operators share: shared scratch tables, Arrow batches, code shipping.

Everything written here goes to the folder named by ``spark.checkpoint.dir``, which the driver
and every executor can see (:mod:`fernbase.sources.scratch`), and is removed when the driver ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.code import ship
from ..sources.scratch import new_folder

#: Rows an Arrow batch may hold when whole texts go to Python: long texts make batches large.
BATCH_ROWS = 256


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return new_folder(spark, name)


#: Bytes read for each file of a narrow table, and for each partition of texts in a shuffle.
NARROW_BYTES, SHUFFLE_BYTES = 16 << 20, 64 << 20


def plan_bytes(df: DataFrame) -> int | None:
    """The bytes that a frame's plan reads, as the planner estimates them for each leaf: of files all that they hold.
    None if it cannot tell, as for rows that the driver sent."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def partitions_for(df: DataFrame, each: int = SHUFFLE_BYTES) -> int | None:
    """As many partitions as the frame's bytes ask for; None where the session's number is as many."""
    n = -(-(plan_bytes(df) or 0) // each)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


class Written:
    """A table written to the shared folder: its rows survive lost executors, its lineage is cut.

    ``narrow`` tables, a few numbers a row after a shuffle, go to as many files as the bytes read for them
    ask for: opening a file costs an executor more than a few rows do.
    """

    def __init__(self, df: DataFrame, name: str, narrow: bool = False):
        self.spark = df.sparkSession
        self.path = fresh(self.spark, name)
        self.schema = df.schema
        if narrow and (read := plan_bytes(df)) is not None:
            files = max(12, -(-read // NARROW_BYTES))
            if files < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.coalesce(files)
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def begin(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """What every operator that runs Python on the executors needs first: the code, and Arrow batches of
    bounded rows, which bounds a Python worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches further where their texts are long, so that a few huge texts never meet in one step."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def fold(column: str, modulus: int, held_out: int) -> F.Column:
    """True where crc32 of the id as text falls on the held-out remainder; a null id is never held out."""
    return F.coalesce((F.crc32(F.col(column).cast("string").cast("binary")) % modulus) == held_out, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sum_vectors(df: DataFrame, vector_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum, over all batches, of a vector of fixed size: each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += vector_of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["i", "v"])

    out = np.zeros(size)
    for i, v in df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the frame has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Plan nodes that give the same rows in the same places each time they run, if their expressions do.
_STEADY = ("Project", "Filter", "LogicalRelation", "LocalRelation")


def repeatable(df: DataFrame) -> DataFrame:
    """A frame whose rows keep their places when it runs again: itself if it only reads files and filters or
    projects them by deterministic expressions of the JVM, else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan()

    def steady(node: object) -> bool:
        below = node.children()
        return node.getClass().getSimpleName() in _STEADY and all(steady(below.apply(k)) for k in range(below.size()))

    return df if plan.deterministic() and steady(plan) else Written(df, "input").df
