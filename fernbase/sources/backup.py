"""Backups: a folder of Parquet with a manifest, or one framed file.

A framed file is a sequence of frames, each a four-byte length and a JSON document in the tagged form of
:mod:`fernbase.functions.documents`: a header (magic, version, name, indexes, count), then the rows in
batches of at most 1000 in the order of their ids; gzip by default, which reading detects. Tasks make the frames
and read them; only the bytes of the one file go through the driver, a frame at a time.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.documents import pack, unpack
from .code import ship
from .scratch import new_folder

MAGIC, VERSION, BATCH = "fernbase-backup", 1, 1000


def export_folder(df: DataFrame, path: str, name: str, indexes: list[dict[str, Any]] | None = None) -> None:
    """All rows as zstd Parquet below ``path``/rows, and a manifest: any number of files, written in parallel."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    manifest = json.dumps({"magic": MAGIC, "version": VERSION, "name": name, "indexes": indexes or [], "schema": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def import_folder(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> tuple[dict[str, Any], DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("magic") != MAGIC:
        raise ValueError(f"{path} is no backup")
    df = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{path}/rows")
    return manifest, chosen(df, doc_ids)


def chosen(df: DataFrame, doc_ids: list[str] | None) -> DataFrame:
    if doc_ids is None:
        return df
    if len(doc_ids) <= 1000:
        return df.where(F.col("id").isin(list(doc_ids)))
    ids = df.sparkSession.createDataFrame([(i,) for i in doc_ids], "id string").distinct()
    return df.join(ids, "id", "left_semi")


def _frame(value: Any) -> bytes:
    data = json.dumps(pack(value), ensure_ascii=False, separators=(",", ":")).encode()
    return struct.pack(">I", len(data)) + data


def _zone(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def export_stream(df: DataFrame, out: BinaryIO, name: str, indexes: list[dict[str, Any]] | None = None, compress: bool = True) -> int:
    """Write one framed file; the rows written."""
    ship(df.sparkSession)
    sink = gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if compress else out
    n, schema, zone = df.count(), df.schema, _zone(df.sparkSession)
    sink.write(_frame({"magic": MAGIC, "version": VERSION, "name": name, "indexes": indexes or [], "count": n, "schema": schema.json()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = [_told(r, schema, zone) for r in batch.slice(at, BATCH).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_frame(rows)], pa.binary())], ["frame"])

    ordered = df.orderBy("id") if "id" in df.columns else df
    for row in ordered.mapInArrow(run, "frame binary").toLocalIterator(prefetchPartitions=True):
        sink.write(row["frame"])
    if compress:
        sink.close()
    return n


def _told(value: Any, kind: T.DataType, zone: str) -> Any:
    """A value out of Arrow as rows have it: times without a zone, maps as objects."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _told(value[f.name], f.dataType, zone) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_told(x, kind.elementType, zone) for x in value]
    if isinstance(kind, T.MapType):
        return {k: _told(x, kind.valueType, zone) for k, x in value}
    if isinstance(kind, T.TimestampType):
        return value.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return value


def frames(data: BinaryIO) -> Iterator[bytes]:
    """The frames of a file, as JSON, inflated if need be."""
    head = data.read(2)
    stream: Any = io.BufferedReader(_Joined(head, data))
    if head == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while size := stream.read(4):
        if len(size) < 4:
            raise ValueError("the backup is cut off")
        n = struct.unpack(">I", size)[0]
        body = stream.read(n)
        if len(body) < n:
            raise ValueError("the backup is cut off")
        yield body


class _Joined(io.RawIOBase):
    def __init__(self, head: bytes, rest: BinaryIO):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: Any) -> int:
        data = self.head[: len(buffer)] if self.head else self.rest.read(len(buffer))
        self.head = self.head[len(data) :] if self.head else b""
        buffer[: len(data)] = data
        return len(data)


#: Bytes of the files that frames are put into for the tasks that read them.
PART = 64 << 20


def import_stream(spark: SparkSession, data: BinaryIO, doc_ids: list[str] | None = None) -> tuple[dict[str, Any], DataFrame]:
    """The header and the rows of a framed file. Frames are copied to the shared folder, a line each (JSON has no line
    breaks of its own); tasks read them from there."""
    every = frames(data)
    try:
        header = json.loads(next(every, b"0"))
    except ValueError as e:
        raise ValueError("this is no backup") from e
    if not isinstance(header, dict) or header.get("magic") != MAGIC:
        raise ValueError("this is no backup")
    header = unpack(header)
    schema, zone, folder = T.StructType.fromJson(json.loads(header["schema"])), _zone(spark), new_folder(spark, "frames")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    out, size, k = None, 0, 0
    for frame in every:
        if out is None or size > PART:
            if out is not None:
                out.close()
            out, size, k = fs.create(path(f"{folder}/{k:06d}.json"), True), 0, k + 1
        out.write(bytearray(frame + b"\n"))
        size += len(frame)
    if out is not None:
        out.close()
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        for batch in batches:
            for line in batch.column(0).to_pylist():
                docs = unpack(json.loads(line))
                columns = [pa.array([_stored(d.get(f.name), f.dataType, zone) for d in docs], kind) for f, kind in zip(schema.fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return header, chosen(spark.read.schema("value string").text(folder).mapInArrow(run, schema), doc_ids)


def _stored(value: Any, kind: T.DataType, zone: str) -> Any:
    """A value as Arrow takes it: times in their zone, maps as pairs."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _stored(value.get(f.name), f.dataType, zone) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_stored(x, kind.elementType, zone) for x in value]
    if isinstance(kind, T.MapType):
        return [(k, _stored(x, kind.valueType, zone)) for k, x in value.items()]
    if isinstance(kind, T.TimestampType):
        return value.replace(tzinfo=ZoneInfo(zone))
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
