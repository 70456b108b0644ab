"""Versioned Parquet snapshots of a table.

``<root>/v-<n>`` holds the rows of version n, ``<root>/_meta-<n>.json`` its name and indexes, ``<root>/_CURRENT``
the current number. A commit writes a new folder and its description, claims the number by a file that must
not exist and names them, moves them to their places, and replaces the pointer in one rename. Two writers
that start from one version cannot both commit it. All steps after the claim can be done by anyone: where a
writer died between them, the next one finishes its commit. Versions are kept for a while, so that
frames read from them go on working.
All access is through Hadoop's file systems, so any that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ConflictError

POINTER = "_CURRENT"


class Store:
    """One table's folder. ``compression`` is Parquet's codec, such as ``zstd``."""

    def __init__(self, spark: SparkSession, root: str, compression: str = "snappy", keep: int = 5):
        self.spark, self.root, self.compression, self.keep = spark, root.rstrip("/"), compression, keep

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self) -> Any:
        return self._path(POINTER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, new: bool = False) -> None:
        """Write a small file in one step; ``new`` fails if it is there, otherwise it is replaced."""
        fs = self._fs()
        hidden = f"_{name}.{uuid.uuid4().hex}"
        stream = fs.create(self._path(hidden), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri() if self._path(name).toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE if new else jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        try:
            context.rename(self._path(hidden), self._path(name), options)
        except Exception:
            fs.delete(self._path(hidden), False)
            raise

    def version(self) -> int:
        text = self._read(POINTER)
        return int(text) if text else 0

    def meta(self, version: int | None = None) -> dict[str, Any]:
        text = self._read(f"_meta-{self.version() if version is None else version}.json")
        return json.loads(text) if text else {}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the current one by default; None if there is none yet."""
        version = self.version() if version is None else version
        if not version:
            return None
        schema = T.StructType.fromJson(self.meta(version)["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/v-{version}")

    def commit(self, df: DataFrame, base: int, meta: dict[str, Any] | None = None, files: int | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """Write ``df`` as the version after ``base`` and make it current. ``check`` sees the rows as they are written,
        so that they are worked out once; if it raises, nothing has happened."""
        new = base + 1
        if self.version() != base:
            raise ConflictError(f"{self.root} is at version {self.version()}, not {base}")
        folder = f"v-{new}.{uuid.uuid4().hex}"
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        out = df.coalesce(files) if files else df
        out.write.option("compression", self.compression).parquet(f"{self.root}/{folder}")
        if check:
            try:
                check(self.spark.read.schema(schema).parquet(f"{self.root}/{folder}"))
            except Exception:
                self._fs().delete(self._path(folder), True)
                raise
        claim = json.dumps({"folder": folder, "meta": {**(meta or {}), "schema": schema.jsonValue()}})
        try:
            self._write(f"_claim-{new}", claim, new=True)
        except Exception as e:
            self._fs().delete(self._path(folder), True)
            self._finish(new)
            raise ConflictError(f"version {new} of {self.root} has been claimed") from e
        self._finish(new)
        self._drop_old(new)
        return new

    def _finish(self, version: int) -> None:
        """What is left to do of a claimed version, whoever claimed it; nothing if it is current already."""
        text = self._read(f"_claim-{version}")
        if text is None or self.version() >= version:
            return
        claim, fs = json.loads(text), self._fs()
        if not fs.exists(self._path(f"v-{version}")):
            fs.rename(self._path(claim["folder"]), self._path(f"v-{version}"))
        self._write(f"_meta-{version}.json", json.dumps(claim["meta"]))
        self._write(POINTER, str(version))

    def _drop_old(self, current: int) -> None:
        fs = self._fs()
        old = current - self.keep
        if old > 0:
            for name in (f"v-{old}", f"_meta-{old}.json", f"_claim-{old}"):
                fs.delete(self._path(name), True)
            for found in fs.globStatus(self._path(f"x-{old}-*")) or []:
                fs.delete(found.getPath(), True)

    def has(self, path: str) -> bool:
        """Whether a folder is there and was written to its end."""
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))

    def drop(self) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)
