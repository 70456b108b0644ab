"""Cutting lineage between rounds of an iterative plan: rows written as Parquet and read again.

Unlike a checkpoint this runs the plan once, and the files tell the planner their size. The folder is below
the one that ``spark.checkpoint.dir`` names, and is removed when the driver ends. Only where that is unset
and the master is local is a temporary folder of the machine used.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder, which the driver and all executors see."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
            top = "file://" + tempfile.mkdtemp(prefix="fernbase-scratch-")
        _ROOTS[app] = f"{top.rstrip('/')}/fernbase-scratch-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends; nothing is left to do then
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder; they outlive the executors that made them."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            _remove(df.sparkSession, path)
