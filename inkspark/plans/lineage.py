"""Cutting a lineage so that an iterative plan stays short and survives the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one that spark.checkpoint.dir names, which all executors share.

    Where the setting is missing a temporary folder is taken, but only in local mode, where the one machine sees it; it is removed
    when the process ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="inkspark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder, without the plan that made them.

    The table lasts until :func:`drop` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_drop_all, os.getpid())
    _TABLES[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that :func:`cut` wrote, once nothing reads them any more; other frames are passed over."""
    for t in tables:
        path = t.__dict__.get("cut_path")
        spark = _TABLES.pop(path, None)
        if spark:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all(pid: int) -> None:
    if pid != os.getpid():
        return
    for path, spark in list(_TABLES.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            break
    _TABLES.clear()
