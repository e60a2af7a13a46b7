"""Tables written between the steps of a job: they cut the lineage of loops, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN = "_tidemark_core_paths"


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_tidemark_core_root", None) or tempfile.mkdtemp(prefix="tidemark-core-")
        context._tidemark_core_root = root
    return root.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the driver's Python ends or by ``clear``."""
    context = spark.sparkContext
    if not hasattr(context, _WRITTEN):
        setattr(context, _WRITTEN, [])
        atexit.register(clear, spark)
    found = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    getattr(context, _WRITTEN).append(found)
    return found


def clear(spark: SparkSession) -> None:
    """Delete what was written. Frames that were returned read it, so call this once those are no longer needed."""
    paths = getattr(spark.sparkContext, _WRITTEN, [])
    while paths and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # what cannot be deleted is no reason to stop
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
