"""Writers: pinned-schema appends, rebuilds, create-if-absent, and writes of what is not there yet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    pass


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in the schema's order, or SchemaMismatch: names and types must be those declared, and nothing may be extra."""
    have, want = {f.name: f.dataType for f in rows.schema}, {f.name: f.dataType for f in schema}
    if have != want:
        odd = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
        raise SchemaMismatch(f"columns differ from the table's: {', '.join(odd)}")
    required = [f.name for f in schema if not f.nullable]
    checked = rows.select(*[F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{n} is null"))).otherwise(F.col(n)).alias(n) if n in required else F.col(n) for n in want])
    return checked


def append(rows: DataFrame, path: str, schema: T.StructType, max_records: int = 0) -> None:
    conform(rows, schema).write.mode("append").option("maxRecordsPerFile", max_records).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rebuild(rows: DataFrame, path: str) -> None:
    """Replace the whole table: the new one is written beside it and takes its place by renames, so a job that fails leaves the
    old table, and ``rows`` may read it. Between the two renames there is none; if the second fails, the old one is put back."""
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    target, system = _file_system(spark, path)
    made, _ = _file_system(spark, f"{path.rstrip('/')}-new-{mark}")
    old, _ = _file_system(spark, f"{path.rstrip('/')}-old-{mark}")
    try:
        rows.write.parquet(made.toString())
    except Exception:
        system.delete(made, True)
        raise
    there = system.exists(target)
    if there and not system.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not system.rename(made, target):
        if there:
            system.rename(old, target)
        raise OSError(f"{made.toString()} could not take the place of {path}")
    if there:
        system.delete(old, True)


def rebuild_table(rows: DataFrame, name: str) -> None:
    """CREATE OR REPLACE TABLE name AS rows, for catalogs that have it, else overwrite by save mode."""
    rows.write.mode("overwrite").saveAsTable(name)


def create_if_absent(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Whether the table had to be made."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


def write_absent(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table lacks, one per key, and return them as they now stand in it. Nothing is
    overwritten. Of rows with equal keys the one that is least in the other columns, in their order, is written."""
    spark = rows.sparkSession
    where, system = _file_system(spark, path)
    rest = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__rest")).select(*keys, "__rest.*").select(*rows.columns) if rest else rows.distinct()
    if system.exists(where):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
