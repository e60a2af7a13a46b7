"""Scratch storage and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Text the contracts call white space: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_tidemark_scratch", None)
        if root is None:
            root = context._tidemark_scratch = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes with ``clear_scratch``, at the latest when the driver's Python ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_paths"):
        context._tidemark_paths = []
        atexit.register(clear_scratch, spark)
    context._tidemark_paths.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this session's operators have written to the shared folder. Frames that they have returned read it, so
    call this once those are written elsewhere."""
    paths = getattr(spark.sparkContext, "_tidemark_paths", [])
    if spark.sparkContext._jsc is not None:
        while paths:
            with contextlib.suppress(Exception):  # a folder that cannot be deleted is no reason to stop
                delete(spark, paths.pop())


def fresh(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that is none of ``columns``, in any case."""
    taken, found = {c.lower() for c in columns}, []
    for stem in stems:
        name = next(n for n in itertools.chain([f"__{stem}"], (f"__{stem}_{i}" for i in itertools.count(1))) if n.lower() not in taken)
        taken.add(name.lower())
        found.append(name)
    return found


def columns(names: list[str]) -> list[Column]:
    """Top-level columns, whatever characters their names have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """SQL settings for jobs that run within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def measured_broadcasts(spark: SparkSession):
    """In jobs that run within the block, joins broadcast what adaptive execution has measured, and nothing by an estimate."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    return settings(spark, {adaptive: spark.conf.get(adaptive, None) or spark.conf.get(static), static: "-1"})


def file_system(spark: SparkSession, path: str):
    """Hadoop's Path and FileSystem of ``path``, whatever store it is in."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, system = file_system(spark, path)
    system.delete(where, True)


def written(df: DataFrame, name: str, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    # partition columns come last on reading
    fields = [f for f in df.schema if f.name not in partition_by] + [df.schema[c] for c in partition_by]
    found = spark.read.schema(type(df.schema)(fields)).parquet(path)
    found._tidemark_path = path
    return found


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing is left to read it."""
    path, paths = df._tidemark_path, df.sparkSession.sparkContext._tidemark_paths
    delete(df.sparkSession, path)
    if path in paths:
        paths.remove(path)


def step(spark: SparkSession, make, name: str) -> DataFrame:
    """What ``make`` gives, written; what was written on the way goes."""
    checkpoint_root(spark)
    start = len(getattr(spark.sparkContext, "_tidemark_paths", []))
    made = written(make(), name)
    paths = spark.sparkContext._tidemark_paths
    for path in paths[start:]:
        if path != made._tidemark_path:
            delete(spark, path)
            paths.remove(path)
    return made


def lower_ascii(text):
    """A-Z lower-cased, all else kept. ``lower`` is the fast way where a text has ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class IdRanges:
    """Ranges of (key, tie) of like size, numbered from 0 in that order, null keys first.

    Bounds are approximate percentiles of the key, read from that column alone. A key that holds several shares of the
    rows, or the null keys, are split further by ``tie``, a hash: percentiles that repeat a key tell how many shares it has.
    """

    def __init__(self, docs: DataFrame, key: str, count: int):
        self.key, self.bounds, self.extra, nulls = key, [], [], 0
        if count > 1:
            shares = [i / count for i in range(1, count)]
            row = docs.agg(F.approx_percentile(key, shares, 1000).alias("b"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count("*").alias("n")).first()
            nulls = round(count * row["nulls"] / row["n"]) if row["n"] else 0
            for bound, same in itertools.groupby(sorted(row["b"] or [])):
                self.bounds.append(bound)
                self.extra.append(sum(1 for _ in same) - 1)
        self.nulls = max(1, nulls)
        self.split = self.nulls > 1 or any(self.extra)
        self.starts = [self.nulls if self.nulls > 1 else 0]  # the number of the range that ends with each bound, and of the last
        for extra in self.extra:
            self.starts.append(self.starts[-1] + 1 + extra)
        self.count = self.starts[-1] + 1

    def of(self, tie: Column | None = None) -> Column:
        """The range of a row; ``tie`` (a long, spread over all values) is needed only if ``split``."""
        key = F.col(self.key)
        part = lambda n: F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
        none = part(F.lit(self.nulls)) if self.nulls > 1 else F.lit(0)
        if not self.bounds:
            return F.when(key.isNull(), none).otherwise(self.starts[0]).cast("int")
        width = max(1, math.isqrt(len(self.bounds)))
        rows = [self.bounds[i : i + width] for i in range(0, len(self.bounds), width)]
        below = lambda values: F.size(F.filter(values, lambda b: b < key))
        row = F.greatest(below(F.array(*[F.lit(r[0]) for r in rows])), F.lit(1))
        within = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows]), row)
        place = (row - 1) * width + below(within)
        found = F.get(F.array(*map(F.lit, self.starts)), place)
        hot = {b: (s, e) for b, s, e in zip(self.bounds, self.starts, self.extra, strict=False) if e}
        for bound, (start, extra) in hot.items():  # at most one for every two ranges
            found = F.when(key == bound, start + 1 + part(F.lit(extra))).otherwise(found)
        return F.when(key.isNull(), none).otherwise(found).cast("int")


def record_batches(rows, schema: str, size: int = 4096):
    """Arrow batches of ``size`` rows (tuples), with the columns of a schema string such as "doc_id long, text string"."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))]
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*part, strict=True), fields, strict=True)], [name for name, _ in fields])


def batch_rows(batches):
    """The rows of Arrow batches as tuples, made a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 512).columns), strict=True)


def with_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that names each of its rows for good: the Parquet file it is in and its place there. A frame that
    is not read straight from Parquet is written first. Equal rows have different names, so they can be dealt apart."""
    from pyspark.errors import AnalysisException

    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    if "_metadata" not in df.columns:
        with contextlib.suppress(AnalysisException):
            found = df.select("*", place)
            found.schema  # resolved now, not when it is read
            return found
    (held,) = fresh(df.columns, "metadata")
    df = df.withColumnRenamed("_metadata", held) if "_metadata" in df.columns else df
    found = written(df, "rows").select("*", place)
    return found.withColumnRenamed(held, "_metadata") if held in found.columns else found


def row_hash(*columns: str) -> Column:
    """A hash of values and of the row's own name (``with_row``), so that rows that repeat whole are dealt apart."""
    *values, row = columns
    return F.xxhash64(*values, F.col(row)["file"], F.col(row)["row"])


def with_number(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long of its own for each row, the same whenever it is read: the number of its file and its place there."""
    (row,) = fresh([*df.columns, name], "row")
    named = with_row(df, row)
    files = named.select(F.col(row)["file"].alias("file")).distinct()
    at, no = fresh(named.columns, "file", "no")
    numbered = files.select(F.col("file").alias(at), (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias(no))  # as many as the scan lists
    found = named.join(F.broadcast(numbered), F.col(row)["file"] == F.col(at))
    return found.withColumn(name, F.shiftleft(no, 40) + F.col(row)["row"]).drop(row, at, no)


def first_of_components(rows: DataFrame, near: DataFrame, key: str, own: str) -> DataFrame:
    """``rows`` but for those that are not the first of their component by ``key`` (null last), then ``own``, a long of each
    row's own. near: doc_id (that long), component_id."""
    (id_,) = columns([key])
    ids = rows.select(id_.alias("id"), F.col(own).alias("doc_id"))
    placed = written(near.select("doc_id", "component_id").join(ids, "doc_id"), "components")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id"))
    groups = written(placed.groupBy("component_id").agg(F.min_by("doc_id", order).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    total = groups.agg(F.sum("n")).first()[0] or 0
    gone = lookup(placed, groups, ["component_id"], "n", total).where("doc_id <> first").select(F.col("doc_id").alias(own))
    return rows.join(gone, own, "left_anti").drop(own)


#: A key that holds one row in so many, or more, is broadcast by ``lookup``: there are at most so many such keys.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key; ``n`` says how many rows have it, out of ``total``).

    The at most ``HOT_SHARE`` keys with that share of the rows are broadcast. Their rows, and those with a null key, then go
    to tasks by their place in the scan, so no task of the join of the rest gets all rows of a key. ``rows`` is read from
    files, so that places stay the same if a task runs again.
    """
    values = [c for c in table.columns if c not in keys]
    tie, hot, rest = fresh([*rows.columns, *table.columns], "tie", "hot", "rest")
    packed = lambda name: F.struct(*columns(values)).alias(name)
    often = table.where(F.col(n) * HOT_SHARE >= total).select(*columns(keys), packed(hot))
    seldom = table.where(F.col(n) * HOT_SHARE < total).select(*columns(keys), F.lit(0).cast("long").alias(tie), packed(rest))
    none = F.lit(False)
    for key in columns(keys):
        none = none | key.isNull()
    spread = F.xxhash64(F.monotonically_increasing_id()).bitwiseOR(F.lit(1))  # never 0
    dealt = rows.join(F.broadcast(often), keys, "left").withColumn(tie, F.when(none | F.col(hot).isNotNull(), spread).otherwise(F.lit(0).cast("long")))
    found = dealt.join(seldom, [*keys, tie], "left")
    return found.select(*columns(rows.columns), *[F.coalesce(F.col(hot)[v], F.col(rest)[v]).alias(v) for v in values])
