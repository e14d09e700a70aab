"""Helpers shared by the operators: scratch tables, Arrow maps, size-checked broadcasts, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import shared_dir

#: A table of at most so many rows, and of so many bytes, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Rows that a function of a batch gets at once, so that what it makes stays small.
SLICE_ROWS = 1024


#: Folders made by this process, for clear_scratch().
_FOLDERS: list[str] = []


class Scratch:
    """Written tables in the shared folder. They cut lineage, outlive executors and are read by column.

    Results may read them, so they stay until clear_scratch() is called.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _FOLDERS.append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def write_buckets(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """Writes a table bucketed by key, whose groups by key need no shuffle later on.

        The catalog, which alone can tell Spark of buckets, holds it only until its plan is known; the files stay.
        """
        self.n += 1
        path, name = f"{self.root}/{self.n}", f"weft_{uuid.uuid4().hex}"
        try:
            df.write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
            out = self.spark.table(name)
        finally:
            self.spark.sql(f"drop table if exists {name}")
        out._scratch = path
        return out

    def new_path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, df: DataFrame) -> None:
        """Deletes a table written here that nothing reads any more."""
        _delete(self.spark, df._scratch)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables that this process has made; call it when the results have been written or read."""
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


class Shared:
    """A value broadcast as its plain attributes, so that executors need no module of its class. Tasks must not change it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.cls, self.sent = type(value), spark.sparkContext.broadcast(vars(value))

    @property
    def value(self):
        out = self.cls.__new__(self.cls)
        out.__dict__.update(self.sent.value)
        return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver let go of shuffles that nothing refers to any more, whose files else stay on the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    # Workers are used again, and would keep what they no longer need.
    pa.default_memory_pool().release_unused()


def _width(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(0))
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).cast("long") * 8
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if its rows and their bytes are few; else Spark joins by shuffle."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], rows: int = SLICE_ROWS) -> DataFrame:
    """Appends columns computed from each Arrow batch; columns of df that already have these names are replaced.

    make() runs once in each task and returns the function of a batch.
    """
    names = {f.name.lower() for f in fields}
    df_kept = [f for f in df.schema.fields if f.name.lower() not in names]
    kept = [f.name for f in df_kept]
    out = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches, rows):
            new = f(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), *new], names=out)

    return df.mapInArrow(run, T.StructType([*df_kept, *fields]))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, whose split() cuts at \\x20 and \\x09-\\x0D alone."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once a row, also where f uses it within a lambda."""
    return F.transform(F.array(value), f)[0]


def crc_of_id(column: str):
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def _stars(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. edges: a > b, distinct.

    Minima are written, so that their join sees two plain shuffles and may split a node with very many edges.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = scratch.write(large)
    low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    out = scratch.write(small.where("a > b").distinct())
    for done in (least, large, low):
        scratch.drop(done)
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), by alternating large and small stars.

    Minima combine before the shuffle, so a node with very many edges makes one row in each task; links never
    reach the driver, only a count and a checksum of the edges do. root is the least node of the component.
    """
    scratch = Scratch(spark, "components")
    at = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
    was = mark(at)
    while was[0]:
        new = _stars(scratch, at)
        scratch.drop(at)
        at, now = new, mark(new)
        if now == was:
            break
        was = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
