"""Whitening of embeddings with distributed block matrices.

Entries are scaled and rounded down to whole numbers. Each distinct vector counts once in the fit: numbered and centred,
these rows become an MLlib block matrix whose transpose is multiplied with it for the scatter, over many splits of the
rows at once. Eigenvectors of that square of the dimensions are taken on the driver; all rows, numbered and centred too,
are projected by a multiplication of their blocks with the whitening matrix. So nothing on the driver or in one task
grows with the rows, and a vector that many rows share makes one row of the fit.

Defined results: null vectors and vectors with null, NaN or infinite entries give no row; a vector shorter than the
longest counts as zero in the entries it lacks; repeated rows and ids are each answered; components whose variance is
zero, to double precision, can't be whitened and are left out, so a table of one distinct vector, or none, gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: Blocks of rows that one split of the transposed product takes.
SPLIT_BLOCKS = 64
#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Components that are kept, and the least share of the greatest variance that is told from zero.
COMPONENTS, LEAST_VARIANCE = 4, 1e-12


def whole_entries(vector: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers; null for a vector that is null or holds a null, NaN or infinite entry."""
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(entries.isNotNull() & ~bad, F.transform(entries, lambda c: F.floor(c * scale)))


def numbered(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """df, written, with a column of numbers from 0 without gaps, and how many there are.

    A task numbers its own rows; what other tasks have is added from a table with a row for each task.
    """
    made = scratch.write(df.withColumn("__weft_id", F.monotonically_increasing_id()))
    task = F.shiftright("__weft_id", 33)
    sizes = made.groupBy(task.alias("__weft_task")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__weft_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.write(sizes.withColumn("__weft_before", F.coalesce(before, F.lit(0))))
    joined = made.withColumn("__weft_task", task).join(broadcast_if_small(offsets.drop("n")), "__weft_task")
    number = F.col("__weft_before") + F.col("__weft_id").bitwiseAND(F.lit((1 << 33) - 1))
    n = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return joined.withColumn(name, number).drop("__weft_task", "__weft_before", "__weft_id"), n


def block_matrix(rows: DataFrame, number: str, entries: str, n: int, dims: int) -> BlockMatrix:
    """The rows (number, entries as doubles) in blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(number).alias("index"), array_to_vector(entries).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b. What they are multiplied over is dealt to so many splits, whose products are then summed."""
    model = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, a.rowsPerBlock, b.colsPerBlock)


def second_moments(a: BlockMatrix, n: int) -> np.ndarray:
    """The mean of the outer products of the rows, a square of the dimensions. Splits hold a bounded number of rows."""
    return product(a.transpose(), a, max(1, -(-n // (BLOCK_ROWS * SPLIT_BLOCKS)))).toLocalMatrix().toArray() / n


def local_block(spark, matrix: np.ndarray) -> BlockMatrix:
    """A matrix of the driver in blocks."""
    cut = range(0, matrix.shape[0], BLOCK_COLUMNS)
    blocks = [((k, 0), DenseMatrix(len(part), matrix.shape[1], part.ravel("F").tolist())) for k, part in enumerate(matrix[i : i + BLOCK_COLUMNS] for i in cut)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), BLOCK_COLUMNS, BLOCK_COLUMNS, *matrix.shape)


def as_rows(matrix: BlockMatrix, number: str, entries: str) -> DataFrame:
    """(number, entries): the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model).toDF("__weft_at", "__weft_vector")
    return rows.select(F.col("__weft_at").alias(number), vector_to_array("__weft_vector", "float64").alias(entries))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, their shares of all, and unit eigenvectors as columns, by falling variance; zero variances left out."""
    e, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    e, vectors = e[::-1], vectors[:, ::-1]
    total = float(np.trace(covariance))
    keep = int((e > LEAST_VARIANCE * max(total, 0.0)).sum()) if total > 0 else 0
    keep = min(keep, most)
    return e[:keep], e[:keep] / total if keep else e[:0], vectors[:, :keep]


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The rows of df with a usable vector, with:

    whole (entries as whole numbers), n (distinct vectors), deviation (sum over the entries of (n * whole - S)^2, S being
    their sums over the distinct vectors; null if a long can't hold it), whitened and explained (an entry for each
    component), identity_error (the greatest entry of whitened's covariance over the fit, less the identity).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "whitening")
    new = ["whole", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.drop(*new).withColumn("whole", whole_entries(F.col(vector_col), scale)).where("whole is not null")
    rows, n_rows = numbered(rows, scratch, "__weft_row")
    dims = rows.agg(F.coalesce(F.max(F.size("whole")), F.lit(0))).first()[0]
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("whole"))
    rows = rows.withColumn("whole", F.concat("whole", zeros))
    fit, n = numbered(rows.select("whole").distinct(), scratch, "__weft_row")
    sums = [0] * dims
    for r in fit.select(F.posexplode("whole").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).toLocalIterator():
        sums[r.i] = int(r.s)
    means = [s / n for s in sums] if n else []
    centred = lambda d: d.select("__weft_row", F.zip_with("whole", F.array(*map(F.lit, means)).cast("array<double>"), lambda x, m: x - m).alias("centred"))
    if n and dims:
        # Kept, on disk where memory is short, since the products read the blocks several times; lost ones are made again.
        matrix = block_matrix(centred(fit), "__weft_row", "centred", n, dims).persist(StorageLevel.MEMORY_AND_DISK)
        e, explained, vectors = components_of(second_moments(matrix, n), components)
    else:
        e, explained, vectors = np.zeros(0), np.zeros(0), np.zeros((dims, 0))
    if not len(e):
        empty = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return rows.drop("__weft_row").where("false").withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    to_white = local_block(spark, vectors / np.sqrt(e))
    white_fit = product(matrix, to_white).persist(StorageLevel.MEMORY_AND_DISK)
    error = float(np.abs(second_moments(white_fit, n) - np.eye(len(e))).max())
    white = as_rows(product(block_matrix(centred(rows), "__weft_row", "centred", n_rows, dims), to_white), "__weft_row", "whitened")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: F.try_add(s, x))
    as_long = lambda s: F.lit(s if abs(s) < 1 << 63 else None).cast("long")
    away = F.zip_with("whole", F.array(*map(as_long, sums)), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    squares = total(F.transform(away, lambda d: F.try_multiply(d, d)))
    out = rows.withColumns({"n": F.lit(n).cast("long"), "deviation": squares, "explained": F.array(*map(F.lit, explained.tolist())), "identity_error": F.lit(error)})
    return out.join(white, "__weft_row").drop("__weft_row").select(*rows.drop("__weft_row").columns, *new[1:])
