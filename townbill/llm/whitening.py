"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers. The distinct vectors are numbered without gaps, centred exactly and laid
out as a BlockMatrix; its transpose times itself gives the scatter matrix, whose eigenvectors are worked
out on the driver, as its size is that of one vector squared. The block matrix times the whitening matrix
projects the rows, and every given row finds its projection by its vector.

A product of a tall matrix with itself ends in one block. So its blocks meet in groups along the shared
dimension (`numMidDimSplits` of the Scala API), and only the groups' sums meet in one task. A product
keeps the coordinates of its blocks in the driver; past PANEL_BLOCKS of them the rows are multiplied in
panels, whose results are added or put side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townbill.llm import common

STEP = 64
SHIFT = 1_000_000
MOST = float(1 << 53)
BLOCK_VALUES = 1 << 17
BLOCK_COLUMNS = 1024
GROUP_BLOCKS = 8
PANEL_BLOCKS = 1 << 16
#: a direction with a smaller share of the variance is rounding error
LEAST_SHARE = 1e-13


def whole_numbers(vector: Column) -> Column:
    """floor(64 * entry) + 1000000 of every entry, null for a vector that has an entry without such a number."""
    entries = F.transform(vector, lambda c: c.cast("double") * F.lit(float(STEP)))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(MOST)))
    return F.when(~bad & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c).cast("long") + F.lit(SHIFT)))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, written once, with an `index` from 0 without gaps.

    The numbers of rows before each task's come from one row per task that wrote; their number is that of
    the shuffle partitions, so they are broadcast.
    """
    rows = common.stored(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftrightunsigned("at", 33)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(task.alias("task")).agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("task", task).join(F.broadcast(sizes.drop("rows")), "task").withColumn("index", F.col("before") + inside).drop("at", "task", "before")


@dataclass
class Blocks:
    """Rows of (index, values) as block matrices, a panel at a time."""

    rows: DataFrame
    n: int
    width: int
    panel_blocks: int = PANEL_BLOCKS

    def __post_init__(self) -> None:
        self.rows_each = max(1, BLOCK_VALUES // self.width)

    def panels(self):
        """(first row, block matrix) of each panel."""
        step = self.rows_each * self.panel_blocks
        for low in range(0, self.n, step):
            inside = self.rows.where((F.col("index") >= low) & (F.col("index") < low + step)) if self.n > step else self.rows
            vectors = inside.select((F.col("index") - F.lit(low)).alias("index"), array_to_vector("values").alias("vector"))
            indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), min(step, self.n - low), self.width)
            yield low, indexed.toBlockMatrix(self.rows_each, BLOCK_COLUMNS)

    def scatter(self) -> np.ndarray:
        """Transpose times itself, summed over the panels."""
        total = np.zeros((self.width, self.width))
        for _, a in self.panels():
            groups = common.pieces_for(common.pieces_for(a.numRows(), self.rows_each), GROUP_BLOCKS)
            total += _product(a.transpose(), a, groups).toLocalMatrix().toArray()
        return (total + total.T) / 2

    def times(self, matrix: np.ndarray) -> DataFrame:
        """(index, values): every row times a local matrix."""
        spark = self.rows.sparkSession
        parts = []
        right = _blocks_of(spark, matrix)
        for low, a in self.panels():
            rows = callMLlibFunc("getIndexedRows", _product(a, right, 1).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
            parts.append(rows.select((F.col("index") + F.lit(low)).alias("index"), vector_to_array("vector").alias("values")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _product(a: BlockMatrix, b: BlockMatrix, groups: int) -> BlockMatrix:
    """The product, whose blocks along the shared dimension meet in so many groups; Python's own method lacks that argument."""
    done = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, groups)
    return BlockMatrix(done, a.rowsPerBlock, b.colsPerBlock)


def _blocks_of(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    rows = spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(matrix)], ["index", "vector"])
    return IndexedRowMatrix(rows, *matrix.shape).toBlockMatrix(BLOCK_COLUMNS, BLOCK_COLUMNS)


@dataclass
class Whitening:
    """What was fitted, and (x, deviation, whitened) of every distinct vector."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    table: DataFrame | None

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _covariance(rows: DataFrame, n: int, width: int, panel_blocks: int) -> np.ndarray:
    """Of rows (index, values): they are centred first, then multiplied, and divided by their number."""
    means = rows.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.avg("value").alias("mean")).orderBy("at")
    mean = F.lit(np.array([r["mean"] for r in means.collect()]))
    centred = rows.select("index", F.zip_with("values", mean, lambda v, m: v - m).alias("values"))
    return Blocks(centred, n, width, panel_blocks).scatter() / n


def fit(rows: DataFrame, count: int = 16, panel_blocks: int = PANEL_BLOCKS) -> Whitening:
    """Fits the whitening on the distinct values of the column `x` of whole numbers, and projects them.

    Each distinct x counts once. The components are the eigenvectors of the covariance (divisor n) of the
    largest eigenvalues, `count` of them at most; directions without variance are none. The covariance of
    what comes out is measured, and its largest difference from the identity kept.
    """
    fitted = numbered(rows.select("x").distinct())
    sums = fitted.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n"))
    sums = sums.orderBy("at").collect()
    if not sums:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, None)
    n, total, width = sums[0]["n"], [int(r["sum"]) for r in sums], len(sums)
    # n * x - sum is exact; a number past a long is null here and taken as a double
    sum_of = F.lit(np.array(total, np.int64)) if max(map(abs, total)) < 1 << 63 else F.array(*[F.lit(None).cast("long") for _ in total])
    mean_of = F.lit(np.array([t / n for t in total]))
    gap = F.zip_with("x", sum_of, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n)), s))
    near = F.zip_with("x", mean_of, lambda x, m: x.cast("double") - m)
    exact = fitted.withColumn("gap", gap)
    centred = exact.select("index", F.zip_with("gap", near, lambda g, d: F.coalesce(g.cast("double") / F.lit(float(n)), d)).alias("values"))
    covariance = Blocks(centred, n, width, panel_blocks).scatter() / n
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = np.argsort(-values, kind="stable")[:count]
    order = order[values[order] > LEAST_SHARE * trace]
    values, vectors = values[order], vectors[:, order]
    model = Whitening(n, total, values, vectors, trace, 0.0, None)
    if len(order):
        projected = common.stored(Blocks(centred, n, width, panel_blocks).times(vectors / np.sqrt(values)), "projected")
        model.identity_error = float(np.abs(_covariance(projected, n, len(order), panel_blocks) - np.eye(len(order))).max())
        deviation = F.aggregate("gap", F.lit(0).cast("long"), lambda s, g: F.try_add(s, F.try_multiply(g, g)))
        model.table = exact.withColumn("deviation", deviation).join(projected, "index").select("x", "deviation", F.col("values").alias("whitened"))
    return model


def whiten(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), count: int = 16, panel_blocks: int = PANEL_BLOCKS) -> tuple[DataFrame, Whitening]:
    """(row, n, deviation, whitened) of the usable rows, and the model; `row` holds the columns in `keep`.

    A row goes if its vector is null or empty, holds a null, infinite or NaN entry or one of 2^47 or more,
    or is not as long as most vectors are (of equally frequent lengths the longest counts). Rows of one
    vector all get its projection; they count once in the fit. `deviation` is null past a long. A table
    without usable rows, or with one vector only, has no components and gives no rows.
    """
    rows = vectors.select(F.struct(*[vectors[c] for c in keep]).alias("row"), whole_numbers(vectors[vector]).alias("x")).where(F.col("x").isNotNull())
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.col("rows").desc(), F.col("width").desc()).first()
    rows = rows.where(F.size("x") == (usual["width"] if usual else 0))
    model = fit(rows, count, panel_blocks)
    if model.table is None:
        none = rows.where(F.lit(False))
        return none.select("row", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), model
    # vectors are compared and sorted by a hash first; a vector that many rows share is on the side that adaptive execution splits
    mine, told = rows.withColumn("hash", F.xxhash64("x")), model.table.withColumn("hash", F.xxhash64("x"))
    return mine.join(told, ["hash", "x"]).select("row", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened"), model
