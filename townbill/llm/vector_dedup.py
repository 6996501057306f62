"""Near-duplicate vectors by PCA-ordered tiled comparison.

The second moments of all unit vectors are summed over the whole table and give an orthonormal basis,
largest direction first; a rotation leaves cosines as they are. Equal vectors of a label are one class
with a count. Linked classes are closer than r = sqrt(2 - 2 * threshold), so in each leading direction
too: classes are dealt to cells of width r in the first two directions, cells to tiles of bounded size,
and tiles are compared within a cell and with the cells around it. A comparison adds up the leading
directions first, bounds the rest of each product by the norms of what is left of both vectors, and goes
on only with pairs that can still reach the threshold. Those that get to the end are judged by the
cosine of the given vectors in double precision.

A comparison gives back link counts and a star per group of linked classes, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townbill.llm import common
from townbill.llm.components import components, smallest_labels

THRESHOLD = 0.93
TILE = 1024
STRIP = 8
SLACK = 1e-9


def usable(vector: str = "embedding"):
    """Vectors that have a direction: not null, not zero, no null or non-finite component."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def basis(vectors: DataFrame, size: int) -> np.ndarray:
    """Principal directions of the unit vectors of one width, largest first, from sums over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    rows = vectors.select("embedding").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "m"))
    total = np.zeros(size * size)
    for row in rows.groupBy("i").agg(F.sum("m").alias("m")).collect():
        total[row["i"]] = row["m"]
    return np.linalg.eigh(total.reshape(size, size))[1][:, ::-1].copy()


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, strip: int = STRIP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (unit vectors in the basis) whose product may reach the threshold."""
    width = a.shape[1]
    left = lambda x, at: np.sqrt(np.maximum(0.0, (x[:, at:] ** 2).sum(axis=1)))
    got = a[:, :strip] @ b[:, :strip].T
    i, j = np.nonzero(got + left(a, strip)[:, None] * left(b, strip)[None, :] >= threshold - SLACK)
    got = got[i, j]
    for at in range(strip, width, strip):
        got = got + (a[i, at : at + strip] * b[j, at : at + strip]).sum(axis=1)
        alive = got + left(a, at + strip)[i] * left(b, at + strip)[j] >= threshold - SLACK
        i, j, got = i[alive], j[alive], got[alive]
    return i, j


def _links_of(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y with a cosine of `threshold` or more, in strips of bounded memory."""
    found = []
    ry = unit(y) @ axes
    for at in range(0, len(x), TILE):
        for to in range(0, len(y), TILE):
            i, j = close_pairs(unit(x[at : at + TILE]) @ axes, ry[to : to + TILE], threshold)
            i, j = i + at, j + to
            keep = np.zeros(len(i), bool)
            for k in range(0, len(i), 1 << 16):
                p, q = x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]
                p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
                cos = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
                keep[k : k + (1 << 16)] = cos >= threshold
            found.append((i[keep], j[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        cls, count, x = table.column("cls").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("embedding"))
        own = axes[x.shape[1]]
        if second.any():
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
            i, j = _links_of(x[left], x[right], own, threshold) if len(left) else (np.zeros(0, int), np.zeros(0, int))
            i, j = left[i], right[j]
        else:
            i, j = _links_of(x, x, own, threshold)
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, weights=count[j], minlength=len(x)) + np.bincount(j, weights=count[i], minlength=len(x))
        label = smallest_labels(i, j, len(x))
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "n_links": links[some].astype(np.int64), "to": cls[label[some]]})

    return compare


def vector_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors` (vec_id, embedding, label).

    Vectors link only within one label that is not null, and only with vectors of their own width. Null
    and zero vectors and those with a null or non-finite component have no links and are their own
    components, as has a row without an id, whose component is null and which is kept. Rows with equal
    ids count as separate vectors. An empty table gives an empty table.
    """
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"), vectors["label"].alias("label"))
    rows = rows.withColumn("ok", usable() & F.col("label").isNotNull())
    good = rows.where("ok")
    # equal vectors are one class; -0.0 and 0.0 are equal
    same = F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0.0)))
    classes = good.withColumn("cls", same).groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"), F.any_value("label").alias("label"))
    classes = common.stored(classes, "vectors")
    widths = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    axes = {w: basis(classes.where(F.size("embedding") == w), w) for w in widths}
    reach = float(np.sqrt(max(2 - 2 * threshold, 1e-12)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            long = np.asarray(vectors.value_lengths())
            at = np.zeros((len(long), 2), np.int32)
            for w in np.unique(long[long > 1]):
                own = np.flatnonzero(long == w)
                at[own] = np.floor(unit(_matrix(vectors.take(pa.array(own)))) @ axes[int(w)][:, :2] / reach)
            c1, c2 = at[:, 0], at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=[*batch.schema.names, "c1", "c2"])

    # a tiny margin, so that rounding cannot put a pair of the threshold two cells apart
    reach *= 1 + 1e-6
    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("cls", "n", "embedding", "label").mapInArrow(cells, f"cls long, n long, embedding array<double>, label {kind}, c1 int, c2 int")
    cell = ["label", "width", "c1", "c2"]
    placed = placed.withColumn("width", F.size("embedding"))
    directory = placed.groupBy(*cell).agg(F.count("*").alias("rows")).select(*cell, F.ceil(F.col("rows") / F.lit(tile)).cast("int").alias("tiles"))
    directory = common.stored(directory, "cells")
    own = placed.join(directory, cell).withColumn("t", F.pmod("cls", F.col("tiles")).cast("int"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = own.withColumn("step", step).withColumn("mine", F.struct("c1", "c2", "t")).withColumn("c1", F.col("c1") + F.col("step.i")).withColumn("c2", F.col("c2") + F.col("step.j")).drop("tiles", "step", "t")
    near = near.join(directory, cell).withColumn("other_t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    near = near.withColumn("other", F.struct("c1", "c2", F.col("other_t").alias("t")))
    tasks = near.select("label", "width", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).alias("second"), "cls", "n", "embedding")
    found = common.stored(tasks.groupBy("label", "width", "one", "two").applyInArrow(_compare(axes, threshold), "cls long, n_links long, to long"), "links")
    counts = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    told = classes.select("cls", "n", "first").join(counts, "cls", "left").join(groups, classes["cls"] == groups["node"], "left")
    told = common.stored(told.select("cls", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), "first", F.coalesce("component", "cls").alias("component")), "classes")
    least = told.groupBy("component").agg(F.min("first").alias("component_id"))
    told = told.join(least, "component").select("cls", "n_links", "component_id")
    linked = good.select("vec_id", same.alias("cls")).join(told, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))
