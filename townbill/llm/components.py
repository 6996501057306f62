"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townbill.llm import common


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node each can reach."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of the links of one batch."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        half = len(at) // 2
        label = smallest_labels(at[:half], at[half:], len(nodes))
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    `links` holds (a, b) as longs. Every batch is first reduced to stars. Then, until nothing changes,
    each node's larger neighbours are tied to its smallest, and each node and its smaller neighbours to
    the smallest of them. The smallest neighbours are aggregates that combine before the exchange, and
    join back as one row per node, so that the links of a hub are split among tasks.
    """
    known = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = common.cut(known.mapInArrow(_forest, "a long, b long").distinct())
    while True:
        size = edges.count()
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b")))
        after = common.cut(small.where("a <> b").distinct())
        if after.count() == size and after.exceptAll(edges).isEmpty():
            break
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
