"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

Documents are encoded where they are read; only one narrow row per piece goes on. Full pieces are
sequences by themselves. The others are dealt by hash to groups of a bounded number of pieces, each
packed in one task: longest piece first, each placed into the open sequence for which the sum of the
squared counts of open sequences per residual gap becomes smallest. A new sequence is opened only when
none has room, so that at most one sequence of a group stays less than half full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townbill.llm import common
from townbill.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the given order."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by gap
    counts = np.zeros(capacity + 1, dtype=np.int64)
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        have = counts[size:]
        left = counts[: capacity + 1 - size]
        # change of the sum when a gap g becomes g - size; a sequence without a gap is closed and counts no more
        change = 2 * (left - have) + 2
        change[0] = 1 - 2 * have[0]
        change[have == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if have[best]:
            gap = best + size
            number = bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, opened
            opened += 1
        sequence[i], offset[i] = number, capacity - gap
        if rest := gap - size:
            bins[rest].append(number)
            counts[rest] += 1
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at `capacity`.

    A null or empty text is its end id alone. Null and repeated ids keep their own pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in common.slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.ids(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(cut, PIECE)


def pack_pieces(rows: DataFrame, capacity: int = 2048, per_group: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length`; `per_group` bounds what one task packs.

    Ties between equal lengths are broken by the rows' other columns, so that reruns agree.
    """
    full = rows.where(F.col("length") >= capacity)
    rest = rows.where(F.col("length") < capacity)
    n_full, n_rest = rows.agg(F.count_if(F.col("length") >= capacity), F.count_if(F.col("length") < capacity)).first()
    groups = common.pieces_for(n_rest, per_group)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = place(table.column("length").to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array(sequence * (groups + 1) + group))
        return table.append_column("offset", pa.array(offset)).drop_columns(["group"])

    shape = PIECE + ", sequence_id long, offset long"
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(pack, shape)
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * (groups + 1) + groups).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, per_group: int = 100_000) -> DataFrame:
    """One row per piece with its place. An empty table gives an empty table; other columns are not read."""
    return pack_pieces(common.stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, per_group)
