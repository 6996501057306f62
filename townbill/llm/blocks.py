"""Texts in blocks of bounded size, and fingerprints of their substrings.

Repeats are looked for in two directions: a block asks about the fingerprints it holds, each once,
in one message per bucket of fingerprints; the bucket answers with one bit for each. Neither texts nor
places travel, and a string that a third of all documents share costs one entry per block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townbill.llm import common

BLOCK_BYTES = 3 << 20
ODD = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(block, doc_id, text, row) with null texts empty, dealt evenly by hash, and the bytes of all texts.

    `row` holds the columns in `carry`, whatever their names.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*[docs[c] for c in carry] or [F.lit(None).cast("int").alias("none")]).alias("row"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = common.pieces_for(size, block_bytes)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), "doc_id", "text", "row"), size


@dataclass
class Block:
    """The texts of a block end to end, in an order that does not depend on how they arrived."""

    ids: pa.Array
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: pa.ChunkedArray

    @staticmethod
    def of(table: pa.Table) -> Block:
        common.keep_only("powers")
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = table.column("text").cast(pa.large_binary())
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        return Block(table.column("doc_id"), data, at[:-1], at[1:], table.column("row"))


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U64) | U64(1)


_POWERS: dict[int, np.ndarray] = {}
common.cached("powers", _POWERS.clear)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U64(base), dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Fingerprints:
    """64-bit fingerprints of any substring of a sequence of 64-bit values, from its running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.multiply(values, _powers(ODD, n), out=self.sums[1:])
        np.cumsum(self.sums, dtype=U64, out=self.sums)
        self.back = _powers(pow(ODD, -1, 1 << 64), n + 1)

    @staticmethod
    def of_bytes(data: np.ndarray) -> Fingerprints:
        return Fingerprints(_codes()[data])

    def at(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts])

    def windows(self, length: int) -> np.ndarray:
        """Of the windows at all places."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        h = self.sums[length:] - self.sums[:n]
        h *= self.back[:n]
        return mixed(h)


def split_names(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half and 32-bit name in the lower, as one sortable number."""
    return ((h >> U64(32)) % U64(buckets)) << U64(32) | (h & U64(0xFFFFFFFF))


def by_bucket(keys: np.ndarray):
    """(bucket, from, to) of the runs of sorted bucket-and-name keys."""
    bucket = (keys >> U64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    lows = np.concatenate([[0], edges]) if len(keys) else edges
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(lows, [*edges, len(keys)], strict=False)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def spread(marks: np.ndarray, length: int) -> np.ndarray:
    """True at every place within `length` from a marked one on."""
    change = np.zeros(len(marks) + 1, np.int32)
    at = np.flatnonzero(marks)
    change[at] += 1
    np.subtract.at(change, np.minimum(at + length, len(marks)), 1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
