"""Token ids as files of bit planes.

Documents are encoded where they are read and dealt to shards by ranges of their id; a shard is a run of
consecutive documents in ascending id order. In a shard the ids form one stream, cut into blocks of a
fixed number of ids; each block is transposed into bit planes (bit k of all its ids) and each plane is
compressed with zstandard. A file row is one shard: the documents with their lengths, the chunk index
(place, number of ids and plane sizes of each block) and the planes. Spark writes the rows, so that a
retried task leaves no second copy, on any store that Spark can write to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townbill.llm import common
from townbill.llm.tokens import encoder

SHARD_BYTES = 8 << 20
BLOCK_IDS = 65_536
INDEX = "array<struct<place:long,n_ids:int,planes:array<int>>>"
FILE = f"shard int, n_ids long, doc_ids array<long>, lengths array<long>, chunks {INDEX}, planes binary"


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of unsigned 32-bit ids, lowest bit first, as many as the largest id needs."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


def write_stream(ids: np.ndarray, block_ids: int = BLOCK_IDS, level: int = 3) -> tuple[list[dict], bytes]:
    """Chunk index and compressed planes of a stream of ids."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    chunks, out, place = [], [], 0
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        packed = [squeeze(p) for p in to_planes(block)]
        chunks.append({"place": place, "n_ids": len(block), "planes": [len(p) for p in packed]})
        out += packed
        place += sum(map(len, packed))
    return chunks, b"".join(out)


def read_stream(chunks: list[dict], planes: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the chunks first..last-1 of a stream; others are not touched."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    parts = []
    for chunk in chunks[first:last]:
        at, own = chunk["place"], []
        for size in chunk["planes"]:
            own.append(expand(planes[at : at + size]))
            at += size
        parts.append(from_planes(own, chunk["n_ids"]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every document, each followed by the end id, to the folder `path`.

    Null and empty texts are their end id alone. Documents without an id come last; rows with the same
    id follow each other in the order of their ids' bytes.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    size, = rows.agg(F.sum(common.n_bytes())).first()
    n = common.pieces_for(size, shard_bytes)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    bounds = np.unique(np.asarray(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in common.slices(batches):
            doc_ids = batch.column(0).to_pylist()
            shards = [len(bounds) if d is None else int(np.searchsorted(bounds, d, "right")) for d in doc_ids]
            ids = []
            for text in batch.column(1).to_pylist():
                own = np.frombuffer(enc.ids(text) + end, "<u4")
                small = bool(own.max() < 65_536)
                ids.append(bytes([small]) + (own.astype("<u2") if small else own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        streams = [np.frombuffer(x[1:], "<u2").astype(np.uint32) if x[0] else np.frombuffer(x[1:], "<u4") for x in table.column("ids").to_pylist()]
        chunks, planes = write_stream(np.concatenate(streams), block_ids)
        lengths = [len(s) for s in streams]
        row = {"shard": key[0].as_py(), "n_ids": sum(lengths), "doc_ids": table.column("doc_id").to_pylist(), "lengths": lengths, "chunks": chunks, "planes": planes}
        return pa.Table.from_pylist([row], schema=ARROW_FILE)

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, ids binary")
    encoded.groupBy("shard").applyInArrow(write, FILE).write.option("compression", "none").parquet(path)


ARROW_FILE = pa.schema(
    [
        ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("chunks", pa.list_(pa.struct([("place", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.int32()))]))), ("planes", pa.binary()),
    ]
)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; `ids` are little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["before"]
                ids = read_stream(row["chunks"], row["planes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                own = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + first, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    files = spark.read.schema(FILE).parquet(path)
    # one row per shard of bounded size: the running sum sees no documents
    before = files.select("shard", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # two numbers a shard go to where the files are read; neither files nor ids are shuffled
    return files.join(F.broadcast(before), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
