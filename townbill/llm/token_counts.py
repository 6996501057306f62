"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where they agree.

A chunk is encoded with character offsets and the number of the pre-token of each token. No token
crosses a pre-token, and a pre-tokenizer that reads from left to right goes on alike from any place
where it starts a pre-token. So a place in the overlap where both chunks start one is proven stable if
it lies before the left chunk's last pre-token and further from its end than the longest added token:
left of it the left chunk is right, from it on the right chunk is. Where there is no such place, the
overlap is doubled, at last up to the place from which the left chunk counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from townbill.llm import common
from townbill.llm.tokens import Encoder, encoder

CHUNK = 16_384
OVERLAP = 256


def _starts(enc: Encoder, text: str, begin: int, end: int) -> tuple[list[int], dict[int, int]]:
    """Start of every token in text[begin:end], and the index of the first token of each pre-token by its start."""
    got = enc.library.encode(text[begin:end], add_special_tokens=False)
    starts = [begin + a for a, _ in got.offsets]
    first: dict[int, int] = {}
    last = object()
    for i, word in enumerate(got.word_ids):
        if word is None or word != last or (i and starts[i] < starts[i - 1]):
            first[starts[i]] = i
        last = word
    return starts, first


def count_chunked(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of `text`, with no more than a few chunks encoded at once."""
    total, base = 0, 0  # all tokens before `base` are counted; a pre-token starts at `base`
    begin, end = 0, min(chunk, len(text))
    starts, first = _starts(enc, text, begin, end)
    while end < len(text):
        wide, spliced = overlap, False
        while not spliced:
            left = max(base, end - wide)
            right = min(len(text), end + chunk)
            starts2, first2 = _starts(enc, text, left, right)
            limit = min(max(first, default=base), end - enc.longest_added)
            common = [p for p in first.keys() & first2.keys() if max(left, base) <= p < limit]
            if common or left == base:
                spliced = True
            else:
                wide *= 2
        if common:
            at = max(common)
            total += first[at] - (first[base] if base in first else 0)
            base = at
        # without one the right chunk reaches back to `base` and replaces the left one
        begin, end, starts, first = left, right, starts2, first2
    return total + len(starts) - (first[base] if base in first else 0)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of `docs`.

    Null and empty texts have no bytes and no tokens; null and repeated ids keep their own rows; other
    columns are not read. An empty table gives an empty table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in common.slices(batches):
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                tokens.append(len(enc.ids(text)) // 4 if len(text) <= chunk else count_chunked(enc, text, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
