"""What a task leaves behind in its worker, and what it holds at its peak."""

import os
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from townbill.llm import blocks, common, spelling, suffix_dedup, tokens


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_a_worker_gives_back_what_it_freed():
    held = [bytes(1000) for _ in range(200_000)]
    last = held[::1000]
    before = resident()
    del held
    common.keep_only()
    assert last and before - resident() > 100 << 20


def test_spelling_drops_what_earlier_steps_left():
    left = []
    common.cached("test", left.clear)
    try:
        words = pa.RecordBatch.from_pydict({"word": ["sesquipedalian"], "n": pa.array([2], pa.int64())})
        layout = spelling.Layout.of({14: 1})
        left.append(1)
        assert list(spelling._hashes(layout)(iter([words])))[0].num_rows == 1 and not left
    finally:
        common._CACHES.pop("test")


def peak(call):
    call()  # fills caches
    tracemalloc.start()
    call()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_suffix_steps_hold_few_copies_of_a_block():
    n = 1 << 20
    values = np.random.default_rng(1).integers(0, 1 << 63, n, dtype=np.uint64)
    least = suffix_dedup._smallest(values, 185)
    assert len(least) == n - 184 and all(least[i] == values[i : i + 185].min() for i in range(0, n - 185, 9973))
    assert peak(lambda: suffix_dedup._smallest(values, 185)) < 28 * n
    prints = blocks.Fingerprints(values)
    assert peak(lambda: prints.windows(16)) < 26 * n


def test_plain_words_are_not_searched_for_added_tokens(tokenizer):
    enc = tokens.Encoder(tokenizer)
    want = [enc._whole(p) for p in (b"hello", b"unheardofword", b"it's", b"word,")]

    class Searched(list):
        def __iter__(self):
            raise AssertionError("searched")

    added, enc.added = enc.added, Searched(enc.added)
    assert [enc._encode(p) for p in (b"hello", b"unheardofword")] == want[:2]
    enc.added = added
    assert [enc._encode(p) for p in (b"it's", b"word,")] == want[2:]
