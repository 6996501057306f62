"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A difference cover D of the residues mod v has for any two places i, j a shift d < v that brings both
into the cover. So two equal windows of `length` bytes hold, at one shift, two equal cover samples of
length - v + 1 bytes, and it is enough to name the samples, a small share of all places.

1. Every block of texts names its samples and asks the sample buckets which names occur elsewhere.
2. A window without a repeated sample cannot be repeated. The others are dealt to suffix buckets by the
   smallest fingerprint of the short strings in them, which equal windows share; neighbouring windows of
   one bucket travel as one piece of text, equal pieces of a block once.
3. A bucket is sorted part by part, each of bounded size: first by the v bytes at either end of the
   windows, then long ties by the ranks of the cover samples, which are worked out before for the part.
   Windows that end up equal are compared byte by byte.
4. The repeated windows go back to their blocks, which cut them out.

The texts are shuffled once, for all passes. A bucket gets one copy of a piece per block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townbill.llm import blocks, common
from townbill.llm.blocks import U64, Block, Fingerprints

LENGTH = 400
SAMPLES_EACH = 2_000_000
PART_BYTES = 2 << 20
SHORT = 16


def cover(length: int) -> tuple[np.ndarray, int]:
    """A difference cover and its modulus, at most half of `length`, by the steps of Colbourn and Ling."""
    r = -1
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length // 2:
        r += 1
    if r < 0:
        return np.zeros(1, np.int64), 1
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.concatenate([[0], np.cumsum(steps)]), 24 * r * r + 36 * r + 13


def shifts(d: np.ndarray, v: int) -> np.ndarray:
    """For a difference c of two residues, an x in the cover with x + c in it too."""
    inside = np.zeros(v, bool)
    inside[d] = True
    return np.array([next(x for x in d if inside[(x + c) % v]) for c in range(v)], dtype=np.int64)


def _sample_places(n: int, length: int) -> tuple[np.ndarray, int]:
    d, v = cover(length)
    size = length - v + 1
    places = (np.arange(-(-n // v), dtype=np.int64)[:, None] * v + d[None, :]).ravel()
    return places[places + size <= n], size


def _named_samples(block: Block, prints: Fingerprints, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover samples that lie in one long enough text, and their bucket-and-name keys."""
    places, size = _sample_places(len(block.data), length)
    doc = np.searchsorted(block.ends, places, "right")
    inside = (places + size <= block.ends[doc]) & (block.ends[doc] - block.starts[doc] >= length)
    places = places[inside]
    return places, blocks.split_names(prints.at(places, size), buckets)


def _ask(length: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block.of(table)
        _, keys = _named_samples(block, Fingerprints.of_bytes(block.data), length, buckets)
        keys = np.unique(keys)
        names = (keys & U64(0xFFFFFFFF)).astype("<u4")
        cut = blocks.by_bucket(keys)
        return pa.table({"bucket": pa.array([b for b, _, _ in cut], pa.int64()), "block": pa.array([key[0].as_py()] * len(cut), pa.int64()), "names": pa.array([names[a:z].tobytes() for _, a, z in cut], pa.binary())})

    return ask


def repeated_names(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block, which of its names another block has too."""
    parts = [np.frombuffer(x, "<u4") for x in table.column("names").to_pylist()]
    names = np.concatenate(parts)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(names), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    own = [flags[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
    some = [i for i, f in enumerate(own) if f.any()]
    return pa.table({"block": table.column("block").take(pa.array(some, pa.int64())), "bucket": pa.array([key[0].as_py()] * len(some), pa.int64()), "bits": pa.array([blocks.bits(own[i]) for i in some], pa.binary())})


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of `width`, by running minima from both ends of stretches."""
    n = len(values)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(U64).max, U64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    np.minimum.accumulate(rows[:, ::-1], axis=1, out=rows[:, ::-1])
    return np.minimum(padded[: n - width + 1], ahead[width - 1 : n])


def _candidates(length: int, buckets: int):
    def candidates(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        none = {"piece_key": [], "block": [], "offsets": [], "piece": []}
        block = Block.of(docs)
        n = len(block.data)
        prints = Fingerprints.of_bytes(block.data)
        places, own = _named_samples(block, prints, length, buckets)
        keys, back, count = np.unique(own, return_inverse=True, return_counts=True)
        hit = count > 1
        for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            low, high = np.searchsorted(keys, np.array([bucket << 32, (bucket + 1) << 32], U64))
            hit[low:high] |= blocks.unbits(packed, high - low)
        places = places[hit[back]]
        if not len(places):
            return pa.table(none, schema=PIECES)
        _, v = cover(length)
        doc = np.searchsorted(block.ends, places, "right")
        first = np.maximum(places - v + 1, block.starts[doc])
        last = np.minimum(places, block.ends[doc] - length) + 1
        good = last > first
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, first[good], 1)
        np.subtract.at(change, last[good], 1)
        windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(windows):
            return pa.table(none, schema=PIECES)
        short = min(SHORT, length)
        least = _smallest(prints.windows(short), length - short + 1)[windows]
        edge = np.flatnonzero((np.diff(windows) != 1) | (least[1:] != least[:-1])) + 1
        begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(windows)]])
        found: dict[tuple[int, bytes], list[int]] = {}
        raw = block.data.tobytes()
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            at = int(windows[a])
            found.setdefault((int(least[a]), raw[at : int(windows[z - 1]) + length]), []).append(at)
        number = key[0].as_py()
        return pa.table(
            {"piece_key": [k - (1 << 63) for k, _ in found], "block": [number] * len(found), "offsets": list(found.values()), "piece": [p for _, p in found]},
            schema=PIECES,
        )

    return candidates


PIECES = pa.schema([("piece_key", pa.int64()), ("block", pa.int64()), ("offsets", pa.list_(pa.int32())), ("piece", pa.binary())])


def _cover_ranks(text: np.ndarray, d: np.ndarray, v: int, size: int) -> np.ndarray:
    """Ranks in byte order of the strings of `size` bytes at the cover samples, 0 elsewhere.

    `size` is v times a power of two: the ranks of v bytes are doubled in length, as the place v on from
    a sample is one too.
    """
    n = len(text)
    places = (np.arange(-(-n // v), dtype=np.int64)[:, None] * v + d[None, :]).ravel()
    places = places[places + v <= n]
    if v >= 8:
        words = _words(text, ">u8")
        parts = [words[places + at] for at in [*range(0, v - 7, 8), v - 8]]
    else:
        parts = [text[places + at] for at in range(v)]
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(places), bool)
    for part in parts:
        new[1:] |= part[order[1:]] != part[order[:-1]]
    rank = np.zeros(n + size + 1, np.int64)
    rank[places[order]] = np.cumsum(new) + 1
    step = v
    while step < size:
        both = rank[places] * (len(places) + 2) + rank[places + step]
        rank[places] = np.unique(both, return_inverse=True)[1] + 1
        step *= 2
    return rank


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return np.ascontiguousarray(rows).view(kind).ravel().astype(np.uint64)


def repeated_windows(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of `text` at the given places have an equal one among them."""
    out = np.zeros(len(windows), bool)
    if len(windows) < 2:
        return out
    d, v = cover(length // 2)
    prints = Fingerprints.of_bytes(text)
    size = v
    while 2 * size <= length - v + 1:
        size *= 2
    rank = _cover_ranks(text, d, v, size)
    # a sample of `size` bytes at a shift below v leaves at most the first v and the last length - size bytes
    ends = prints.at(windows, v) * U64(3) + prints.at(windows + size, length - size)
    order = np.argsort(ends, kind="stable")
    new = np.concatenate([[True], np.diff(ends[order]) != 0])
    x = shifts(d, v)
    group = np.cumsum(new)
    # split the groups by the ranks at the shift each member shares with its group's first: as the ranks
    # are in byte order, equal windows fall on the same side whatever their shifts
    todo, done, classes = order, [], 0
    while len(todo):
        head = np.concatenate([[True], group[1:] != group[:-1]])
        size_of = np.diff(np.concatenate([np.flatnonzero(head), [len(todo)]]))
        alone = np.repeat(size_of == 1, size_of)
        todo, group, head = todo[~alone], group[~alone], head[~alone]
        if not len(todo):
            break
        size_of = size_of[size_of > 1]
        pivot = np.repeat(windows[todo[head]], size_of)
        mine = windows[todo]
        shift = (x[(mine - pivot) % v] - pivot) % v
        side = rank[mine + shift] - rank[pivot + shift]
        equal = side == 0
        done.append((todo[equal], group[equal] + classes))
        classes += int(group.max()) + 1
        todo, group, side = todo[~equal], group[~equal], side[~equal]
        split = np.argsort(group * 2 + (side > 0), kind="stable")
        todo = todo[split]
        parted = (group * 2 + (side > 0))[split]
        group = np.cumsum(np.concatenate([[True], parted[1:] != parted[:-1]])) if len(parted) else parted
    if not done:
        return out
    members, cls = np.concatenate([m for m, _ in done]), np.concatenate([c for _, c in done])
    head = np.concatenate([[True], cls[1:] != cls[:-1]])
    size_of = np.diff(np.concatenate([np.flatnonzero(head), [len(cls)]]))
    many = np.repeat(size_of > 1, size_of)
    members, head, size_of = members[many], head[many], size_of[size_of > 1]
    if not len(members):
        return out
    first = np.repeat(windows[members[head]], size_of)
    same = _equal(text, windows[members], first, length)
    out[members[same & ~head]] = True
    out[members[head]] = np.logical_or.reduceat(same & ~head, np.flatnonzero(head))
    # members that differ from their class's first: fingerprints met by chance
    odd = members[~same]
    if len(odd):
        by_text: dict[bytes, list[int]] = {}
        for m in odd.tolist():
            by_text.setdefault(text[windows[m] : windows[m] + length].tobytes(), []).append(m)
        for own in by_text.values():
            if len(own) > 1:
                out[own] = True
    return out


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at a and b hold the same bytes, eight at a time."""
    if length < 8:
        return np.array([bool((text[i : i + length] == text[j : j + length]).all()) for i, j in zip(a, b, strict=True)], bool)
    words = _words(text, "<u8")
    same = words[a] == words[b]
    left = np.flatnonzero(same)
    for at in [*range(8, length - 7, 8), length - 8]:
        good = words[a[left] + at] == words[b[left] + at]
        if not good.all():
            same[left[~good]] = False
            left = left[good]
    return same


def _sort_bucket(length: int, part_bytes: int):
    def sort_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_key", "ascending")]).combine_chunks()
        keys = table.column("piece_key").to_numpy()
        pieces, offsets, number = table.column("piece").to_pylist(), table.column("offsets"), table.column("block")
        twice = np.array([len(o) > 1 for o in offsets.to_pylist()], bool)
        take, flags = [], []
        at = 0
        while at < len(keys):
            # whole suffix keys, until the part is large enough
            part: dict[bytes, list[int]] = {}
            size, end = 0, at
            while end < len(keys) and (size < part_bytes or keys[end] == keys[end - 1]):
                if pieces[end] not in part:
                    size += len(pieces[end])
                part.setdefault(pieces[end], []).append(end)
                end += 1
            lengths = np.array([len(p) for p in part], np.int64)
            starts = np.cumsum(lengths) - lengths
            count = lengths - length + 1
            first = np.cumsum(count) - count
            windows = np.repeat(starts - first, count) + np.arange(int(count.sum()))
            found = repeated_windows(np.frombuffer(b"".join(part), np.uint8), windows, length)
            for rows, f, c in zip(part.values(), first.tolist(), count.tolist(), strict=True):
                own = np.ones(c, bool) if len(rows) > 1 or twice[rows[0]] else found[f : f + c]
                if own.any():
                    packed = blocks.bits(own)
                    take += rows
                    flags += [(packed, c)] * len(rows)
            at = end
        chosen = pa.array(take, pa.int64())
        return pa.table({"block": number.take(chosen), "offsets": offsets.take(chosen), "n": pa.array([c for _, c in flags], pa.int32()), "bits": pa.array([b for b, _ in flags], pa.binary())})

    return sort_bucket


def _remove(length: int, as_text: bool):
    def remove(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        block = Block.of(docs)
        marks = np.zeros(len(block.data), bool)
        for offsets, n, packed in zip(found.column("offsets").to_pylist(), found.column("n").to_pylist(), found.column("bits").to_pylist(), strict=True):
            own = blocks.unbits(packed, n)
            for at in offsets:
                marks[at : at + n] |= own
        gone = blocks.spread(marks, length)
        kept, spans = [], []
        for a, z in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            own = gone[a:z]
            if own.any():
                kept.append(block.data[a:z][~own].tobytes())
                begins, ends = blocks.runs(own)
                spans.append([{"start": s, "end": e} for s, e in zip(begins.tolist(), ends.tolist(), strict=True)])
            else:
                kept.append(block.data[a:z].tobytes())
                spans.append([])
        # bytes of characters that were cut through are no text
        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return pa.table(
            {"doc_id": block.ids, "row": block.rows, "n_bytes": pa.array(block.ends - block.starts), "kept": left, "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        )

    return remove


def suffix_dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = blocks.BLOCK_BYTES, samples_each: int = SAMPLES_EACH, part_bytes: int = PART_BYTES, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, row, n_bytes, kept, spans): what is left of each text, and the byte spans removed.

    A byte goes if a `length`-byte string over it also starts at any other place of any text. Null texts
    are empty and keep nothing; equal rows are repeats of each other; null ids are kept as they are. An
    empty table gives an empty table. Of other columns those in `carry` go along, as fields of `row`. With
    `as_text`, `kept` is text, without the bytes of characters that were cut through.
    """
    texts, size = blocks.in_blocks(docs, block_bytes=block_bytes, carry=carry)
    d, v = cover(length)
    sample_buckets = common.pieces_for(size * len(d) // v, samples_each)
    suffix_buckets = common.pieces_for(size, 4 * part_bytes)
    asked = texts.groupBy("block").applyInArrow(_ask(length, sample_buckets), "bucket long, block long, names binary")
    answers = asked.groupBy("bucket").applyInArrow(repeated_names, "block long, bucket long, bits binary")
    pieces = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_candidates(length, sample_buckets), "piece_key long, block long, offsets array<int>, piece binary")
    dealt = pieces.groupBy(F.pmod(F.xxhash64("piece_key"), F.lit(suffix_buckets)).alias("suffix_bucket"))
    found = dealt.applyInArrow(_sort_bucket(length, part_bytes), "block long, offsets array<int>, n int, bits binary")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(length, as_text), f"doc_id long, row {texts.schema['row'].dataType.simpleString()}, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<start:long,end:long>>")
