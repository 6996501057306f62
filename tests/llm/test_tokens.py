"""Token counts, packing and token files, against the library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from townbill.llm import common, packing, token_counts, token_files, tokens

LONG = "Thé quick, brown fox's 42 <|endoftext|> jumps... Ünïcode Ïs HERE! " * 2500
TEXTS = [
    (1, "Hello, World! it's 12 o'clock"), (2, None), (3, ""), (4, " \n\t "), (5, "<|ENDOFTEXT|> x <|endoftext|>y"), (6, "ÉTÉ é Σίσυφος ς ΑΣ"),
    (7, "a" * 5000), (8, LONG), (8, LONG), (9, "x y ź é"), (None, "no id"), (10, "日本語のテキスト。" * 400), (11, "don't,can't.stop;" * 3000), (12, "\x1c\x85|<|"),
]


def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="module")
def want(tokenizer):
    lib = library(tokenizer)
    return {t: np.asarray(lib.encode(t or "", add_special_tokens=False).ids, "<u4") for _, t in TEXTS}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "Don't", ",", ".", "%%", "*", "(", "É", "ÿ", "×", " ", "\n", "\x0b", " ", "é", "é", "́", "<|endoftext|>", "<|", "|>", "9", "ß", "İ", "Σ", "word", "_", "-", "日本"]), max_size=30))
def test_pieces_give_the_library_ids(parts):
    import public_tokenizers

    enc = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "".join(parts)
    assert enc.by_piece
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids


def word_level(folder, split, lowers=False, added=()):
    from tokenizers import Tokenizer, models, normalizers

    words = ["?", "The", "the", "a.", "a", ".", ",", "end", "é", "b,"]
    made = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="?"))
    made.pre_tokenizer = split
    if lowers:
        made.normalizer = normalizers.Lowercase()
    made.add_tokens(list(added))
    made.save(str(folder / "words.json"))
    return tokens.Encoder(str(folder / "words.json"))


def test_nothing_is_assumed_of_other_tokenizers(tmp_path):
    from tokenizers import pre_tokenizers

    texts = ["The the", "a. a .", "The END <E> end", "thethe,", "a.b, a.", "É é éa", "xthe end", "[the] THE", "", " ", "a.\n\x0bThe\u2003the"]
    for split in (pre_tokenizers.Whitespace(), pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation()])):
        for lowers in (False, True):
            for added in ((), ("<E>",), ("the",), ("two words",), ("É",)):
                enc = word_level(tmp_path, split, lowers, added)
                for text in texts:
                    got = np.frombuffer(enc.ids(text), "<u4").tolist()
                    assert got == enc.library.encode(text, add_special_tokens=False).ids, (split, lowers, added, text)


def test_pieces_outlive_a_full_cache(tokenizer):
    enc = tokens.Encoder(tokenizer)
    enc.LIMIT = 3
    text = " ".join(f"wörd{i % 7},; {i % 5}x the" for i in range(50))
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert len(enc) <= 3 and len(enc.old) <= 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the ", "Don't", ",", "...", "  ", "\n\n", "é", "é", "<|endoftext|>", "9", "abcdefghij" * 3, "日本", "a"]), max_size=60), st.integers(20, 60), st.integers(1, 12))
def test_chunks_are_spliced_right(name, parts, chunk, overlap):
    import public_tokenizers

    enc = tokens.encoder(public_tokenizers.path(name))
    text = "".join(parts)
    assert token_counts.count_chunked(enc, text, chunk, overlap) == len(enc.library.encode(text, add_special_tokens=False).ids)


def test_counts(make, tokenizer, want):
    for chunk in (64, 4096):
        got = token_counts.token_counts(make(TEXTS), tokenizer, chunk=chunk, overlap=16).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(d), len((t or "").encode()), len(want[t])) for d, t in TEXTS)


def test_packing(make, tokenizer, want):
    rows = packing.pack_documents(make(TEXTS), tokenizer, per_group=40).collect()
    pieces, bins = [], {}
    for d, t in TEXTS:
        ids = np.append(want[t], 0).astype("<u4")
        pieces += [(str(d), i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces)
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_place_is_gapless_and_any_fit(lengths):
    lengths = np.sort(np.array(lengths, dtype=np.int64))[::-1]
    sequence, offset = packing.place(lengths, 50)
    fill = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        assert fill.get(s, 0) == o
        fill[s] = o + n
    assert all(f <= 50 for f in fill.values()) and sum(f <= 25 for f in fill.values()) <= 1


def test_token_files(spark, make, tokenizer, want, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(make(TEXTS), path, tokenizer, shard_bytes=60_000, block_ids=1000)
    assert spark.read.parquet(path).count() > 1
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = np.append(want[t], 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (d, at, len(ids)) and bytes(r.ids) == ids.tobytes()
        at += len(ids)


def test_token_files_are_read_without_shuffling_ids(spark, make, tokenizer, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(make(TEXTS), path, tokenizer, shard_bytes=60_000)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_files.read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.integers(1, 64))
def test_planes_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    chunks, planes = token_files.write_stream(ids, block)
    assert token_files.read_stream(chunks, planes).tolist() == ids.tolist()
    assert token_files.read_stream(chunks, planes, 1, 2).tolist() == ids[block : 2 * block].tolist()


def test_empty_tables(spark, make, tokenizer):
    none = make([(1, "a")]).where("doc_id > 1")
    assert token_counts.token_counts(none, tokenizer).count() == 0
    assert packing.pack_documents(none, tokenizer).count() == 0
    path = common.new_path(spark, "none")
    token_files.write_tokens(none, path, tokenizer)
    assert token_files.read_tokens(spark, path).count() == 0
