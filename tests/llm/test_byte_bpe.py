"""Byte-level BPE against the tokenizer library, on single pieces, awkward rows and a whole table."""

from __future__ import annotations

import gc
import hashlib
import random
import weakref

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from ledgerline.llm import byte_bpe

SF_DIR = "/root/testdata/sf0.001"
RAW = byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
RANKS = byte_bpe.read_ranks(RAW)
ENCODER = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text: str) -> list[int]:
    return np.frombuffer(ENCODER.packed(text), dtype="<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("letters", ["ab", "aa a", "xyz \n", " \t\n.\x1c\x85x", "éàüa ñ1", "the an ing ", "日本語漢 ", "'s't"])
def test_random_runs(letters):
    source = random.Random(letters)
    for length in (1, 2, 7, 60, 700, 7000):
        text = "".join(source.choice(letters) for _ in range(length))
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_long_windows_equal_short_ones():
    source = random.Random(7)
    for _ in range(200):
        data = bytes(source.choice(b"abcdeingth") for _ in range(source.randint(1, 60)))
        assert ENCODER._merged_long(data) == ENCODER._merged_short(data)


def test_joining_is_associative():
    parts = [b"inter", b"nation", b"ali", b"zation", b"s"]
    left = ENCODER.reduced(parts[0])
    for part in parts[1:]:
        left = ENCODER.join(left, ENCODER.reduced(part))
    right = ENCODER.reduced(parts[-1])
    for part in reversed(parts[:-1]):
        right = ENCODER.join(ENCODER.reduced(part), right)
    assert left == right == ENCODER.merged(b"".join(parts))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    small = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(str(n * 7919) + "ing" for n in range(200))
    assert np.frombuffer(small.packed(text), dtype="<i4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(small.packed_spaced) <= 5 and len(small.window) <= 5


def test_awkward_rows(spark):
    texts = [None, "", " ", "<|endoftext|>", "word " * 20_000, "x" * 5000, "same", "same", "a\x00b ‍ é"]
    docs = spark.createDataFrame([(i % 3, t, [i]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    out = byte_bpe.decode(byte_bpe.encode(docs, RAW, public_tokenizers.PATTERN), RAW, "ids_").collect()
    assert [r["ids"] for r in out] == [[i] for i in range(len(texts))]
    for row, text in zip(out, texts):
        assert row["ids_"] == LIBRARY.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()
    nulls = spark.createDataFrame([(None,), ([],), ([None, 5],)], "ids array<int>")
    assert [r["decoded"] for r in byte_bpe.decode(nulls, RAW).collect()] == [None, b"", LIBRARY.decode_bytes([5])]
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(spark.createDataFrame([([1 << 30],)], "ids array<int>"), RAW).collect()
    assert byte_bpe.encode(docs.limit(0), RAW, public_tokenizers.PATTERN).count() == 0


def test_query_matches_library(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    wanted = set()
    for doc_id, text in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        wanted.add((
            doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest(),
        ))
    assert {tuple(r) for r in queries()["op13_byte_bpe"](spark, SF_DIR).collect()} == wanted


def test_an_encoder_goes_with_its_task():
    """A reused worker holds the memos of one task, not those of all tasks since the last collection."""
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    encoder.packed("several words, éàü and 123 numbers")
    alive, memo = weakref.ref(encoder), weakref.ref(encoder.window)
    gc.disable()
    try:
        del encoder
        assert alive() is None and memo() is None
    finally:
        gc.enable()


def test_encoding_and_decoding_share_a_worker(spark):
    """One Python node in the query's plan, with the rows of both one after the other."""
    plan = queries()["op13_byte_bpe"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    texts = [None, "", "same", "same", "a\x00b ‍ é", "x" * 5000, "word  word\n" * 300]
    docs = spark.createDataFrame([(i % 3, t, [i]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    both = byte_bpe.round_trip(docs, RAW, public_tokenizers.PATTERN, keep_text=True)
    apart = byte_bpe.decode(byte_bpe.encode(docs, RAW, public_tokenizers.PATTERN, keep_text=True), RAW, "ids_")
    assert both.schema == apart.schema and both.collect() == apart.collect()
    assert byte_bpe.round_trip(docs.limit(0), RAW, public_tokenizers.PATTERN).count() == 0


def test_a_worker_keeps_one_encoder():
    """The next task of a worker finds what the last one remembered; other settings take its place."""
    first = byte_bpe.kept_coders(RAW, public_tokenizers.PATTERN, True)
    gone = weakref.ref(first[0])
    assert byte_bpe.kept_coders(bytes(bytearray(RAW)), public_tokenizers.PATTERN, True) is first
    other = byte_bpe.kept_coders(RAW, public_tokenizers.PATTERN, False)
    assert other is not first and len(byte_bpe._KEPT) == 1
    del first
    assert gone() is None
