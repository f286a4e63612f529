"""The codec and packing against the public libraries, and the packing against its own promises."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugewright.llm import packing, piece_codec

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(BYTES)
TOKENIZER.encode_special_tokens = True
PARTS = st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "   ", "\n", "\n\n", "▁", "é", "日本", "😀", "\x00", "\t", "ing", "er", "aaaa", "==", "<s>", "<0x0A>", "'s", "1", "23", ".", "\r\n", " ", "<|endoftext|>", " " * 23, "x" * 20]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(PARTS, st.text(max_size=30)))
def test_codec_equals_the_library(text):
    own = piece_codec.codec(PIECES)
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids).decode() == LIBRARY.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.one_of(PARTS, st.text(max_size=30)))
def test_byte_ids_equal_the_library(text):
    assert np.frombuffer(packing.encoder(BYTES).encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_chunks():
    own = piece_codec.codec(PIECES)
    for text in ("ab" * 40_000, " " * 5000 + "x", "日" * 3000, "a\n" * 2000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 9000), (5, "same"), (5, "same"), (None, "no id"), (6, "x" * 20_000)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, length int, _rank string").repartition(3)


def test_round_trip_query(spark):
    got = sorted(map(tuple, piece_codec.round_trip_digests(docs(spark), PIECES).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = piece_codec.encode_documents(docs(spark), PIECES)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(encoded, PIECES).collect()}
    assert back[1] == "Hello world" and back[4] == "word " * 9000 and back[2] == ""
    assert piece_codec.round_trip_digests(docs(spark).where("false"), PIECES).count() == 0


def check_packing(rows, texts, capacity):
    """Every promise of the contract; returns the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and 1 <= length <= capacity
            at += length
        assert at <= capacity
    want = Counter()
    for i, t in texts:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        start, stop, piece = 0, first, 0
        while start < len(ids):
            want[i, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start, stop, piece = stop, stop + capacity, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by)


def test_packing(spark):
    rows = packing.pack_documents(docs(spark), BYTES).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, ROWS, 2048) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs(spark).where("false"), BYTES).count() == 0
    small = packing.pack_documents(docs(spark), BYTES, capacity=16, with_ids=True).collect()
    check_packing(small, ROWS, 16)
    assert all(len(r["ids"]) == r["length"] for r in small)


def test_packing_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(table, BYTES).collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in table.collect()], 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=12), st.integers(1, 1000))
def test_plan_places_everything(counts, factor):
    counts = {n: c * factor for n, c in counts.items()}
    plan = packing.plan_packing(counts, 60)
    ranks = defaultdict(list)
    events = defaultdict(int)
    for length, rank, many, first, offset in plan:
        ranks[length].append((rank, many))
        events[first, offset] += length
        assert offset + length <= 60 and many > 0
    for length, c in counts.items():
        at = 0
        for rank, many in sorted(ranks.get(length, [])):
            assert rank == at
            at += many
        assert at == c
    if factor == 1:
        fill = defaultdict(list)
        for length, _, many, first, offset in plan:
            for k in range(many):
                fill[first + k].append((offset, length))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length


def test_two_thirds_pair_up():
    plan = packing.plan_packing({1000: 10, 1048: 10}, 2048)
    assert max(p[3] + p[2] for p in plan) == 10
    with pytest.raises(ValueError):
        packing.plan_packing({3000: 1}, 2048)
