"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, tokens
from tidemark.llm.common import table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, piece string"


def odd_texts():
    rng = random.Random(4)
    letters = "abC theİnrou .,'1_<>[]\n\t\r\x1c 日é#😀\xa0́ßſ½"
    texts = [None, "", " ", "\n", "  a  b ", "a\n\n b\t\tc", "<|endoftext|>x <|startoftext|> <|endoftext|>", "aaaa aaaaaaaaaaaaaaa", "日本語 テスト　全角",
             "I'LL don't 12345 ½ ²", "\x1c\x1d a\x85b\xa0c", "👩‍👧 \x00", "th" * 5000, "ab " * 4000, "ΣΑΣ ὈΔΥΣΣΕΎΣ", "é e.́", "trail  "]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None if i % 50 == 7 else i // 2, t, "x", "y") for i, t in enumerate(odd_texts())]
    real = [(10_000 + r.doc_id, r.text, "x", "y") for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    return spark.createDataFrame(odd + real, SCHEMA).repartition(3)


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(spark, docs):
    known = Tokenizer.from_file(BYTE)
    want = []
    for r in docs.collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r) for r in bpe.digests(docs, BYTE).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    whole = bpe.encode(docs.where("text IS NOT NULL"), BYTE).collect()
    assert sorted(r.decoded for r in whole) == sorted(known.decode(known.encode(r.text).ids, skip_special_tokens=False)
                                                     for r in docs.where("text IS NOT NULL").collect())


def test_automaton_against_plain_merging():
    """Gadget by gadget: all words over a small alphabet, with merges of equal halves among them."""
    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "c"), ("ab", "c"), ("c", "ab"), ("aa", "b"), ("bc", "bc"), ("aaaa", "bc")]
    vocabulary = {c: i for i, c in enumerate(bpe.byte_characters())}
    for a, b in merges:
        vocabulary[a + b] = len(vocabulary)
    machine = bpe.Automaton(vocabulary, merges, {})

    def plain(word):
        parts = list(word)
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i:i + 2] = [a + b]
                i += 1
        return [vocabulary[p] for p in parts]

    words = ["".join(w) for n in range(1, 8) for w in __import__("itertools").product("abc", repeat=n)] + ["ab" * 40, "a" * 77]
    found = machine.encode_words([w.encode() for w in words])
    assert [np.frombuffer(f, dtype="<u4").tolist() for f in found] == [plain(w) for w in words]
    assert [machine.decode(plain(w)) for w in words] == words


def test_counts(spark, docs):
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library(BYTE, r.text)), n > 512) for r in docs.collect()), key=str)
    for block in (tokens.BLOCK_CHARS, 2_000):
        found = tokens.token_counts(docs, BYTE, block_chars=block)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want


def check_packed(rows, want, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    return len(bins)


@pytest.mark.parametrize("size,group", [(2048, 20_000), (64, 50)])
def test_packing(spark, docs, size, group):
    known, want, total = Tokenizer.from_file(WORD), [], 0
    for r in docs.collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for p in range(0, len(ids), size):
            part = ids[p:p + size]
            want.append((r.doc_id, p // size, p, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    rows = packing.pack_documents(docs, WORD, size=size, group=group).collect()
    bins = check_packed(rows, sorted(want, key=str), size)
    assert bins <= -(-total // size) * 1.03 + 1


def test_ids_can_be_kept(spark, docs):
    few = docs.where("length(text) < 50")
    rows = packing.token_pieces(few, WORD, with_ids=True).collect()
    assert sorted((r.ids for r in rows), key=str) == sorted((library(WORD, r.text) + [0] for r in few.collect()), key=str)


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 100, 60)
        start = [[i] for i in range(60)]
        bins = packing.improve(start, lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 100 for b in bins)
        assert len(bins) <= -(-lengths.sum() // 100) + 6
    # best fit decreasing leaves four bins here, exchanges make it three
    lengths = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert len(packing.pack_group(lengths, 61)) <= -(-lengths.sum() // 61) + 1


def test_two_for_one_exchange():
    lengths = np.array([30, 25, 70, 50, 5])
    bins = packing.improve([[0, 1], [2, 4], [3]], lengths, 100)
    assert len(bins) == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for found in (bpe.digests(empty, BYTE), tokens.token_counts(empty, BYTE), packing.pack_documents(empty, WORD)):
        assert found.count() == 0
