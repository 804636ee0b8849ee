import random
import struct
import zlib

import pytest
from coratings.llm.packing import END, ChunkEncoder, binary_lengths, packed
from coratings.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def assert_packed(pieces, rows, tokenizer, longest):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.offset == 0
            part = ids[at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert p.length <= longest and p.length & (p.length - 1) == 0
            at += p.length
        assert at == len(ids)
    assert not by_doc
    pieces = sorted(pieces, key=lambda p: p.sequence_id)
    assert [p.sequence_id for p in pieces] == list(range(len(pieces)))
    # Buckets of equal lengths, one behind the other.
    assert [p.length for p in pieces] == sorted([p.length for p in pieces], reverse=True)


def test_round_trip(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").repartition(4)
    rows = [tuple(r) for r in docs.collect()]
    assert_packed(packed(docs, tokenizer_path()).collect(), rows, tokenizer, 2048)


def test_ids_of_odd_chunks(tokenizer):
    pick, encode = random.Random(2), ChunkEncoder(tokenizer_path())
    letters = [*"abzAZéÉßñÑıİΣσς'’.,!?|$12٣ª_-—…<>ﬁǅ中ǘ\x1c\x85\u00a0\u3000 \n\t", "<|endoftext|>", "'s", "'LL", "e\u0301"]
    for _ in range(5000):
        text = "".join(pick.choices(letters, k=pick.randrange(9)))
        ids = encode(text.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*tokenizer.encode(text, add_special_tokens=False).ids, END]


def test_little_is_remembered_of_long_chunks(tokenizer, monkeypatch):
    from coratings.llm import packing

    monkeypatch.setattr(packing, "CACHED", 20_000)
    encode, pick = ChunkEncoder(tokenizer_path()), random.Random(1)
    for k in range(60):
        text = " ".join("".join(pick.choices("abcdefgh", k=pick.choice([3, 9, 400]))) for _ in range(40)) + " same" * 3 + " x" * 300 + "y" * 999 * (k % 2)
        ids = encode(text.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*tokenizer.encode(text, add_special_tokens=False).ids, END]
        assert encode.size < 40_000 and max(map(len, encode.ids)) <= packing.LONG


def test_binary_lengths():
    assert binary_lengths(1, 8) == [1] and binary_lengths(23, 8) == [8, 8, 4, 2, 1] and binary_lengths(16, 8) == [8, 8]


def test_odd_rows(odd_docs, no_docs, tokenizer):
    got = packed(odd_docs, tokenizer_path(), longest=64, with_ids=True).collect()
    assert sorted(p.sequence_id for p in got) == list(range(len(got)))
    assert sum(p.doc_tokens == 1 for p in got) == 4  # two nulls, an empty text, white space
    assert all(len(p.ids) == p.length for p in got)
    assert packed(no_docs, tokenizer_path()).collect() == []
