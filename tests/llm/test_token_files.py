import heapq
import random
import zlib

import numpy as np
import pytest
from coratings.llm import subwords, token_files
from coratings.llm.queries import byte_tokenizer_path
from coratings.llm.staging import folder
from coratings.llm.subwords import ByteBpe
from coratings.llm.token_files import BLOCK, LIMIT, Decoder, Encoder, canonical, code_lengths, read_ids, write_ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokenizer_path())


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(tokenizer, rows):
    """Rows that share a doc_id may lie in either order: (doc_id, start of the first, their (n_tokens, crc32) sorted)."""
    by_doc, start, out = {}, 0, []
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(encoded(tokenizer, text))
    for doc in sorted(by_doc, key=lambda d: (d is not None, d or 0)):
        out.append((doc, start, sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in by_doc[doc])))
        start += sum(map(len, by_doc[doc]))
    return out


def found(rows):
    by_doc, at = {}, 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at  # gapless, in the order of doc_id
        at += r.n_tokens
        by_doc.setdefault(r.doc_id, []).append(r)
    return [(doc, rs[0].start, sorted((r.n_tokens, r.ids_crc32) for r in rs)) for doc, rs in by_doc.items()]


LETTERS = [*"abzAZéÉßñÑıİΣσς'’.,!?|$12٣ª_-—…<>ﬁǅ中ǘ\x1c\x85 　᠎ \n\t", "  ", "\n\n", " \n", "<|endoftext|>", "'s", "'LL", "é", "😀"]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_of_odd_texts(tokenizer, plain, monkeypatch):
    monkeypatch.setattr(subwords, "HELD", 5000)
    pick, encode = random.Random(3), ByteBpe(byte_tokenizer_path(), plain)
    tokenizer.encode_special_tokens = plain
    try:
        for _ in range(8000):
            text = "".join(pick.choices(LETTERS, k=pick.randrange(14)))
            assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    finally:
        tokenizer.encode_special_tokens = False
    assert encode.known.turns > 0


def huffman_cost(counts):
    heap = sorted(c for c in counts if c)
    total = 0 if len(heap) > 1 else sum(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths():
    pick = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = pick.zipf(1.3, n).clip(0, 10**9)
        lengths = code_lengths(counts, 60)
        assert (counts * lengths).sum() == huffman_cost(counts.tolist())
        limited = code_lengths(counts, max(1, int(n - 1).bit_length()))
        assert limited.max() <= max(1, int(n - 1).bit_length()) and sum(2.0 ** -limited[limited > 0].astype(float)) <= 1
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    assert code_lengths(np.array(fibonacci)).max() == LIMIT
    with pytest.raises(ValueError):
        code_lengths(np.ones(5, np.int64), 2)


def test_canonical_codes():
    codes, order = canonical(np.array([2, 0, 3, 1, 3], np.uint8))
    assert order.tolist() == [3, 0, 2, 4] and codes[[3, 0, 2, 4]].tolist() == [0b0, 0b10, 0b110, 0b111]


def test_blocks_round_trip():
    pick = np.random.default_rng(2)
    ids = np.minimum(pick.zipf(1.2, 20_000), 60_000).astype(np.uint32)
    lengths = code_lengths(np.bincount(ids))
    counts = np.array([1, BLOCK, BLOCK + 1, 5 * BLOCK - 1, 7, 10_000])
    counts = np.append(counts, len(ids) - counts.sum())
    low = 0
    for (blocks, code), n in zip(Encoder(lengths)(ids, counts), counts, strict=True):
        starts = np.concatenate([[0], np.frombuffer(blocks, "<u8")]).astype(np.int64)
        sizes = np.minimum(BLOCK, n - np.arange(len(starts)) * BLOCK)
        assert Decoder(lengths)(np.frombuffer(code, np.uint8), starts, sizes).tolist() == ids[low : low + n].tolist()
        # A block is decoded without the ones before it.
        k = len(starts) - 1
        assert Decoder(lengths)(np.frombuffer(code, np.uint8), starts[k:], sizes[k:]).tolist() == ids[low + k * BLOCK : low + n].tolist()
        low += n


def test_odd_rows(spark, odd_docs, no_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 100)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(token_files.token_files(odd_docs, byte_tokenizer_path()).collect()) == expected(tokenizer, rows)
    assert token_files.token_files(no_docs, byte_tokenizer_path()).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(token_files.token_files(nothing, byte_tokenizer_path()).collect()) == expected(tokenizer, [(1, None), (2, "")])


def test_very_long_text_and_other_ids(spark, tokenizer):
    rows = [("b", "long words " * 300_000), ("a", "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in token_files.token_files(docs, byte_tokenizer_path()).collect()}
    assert got == {d: len(encoded(tokenizer, t)) for d, t in rows}


def test_files(spark, sf_small, tokenizer, monkeypatch):
    """The ids themselves come back, from many segments, by more than one task."""
    monkeypatch.setattr(token_files, "SEGMENT", 4000)
    monkeypatch.setattr(token_files, "READ", 20_000)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").repartition(4)
    where = folder(spark)
    index = write_ids(docs, byte_tokenizer_path(), where)
    assert index.count() > 20
    read = read_ids(index, where, with_ids=True)
    assert read.rdd.getNumPartitions() > 4
    rows = {r.doc_id: r for r in read.collect()}
    start = 0
    for doc, text in sorted(map(tuple, docs.collect())):
        assert rows[doc].ids == encoded(tokenizer, text) and rows[doc].start == start
        start += rows[doc].n_tokens


def test_test_tables(spark, sf_check, tokenizer):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").select("doc_id", "text")
    assert found(token_files.token_files(docs, byte_tokenizer_path()).collect()) == expected(tokenizer, map(tuple, docs.collect()))
