import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import pytest
from coratings.llm import alignment as module
from coratings.llm.alignment import Aligner, alignment, compose, fragment, packed_pairs, ranges, unpacked_pairs
from coratings.llm.queries import byte_tokenizer_path, tokenizer_path

PATHS = byte_tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    """Whole texts by the two libraries: ids, and the bytes of each."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def of(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b

    return of


def groups_of(both, text):
    if not text:
        return []
    ids_a, bytes_a, ids_b, bytes_b = both(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    if len(whole) > 20_000:
        ends = lambda parts: list(__import__("itertools").accumulate(map(len, parts)))
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    both_ends = sorted(set(ends_a) & set(ends_b))
    out, i, j = [], 0, 0
    for end in both_ends:
        a, b = [], []
        while i < len(ends_a) and ends_a[i] <= end:
            a.append(ids_a[i])
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            b.append(ids_b[j])
            j += 1
        out.append((a, b))
    return out


def expected(both, rows):
    found = [(doc, groups_of(both, text)) for doc, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    holders = Counter(p for pairs in links for p in pairs)
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, groups), pairs in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in pairs.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def got(docs, **how):
    return sorted((tuple(r) for r in alignment(docs, *PATHS, **how).collect()), key=str)


LETTERS = [*"abzAZéÉßñς'.,!?|$12٣_-—…<>ﬁ中ǘ\x1c\x85 　\n\t▁", " ", " ", "the", " of", "  ", "\n\n", " \n", "<|endoftext|>", "<s>", "<0x41>", "é", "😀", "▁"]


def test_odd_texts(both, monkeypatch):
    monkeypatch.setattr(module, "LARGE", 6)
    pick, aligner = random.Random(4), Aligner(*PATHS)
    for _ in range(4000):
        text = "".join(pick.choices(LETTERS[: -1 if pick.random() < 0.9 else None], k=pick.randrange(1, 14))).replace("▁" if pick.random() < 0.9 else "\0", "x")
        parts, want = aligner.parts(text), groups_of(both, text)
        if not want:
            assert not all(parts), repr(text)
            continue
        assert ";".join(p[0] for p in parts) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want), repr(text)
        keys, links = aligner.pairs(parts)
        pairs = Counter((x, y) for a, b in want for x in a for y in b)
        assert {(int(k) >> 16, int(k) & 0xFFFF): int(n) for k, n in zip(keys, links, strict=True)} == pairs
        back = unpacked_pairs(packed_pairs(keys, links), aligner.kind)
        assert back[0].tolist() == keys.tolist() and back[1].tolist() == links.tolist()


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_new_words_are_tokenized_together(monkeypatch):
    """a word that isn't known yet has no call of its own."""
    import pyarrow as pa

    pick, calls = random.Random(6), []
    words = ["".join(pick.choices("abcdefgéßÉ", k=9)) + pick.choice(["", ".", ",", "&&&", "'s", "7", "-x"]) for _ in range(3000)]
    texts = [" ".join(words[i : i + 100]) + "\nEnd" for i in range(0, 3000, 100)]
    closed = Aligner.closed
    monkeypatch.setattr(Aligner, "closed", lambda self, piece: calls.append(piece) or closed(self, piece))
    monkeypatch.setattr(module, "of_process", lambda make, *key: make(*key))
    monkeypatch.setattr(module, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": texts})
    assert sum(b.num_rows for b in module._documents(PATHS, 1 << 16, 1 << 12)(iter([batch]))) == 30
    assert len(calls) < 50


@pytest.mark.parametrize("held", (0, 20_000, 1 << 26))
def test_words_of_many_texts_at_once(both, monkeypatch, held):
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "LARGE", 6)
    monkeypatch.setattr(module, "LONGEST", 40)
    pick, aligner = random.Random(7), Aligner(*PATHS)
    assert aligner.b.symbols_apart
    starts = [*LETTERS[:30], "wörd", "The", "ĳssel", "ʰa", "՛ա", "中文", "x" * 41, "x" * 41 + "!", "<|endoftext|>", "0▁0", "a\0b", "²", "a²", "ª"]
    words = ["".join(pick.choices(starts, k=pick.randrange(1, 5))) + "".join(pick.choices(".,;:!?$&%#*|'", k=pick.randrange(4))) for _ in range(400)]
    for _ in range(12):
        texts = [pick.choice(["", "\n", "x "]) + pick.choice([" ", "\n"]).join(pick.choices(words, k=pick.randrange(1, 40))) for _ in range(40)]
        for text, parts in zip(texts, aligner.parts_of(texts), strict=True):
            want = groups_of(both, text)
            if not want:
                assert not all(parts), repr(text)
                continue
            assert ";".join(p[0] for p in parts) == as_text(want), repr(text)
            assert sum(p[2] for p in parts) == sum(len(a) for a, _ in want)
            keys, links = aligner.pairs(parts)
            assert {(int(k) >> 16, int(k) & 0xFFFF): int(n) for k, n in zip(keys, links, strict=True)} == Counter((x, y) for a, b in want for x in a for y in b)
        assert aligner.known.size <= aligner.known.half
    assert held or not aligner.known.young


def test_links_of_any_width():
    import numpy as np

    for most in (1, 255, 256, 1 << 16, 1 << 32, (1 << 63) - 1):
        for kind in ("<u4", "<u8"):
            keys, links = np.array([0, 7, (1 << 32) - 1], kind), np.array([1, most, 3], "<u8")
            back = unpacked_pairs(packed_pairs(keys, links), kind)
            assert back[0].tolist() == keys.tolist() and back[1].tolist() == links.tolist()


def fragments(aligner, text, chunk, context):
    data = (" " + text).encode()
    cuts = ranges(data, chunk, context)
    assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == len(data)
    return [fragment(aligner, data[left:right].decode(), left, low, high) for low, high, left, right in cuts]


def test_fragments_compose_in_any_order(both):
    aligner = Aligner(*PATHS)
    pick = random.Random(5)
    words = "the unforgettable été antidisestablishmentarianism 中文字符 1234567 naïveté\nxyzzy qqq'll don't ...!!! a b".split(" ")
    seen_open = 0
    for _ in range(60):
        text = " ".join(pick.choices(words, k=60))
        for chunk, context in ((7, 64), (23, 64), (40, 5)):
            found = fragments(aligner, text, chunk, context)
            assert all(found)
            seen_open += sum(bool(f["before_a"]) for f in found)

            def whole(parts):
                groups = [list(aligner.groups(*p["closed"])) if p["has_end"] else [] for p in parts]
                between = [[] for _ in parts]

                def tree(low, high):
                    if high - low == 1:
                        return parts[low]
                    middle = pick.randrange(low + 1, high)
                    both_, group = compose(tree(low, middle), tree(middle, high))
                    if group:
                        between[middle].append(group)
                    return both_

                top = tree(0, len(parts))
                assert not top["before_a"] and not top["after_a"]
                return [tuple(map(list, g)) for b, own in zip(between, groups, strict=True) for g in [*b, *own]]

            assert whole(found) == groups_of(both, text)
    assert seen_open > 100


def test_odd_rows(spark, odd_docs, no_docs, both):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = expected(both, rows)
    assert got(odd_docs) == want
    assert got(odd_docs, chunk=1000, context=50) == want
    assert got(no_docs) == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(nothing) == expected(both, [(1, None), (2, "")])


def test_very_long_texts(spark, both):
    """Byte ranges over many tasks, texts without a place to cut, and one whose bytes a tokenizer changes far behind."""
    rows = [(1, "some länger words\nand more " * 20_000), (2, "x" * 30_000 + " end " * 3000), (3, "ok " * 20_000 + "▁"), (4, "short"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(both, rows)
    assert want[2][1] == 0
    assert got(docs, chunk=4096, context=300) == want


def test_rare_pairs_are_joined(spark, sf_small, both, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    want = expected(both, map(tuple, docs.collect()))
    assert got(docs) == want
    for frequent in (0, 2000):
        monkeypatch.setattr(module, "FREQUENT", frequent)
        monkeypatch.setattr(module, "COMBINED", 5000)
        assert got(docs.repartition(3), chunk=8192) == want
