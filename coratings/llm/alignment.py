"""Tokens of two tokenizers aligned over the bytes of each document, and how many documents hold each linked pair.

A byte range of a document yields a fragment: tokens up to its first common
end (open prefix), whole groups, and tokens after its last common end (open
suffix). Fragments compose associatively, so those of a very long document
are reduced in a tree across tasks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from coratings.llm.packing import byte_letters
from coratings.llm.staging import cut, sized, text_columns
from coratings.llm.subwords import CUTS, HELD, LONGEST, SETTLED, SYMBOLS, ByteBpe, ends_in_word, joints, of_process, piece_of

CHUNK = 64 << 10  # bytes of a fragment; a longer document becomes several
CONTEXT = 4 << 10  # bytes to look through for a cut on both sides of a fragment's ends
FAN = 16  # fragments composed in one step of the tree
LARGE = 64  # tokens of a group beyond which its pairs are counted, not listed
FREQUENT = 1_000_000  # pairs whose counts every task holds, the most frequent ones, 16 MB
COMBINED = 4_000_000  # pairs a task gathers before it adds them up
AT_ONCE = 1 << 19  # characters of texts whose new words are tokenized together
EACH = 350  # bytes that a remembered word takes beside 8 a letter
BYTE_CUTS = re.compile(rb"(?<=[!-~])(?=[ \n])")


class Pieces:
    """The second tokenizer: ids by sentencepiece of pieces that begin with a blank or a line end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # A text may be cut before a blank only if no piece goes on after one, and before a line end only if no piece holds one.
        if any(re.search("[^▁]▁|\n", name) for name in names):
            raise ValueError("pieces of this model reach over blanks or line ends")
        self.blank = self.model.piece_to_id("▁")
        # Merges can't join letters with a symbol behind them if no piece holds both.
        self.symbols_apart = not any(x.isalpha() and y in SYMBOLS for name in names for x, y in zip(name, name[1:], strict=False))
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def ids(self, piece: str) -> list[int] | None:
        """None if the piece's first blank, which the model adds to any text, can't be told apart."""
        if piece == " ":
            return [self.blank]
        if piece[0] == " ":
            return self.model.encode(piece[1:])
        ids = self.model.encode(piece)
        return ids[1:] if ids[:1] == [self.blank] else None

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """``ids`` of the pieces of words, empty instead of None."""
        found = self.model.encode(words, num_threads=1)
        return [(ids[1:] if ids[:1] == [self.blank] else []) if word[0] == "\n" else ids for word, ids in zip(words, found, strict=True)]


class Halves:
    """Values by word, in two halves of ``held`` bytes: when the younger is full the older is forgotten. Words asked for stay."""

    def __init__(self, held: int):
        self.young, self.old, self.size, self.half = {}, {}, 0, held // 2

    def missing(self, words: set[str]) -> list[str]:
        """Those of ``words`` without a value; all others are in the younger half then."""
        rest, old = words.difference(self.young), self.old
        self.add({w: old[w] for w in rest if w in old})
        return [w for w in rest if w not in old]

    def add(self, values: dict) -> None:
        self.young.update(values)
        self.size += EACH * len(values) + 8 * sum(map(len, values))

    def turn(self) -> None:
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteBpe(byte_path, plain_specials=True, held=HELD // 10), Pieces(piece_path)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        entries = {i: t for t, i in self.a.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(map(back.__getitem__, entries.get(i, ""))) for i in range(self.a.size)]
        self.b_bytes = self.b.bytes
        self.a_length, self.b_length = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.digits = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.wide = max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16
        self.shift, self.kind = (32, "<u8") if self.wide else (16, "<u4")
        self.known = Halves(HELD)
        self.lengths = np.array(self.a_length, np.int32), np.array(self.b_length, np.int32)
        # Decimal ids in rows of equal width, with room for what stands behind.
        self.width = np.char.str_len(np.array(self.digits))
        self.signs = np.zeros((len(self.digits), int(self.width.max()) + 1), np.uint8)
        for row, digits in zip(self.signs, self.digits, strict=True):
            row[: len(digits)] = list(digits.encode())
        self.tails: dict[str, tuple] = {}  # short ones

    def tokens(self, piece: str) -> tuple[list[int], list[int]] | None:
        """Ids of both, or None where the joined bytes of either aren't the piece."""
        raw = self.a.known[piece[1:]] if piece[0] == " " and ends_in_word(piece) and piece[1:2] != " " and "\n" not in piece else self.a.whole(piece)
        a, b = list(struct.unpack(f"<{len(raw) // 4}I", raw)), self.b.ids(piece)
        text = piece.encode()
        if b is None or b"".join(map(self.a_bytes.__getitem__, a)) != text or b"".join(map(self.b_bytes.__getitem__, b)) != text:
            return None
        return a, b

    def groups(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """Groups of tokens that cover the same bytes from end to end."""
        a_length, b_length, size = self.a_length, self.b_length, len(a)
        i = j = end_a = end_b = 0
        while i < size:
            first_a, first_b = i, j
            end_a += a_length[a[i]]
            end_b += b_length[b[j]]
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += a_length[a[i]]
                    i += 1
                else:
                    end_b += b_length[b[j]]
                    j += 1
            yield a[first_a:i], b[first_b:j]

    def described(self, groups: Iterator[tuple[list[int], list[int]]]) -> tuple[str, bytes, int, tuple]:
        """(text of the groups, a key for each link, tokens of the first, (key, links) of groups with very many)."""
        texts, keys, n_a, large, digits, shift = [], [], 0, [], self.digits, self.shift
        for a, b in groups:
            if len(a) == 1 == len(b):
                x, y = a[0], b[0]
                texts.append(f"{digits[x]}|{digits[y]}")
                keys.append(x << shift | y)
                n_a += 1
                continue
            texts.append(",".join([digits[x] for x in a]) + "|" + ",".join([digits[y] for y in b]))
            n_a += len(a)
            if len(a) + len(b) <= LARGE:
                keys += [x << shift | y for x in a for y in b]
            else:
                counts = Counter(b).items()
                large += [(x << shift | y, n * m) for x, n in Counter(a).items() for y, m in counts]
        return ";".join(texts), struct.pack(f"<{len(keys)}{'Q' if self.wide else 'I'}", *keys), n_a, tuple(large)

    def closed(self, piece: str) -> tuple:
        """A piece at whose both ends both tokenizers have an end; empty where the bytes differ."""
        found = self.tokens(piece)
        return self.described(self.groups(*found)) if found else ()

    def ready(self, words: set[str]) -> dict[str, tuple]:
        """What ``closed`` says of the pieces of words; those that don't end in a word are left out.

        Letters are remembered without the symbols behind them. What isn't remembered is tokenized together.
        """
        young, cores, asked = self.known.young, {}, set()
        ready = {w: young[w] for w in words if w in young}
        for word in words.difference(ready):
            if word.isalpha():
                asked.add(word)
            elif ends_in_word(word):
                core = word.rstrip(SYMBOLS) if self.b.symbols_apart else ""
                if core != word and core.isalpha() and (core.isascii() or max(core) < SETTLED):
                    cores[word] = core
                    if core not in young:
                        asked.add(core)
                else:
                    asked.add(word)
        long = {w for w in asked if len(w) > LONGEST}
        missing = self.known.missing(asked - long)
        if missing:
            self.known.add(self.closed_all(missing))
        ready |= {w: young[w] for w in asked - long} | {w: self.closed(piece_of(w)) for w in long}
        behind, tails = {}, self.tails
        for word, core in cores.items():
            first, tail = ready.get(core) or young.get(core), word[len(core) :]
            last = tails[tail] if tail in tails else self.tail(tail)
            behind[word] = (f"{first[0]};{last[0]}", first[1] + last[1], first[2] + last[2], first[3] + last[3]) if first and last else ()
        ready |= behind
        self.known.turn()
        return ready

    def tail(self, tail: str) -> tuple:
        """``closed`` of symbols that stand behind letters: both tokenizers have an end between them."""
        a, b, text = [token.id for token in self.a.tokenize(tail)], self.b.model.encode("a" + tail)[1:], tail.encode()
        fits = b"".join(map(self.a_bytes.__getitem__, a)) == text == b"".join(map(self.b_bytes.__getitem__, b))
        found = self.described(self.groups(a, b)) if fits else ()
        if len(tail) <= 8:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = found
        return found

    def closed_all(self, words: list[str]) -> dict[str, tuple]:
        """``closed`` of the pieces of words that end in words, all at once."""
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < SETTLED)]
        words = plain + list(set(words).difference(plain)) if len(plain) < len(words) else plain
        pieces = [piece_of(w) for w in words]
        found = self._closed_all([p.encode() for p in pieces], self.a_ids(plain, pieces[len(plain) :]), self.b.ids_of(words))
        if found is not None:
            return {w: p or self.closed(piece) for w, p, piece in zip(words, found, pieces, strict=True)}
        if len(words) == 1:
            return {words[0]: self.closed(pieces[0])}
        half = len(words) // 2  # bytes differ somewhere
        return self.closed_all(words[:half]) | self.closed_all(words[half:])

    def a_ids(self, plain: list[str], pieces: list[str]) -> list[int]:
        """Ids of words of settled letters, and of pieces behind them, one after the other."""
        tokenize, blank, letters = self.a.tokenize, self.a.blank, self.a.letters
        ids = [t.id for w in plain for t in tokenize(blank + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))]
        return ids + self.a.tokenizer.encode("".join(pieces), add_special_tokens=False).ids if pieces else ids

    def _closed_all(self, pieces: list[bytes], ids_a: list[int], of_b: list[list[int]]) -> list[tuple | None] | None:
        """``closed`` of each piece, None in place of those with large groups; None if bytes differ."""
        ids_b, data = list(itertools.chain.from_iterable(of_b)), b"".join(pieces)
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) != data or b"".join(map(self.b_bytes.__getitem__, ids_b)) != data:
            return None
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        is_a, is_b = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        last_a, last_b = is_b[ends_a], is_a[ends_b]
        # First token of each group, and one more; the group in which a piece ends.
        first_a, first_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        closes = ends_a[first_a - 1]
        until = np.searchsorted(closes, ends)
        if not np.array_equal(closes[until], ends):
            return None
        first_a, first_b = np.concatenate([[0], first_a]), np.concatenate([[0], first_b])
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        until = np.concatenate([[0], until + 1])

        # Ids as text: those of A, then those of B of each group, each with what stands behind.
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        behind = np.empty(len(ids), np.uint8)
        place_a, place_b = np.arange(len(ids_a)) + first_b[group_a], np.arange(len(ids_b)) + first_a[group_b + 1]
        ids[place_a], ids[place_b] = ids_a, ids_b
        behind[place_a], behind[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        signs, width = self.signs[ids], self.width[ids]
        signs[np.arange(len(ids)), width] = behind
        texts = signs[np.arange(signs.shape[1]) <= width[:, None]].tobytes().decode()
        text_at = np.concatenate([[0], np.cumsum(width + 1)])[first_a[until] + first_b[until]].tolist()

        # Each id of A with every one of B in its group.
        large = n_a + n_b > LARGE
        times = np.where(large, 0, n_b)[group_a]
        key_at = np.concatenate([[0], np.cumsum(times)])
        of_each = np.arange(key_at[-1]) - np.repeat(key_at[:-1] - first_b[group_a], times)
        keys = (np.repeat(ids_a, times) << self.shift | ids_b[of_each]).astype(self.kind).tobytes()
        key_at = (key_at[first_a[until]] * np.dtype(self.kind).itemsize).tolist()
        tokens = np.diff(first_a[until]).tolist()
        out = [
            (texts[x : y - 1], keys[k:m], n, ())
            for x, y, k, m, n in zip(text_at, text_at[1:], key_at, key_at[1:], tokens, strict=False)
        ]
        for i in set((np.searchsorted(until, np.flatnonzero(large), "right") - 1).tolist()):
            out[i] = None
        return out

    def parts(self, text: str) -> list[tuple]:
        return self.parts_of([text])[0]

    def parts_of(self, texts: list[str]) -> list[list[tuple]]:
        """What ``closed`` says of the pieces of a blank and each of ``texts``."""
        split = [joints(" " + text)[1:] for text in texts]
        ready, out = self.ready(set().union(*split)), []
        for text, words in zip(texts, split, strict=True):
            try:
                last = words[-1]
                out.append([ready[w] for w in words] if ends_in_word(last) else [*map(ready.__getitem__, words[:-1]), self.closed(piece_of(last))])
            except KeyError:
                out.append(list(map(self.closed, CUTS.split(" " + text))))
        return out

    def pairs(self, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and the links of each."""
        _, keys, _, large = zip(*parts, strict=True)
        keys = np.frombuffer(b"".join(keys), self.kind)
        if not any(large):
            keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.diff(first, append=len(keys)).astype("<u8")
        large = [x for found in large for x in found]
        every = np.concatenate([keys, np.array([k for k, _ in large], self.kind)])
        links = np.concatenate([np.ones(len(keys), "<u8"), np.array([n for _, n in large], "<u8")])
        keys, place = np.unique(every, return_inverse=True)
        total = np.zeros(len(keys), "<u8")
        np.add.at(total, place, links)
        return keys, total


def packed_pairs(keys: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending keys and their links, small: steps between keys, byte by byte of all numbers in turn, compressed."""
    planes = lambda x: x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    width = next(n for n in (1, 2, 4, 8) if n == 8 or int(links.max(initial=0)) < 1 << 8 * n)
    raw = planes(np.diff(keys, prepend=keys.dtype.type(0))) + planes(links.astype(f"<u{width}"))
    return struct.pack("<IB", len(keys), width) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked_pairs(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<IB", data)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[5:], n * (size + width), asbytes=True), np.uint8)
    plain = lambda part, width: np.ascontiguousarray(part.reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.cumsum(plain(raw[: n * size], size), dtype=kind), plain(raw[n * size :], width).astype("<u8")


def ranges(data: bytes, chunk: int, context: int) -> list[tuple[int, int, int, int]]:
    """(low, high, first and last byte of the text needed) of the byte ranges of a document.

    Ranges end at multiples of ``chunk``, wherever that is, with the text up to
    the cuts on both sides of it; where there is none near, at the next cut.
    """
    ends, at = [(0, 0, 0)], chunk
    while at < len(data):
        left = [m.start() for m in BYTE_CUTS.finditer(data, max(ends[-1][0], at - context), min(len(data), at + 1)) if m.start() <= at]
        right = BYTE_CUTS.search(data, at, min(len(data), at + context))
        if left and right:
            ends.append((at, left[-1], right.start()))
        elif right := BYTE_CUTS.search(data, at):
            ends.append((right.start(),) * 3)
        else:
            break
        at = (ends[-1][0] // chunk + 1) * chunk
    ends.append((len(data),) * 3)
    return [(low, high, left, right) for (low, left, _), (high, _, right) in zip(ends, ends[1:], strict=False) if high > low]


def read_together(aligner: Aligner, texts: list[str | None], chunk: int) -> Iterator[tuple[int, str | None, list[tuple] | None]]:
    """(place, text, parts) of texts, AT_ONCE characters at a time; no parts is None if the text goes in byte ranges."""
    some, size = [], 0

    def done() -> Iterator[tuple[int, str | None, list[tuple] | None]]:
        parts = iter(aligner.parts_of([text for _, text, short in some if text and short]))
        for i, text, short in some:
            yield i, text, None if not short else next(parts) if text else []

    for i, text in enumerate(texts):
        short = len(text or "") < chunk // 4 or len(text.encode()) < chunk
        if size and size + len(text or "") > AT_ONCE:
            yield from done()
            some, size = [], 0
        some.append((i, text, short))
        size += len(text or "") if short else 0
    yield from done()


DOC = "key long, doc_id {0}, long_text boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, seq long, low long, high long, base long, part binary"


def _documents(paths: tuple[str, str], chunk: int, context: int):
    """A row per document, or one per byte range of a long one."""
    names = [f.split()[0] for f in DOC.split(", ")]
    types = [pa.int64(), None, pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.int64()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = of_process(Aligner, *paths)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some, rows, of = batch.slice(low, 256), [], []
                for i, text, parts in read_together(aligner, some.column("text").to_pylist(), chunk):
                    key += 1
                    if parts is None:
                        data = b" " + text.encode()
                        cuts = ranges(data, chunk, context)
                        rows += [(key, True, 0, 0, 0, 0, "", None, k, a, b, left, data[left:right]) for k, (a, b, left, right) in enumerate(cuts)]
                        of += [i] * len(cuts)
                        continue
                    of.append(i)
                    if not parts or not all(parts):
                        rows.append((key, False, 0, 0, 0, 0, "", None, None, None, None, None, None))
                        continue
                    texts, _, sizes, _ = zip(*parts, strict=True)
                    joined = ";".join(texts)
                    n_groups, n_a = joined.count("|"), sum(sizes)
                    keys, links = aligner.pairs(parts)
                    n_b = joined.count(",") + 2 * n_groups - n_a
                    digest = hashlib.sha256(joined.encode()).hexdigest()
                    rows.append((key, False, n_a, n_b, n_groups, int(links.sum()), digest, packed_pairs(keys, links), None, None, None, None, None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, types[:1] + types[2:], strict=True)]
                arrays.insert(1, some.column("doc_id").take(pa.array(of)))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


FRAGMENT = "key long, seq long, own boolean, bad boolean, has_end boolean, before_a array<int>, before_b array<int>, after_a array<int>, after_b array<int>, groups string, n_a long, n_b long, n_groups long, n_links long, pairs binary"


def fragment(aligner: Aligner, text: str, base: int, low: int, high: int) -> dict | None:
    """The fragment of a document's bytes ``low`` to ``high`` from the text that begins at ``base``; None where bytes differ.

    Tokens belong to the range in which they end. A range that begins at a cut has no open prefix.
    """
    a, b, at = ([], []), ([], []), base
    for piece in CUTS.split(text):
        found = aligner.tokens(piece)
        if found is None:
            return None
        for ids, lengths, (out, ends) in zip(found, (aligner.a_length, aligner.b_length), (a, b), strict=True):
            end = at
            for i in ids:
                end += lengths[i]
                if low < end <= high:
                    out.append(i)
                    ends.append(end)
        at = end
    common = sorted(set(a[1]) & set(b[1]))
    first = low if base == low else (common[0] if common else None)
    if first is None:
        return {"has_end": False, "before_a": a[0], "before_b": b[0], "after_a": [], "after_b": [], "closed": ([], [])}
    last = common[-1] if common else low
    pick = lambda side, x, y: [i for i, e in zip(*side, strict=True) if x < e <= y]
    return {
        "has_end": True, "before_a": pick(a, low, first), "before_b": pick(b, low, first), "after_a": pick(a, last, high), "after_b": pick(b, last, high),
        "closed": (pick(a, first, last), pick(b, first, last)),
    }


def _fragments(paths: tuple[str, str]):
    schema = pa.schema([(n.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}.get(n.split()[1], pa.list_(pa.int32()))) for n in FRAGMENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = of_process(Aligner, *paths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = fragment(aligner, row["part"].decode(), row["base"], row["low"], row["high"])
                out = {"key": row["key"], "seq": row["seq"], "own": True, "bad": found is None, "has_end": True, "groups": "", "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
                if found:
                    closed = found.pop("closed")
                    out |= found | _counted(aligner, aligner.groups(*closed))
                yield pa.RecordBatch.from_pylist([{n: out.get(n, [] if n.startswith(("before", "after")) else None) for n in schema.names}], schema)

    return run


def _counted(aligner: Aligner, groups: Iterator[tuple[list[int], list[int]]]) -> dict:
    part = aligner.described(groups)
    keys, links = aligner.pairs([part])
    n_groups = part[0].count("|")
    return {"groups": part[0], "n_a": part[2], "n_b": part[0].count(",") + 2 * n_groups - part[2], "n_groups": n_groups, "n_links": int(links.sum()), "pairs": packed_pairs(keys, links)}


def compose(left: dict, right: dict) -> tuple[dict, tuple[list, list] | None]:
    """The fragment of two neighbours, and the group that closes between them if any."""
    out = dict(left)
    if not right["has_end"]:
        side = "after" if left["has_end"] else "before"
        for t in "ab":
            out[f"{side}_{t}"] = [*left[f"{side}_{t}"], *right[f"before_{t}"]]
        return out, None
    out |= {"has_end": True, "after_a": right["after_a"], "after_b": right["after_b"]}
    if not left["has_end"]:
        for t in "ab":
            out[f"before_{t}"] = [*left[f"before_{t}"], *right[f"before_{t}"]]
        return out, None
    group = tuple([int(i) for side in (left["after_" + t], right["before_" + t]) for i in side] for t in "ab")
    return out, group if group[0] else None


def _composed(paths: tuple[str, str]):
    names = [n.split()[0] for n in FRAGMENT.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        aligner = of_process(Aligner, *paths)
        every = sorted(rows.to_dict("records"), key=lambda r: r["seq"])
        empty = {"groups": "", "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "pairs": None}
        whole, out = every[0], []
        for right in every[1:]:
            whole, group = compose(whole, right)
            if group:
                out.append({**right, "own": True, **{n: [] for n in names if n.startswith(("before", "after"))}, **_counted(aligner, iter([group]))})
        out.append({**whole, **empty, "own": False, "bad": any(r["bad"] for r in every), "seq": every[0]["seq"] // FAN})
        return pd.DataFrame(out)[names]

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of rows in the order of the text."""
    names = ("n_a", "n_b", "n_groups", "n_links")
    key, digest, sums, first = None, None, None, True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": key, **dict(zip(names, sums, strict=True)), "groups_sha256": digest.hexdigest()}])

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    yield done()
                key, digest, sums, first = row["key"], hashlib.sha256(), [0] * 4, True
            if row["n_groups"]:
                digest.update((row["groups"] if first else ";" + row["groups"]).encode())
                sums, first = [s + row[n] for s, n in zip(sums, names, strict=True)], False
    if key is not None:
        yield done()


def _listed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                pairs, links = unpacked_pairs(data, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key)), pa.array(pairs.astype(np.int64)), pa.array(links.astype(np.int64))], ["key", "pair", "links"])

    return run


def long_documents(ranges_: DataFrame, paths: tuple[str, str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(key, sums and digest; key, pair, links) of documents that lie in byte ranges.

    Ranges are tokenized each for itself; what is open at their ends goes up a
    tree of FAN fragments a step, and the groups that close there come between
    the ranges' own. Digests are taken along the parts in order, one by one.
    """
    found = cut(ranges_.repartition("key", "seq").mapInArrow(_fragments(paths), FRAGMENT))
    own, level = [found], found
    n = (ranges_.agg(F.max("seq")).first()[0] or 0) + 1
    step = 0
    while n > 1:
        composed = cut(level.withColumn("at", F.expr(f"seq div {FAN}")).groupBy("key", "at").applyInPandas(_composed(paths), FRAGMENT))
        # A group that closed at this level lies before the first range of the fragment on its right.
        own.append(composed.where("own").withColumn("seq", F.col("seq") * FAN**step))
        level = composed.where("NOT own")
        n, step = -(-n // FAN), step + 1
    bad = cut(found.where("bad").select("key").distinct())
    parts = own[0].withColumn("place", F.lit(1))
    for rows in own[1:]:
        parts = parts.union(rows.withColumn("place", F.lit(0)))
    parts = cut(parts.join(sized(bad), "key", "left_anti").where("n_groups > 0").select("key", "seq", "place", "groups", "n_a", "n_b", "n_groups", "n_links", "pairs"))
    sums = parts.drop("pairs").repartition("key").sortWithinPartitions("key", "seq", "place").mapInArrow(
        _hashed, "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    )
    pairs = parts.select("key", "pairs").mapInArrow(_listed(kind), "key long, pair long, links long").groupBy("key", "pair").agg(F.sum("links").alias("links"))
    return cut(sums), cut(pairs)


def _holders(kind: str):
    """(pair, documents that hold it) of a task's documents, added up now and then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                held.append(unpacked_pairs(data, kind)[0])
                size += len(held[-1])
                if size > COMBINED:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    return run


def _scored(kind: str, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """n_best and count_sum of documents over the frequent pairs; a row for each other pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column("key").to_pylist(), batch.column("pairs").to_pylist()
            for low in range(0, len(keys), 256):
                rows = [unpacked_pairs(d, kind) for d in data[low : low + 256]]
                size = [len(r[0]) for r in rows]
                key = np.repeat(np.array(keys[low : low + 256], np.int64), size)
                pair, links = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]).astype(np.int64)
                at = np.searchsorted(pairs, pair)
                at[at == len(pairs)] = 0
                hit = pairs[at] == pair
                first = np.cumsum([0, *size[:-1]])
                worth, top = np.where(hit, links * counts[at], 0), np.where(hit & best[at], links, 0)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[low : low + 256], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.add.reduceat(top, first)), pa.array(np.add.reduceat(worth, first))],
                    ["key", "pair", "links", "n_best", "count_sum"],
                )
                if not hit.all():
                    miss, rest = ~hit, int((~hit).sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[miss]), pa.array(pair[miss]), pa.array(links[miss]), pa.nulls(rest, pa.int64()), pa.nulls(rest, pa.int64())],
                        ["key", "pair", "links", "n_best", "count_sum"],
                    )

    return run


def alignment(docs: DataFrame, byte_path: str, piece_path: str, chunk: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    ``byte_path`` is a tokenizers file of a byte-level BPE (A), ``piece_path`` a
    sentencepiece model (B). Null and empty texts, and texts whose bytes either
    tokenizer changes, have no tokens: zeros and an empty digest. Repeated rows and
    rows that share a doc_id, null too, are documents of their own. Ties for
    the highest count of an A id all count. Texts of over ``chunk`` bytes go in
    byte ranges; a stretch without a blank or line end behind a printable ASCII character
    isn't parted, so memory follows the longest of these. Other columns of ``docs`` play no part.
    Empty input: no rows.

    Counts of the FREQUENT most frequent pairs go to every task; other pairs are
    joined by shuffles, and none of them is in more documents than those.
    """
    paths, kind_of_id = (byte_path, piece_path), docs.schema["doc_id"].dataType.simpleString()
    aligner = Aligner(*paths)
    kind, shift = aligner.kind, aligner.shift
    read = cut(text_columns(docs).mapInArrow(_documents(paths, chunk, context), DOC.format(kind_of_id)))
    short, in_ranges = read.where("NOT long_text"), read.where("long_text")
    whole = short.select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    spark = docs.sparkSession
    if in_ranges.isEmpty():
        long_pairs = spark.createDataFrame([], "key long, pair long, links long")
    else:
        sums, long_pairs = long_documents(in_ranges.select("key", "seq", "low", "high", "base", "part"), paths, kind)
        ids = in_ranges.where("seq = 0").select("key", "doc_id").join(sized(sums), "key", "left").fillna(0, ["n_a", "n_b", "n_groups", "n_links"]).fillna("", ["groups_sha256"])
        whole = whole.union(ids.select(whole.columns))

    holders = short.where("pairs IS NOT NULL").select("pairs").mapInArrow(_holders(kind), "pair long, n long").union(long_pairs.select("pair", F.lit(1).cast("long").alias("n")))
    counts = cut(holders.groupBy("pair").agg(F.sum("n").alias("n")))
    # At most one row for each id of A's vocabulary.
    highest = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("n").alias("most"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", shift)).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))

    # The most frequent pairs, as many whole classes of counts as fit.
    classes = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.c, r.size) for r in counts.groupBy(classes.alias("c")).agg(F.count("*").alias("size")).collect()), reverse=True)
    least, total = float("inf"), 0
    for c, size in sizes:
        total += size
        if total > FREQUENT:
            break
        least = c
    frequent = counts.where(classes >= least).toPandas().sort_values("pair") if least < float("inf") else pd.DataFrame({"pair": [-1], "n": [0], "best": [False]})
    arrays = (frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool))
    scored = cut(short.where("pairs IS NOT NULL").select("key", "pairs").mapInArrow(_scored(kind, *arrays), "key long, pair long, links long, n_best long, count_sum long"))
    loose = scored.where("pair IS NOT NULL").select("key", "pair", "links").union(long_pairs)
    of_loose = loose.join(sized(counts), "pair").select(
        "key", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum")
    )
    total = cut(scored.where("pair IS NULL").select("key", "n_best", "count_sum").union(of_loose).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return whole.join(sized(total), "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
