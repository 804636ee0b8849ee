"""Ids of whole texts by a byte-level BPE, piece of text by piece of text, each distinct one encoded once."""

from __future__ import annotations

import re
import struct
import sys
import types

from coratings.llm.packing import byte_letters

HELD = 320 << 20  # bytes that a worker process remembers at most
LONGEST = 1 << 10  # longer pieces of text are encoded each time
# Before a blank or line end that follows no white space every pre-token ends, so texts are cut there.
CUTS = re.compile(r"(?<=[\w!-~])(?=[ \n])")
# Ends of words that are a pre-token of their own after letters.
SYMBOLS = ".,;:!?$&%#*|"
# Letters below this are letters in every version of the tables in use.
SETTLED = "\u0530"

def ends_in_word(piece: str) -> bool:
    last = piece[-1:]
    return last.isalnum() or "!" <= last <= "~"


def joints(text: str) -> list[str]:
    """``text`` as words: one that begins with a line end is taken as it is, any other but the first stands behind a blank.

    Right wherever none but the first is empty and each but the last ends in a word.
    """
    return text.replace("\n", " \n").split(" ")


def piece_of(word: str) -> str:
    return word if word[:1] == "\n" else " " + word


class Memory(dict):
    """Values by word, made by ``make`` when first asked for; emptied when ``held`` bytes are used.

    A word that isn't ``ends_in_word`` is a KeyError: its neighbours matter.
    ``each`` is what an entry takes beside 8 bytes a letter; ``turns`` counts
    how often all was forgotten.
    """

    def __init__(self, make, each: int, held: int):
        self.make, self.each, self.held, self.size, self.turns = make, each, held, 0, 0

    def __missing__(self, word: str):
        if not (word.isalpha() or ends_in_word(word)):
            raise KeyError(word)
        value, length = self.make(word), len(word)
        if length <= LONGEST:
            self.size = size = self.size + self.each + 8 * length
            if size > self.held:
                self.clear()
                self.size, self.turns = 0, self.turns + 1
            self[word] = value
        return value


class ByteBpe:
    """Ids by the tokenizers library of texts whose tokenizer splits before it merges (byte-level BPE).

    ``plain_specials``: special tokens' strings inside texts are plain text. A
    piece of letters with or without symbols behind goes straight to the
    tokenizer's model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, plain_specials: bool = False, held: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[32]
        self.size = self.tokenizer.get_vocab_size()
        self.known = Memory(self._make, 200, HELD if held is None else held)
        self.symbols: dict[str, bytes] = {}

    def whole(self, piece: str) -> bytes:
        """The ids of any piece of text, little-endian unsigned 32-bit, by the whole tokenizer."""
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pre_token(self, text: str) -> bytes:
        ids = [token.id for token in self.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _make(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                return self._pre_token(self.blank + word)
            if max(word) < SETTLED:
                return self._pre_token(self.blank + word.encode().decode("latin-1").translate(self.letters))
            return self.whole(" " + word)
        core = word.rstrip(SYMBOLS)
        if core.isalpha() and len(core) <= LONGEST:
            tail = word[len(core) :]
            if tail not in self.symbols:
                if len(self.symbols) > 10_000:
                    self.symbols.clear()
                self.symbols[tail] = self._pre_token(tail)
            return self.known[core] + self.symbols[tail]
        return self.whole(piece_of(word))

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        first, *words = joints(text)
        if not first or not words or ends_in_word(first):
            known = self.known
            try:
                parts = [known[w] for w in words[:-1]]
            except KeyError:
                pass
            else:
                if words:
                    last = words[-1]
                    parts.append(known[last] if ends_in_word(last) else self.whole(piece_of(last)))
                return (self.whole(first) if first else b"") + b"".join(parts)
        return b"".join(map(self.whole, CUTS.split(text)))


def of_process(make, *key):
    """``make(*key)``, once in each worker process: its tasks share what is remembered."""
    held = sys.modules.setdefault("coratings_llm_of_process", types.ModuleType("coratings_llm_of_process")).__dict__
    name = (make.__qualname__, *key)
    if name not in held:
        held[name] = make(*key)
    return held[name]
