"""Packing by power-of-two decomposition: no sequence crosses documents, no padding."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from coratings.llm.staging import cut, text_columns

END = 1  # the id put after each document
CACHED = 128 << 20  # bytes of chunks and their ids that a task remembers at most, about
LONG = 256  # longer chunks of text are encoded each time
SYMBOLS = ".,;:!?$&%#*|"


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ChunkEncoder:
    """Ids of texts, chunk by chunk between white space, each distinct chunk encoded once.

    The tokenizer drops white space and lets no token reach over it, so the ids
    of a text are those of its chunks in turn. Texts and chunks are UTF-8
    bytes, which split at ASCII white space only. What is remembered is
    bounded: a full memory is emptied.

    A chunk of letters with or without symbols after them goes straight to the
    tokenizer's model, normalised as the tokenizer would; any other chunk goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        self.ids: dict[bytes, bytes] = {}
        self.size = 0

    def _part(self, text: str) -> list[int]:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(text)] if text else []

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        core = text.rstrip(SYMBOLS)
        lower = core if core.isascii() else unicodedata.normalize("NFC", core)
        lower = lower.lower()
        if not core or (lower.isalpha() and not set("\u03a3\u03c2") & set(core)):
            ids = self._part(lower) + self._part(text[len(core) :])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: bytes) -> bytes:
        """The ids, END included, as little-endian unsigned 32-bit numbers."""
        chunks, known = text.split(), self.ids
        try:
            parts = [known[c] for c in chunks]
        except KeyError:
            if self.size > CACHED:
                known.clear()
                self.size = 0
            long: dict[bytes, bytes] = {}
            for chunk in chunks:
                if chunk not in known and chunk not in long:
                    ids = self._encode(chunk)
                    if len(chunk) > LONG:
                        long[chunk] = ids
                    else:
                        known[chunk] = ids
                        self.size += 170 + len(chunk) + len(ids)
            parts = [known[c] for c in chunks] if not long else [long[c] if c in long else known[c] for c in chunks]
        parts.append(struct.pack("<I", END))
        return b"".join(parts)


def binary_lengths(total: int, longest: int) -> list[int]:
    """``total`` as pieces of ``longest`` and then falling powers of two."""
    out = [longest] * (total // longest)
    rest, power = total % longest, longest // 2
    while rest:
        if rest >= power:
            out.append(power)
            rest -= power
        power //= 2
    return out


def _packer(path: str, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(path)
        task, count = TaskContext.get().partitionId(), dict.fromkeys(binary_lengths(2 * longest - 1, longest), 0)
        names = ["start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                rows: dict[str, list] = {n: [] for n in ["row", *names, "nth", "ids"]}
                for row, text in enumerate(some.column("text").cast(pa.binary()).to_pylist()):
                    ids = encode(text)
                    start, total = 0, len(ids) // 4
                    for length in binary_lengths(total, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        values = (row, start, length, zlib.crc32(piece), total, count[length])
                        for name, value in zip(["row", *names, "nth"], values, strict=True):
                            rows[name].append(value)
                        count[length] += 1
                        if with_ids:
                            rows["ids"].append(np.frombuffer(piece, "<i4"))
                        start += length
                n = len(rows["row"])
                arrays = [
                    some.column("doc_id").take(pa.array(rows["row"], pa.int64())),
                    *[pa.array(rows[c], pa.int64()) for c in names],
                    pa.array([task] * n, pa.int64()),
                    pa.array(rows["nth"], pa.int64()),
                    *([pa.array(rows["ids"], pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "task", "nth", *(["ids"] if with_ids else [])])

    return run


def packed(docs: DataFrame, tokenizer: str, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece; ``with_ids`` adds ids.

    A document's ids (the tokenizer's, then END) are cut into full sequences
    and the binary parts of what is left. Every piece is a power of two long
    and is a sequence of its own: sequences of one length form a bucket and
    batch together without padding, and none holds two documents. Sequences
    are numbered from 0 without gaps, in the order of the input's partitions.

    ``tokenizer`` is the path of a tokenizers file that drops white space.
    Null or empty text: the END id alone, one piece. Repeated rows and null
    doc_ids are documents of their own, rows that share a doc_id too. A very
    long text is encoded in one piece, so memory follows the longest one. Other columns of ``docs``
    play no part. Empty input: no rows.
    """
    fields = [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "task", "nth")]
    ids = [StructField("ids", ArrayType(IntegerType()))] if with_ids else []
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *fields, *ids])
    pieces = cut(text_columns(docs).mapInArrow(_packer(tokenizer, longest, with_ids), schema))
    # A row per bucket and task of the step above: their running total fits any broadcast.
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = pieces.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(F.broadcast(tasks), ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("before") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *[f.name for f in ids],
    )
