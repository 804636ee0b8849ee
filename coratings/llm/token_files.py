"""Token-id files: canonical length-limited Huffman codes, in independent blocks that a table decodes."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from coratings.llm.staging import cut, folder, text_columns
from coratings.llm.subwords import ByteBpe, of_process
from coratings.llm.warc import _filesystem
from coratings.plans.staging import release

END = 0  # the id put after each document
LIMIT = 18  # bits of the longest code, more only where there are too many ids for that
BLOCK = 256  # ids between two checkpoints
SEGMENT = 1 << 20  # bytes of code that are written together
FILE = 256 << 20  # bytes of code that a task writes, about
READ = 32 << 20  # bytes of code that a task reads, about
PIECE = 1 << 17  # ids that are coded at once, those of one document at least
MAGIC = b"hufids1\n"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for those that don't occur: the shortest in all with none above ``limit`` (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << min(limit, 25):
        raise ValueError(f"{len(used)} symbols have no codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    packages, is_coin = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        is_coin.append(order < len(coins))
        both = both[order[: len(order) // 2 * 2]]
        packages = both[0::2] + both[1::2]
    taken, bits = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for level in reversed(is_coin):
        own = int(level[:taken].sum())
        bits[:own] += 1
        taken = 2 * (taken - own)
    lengths[used] = bits
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each symbol, symbols in the order of their codes): by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sorted_bits = lengths[order].astype(np.uint64)
    longest = np.uint64(sorted_bits[-1]) if len(order) else np.uint64(0)
    steps = np.uint64(1) << (longest - sorted_bits)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(steps) - steps) >> (longest - sorted_bits)
    return codes, order


class Encoder:
    def __init__(self, lengths: np.ndarray):
        self.both = (canonical(lengths)[0].astype(np.int64) << 6) | lengths.astype(np.int64)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(bit offsets of the blocks but the first, code) of consecutive lists of ``counts`` ids each, none empty."""
        both = self.both[ids]
        bits, codes = both & 63, (both >> 6).view(np.uint64)
        ends = np.cumsum(bits)
        last = np.cumsum(counts)
        first = last - counts
        before = ends[first] - bits[first]
        n_bytes = (ends[last - 1] - before + 7) // 8
        at = np.cumsum(n_bytes) - n_bytes
        place = ends - bits + np.repeat(at * 8 - before, counts)
        room = 64 - (place & 63) - bits
        word, fits = place >> 6, room >= 0
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        over = np.flatnonzero(~fits)  # at most one code in a word
        here = codes << np.maximum(room, 0).view(np.uint64)
        here[over] = codes[over] >> (-room[over]).view(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[new]] = np.bitwise_or.reduceat(here, new)
        out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        data = out.astype(">u8").tobytes()
        for a, n, size, low in zip(first, counts, n_bytes, at, strict=True):
            yield (place[a + BLOCK : a + n : BLOCK] - low * 8).astype("<u8").tobytes(), data[low : low + size]


class Decoder:
    """Decodes many blocks side by side, one look into the table for an id of each."""

    def __init__(self, lengths: np.ndarray):
        _, order = canonical(lengths)
        self.longest = int(lengths.max(initial=1))
        entries = (order.astype(np.int32) << 5) | lengths[order].astype(np.int32)
        self.table = np.zeros(1 << self.longest, np.int32)
        rows = np.repeat(entries, 1 << (self.longest - lengths[order].astype(np.int64)))
        self.table[: len(rows)] = rows

    def __call__(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of blocks that begin at bits ``starts`` and hold ``counts`` ids, one block behind the other."""
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        order = np.argsort(-counts, kind="stable")
        at, falling = starts[order].astype(np.int64), -counts[order]
        out = np.zeros((int(counts.max(initial=0)), len(counts)), np.uint32)
        room, mask = 32 - self.longest, (1 << self.longest) - 1
        for k in range(len(out)):
            live = int(np.searchsorted(falling, -k))  # blocks with more than k ids
            here = at[:live]
            entry = self.table[(window[here >> 3] >> (room - (here & 7))) & mask]
            out[k, :live] = entry >> 5
            here += entry & 31
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(len(out)) < counts[:, None]]


def _tokenizer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = of_process(ByteBpe, path), struct.pack("<I", end)
        kind = np.dtype("<u2") if max(encode.size, end + 1) <= 1 << 16 else np.dtype("<u4")
        counts, doc_type = np.zeros(max(encode.size, end + 1), np.int64), None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                found = [encode(text) + tail for text in some.column("text").to_pylist()]
                ids = np.frombuffer(b"".join(found), "<u4")
                counts += np.bincount(ids, minlength=len(counts))
                ends = np.cumsum([0, *[len(f) // 4 * kind.itemsize for f in found]])
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists.cast(pa.binary()), pa.nulls(len(found), pa.binary())], ["doc_id", "ids", "counts"])
        if doc_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for counts in batch.column("counts").drop_null().to_pylist():
            counts = np.frombuffer(counts, np.int64)
            total = counts if total is None else total + counts
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def _coder(lengths: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(lengths)
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2], f"<u{size}", int(offsets[-1] - offsets[0]) // size, int(offsets[0]))
            offsets = (offsets - offsets[0]) // size
            low = 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
                counts = np.diff(offsets[low : high + 1])
                made = list(encode(ids[offsets[low] : offsets[high]], counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(counts), pa.array([len(c) for _, c in made], pa.int64()),
                     pa.array([b for b, _ in made], pa.binary()), pa.array([c for _, c in made], pa.binary())],
                    ["doc_id", "n_ids", "n_bytes", "blocks", "code"],
                )
                low = high

    return run


def _writer(where: str, lengths: np.ndarray):
    header = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(where)
        files.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        out, name, offset, held, nth = None, "", 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal offset, held, nth
            table = pa.Table.from_batches(held).combine_chunks()
            listed = pa.BufferOutputStream()
            with pa.ipc.new_stream(listed, table.select(["doc_id", "n_ids", "n_bytes"]).schema) as stream:
                stream.write_table(table.select(["doc_id", "n_ids", "n_bytes"]))
            listed = listed.getvalue().to_pybytes()
            blocks, code = b"".join(table["blocks"].to_pylist()), b"".join(table["code"].to_pylist())
            raw = struct.pack("<QQQ", len(listed), len(blocks), len(code)) + listed + blocks + code
            out.write(raw)
            row = {"file": name, "offset": offset, "length": len(raw), "part": task, "nth": nth, "n_docs": table.num_rows, "n_ids": sum(table["n_ids"].to_pylist())}
            offset, held, nth = offset + len(raw), [], nth + 1
            return pa.RecordBatch.from_pylist([row])

        try:
            size = 0
            for batch in batches:
                if out is None:
                    # A name of its own for each attempt: what a lost attempt left is in no index.
                    name = f"{task:06d}-{uuid.uuid4().hex}.ids"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(MAGIC + struct.pack("<Q", len(header)) + header)
                    offset = len(MAGIC) + 8 + len(header)
                sums, low = np.cumsum(batch.column("n_bytes").to_numpy()), 0
                while low < batch.num_rows:
                    before = int(sums[low - 1]) if low else 0
                    high = min(batch.num_rows, int(np.searchsorted(sums, before + SEGMENT - size)) + 1)
                    held.append(batch.slice(low, high - low))
                    size += int(sums[high - 1]) - before
                    low = high
                    if size >= SEGMENT:
                        yield flush()
                        size = 0
            if held:
                yield flush()
        finally:
            if out is not None:
                out.close()

    return run


INDEX = "file string, offset long, length long, part long, nth long, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, where: str, end: int = END) -> DataFrame:
    """Write the ids of ``docs`` below ``where``, in ascending doc_id order; return the index, a row per segment.

    Each document's ids (the tokenizer's, then ``end``) are coded with the
    Huffman code of the counts over all documents. A file holds the code's
    lengths and then segments: doc_id, number of ids and bytes of each
    document, the bit offset of each block of BLOCK ids, and the codes. Files
    ascend with ``part``, segments with ``nth``. Rows that share a doc_id follow each
    other in the order of their codes' hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = cut(text_columns(docs).mapInArrow(_tokenizer(tokenizer, end), f"doc_id {kind}, ids binary, counts binary"), codec="uncompressed")
    counted = ids.select("counts").where("counts IS NOT NULL").mapInArrow(_sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max([end, *[r.id for r in rows]]) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max(LIMIT, int(np.count_nonzero(counts)).bit_length()))
    size = 2 if max(ByteBpe(tokenizer).size, end + 1) <= 1 << 16 else 4
    coded = cut(ids.where("ids IS NOT NULL").select("doc_id", "ids").mapInArrow(_coder(lengths, size), f"doc_id {kind}, n_ids long, n_bytes long, blocks binary, code binary"), codec="uncompressed")
    release(ids)
    total = coded.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE))
    # Hash and row number spread rows that share a doc_id.
    order = ["doc_id", "__hash", "__row"]
    keyed = coded.withColumns({"__hash": F.xxhash64("code"), "__row": F.monotonically_increasing_id()})
    index = cut(keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("__hash", "__row").mapInArrow(_writer(where, lengths), INDEX))
    release(coded)
    return index


def _reader(where: str, kind: pa.DataType | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(where)
        name, source, decode, known = "", None, None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, source = row["file"], files.open_input_file(f"{root}/{row['file']}")
                    head = source.read_at(len(MAGIC) + 8, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{name} is no file of token ids")
                    header = source.read_at(*struct.unpack("<Q", head[len(MAGIC) :]), len(head))
                    if header != known:
                        known, decode = header, Decoder(np.frombuffer(zlib.decompress(header), np.uint8))
                raw = source.read_at(row["length"], row["offset"])
                n_listed, n_blocks, n_code = struct.unpack_from("<QQQ", raw)
                listed = pa.ipc.open_stream(raw[24 : 24 + n_listed]).read_all()
                n_ids, n_bytes = listed["n_ids"].to_numpy(), listed["n_bytes"].to_numpy()
                inner = np.frombuffer(raw, "<u8", n_blocks // 8, 24 + n_listed).astype(np.int64)
                code = np.frombuffer(raw, np.uint8, n_code, 24 + n_listed + n_blocks)
                # Blocks of all documents in turn: the first of each at its first byte, the others at their checkpoints.
                per_doc = -(-n_ids // BLOCK)
                doc = np.repeat(np.arange(len(n_ids)), per_doc)
                first = np.cumsum(per_doc) - per_doc
                starts = np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, per_doc)
                others = np.ones(len(doc), bool)
                others[first] = False
                starts[others] += inner
                counts = np.minimum(BLOCK, n_ids[doc] - (np.arange(len(doc)) - first[doc]) * BLOCK)
                ids = decode(code, starts, counts).astype("<u4")
                low = np.cumsum(n_ids) - n_ids
                lists = [ids[a : a + n] for a, n in zip(low, n_ids, strict=True)]
                arrays = [listed["doc_id"].combine_chunks(), pa.array(row["first"] + low), pa.array(n_ids), pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def read_ids(index: DataFrame, where: str, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """doc_id (of type ``kind``), start, n_tokens, ids_crc32 and, ``with_ids``, ids of every document in the files of ``index``.

    Each segment is read and decoded by itself; start counts the ids of all
    documents before.
    """
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.join(F.broadcast(files), "part").withColumn("first", F.col("before") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    # By the bytes behind the index, not by the few of the index itself.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ))
    ordered = placed.select("file", "offset", "length", "first").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    more = ", ids array<int>" if with_ids else ""
    return ordered.mapInArrow(_reader(where, None, with_ids), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{more}")


def token_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read all of them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text: the end id alone. Null doc_ids come first; rows that
    share a doc_id, repeated ones too, are documents of their own. A very long
    text is coded in one piece, so a task needs about 50 bytes of memory per
    byte of its longest text. Other columns of ``docs`` play no part. Empty input: no files, no rows.
    """
    where = folder(docs.sparkSession)
    return read_ids(write_ids(docs, tokenizer, where, end), where, docs.schema["doc_id"].dataType.simpleString())
