"""Removal of long repeated byte strings by a sparse, range-partitioned suffix array.

Sorting the suffix at every byte would move hundreds of bytes for each byte of
text. It is enough to sort at anchors: the least of the hashed ``gram``-byte
strings inside each ``length``-byte window. Equal windows have equal anchors, so
a repeated window shows as two anchors with the same leading bytes, as much in
common to the right and as much to the left as the window needs.

1. One scan hashes the grams and lists each distinct text's anchors; only
   anchors whose gram occurs twice go on.
2. An anchor's context is all bytes of the windows it is the anchor of. Equal
   contexts are one, found by a combined aggregate; a gram with one context
   only is decided by its count.
3. The rest are range partitioned by the leading bytes of the suffix at the
   anchor, with splitters that Spark samples. A bucket sorts its suffixes, and
   the reversed bytes to the left, by multikey quicksort. Equal leading bytes
   never lie on both sides of a boundary, so no match crosses one. A gram with
   more than HOT contexts is not sorted in one task: its windows are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coratings.llm.staging import cut, sized, text_columns, text_key
from coratings.llm.text import DOWN, UP, mix, pieces, prefix, salt, span_hash

BUCKET = 20_000  # contexts in a bucket, on average
HOT = 50_000  # contexts of one gram beyond which its windows are counted instead


def gram_of(length: int) -> int:
    return max(1, length // 4)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: position, document, least and greatest distance of a window's start, gram hash.

    The least 32 bits of hash win, the leftmost of equals: both depend on the
    window's bytes alone.
    """
    gram, n = gram_of(length), len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    at = np.arange(n - gram + 1)
    hashed = span_hash(prefix(data), at, at + gram)
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: n - length + 1], least[width - span :][: n - length + 1])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[doc + 1])
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(edge[1:], len(anchor))[: len(edge)] - 1
    anchor = anchor[edge]
    return anchor, doc[start[edge]], anchor - start[last], anchor - start[edge], hashed[anchor]


def _lister(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                at, doc, _, _, gram = anchors(data, offsets, length)
                first = pa.array(np.searchsorted(doc, np.arange(high - low + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (gram.view(np.int64), (at - offsets[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(low, high - low) for i in (1, 2, 3)], *lists],
                    ["key_a", "key_b", "n_bytes", "grams", "positions"],
                )

    return run


def _second(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of spans, over mixed pairs of bytes, independent of the first."""
    pair = data.astype(np.uint64)
    pair[1:] += pair[:-1] * np.uint64(257)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(pair + salt(77)) * UP.upto(len(data)))))
    inner = np.minimum(start + 1, end)
    value = (sums[end] - sums[inner]) * DOWN.upto(len(data) + 1)[inner]
    return mix(value + data[np.minimum(start, len(data) - 1)] * np.uint64(3) + (end - start).astype(np.uint64) * salt(78))


def _wanted(batch: pa.RecordBatch, low: int, high: int, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which anchors are listed in the batch's ``positions``."""
    listed = batch.column(batch.schema.get_field_index("positions")).slice(low, high - low)
    counts = np.diff(listed.offsets.to_numpy())
    listed = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offsets[:-1], counts)
    return np.isin(at, listed)


def _describer(length: int):
    """Rows of anchors without their bytes: two hashes stand for the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                at, doc, near, far, gram = anchors(data, offsets, length)
                keep = _wanted(batch, low, high, offsets, at, doc)
                at, doc, near, far, gram = at[keep], doc[keep], near[keep], far[keep], gram[keep]
                start, end = at - far, at - near + length
                shape = (near * 4096 + far).astype(np.uint64)
                contexts = (
                    mix(span_hash(prefix(data), start, end) + mix(shape + salt(1))),
                    mix(_second(data, start, end) + mix(shape + salt(2))),
                )
                tid, many = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[low:high] for c in ("tid", "many"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tid[doc], pa.int64()),
                        pa.array((at - offsets[doc]).astype(np.int32)),
                        pa.array(near.astype(np.int32)),
                        pa.array(far.astype(np.int32)),
                        pa.array(np.where(many[doc], 2, 1), pa.int64()),
                        pa.array(gram.view(np.int64)),
                        *[pa.array(c.view(np.int64)) for c in contexts],
                    ],
                    ["tid", "position", "near", "far", "n", "gram", "ctx_a", "ctx_b"],
                )

    return run


def _reader(length: int, windows: bool):
    """The bytes of chosen contexts, or with ``windows`` two hashes of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                listed = batch.column(batch.schema.get_field_index("contexts")).slice(low, high - low)
                counts = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten()
                cols = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
                at = cols["position"] + np.repeat(offsets[:-1], counts)
                near, far = cols["near"].astype(np.int64), cols["far"].astype(np.int64)
                names = ["ctx_a", "ctx_b", "n"]
                if windows:
                    times = far - near + 1
                    back = np.repeat(far, times) - (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                    start = np.repeat(at, times) - back
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(np.repeat(cols[c], times)) for c in names],
                            pa.array(back.astype(np.int32)),
                            pa.array(span_hash(prefix(data), start, start + length).view(np.int64)),
                            pa.array(_second(data, start, start + length).view(np.int64)),
                        ],
                        [*names, "back", "win_a", "win_b"],
                    )
                    continue
                raw = data.tobytes()
                right = [raw[a : a - b + length] for a, b in zip(at.tolist(), near.tolist(), strict=True)]
                left = [raw[a - b : a] for a, b in zip(at.tolist(), far.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(cols[c]) for c in names],
                        pa.array(near.astype(np.int32)),
                        pa.array(far.astype(np.int32)),
                        pa.array(right, pa.binary()),
                        pa.array(left, pa.binary()),
                    ],
                    [*names, "near", "far", "suffix", "left"],
                )

    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of strings given as rows of 8-byte words.

    Three-way quicksort on one word at a time: what equals the pivot goes on to
    the next word. All open segments are split at once in each round.
    """
    n, width = words.shape
    order = np.arange(n)
    place, segment, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(place) > 1:
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        size = np.diff(np.append(first, len(place)))
        item = order[place]
        key = words[item, depth]
        pivot = np.repeat(key[first + size // 2], size)
        part = np.repeat(np.arange(len(first)) * 3, size) + (key == pivot) + 2 * (key > pivot)
        moved = np.argsort(part, kind="stable")
        order[place] = item[moved]
        part = part[moved]
        depth = depth[moved] + (part % 3 == 1)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(np.append(first, len(place)))
        still = (np.repeat(size, size) > 1) & (depth < width)
        place, segment, depth = place[still], part[still], depth[still]
    return order


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of zero-padded words, and their lengths."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    size = np.diff(offsets)
    spot = np.arange(-(-width // 8) * 8)
    out = data[np.minimum(offsets[:-1, None] + spot, max(0, len(data) - 1))]
    out[spot >= size[:, None]] = 0
    return out, size


def _ranked(matrix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the bytes each has in common with the one before it."""
    order = multikey_quicksort(np.ascontiguousarray(matrix).view(">u8").astype(np.uint64))
    differ = matrix[order[1:]] != matrix[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))


def _group(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the group of rows that agree in ``depth`` bytes."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < depth)
    return out


def _bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("ctx_a", "ctx_b", "n", "near", "far")}
        right = _ranked(*_matrix(table.column("suffix").chunk(0), length))
        left, size = _matrix(table.column("left").chunk(0), max(8, length))
        spot = size[:, None] - 1 - np.arange(left.shape[1])
        left = np.where(spot >= 0, np.take_along_axis(left, np.maximum(spot, 0), 1), 0).astype(np.uint8)
        left = _ranked(left, size)
        far, near = np.full(table.num_rows, -1, np.int32), np.full(table.num_rows, -1, np.int32)
        for back in range(int(col["near"].min()), int(col["far"].max()) + 1):
            here = np.flatnonzero((col["near"] <= back) & (back <= col["far"]))
            key = _group(*right, length - back)[here] * (table.num_rows + 1) + _group(*left, back)[here]
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            twice = here[(count[which] > 1) | (col["n"][here] > 1)]
            far[twice] = back
            near[twice[near[twice] < 0]] = back
        found = far >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[found]) for x in (col["ctx_a"], col["ctx_b"], near, far)], ["ctx_a", "ctx_b", "low", "high"]
        )

    return run


def _cutter(as_text: bool):
    """The texts without their repeated bytes; ``as_text`` also drops what is left of a cut character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
                pairs = sorted((x["low"], x["high"]) for x in spans.as_py())
                runs: list[list[int]] = []
                for low, high in pairs:
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                edges = [0, *[x for run in runs for x in run], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["kept"].append(kept.decode("utf-8", "ignore").encode() if as_text else kept)
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key_a"), batch.column("key_b"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())],
                ["key_a", "key_b", "n_removed", "n_spans", "kept"],
            )

    return run


def _changed(source: DataFrame, length: int, as_text: bool = False) -> DataFrame:
    """key_a, key_b, n_removed, n_spans, kept (bytes) of the texts that lose bytes."""
    keyed = source.select("text", *text_key())
    listed = keyed.select("text", "key_a", "key_b", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        _lister(length), "key_a long, key_b long, n_bytes long, grams array<long>, positions array<int>"
    )
    texts = cut(
        listed.groupBy("key_a", "key_b")
        .agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_bytes", "grams", "positions")])
        .where(F.col("n_bytes") >= length)
        .withColumn("tid", F.monotonically_increasing_id())
    )
    spots = texts.select("tid", F.explode(F.arrays_zip("grams", "positions")).alias("x")).select("tid", F.col("x.grams").alias("gram"), F.col("x.positions").alias("position"))
    twice = texts.select(F.explode("grams").alias("gram"), (F.col("copies") > 1).cast("int").alias("more"))
    # Written, so that the joins below read plain shuffles, of which Spark splits hot grams.
    twice = cut(twice.groupBy("gram").agg(F.sum(F.col("more") + 1).alias("n")).where("n > 1").select("gram"))
    chosen = spots.join(twice, "gram").groupBy("tid").agg(F.collect_list("position").alias("positions"))
    chosen = cut(chosen.join(texts.select("tid", "key_a", "key_b", (F.col("copies") > 1).alias("many")), "tid"))
    needed = sized(chosen.select("key_a", "key_b"))
    kept_texts = cut(
        keyed.join(needed, ["key_a", "key_b"], "left_semi")
        .groupBy("key_a", "key_b")
        .agg(F.first("text").alias("text"))
        .join(chosen, ["key_a", "key_b"])
    )

    seen = cut(
        kept_texts.select("text", "tid", "many", "positions").mapInArrow(
            _describer(length), "tid long, position int, near int, far int, n long, gram long, ctx_a long, ctx_b long"
        )
    )
    contexts = cut(
        seen.groupBy("gram", "ctx_a", "ctx_b").agg(
            F.sum("n").alias("n"), F.min(F.struct("tid", "position", "near", "far")).alias("at")
        ).select("gram", "ctx_a", "ctx_b", "n", "at.*")
    )
    grams = cut(contexts.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1"))
    undecided = cut(contexts.join(grams, "gram"))
    decided = contexts.where("n > 1").select("ctx_a", "ctx_b", F.col("near").alias("low"), F.col("far").alias("high"))

    def with_text(rows: DataFrame, run, schema: str) -> DataFrame:
        lists = rows.groupBy("tid").agg(F.collect_list(F.struct("ctx_a", "ctx_b", "n", "position", "near", "far")).alias("contexts"))
        return lists.join(kept_texts.select("tid", "text"), "tid").select("text", "contexts").mapInArrow(run, schema)

    buckets = max(1, -(-undecided.count() // BUCKET))
    suffixes = with_text(
        undecided.where(F.col("different") <= HOT), _reader(length, False),
        "ctx_a long, ctx_b long, n long, near int, far int, suffix binary, left binary",
    )
    result = "ctx_a long, ctx_b long, low int, high int"
    sorted_ = suffixes.repartitionByRange(buckets, F.substring("suffix", 1, gram_of(length))).mapInArrow(_bucket(length), result)
    windows = with_text(
        undecided.where(F.col("different") > HOT), _reader(length, True),
        "ctx_a long, ctx_b long, n long, back int, win_a long, win_b long",
    )
    again = windows.groupBy("win_a", "win_b").agg(F.sum("n").alias("times")).where("times > 1")
    counted = windows.join(again, ["win_a", "win_b"]).groupBy("ctx_a", "ctx_b").agg(F.min("back").alias("low"), F.max("back").alias("high"))
    repeated = decided.union(sorted_)
    if not undecided.where(F.col("different") > HOT).isEmpty():
        repeated = repeated.union(counted)
    repeated = cut(repeated.groupBy("ctx_a", "ctx_b").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    spans = (
        seen.join(repeated, ["ctx_a", "ctx_b"])
        .select("tid", F.struct((F.col("position") - F.col("high")).alias("low"), (F.col("position") - F.col("low") + length).alias("high")).alias("span"))
        .groupBy("tid")
        .agg(F.collect_list("span").alias("spans"))
    )
    part = (
        kept_texts.where(~F.col("many"))
        .select("tid", "key_a", "key_b", "text")
        .join(spans, "tid")
        .mapInArrow(_cutter(as_text), "key_a long, key_b long, n_removed long, n_spans long, kept binary")
    )
    whole = texts.where("copies > 1").select("key_a", "key_b", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return cut(part.union(whole))


def repeated_text(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``.

    A byte goes if a ``length``-byte string over it also starts anywhere else,
    in the same text or another, judged on the input; matches stay within one
    text. Every occurrence goes, the first included.

    Null text is empty. Shorter and empty texts lose nothing. Repeated rows
    are occurrences of their own, whatever their doc_id, which may be null.
    Empty input: no rows.
    """
    source = text_columns(docs)
    changed = _changed(source, length).select("key_a", "key_b", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    every = source.select("doc_id", *text_key(), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return every.join(changed, ["key_a", "key_b"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text, and n_chars to match.

    Rows and other columns stay; a text may become empty. A character of which
    only some bytes go is dropped whole.
    """
    changed = _changed(text_columns(docs), length, as_text=True).select(
        F.col("key_a").alias("__cut_a"), F.col("key_b").alias("__cut_b"), F.col("kept").cast("string").alias("__kept")
    )
    key_a, key_b = text_key()
    joined = docs.join(changed, (key_a == F.col("__cut_a")) & (key_b == F.col("__cut_b")), "left")
    text = F.coalesce("__kept", docs["text"])
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])

