"""Near duplicates by SuperMinHash signatures, banding, verification and grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from coratings.llm.staging import cut, sized, text_columns, text_key
from coratings.llm.text import SPACED, Words, long_lists, mix, pieces, salt, shingles

ROWS = 5  # signature values per band
MISS = 1e-7  # most likely share of pairs exactly at the threshold that meet in no band
BLOCK = 512  # documents on one side of a block of comparisons
ELEMENTS = 2_000_000  # set elements on one side of a block, on average
SLICE = 256  # documents of one hub that a task tests, on average
COUNTERS = 1 << 18  # hashed counters of how many sets have an element
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int) -> int:
    """Bands so that a pair at the threshold misses all with a probability of at most MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def superminhash(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures (rows x size) of sets of hashes.

    Every element walks through its own random permutation of the slots, in
    step j with the rank j plus a random fraction, and each slot keeps its
    least rank. A set stops as soon as the next step could lower none of its
    slots. All sets of the piece take step j together. A rank is 8 bits of j
    and 40 of fraction or more; an empty set keeps NEVER everywhere.
    """
    rows = len(offsets) - 1
    signature = np.full((rows, size), NEVER, np.uint64)
    flat = signature.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = np.arange(len(values))
    order: np.ndarray | None = None
    for step in range(size):
        if step:
            top = signature.max(axis=1)
            open_rows = (top >= np.uint64(step << 40)) & (np.diff(offsets) > 0)
            keep = open_rows[row[at]]
            if not keep.any():
                break
            at = at[keep]
            order = _start(values[at], size) if order is None else order[keep]
        drawn = mix(values[at] + salt(step))
        slot = step + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(size - step)) >> np.uint64(24)).astype(np.int64)
        if order is not None:
            line = np.arange(len(at))
            taken = order[line, slot].astype(np.int64)
            order[line, slot] = order[line, step]
            slot = taken
        np.minimum.at(flat, row[at] * size + slot, np.uint64(step << 40) | (drawn >> np.uint64(24)))
    return signature


def _start(values: np.ndarray, size: int) -> np.ndarray:
    """The permutations after step 0, for the few sets that go on."""
    order = np.tile(np.arange(size, dtype=np.uint16 if size > 256 else np.uint8), (len(values), 1))
    slot = (((mix(values + salt(0)) & np.uint64(0xFFFFFF)) * np.uint64(size)) >> np.uint64(24)).astype(np.int64)
    order[np.arange(len(values)), slot] = 0
    return order


def _signer(words: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                value, at = shingles(Words(data, offsets, SPACED), words)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(value + salt(900 + i))))) for i in (0, 1)]
                signature = superminhash(value, at, bands * ROWS)
                band = np.zeros((high - low, bands), np.uint64)
                for i in range(ROWS):
                    band = mix(band + signature[:, i::ROWS] + salt(i + 50))
                band += np.array([salt(500 + b) for b in range(bands)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(low, high - low) for c in ("doc_id", "key_a", "key_b")],
                        pa.array(np.diff(at), pa.int64()),
                        *[pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums],
                        long_lists(band.reshape(-1), np.arange(high - low + 1) * bands),
                    ],
                    ["doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _set_reader(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                value, at = shingles(Words(data, offsets, SPACED), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), long_lists(value, at)], ["doc_id", "elements"]
                )

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements per counter, one row per counter and task."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])


def _rarest(counts, percent: int):
    """The rarest elements of each set, as many as a set that is alike enough must share one of.

    Of n elements at least ``percent`` in a hundred are common, so the first
    common one, in any order that all sets agree on, is among the first
    n - ceil(n * percent / 100) + 1. The order is by counter, then by element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            value, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((value, counts.value[value & (COUNTERS - 1)], row))
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            chosen = place < (size - -(-size * percent // 100) + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(value[order][chosen]), batch.column(0).take(pa.array(row[chosen]))], ["key", "doc"])

    return run


def _enough(both, left, right, percent: int):
    return both * 100 >= (left + right - both) * percent


def _block_edges(percent: int):
    """Groups that the links between the probes and targets of a block make, as edges to their least member."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        probe, target = block[block.probe], block[~block.probe]
        sides = []
        shared = np.intersect1d(*[np.concatenate([*s.elements, np.zeros(0, np.int64)]) for s in (probe, target)])
        for side in (probe, target):
            size = np.array([len(e) for e in side.elements], np.int64)
            every = np.concatenate([*side.elements, np.zeros(0, np.int64)])
            column = np.searchsorted(shared, every)
            hit = column < len(shared)
            hit[hit] = shared[column[hit]] == every[hit]
            sides.append((side.doc.to_numpy(), size, np.repeat(np.arange(len(side)), size)[hit], column[hit]))
        (ids, n, line, column), (ids2, n2, line2, column2) = sides
        both = np.zeros((len(ids), len(ids2)), np.float32)
        for low in range(0, len(shared), 4096):
            a, b = np.zeros((len(ids), 4096), np.float32), np.zeros((len(ids2), 4096), np.float32)
            for m, i, c in ((a, line, column), (b, line2, column2)):
                here = (c >= low) & (c < low + 4096)
                m[i[here], c[here] - low] = 1
            both += a @ b.T
        linked = _enough(both.astype(np.int64), n[:, None], n2[None, :], percent)
        linked &= ids[:, None] != ids2[None, :]
        # Union-find with flat roots: a probe and its targets get the least of their roots.
        nodes = np.unique(np.concatenate([ids, ids2]))
        root = np.arange(len(nodes))
        own, other = np.searchsorted(nodes, ids), np.searchsorted(nodes, ids2)
        for i in np.flatnonzero(linked.any(axis=1)):
            roots = np.unique(root[np.append(other[linked[i]], own[i])])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        joined = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[root[joined]], "b": nodes[joined]}, dtype="int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a < b): root is the smallest id reachable.

    Large and small stars in turn (each id hands its larger, then its smaller
    neighbours to the smallest) until nothing changes; each turn is written.
    """
    now = cut(edges.select("a", "b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("root").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("root"))
        now = cut(
            large.join(least, "b")
            .select(F.col("root"), F.explode(F.array("a", "b")).alias("id"))
            .where("root < id")
            .select(F.col("root").alias("a"), F.col("id").alias("b"))
            .distinct()
        )
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))


def hub_pairs(keyed: DataFrame) -> DataFrame:
    """(hub, doc) from (key, doc): every document beside the smallest id that shares a key with it."""
    # Written, so that the join below reads plain shuffles, of which Spark splits hot keys.
    hubs = cut(keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    return cut(keyed.join(hubs, "key").where("hub <> doc").select("hub", "doc").distinct())


def tested_with_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, doc, size and linked of every pair, on full sets. The documents of a hub are dealt to tasks in slices."""
    heads = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SLICE).alias("slices")))
    dealt = pairs.join(sized(heads), "hub").select("hub", "doc", F.pmod(F.xxhash64("doc"), "slices").alias("slice"))
    of_hub = heads.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).join(
        sets.select(F.col("doc").alias("hub"), F.col("elements").alias("hub_elements")), "hub"
    )
    common = F.size(F.array_intersect("elements", "hub_elements")).cast("long")
    linked = _enough(common, F.size("elements"), F.size("hub_elements"), percent)
    return cut(
        dealt.join(sets, "doc")
        .join(of_hub, ["hub", "slice"])
        .select("hub", "doc", F.size("elements").cast("long").alias("size"), linked.alias("linked"))
    )


def loose_hubs(tested: DataFrame) -> DataFrame:
    """Hubs that some of their documents are not linked with, and the blocks in which those meet the others."""
    out = ~F.col("linked")
    found = tested.groupBy("hub").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.count_if(out).alias("n_out"), F.sum(F.when(out, F.col("size"))).alias("size_out")
    )
    blocks = [F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / ELEMENTS)) for n, size in (("n", "size"), ("n_out", "size_out"))]
    return cut(found.where("n > 1 AND n_out > 0").select("hub", blocks[0].alias("across"), blocks[1].alias("down")))


def block_members(tested: DataFrame, hubs: DataFrame) -> DataFrame:
    """hub, doc, probe, i, j: the blocks of comparisons that the documents of loose hubs go to."""
    mixed = tested.join(sized(hubs), "hub")
    spot = F.xxhash64("doc")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    targets = mixed.select("hub", "doc", F.lit(False).alias("probe"), all_of("down").alias("i"), F.pmod(spot, "across").alias("j"))
    probes = mixed.where(~F.col("linked")).select("hub", "doc", F.lit(True).alias("probe"), F.pmod(spot, "down").alias("i"), all_of("across").alias("j"))
    return targets.union(probes)


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, doc): of each set the elements that one alike enough must share one of, the rarest among ``sets``."""
    counted = sets.select("elements").mapInArrow(_counter, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[table.column("counter").to_numpy()] = table.column("n").to_numpy()
    kind = sets.schema["doc"].dataType.simpleString()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return cut(sets.select("doc", "elements").mapInArrow(_rarest(shared, percent), f"key long, doc {kind}"))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and key_a, key_b of the text, per row of ``docs``.

    Two documents are linked if 100 * common shingles >= ``percent`` * all
    shingles. Words are runs of non-space characters, A-Z lower-cased.

    Equal sets are one class, found by a combined aggregate, so copies cost
    nothing further. Classes that meet in a band are first compared with the
    smallest id of their bucket only. The members of buckets where some fail
    that test must also share one of their rarest elements to be linked, so
    they are dealt by those anew, which leaves texts of one template apart, and
    compared with the smallest id again. Where some fail that too, they are
    compared, in blocks of bounded size spread over tasks, with all that share
    such a smallest id; so no link is lost and no bucket is capped.

    Null text, or text without words: empty set, linked with nothing, itself
    its component. Null doc_id: component null, kept. Rows that share a doc_id
    are each judged by their own text; where one of them must stand for the id
    in a comparison, it is the one with the least set. Empty input: no rows. A text of any length is one
    set, read whole in one task. Columns other than doc_id and text are not
    looked at.
    """
    source = text_columns(docs)
    bands = bands_for(percent)
    key = StructField("doc_id", docs.schema["doc_id"].dataType)
    longs = [StructField(n, LongType()) for n in ("key_a", "key_b", "n_shingles", "set_a", "set_b")]
    signed = cut(source.select("doc_id", "text", *text_key()).mapInArrow(_signer(words, bands), StructType([key, *longs, StructField("bands", ArrayType(LongType()))])))
    same = ["set_a", "set_b", "n_shingles"]
    classes = cut(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"))
    )

    pairs = hub_pairs(classes.select("doc", F.explode("bands").alias("key")))
    wanted = cut(pairs.select(F.explode(F.array("hub", "doc")).alias("doc_id")).distinct())
    sets = cut(
        source.join(sized(wanted), "doc_id", "left_semi")
        .mapInArrow(_set_reader(words), StructType([key, StructField("elements", ArrayType(LongType()))]))
        .groupBy(F.col("doc_id").alias("doc"))
        .agg(F.min("elements").alias("elements"))
    )
    tested = tested_with_hubs(pairs, sets, percent)
    edges = tested.where("linked").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    loose = cut(tested.join(sized(loose_hubs(tested).select("hub")), "hub", "left_semi").select("doc").distinct())
    if not loose.isEmpty():
        rest = cut(sets.join(sized(loose), "doc", "left_semi"))
        tested = tested_with_hubs(hub_pairs(rare_keys(rest, percent)), rest, percent)
        found = (
            block_members(tested, loose_hubs(tested))
            .join(rest, "doc")
            .groupBy("hub", "i", "j")
            .applyInPandas(_block_edges(percent), "a long, b long")
        )
        edges = edges.union(tested.where("linked").select("hub", "doc")).union(found)
    roots = components(edges)

    class_of = classes.select(*same, "doc").join(roots.select(F.col("id").alias("doc"), "root"), "doc", "left")
    class_of = class_of.select(*same, F.coalesce("root", "doc").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.drop("bands")
        .join(class_of, same, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), "key_a", "key_b")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
