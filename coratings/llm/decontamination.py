"""Benchmark passages in training text, found through a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from coratings.llm.staging import BROADCAST_TEXT_ROWS, cut, sized, text_key
from coratings.llm.text import ALNUM, Words, pieces

# The filter of benchmark words has 2 ** BITS bits: 8 MB, however large the benchmark is.
BITS = 26
SPAN = 64  # places that are looked through together where two lists are intersected


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch):
            words = Words(data, offsets, ALNUM)
            lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["item_id", "words"])


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id (string) and terms: every ``size`` consecutive words, or all words of a shorter item."""
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = source.mapInArrow(_benchmark_words, "item_id string, words array<long>").where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return words.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start"), F.lit(size)).alias("terms")
    )


def _word_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each value that the first BITS bits of a benchmark word's hash take.

    Made by Spark, 64 bits a row, so at most 2 ** BITS / 64 rows reach the driver. With
    more words more bits are set and more words of documents are posted in vain, no more.
    """
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    rows = terms.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - BITS}) & 63 AS INT))").alias("bit"))
    table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, (1 << BITS) // 64), np.int64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _poster(known, bits: int):
    """Rows of two kinds for each piece of documents: its documents, and each word that passes the
    filter with all its places in the piece (row of the document * 2 ** 32 + place), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = known.value
        segment = TaskContext.get().partitionId() << 40
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for low, high, data, offsets in pieces(batch):
                words = Words(data, offsets, ALNUM)
                hashed = words.hashes()
                bit = hashed >> np.uint64(64 - bits)
                hit = np.flatnonzero((flags[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                hit = hit[np.argsort(hashed[hit], kind="stable")]
                row, term = words.row[hit].astype(np.int64), hashed[hit]
                at = (row << 32) | (hit - words.first[row])
                edge = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
                edges = np.append(edge, len(term)).astype(np.int32)
                count = high - low

                def column(documents, postings, type_):
                    blank = [pa.nulls(n, type_) for n in (count, len(edge))]
                    return pa.concat_arrays([blank[0] if documents is None else documents, blank[1] if postings is None else postings])

                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(None, pa.array(term[edge].view(np.int64)), pa.int64()),
                        pa.array(np.full(count + len(edge), segment)),
                        column(None, pa.array(np.diff(edges).astype(np.int64)), pa.int64()),
                        column(None, lists, lists.type),
                        column(pa.array(np.arange(segment, segment + count)), None, pa.int64()),
                        column(batch.column(0).slice(low, count), None, kind),
                        *[column(batch.column(i).slice(low, count), None, pa.int64()) for i in (1, 2)],
                        column(pa.array(words.count, pa.int64()), None, pa.int64()),
                    ],
                    ["term", "segment", "n", "at", "rid", "doc_id", "key_a", "key_b", "n_words"],
                )
                segment += count

    return run


def _span(column: Column) -> Column:
    return column - F.pmod(column, F.lit(SPAN))


def _spans(column: Column, slop: int) -> Column:
    """The one or two spans that places at most ``slop`` from ``column`` lie in."""
    return F.explode(F.array_distinct(F.array(_span(column - slop), _span(column + slop))))


class PositionalIndex:
    """``documents``: rid, doc_id, key_a, key_b, n_words. ``postings``: term, segment, n, at.

    A posting row holds all places of a word in one segment (a piece of about a megabyte
    of documents), so a very frequent word is many rows. They are written once, by term:
    rebalanced, so that Spark splits what a frequent word makes too large, and sorted, so
    that row groups tell the terms in them. Only words that pass a filter of the
    benchmark's words (``terms``: hash) are posted; no other word can be in a match.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame):
        known = docs.sparkSession.sparkContext.broadcast(_word_filter(terms))
        source = docs.select("doc_id", *text_key(), F.coalesce(docs["text"], F.lit("")).alias("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = source.mapInArrow(
            _poster(known, BITS),
            f"term long, segment long, n long, at array<long>, rid long, doc_id {kind}, key_a long, key_b long, n_words long",
        )
        spread = rows.withColumn("spread", F.coalesce("term", F.xxhash64("rid"))).hint("rebalance", "spread")
        stored = cut(spread.sortWithinPartitions("term", "rid").drop("spread"))
        self.documents = stored.where("term IS NULL").select("rid", "doc_id", "key_a", "key_b", "n_words")
        self.postings = stored.where("term IS NOT NULL").select("term", "segment", "n", "at")

    def found(self, windows: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
        """(exact, near): rid, wid, start, size of whole windows, and rid, wid of windows all of whose words
        occur, each at a place of its own, moved by at least some a and at most a + ``slop`` places from
        the window's (slop = 0: no near ones). So up to ``slop`` words may be between its words, or two
        neighbours be exchanged for slop = 2; a window with a word replaced or left out is no match.

        ``windows``: wid, terms (hashes). The lists of the rarest two words are
        intersected first, each place less its word's place in the window; the
        others are looked up only in segments and documents where those agree.
        """
        terms = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
        wanted = sized(cut(terms.select("term").distinct()))
        counts = cut(self.postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")))
        by_rarity = Window.partitionBy("wid").orderBy("n", "term", "place")
        # A window with a word that no document has cannot occur.
        placed = cut(
            terms.join(sized(counts), "term")
            .withColumn("known", F.count("*").over(Window.partitionBy("wid")))
            .withColumn("rank", F.row_number().over(by_rarity))
            .where("known = size")
            .select("wid", "size", "place", "term", "rank")
        )
        rid, at = F.col("segment") + F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))

        def starts(where: str) -> DataFrame:
            rows = placed.where(where).select("wid", "place", "term")
            places = self.postings.drop("n").join(sized(rows), "term").withColumn("at", F.explode("at"))
            return places.select("segment", rid.alias("rid"), "wid", (at - F.col("place")).alias("start"))

        first = starts("rank = 1 AND size > 1").withColumn("span", _spans(F.col("start"), slop))
        second = starts("rank = 2").select("rid", "wid", F.col("start").alias("other"), _span(F.col("start")).alias("span"))
        agreed = first.join(second, ["rid", "wid", "span"]).where(F.abs(F.col("other") - F.col("start")) <= slop)
        alike = cut(agreed.select("segment", "rid", "wid", "start").distinct().union(starts("rank = 1 AND size = 1")))

        others = sized(cut(placed.where("rank > 1").select("wid", "place", "term")))
        sought = alike.join(others, "wid")
        segments = sized(cut(sought.select("segment", "term").distinct()))
        rids = sized(cut(alike.select("rid").distinct()))
        lists = (
            self.postings.drop("n").join(segments, ["segment", "term"], "left_semi").withColumn("at", F.explode("at"))
            .select(rid.alias("rid"), "term", at.alias("at")).join(rids, "rid", "left_semi")
            .withColumn("span", _span(F.col("at")))
        )
        goal = F.col("start") + F.col("place")
        heads = sized(cut(placed.where("rank = 1").select("wid", "size", F.col("place").alias("head"), F.col("term").alias("head_term"))))
        # A word has at most 2 * slop + 1 places here, so the lists are short.
        met = (
            sought.withColumn("span", _spans(goal, slop)).join(lists, ["rid", "term", "span"]).where(F.abs(F.col("at") - goal) <= slop)
            .groupBy("rid", "wid", "start")
            .agg(
                F.count_if(F.col("at") == goal).alias("held"),
                F.collect_list(F.struct("place", "term", (F.col("at") - F.col("place")).alias("move"))).alias("words"),
            )
            .union(alike.join(heads.where("size = 1"), "wid", "left_semi").select("rid", "wid", "start", F.lit(0).cast("long"), F.array().cast("array<struct<place:int,term:bigint,move:bigint>>")))
            .join(heads, "wid")
        )
        whole = F.col("held") == F.col("size") - 1
        own = F.array(F.struct(F.col("head").alias("place"), F.col("head_term").alias("term"), F.col("start").alias("move")))
        met = cut(
            met.where(F.size(F.array_distinct("words.place")) == F.col("size") - 1)
            .select("rid", "wid", "start", "size", whole.alias("whole"), F.when(~whole, F.concat("words", own)).alias("words"))
        )
        exact = met.where("whole").select("rid", "wid", "start", "size")
        if not slop:
            return exact, exact.select("rid", "wid").limit(0)
        loose = met.where("NOT whole").select("rid", "wid", "start", "words")
        return exact, cut(loose.mapInArrow(_fitting(slop), "rid long, wid long").distinct())


def fits(start: int, words: list[tuple[int, int, list[int]]], slop: int) -> bool:
    """Whether all ``words`` (place, term, moves) have a place of their own with moves from a to a + slop, for an a that allows ``start``."""
    words = sorted(words)
    for a in range(start - slop, start + 1):
        last: dict[int, int] = {}
        for place, term, moves in words:
            # Of one term the places allowed grow with the word's own, so the first free one is as good as any.
            free = [place + m for m in moves if a <= m <= a + slop and place + m > last.get(term, -1)]
            if not free:
                break
            last[term] = min(free)
        else:
            return True
    return False


def _fitting(slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, words = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for start, found in zip(starts, words, strict=True):
                moves: dict[tuple[int, int], list[int]] = {}
                for w in found:
                    moves.setdefault((w["place"], w["term"]), []).append(w["move"])
                good.append(fits(start, [(*word, near) for word, near in moves.items()], slop))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["rid", "wid"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and key_a, key_b per row of ``docs``.

    A word inside any occurrence of a window of ``benchmark`` is hit. n_near
    counts windows found only loosely, see PositionalIndex.found; contaminated
    is by whole windows alone.

    Null or empty texts have no words and no windows. Repeated documents are
    judged each; items with the same window all count, those without item_id
    are left out of the list of items but their words are hit. Empty tables:
    no rows, or no hits.
    A very long text is a segment of its own and is
    read whole. Other columns of either table play no part, whatever their names.
    """
    items = cut(benchmark_windows(benchmark, size))
    windows = cut(items.groupBy("terms").agg(F.count("*").alias("times")).withColumn("wid", F.monotonically_increasing_id()))
    of_item = items.where("item_id IS NOT NULL").join(windows, "terms").select("wid", "item_id").distinct()
    index = PositionalIndex(docs, windows.select(F.explode("terms").alias("hash")).distinct())
    hits, loose = index.found(windows, slop)

    words = hits.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("word"))
    hit_words = words.distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    listed = (
        hits.select("rid", "wid").distinct().join(sized(cut(of_item), BROADCAST_TEXT_ROWS), "wid").select("rid", "item_id").distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    loosely = loose.join(hits, ["rid", "wid"], "left_anti").groupBy("rid").agg(F.countDistinct("wid").alias("n_near"))
    marked = cut(hit_words.join(listed, "rid", "left").join(loosely, "rid", "full"))
    zero = F.lit(0).cast("long")
    n_hit, names = F.coalesce("n_hit", zero), F.coalesce("items", F.array().cast("array<string>"))
    return index.documents.join(sized(marked, BROADCAST_TEXT_ROWS), "rid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"), "key_a", "key_b",
    )
