import itertools
import random

import brute
from coratings.llm import decontamination as module
from coratings.llm.decontamination import contamination
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def small(spark):
    pick = random.Random(1)
    vocabulary = "a b c dd e é".split()
    rows = [(i, " ".join(pick.choices(vocabulary, k=pick.choice([0, 3, 30])))) for i in range(80)]
    rows += [(1, None), (None, "a b"), (2, "")]
    items = [(1, "a"), (2, "b c"), (3, None), (4, "dd dd dd"), (5, "a b c dd e"), (None, "é é"), (7, "A!B c")]
    items += [(10, " ".join(pick.choices(vocabulary, k=14))), (11, "never seen words"), (12, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, items, docs, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    rows, items, docs, benchmark = small(spark)
    assert rows_of(contamination(docs, benchmark)) == sorted(brute.contaminated(rows, items), key=str)


def test_a_filter_that_lets_every_word_pass(spark, monkeypatch):
    rows, items, docs, benchmark = small(spark)
    monkeypatch.setattr(module, "BITS", 1)
    assert rows_of(contamination(docs, benchmark)) == sorted(brute.contaminated(rows, items), key=str)


def test_test_tables(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_check}/benchmark.parquet").select("item_id", "text")
    want = brute.contaminated([tuple(r) for r in docs.collect()], [tuple(r) for r in benchmark.collect()])
    assert rows_of(contamination(docs, benchmark)) == sorted(want, key=str)
    assert any(x[5] for x in want)


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha q q q q beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in contamination(docs, items, slop=1).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0)}


def near_by_hand(words, window, slop):
    """Whether places of their own for all words of ``window`` exist, moved by at most ``slop`` more for one than for another."""
    places = [[q for q, w in enumerate(words) if w == x] for x in window]
    return any(
        len(set(p)) == len(p) and max(q - k for k, q in enumerate(p)) - min(q - k for k, q in enumerate(p)) <= slop
        for p in itertools.product(*places)
    )


def test_near_matches_of_long_windows(spark):
    item = "one two three four five six seven eight nine ten".split()
    put = lambda at, *more: item[:at] + list(more) + item[at:]
    docs = [
        item, put(5, "x"), put(5, "x", "y"), put(3, "x")[:7] + ["y"] + put(3, "x")[7:], put(5, "x", "y", "z"),
        item[:4] + [item[5], item[4]] + item[6:], [*item[:5], "x", *item[6:]], item[:1] + list("abcdefg") + item[8:], item[:2] + item[:1] + item[2:], [],
    ]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in contamination(rows, items, slop=2).collect()}
    want = {i: (False, int(near_by_hand(d, item, 2))) for i, d in enumerate(docs)}
    want |= {i: (True, 0) for i in (0,)}
    assert got == want
    assert [i for i, (_, n) in got.items() if n] == [1, 2, 3, 5, 8]


def test_near_matches_against_brute_force(spark):
    pick = random.Random(3)
    docs = [[pick.choice("abcde") for _ in range(pick.randrange(9))] for _ in range(60)]
    windows = {tuple(pick.choice("abcde") for _ in range(n)) for n in (2, 3, 4, 4, 4)}
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(windows)], "item_id long, text string")
    got = {r.doc_id: r.n_near for r in contamination(rows, items, slop=2).collect()}
    exact = lambda d, w: any(tuple(d[k : k + len(w)]) == w for k in range(len(d)))
    want = {i: sum(near_by_hand(d, w, 2) and not exact(d, w) for w in windows) for i, d in enumerate(docs)}
    assert got == want and sum(want.values()) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "c d e f", 0)], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(contamination(odd_docs, items)) == sorted(brute.contaminated(rows, [(1, "c d e f")]), key=str)
    assert contamination(no_docs, items).collect() == []
    assert not any(r.contaminated for r in contamination(odd_docs, items.limit(0)).collect())


def test_postings_lie_by_term(spark):
    """A word is one row per segment, all its places in it; a file holds each term's rows next to each other."""
    _, _, docs, benchmark = small(spark)
    terms = module.benchmark_windows(benchmark, 10).select(F.explode("terms").alias("hash")).distinct()
    index = module.PositionalIndex(docs.repartition(3), terms)
    rows = index.postings.withColumn("file", F.input_file_name()).collect()
    assert len({(r.term, r.segment) for r in rows}) == len(rows) and all(r.n == len(r["at"]) and r["at"] == sorted(r["at"]) for r in rows)
    for name in {r.file for r in rows}:
        mine = [r.term for r in rows if r.file == name]
        assert mine == sorted(mine)
    assert len({r.segment for r in rows}) == 3


def test_a_very_long_text(spark):
    """A benchmark passage behind three million bytes of its own words, in one document."""
    item = "one two three four five six seven eight nine ten".split()
    long = "one two three ten nine " * 140_000
    docs = spark.createDataFrame([(1, long + " ".join(item)), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, items, slop=2).collect()}
    assert got == {1: (700_010, 10, True), 2: (700_000, 0, False)}
