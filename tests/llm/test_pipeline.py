import brute
import corpus_pipeline
import pytest
from coratings.llm.staging import cut
from oracle import assert_same

from coratings.llm.queries import ORACLES, QUERIES


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], folder)))
    return docs


def test_every_stage_against_brute_force(spark, stages):
    start, good, single, cleaned, apart, packed = stages
    for df in (good, single, cleaned, apart):
        assert df.dtypes == start.dtypes
    quality = {r.doc_id: r.predicted for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert ids(good) == sorted(d for d in ids(start) if quality[d])

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert ids(single) == sorted(d for d, (_, _, kept) in brute.components(rows, 80).items() if kept)
    assert len(ids(single)) < len(rows)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    after = {r.doc_id: len(r.text.encode()) for r in cleaned.collect()}
    want = brute.repeats(rows, 200)
    assert len(after) == len(rows)
    # A character of which a part goes is dropped whole.
    assert all(0 <= n - gone - after[d] <= 3 * 2 * spans for d, n, gone, spans, _ in want)
    assert any(gone for _, _, gone, _, _ in want)

    rows = [(r.doc_id, r.text) for r in cleaned.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert ids(apart) == sorted(x[0] for x in brute.contaminated(rows, items) if not x[5])

    pieces = packed.collect()
    assert {p.doc_id for p in pieces} == set(ids(apart))
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_odd_rows_pass_all_stages(spark, odd_docs, some_labels, tmp_path):
    folder = str(tmp_path)
    some_labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd_docs, odd_docs.limit(0)):
        docs = cut(docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, cut(stage(spark, docs, folder))
            assert docs.dtypes == before.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f")], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, sf_small, sf_check, name):
    for folder in (sf_small, sf_check):
        assert assert_same(QUERIES[name](spark, folder), ORACLES[name], folder) > 0
