import brute
import numpy as np
from coratings.llm.rules import COUNTS, learn_accuracies, quality_rules


def counted(df):
    return sorted((tuple(r) for r in df.select("doc_id", *COUNTS, "base_failed").collect()), key=str)


def test_counts(spark, sf_small, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    lines = spark.createDataFrame([(1, "a b\n\na b\n \na b \nc"), (2, "a b c a b c a"), (3, "\n"), (4, "x\n" * 60)], "doc_id long, text string")
    for df in (docs, odd_docs, lines):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert counted(quality_rules(df)) == sorted(((d, *brute.rule_counts(t)) for d, t in rows), key=str)
    assert quality_rules(no_docs).collect() == []


def test_junk_goes_and_prose_stays(spark, sf_check):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_check}/labels.parquet").collect()}
    got = [r for r in quality_rules(spark.read.parquet(f"{sf_check}/documents.parquet")).collect() if r.doc_id in labels]
    assert not any(r.kept for r in got if r.base_failed)
    judged = [r for r in got if not r.base_failed]
    assert np.mean([r.kept for r in judged if labels[r.doc_id] == 1]) > 0.98
    assert np.mean([r.kept for r in judged if labels[r.doc_id] == 0]) < 0.1


def test_expectation_maximisation_finds_the_accurate_rule():
    draw = np.random.default_rng(3)
    good = draw.random(20_000) < 0.8
    votes = np.full((20_000, 3), -1)
    for rule, (hit, miss) in enumerate([(0.9, 0.02), (0.8, 0.05), (0.5, 0.4)]):
        bad_vote = draw.random(20_000) < np.where(good, miss, hit)
        votes[:, rule] = np.where(bad_vote, 0, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, odds = learn_accuracies(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    assert odds[0, 0] < odds[1, 0] < odds[2, 0] <= 0


def test_a_share_for_every_document_without_votes(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.good, r.kept, r.base_failed) for r in quality_rules(docs).collect()] == [(0.0, False, True)] * 2
