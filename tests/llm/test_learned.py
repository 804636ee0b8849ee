import random

import brute
import numpy as np
import pytest
from coratings.llm.queries import QUERIES
from coratings.llm.quality import quality
from coratings.llm.text import ALNUM, Words
from coratings.llm.toxicity import Calibration, Segments, maximal_segments, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return folder, {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


@pytest.mark.parametrize(("name", "label", "fold", "at_least"), [("op7_quality", "quality", (4, 2), 0.97), ("op3_toxicity", "toxic", (3, 1), 0.85)])
def test_held_out(spark, tables, name, label, fold, at_least):
    """Accuracy on the fold that nothing is learned from (balanced over both classes)."""
    import zlib

    folder, labels = tables
    got = QUERIES[name](spark, folder).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in got)
    held = [(labels[r.doc_id][label], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    right = [np.mean([p == c for y, p in held if y == c]) for c in (0, 1)]
    assert len(held) > 500 and min(right) >= at_least


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_labels_of_the_held_out_fold_do_not_matter(spark, sf_check, operator):
    from coratings.llm.learning import in_fold
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    labels = spark.read.parquet(f"{sf_check}/labels.parquet")
    folds = (4, 2) if operator is quality else (3, 1)
    swapped = labels.withColumns({c: F.when(in_fold(*folds), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    one, two = ({r.doc_id: r.score for r in operator(docs, x).collect()} for x in (labels, swapped))
    assert one.keys() == two.keys() and max(abs(one[d] - two[d]) for d in one) < 1e-6


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, odd_docs, no_docs, some_labels, operator):
    got = operator(odd_docs, some_labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1  # null, empty and blank alike
    assert operator(no_docs, some_labels).collect() == []
    assert len(operator(odd_docs, some_labels.limit(0)).collect()) == odd_docs.count()
    one_class = some_labels.where("quality = 1 AND toxic = 1")
    assert len(operator(odd_docs, one_class).collect()) == odd_docs.count()


def test_maximal_segments():
    pick = random.Random(7)
    for _ in range(300):
        scores = [pick.choice([-3, -2, -1, 1, 2, 4]) for _ in range(pick.randrange(14))]
        total = np.concatenate(([0.0], np.cumsum(scores)))
        got = maximal_segments(np.flatnonzero(np.array(scores) > 0), total)
        want = brute.maximal_segments(scores)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want) or len(scores) != len(set(total))
        assert all(a < b and s > 0 for a, b, s in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_evidence_grows_with_scores_and_shrinks_with_length():
    c = Calibration(0.01, 1.0, -2.0, 1.0)
    assert c.evidence([], 100) == 0
    assert c.evidence([8.0], 100) > c.evidence([8.0], 10_000) > 0
    assert c.evidence([8.0, 7.0], 100) > c.evidence([8.0], 100)


def segments_of(*texts):
    """Segments where the words bad0 .. bad9 score 2 each and others -1, and what they add as evidence."""
    telling = " ".join(f"bad{i}" for i in range(10)).encode()
    hashes = np.sort(Words(np.frombuffer(telling, np.uint8), np.array([0, len(telling)]), ALNUM).hashes())
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    return Segments(hashes, np.full(10, 3.0)).of_piece(np.frombuffer(b"".join(data), np.uint8), offsets)


def test_a_passage_again():
    passage = " ".join(f"bad{i}" for i in range(10))
    gap = " ".join(f"w{i}" for i in range(30))
    _, found, fresh = segments_of(f"{passage} {gap} {passage}", passage)
    assert found == [[(0, 10, 20.0), (40, 50, 20.0)], [(0, 10, 20.0)]]
    assert fresh == [[20.0], [20.0]]


def test_scattered_words_before_a_passage():
    passage = " ".join(f"bad{i}" for i in range(10))
    scattered = " ".join(f"bad{i} " + "word " * 8 for i in range(10))
    _, found, fresh = segments_of(f"{scattered}{passage}")
    assert found[0][-1] == (90, 100, 20.0) and [x[2] for x in found[0][:-1]] == [2.0] * 10
    assert fresh[0] == [20.0]


def test_one_word_over_and_over():
    _, found, _ = segments_of("bad0 " * 50)
    assert found == [[(0, 1, 2.0)]]
