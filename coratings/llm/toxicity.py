"""Toxic passages: maximal scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coratings.llm.learning import in_fold, labelled_sample, logistic_fit
from coratings.llm.staging import cut
from coratings.llm.text import ALNUM, Words, mix, pieces, prefix, salt, span_hash

PER_CLASS = 5000  # labelled documents of each class that are learned from
PREFIXES = (3, 4, 5, 6)  # bytes; a rare word is judged by its longest known prefix
LEAST = 3  # documents a feature must be in
PRIOR = 5.0  # weight of the Dirichlet prior, in documents
CERTAIN = 40.0  # evidence is cut here
DRIFT = 1.0  # taken off every token, so that ordinary text scores below 0
APART = 5.0  # a run ends where its score has fallen so far, about that many ordinary words


def _features(words: Words) -> list[np.ndarray]:
    """Hashes of each word's prefixes, shortest first, and of the word."""
    sums = prefix(words.data)
    out = [mix(span_hash(sums, words.start, np.minimum(words.start + k, words.end)) + salt(20 + k)) for k in PREFIXES]
    return [*out, words.hashes()]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a feature, by class and half, combined within the piece."""
    for batch in batches:
        for low, high, data, offsets in pieces(batch):
            words = Words(data, offsets, ALNUM)
            kind = batch.column(1).to_numpy(zero_copy_only=False)[low:high].astype(np.int64)
            got, above = [], np.zeros(len(words.row), np.uint64)
            for depth, level in enumerate(_features(words)):
                order = np.lexsort((level, words.row))
                value, row = level[order], words.row[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
                of, up = kind[row[new]], above[order][new]
                value, first, which = np.unique(value[new], return_index=True, return_inverse=True)
                got.append((value, up[first], np.full(len(value), depth), *[np.bincount(which[of == k], minlength=len(value)) for k in range(4)]))
                above = level
            value, up, depth, *counts = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(up.view(np.int64)), pa.array(depth, pa.int64()), *[pa.array(c, pa.int64()) for c in counts]],
                ["feature", "above", "depth", *_KINDS],
            )


_KINDS = ("good_0", "bad_0", "good_1", "bad_1")  # label, then half of the sample


def _log_odds(table: dict[str, np.ndarray], good: np.ndarray, bad: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and the log-odds of label 1, against those of the sample.

    The Dirichlet prior of a prefix or word is what the next shorter prefix
    gives, and that of the shortest the share in the sample, so that a rare
    form of a telling stem tells as much as the stem.
    """
    base = (sizes[1] + 1e-9) / (sum(sizes) + 2e-9)
    order = np.argsort(table["feature"])
    feature, above, depth, good, bad = (x[order] for x in (table["feature"], table["above"], table["depth"], good, bad))
    share = np.full(len(feature), base)
    for level in range(len(PREFIXES) + 1):
        at = np.flatnonzero(depth == level)
        prior = share[np.minimum(np.searchsorted(feature, above[at]), len(feature) - 1)] if level else np.full(len(at), base)
        share[at] = (bad[at] + PRIOR * prior) / (bad[at] + good[at] + PRIOR)
    odds = np.log(share / (1 - share)) - math.log(base / (1 - base))
    enough = bad + good >= LEAST
    return feature[enough], odds[enough]


class Segments:
    """Scores words and finds the maximal scoring segments of documents."""

    def __init__(self, features: np.ndarray, scores: np.ndarray):
        self.features, self.scores = features, scores

    def words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each word's most specific known feature, less DRIFT, and the number of the distinct word."""
        levels = _features(words)
        _, first, which = np.unique(levels[-1], return_index=True, return_inverse=True)
        score = np.full(len(first), -DRIFT)
        for level in levels:
            at = np.searchsorted(self.features, level[first])
            hit = np.flatnonzero(at < len(self.features))
            hit = hit[self.features[at[hit]] == level[first][hit]]
            score[hit] = self.scores[at[hit]] - DRIFT
        return score[which], which

    def of_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], list[list[float]]]:
        """Words per document, its segments (first word, word after the last, score), and what each adds as evidence."""
        words = Words(data, offsets, ALNUM)
        score, which = self.words(words)
        up = np.flatnonzero(score > 0)
        gain = score.copy()
        edge = np.searchsorted(up, words.first)
        total = np.concatenate(([0.0], np.cumsum(score)))
        for row in np.flatnonzero(np.diff(edge)):
            mine = up[edge[row] : edge[row + 1]]
            gain[mine[repeats_in_runs(mine, which, total)]] = 0.0
        total = np.concatenate(([0.0], np.cumsum(gain)))
        up = np.flatnonzero(gain > 0)
        edge = np.searchsorted(up, words.first)
        out: list[list[tuple[int, int, float]]] = [[] for _ in words.count]
        fresh: list[list[float]] = [[] for _ in words.count]
        for row in np.flatnonzero(np.diff(edge)):
            base, mine = int(words.first[row]), up[edge[row] : edge[row + 1]]
            found = maximal_segments(mine, total)
            out[row] = [(a - base, b - base, s) for a, b, s in found]
            fresh[row] = new_evidence(found, mine, which, gain)
        return words.count, out, fresh


def repeats_in_runs(up: np.ndarray, which: np.ndarray, total: np.ndarray) -> list[int]:
    """Which of the positive words ``up`` their run has had before.

    A run starts at a positive word and ends where its score is used up or has
    fallen by APART from its highest; the next one starts afresh. So a word
    said over and over counts once, and a passage counts whole whatever the
    text had before it. ``total`` are running sums over all words.
    """
    again: list[int] = []
    seen: set[int] = set()
    now = high = 0.0
    last = 0
    before, after, word = total[up].tolist(), total[up + 1].tolist(), which[up].tolist()
    for i, w in enumerate(word):
        now += before[i] - last if i else 0.0
        if now <= 0 or high - now >= APART:
            seen.clear()
            now = high = 0.0
        if w in seen:
            again.append(i)
        else:
            seen.add(w)
            now += after[i] - before[i]
            high = max(high, now)
        last = after[i]
    return again


def new_evidence(found: list[tuple[int, int, float]], up: np.ndarray, which: np.ndarray, gain: np.ndarray) -> list[float]:
    """Scores of the segments, best first, without the gain of words that a better one has had.

    The same line again is another passage, but tells nothing new of the document.
    """
    if len(found) < 2:
        return [s for _, _, s in found]
    word, worth = which[up].tolist(), gain[up].tolist()
    low, high = (np.searchsorted(up, [x[i] for x in found]).tolist() for i in (0, 1))
    seen: set[int] = set()
    out = []
    for k in sorted(range(len(found)), key=lambda k: (-found[k][2], k)):
        inside = {}
        score = found[k][2]
        for i in range(low[k], high[k]):
            if word[i] in seen:
                score -= worth[i]
            else:
                inside[word[i]] = True
        seen.update(inside)
        if score > 0:
            out.append(score)
    return out


def maximal_segments(up: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in time linear in the positive words ``up``.

    ``total`` are running sums over all words. A segment is kept with the sums
    before and after it; a new one is joined with the nearest earlier segment
    that starts from a lower sum, if it ends on a higher one.
    """
    found: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each kept segment, the nearest one before it that starts lower
    for w in up.tolist():
        first, before, after = w, float(total[w]), float(total[w + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= after:
                lower.append(j)
                found.append((first, w + 1, before, after))
                break
            first, before = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Calibration:
    """Expected segments of at least a score in clean text, and from that a document's probability."""

    def __init__(self, rate: float, scale: float, intercept: float, slope: float):
        self.rate, self.scale, self.intercept, self.slope = rate, scale, intercept, slope

    def expected(self, score: float, n_words: int) -> float:
        return self.rate * n_words * math.exp(-self.scale * score)

    def evidence(self, scores: list[float], n_words: int) -> float:
        """-log of the chance that clean text of this length has such segments, for the most telling number of them."""
        best = 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            mean = max(self.expected(score, n_words), 1e-300)
            # Chance of r or more such segments, at most mean^r / r!, times the choices of r.
            # Segments that are common anyway vary too much from text to text to be counted.
            if mean >= 1:
                break
            best = max(best, -(r * math.log(mean) - math.lgamma(r + 1)) - math.log(r))
        # Beyond this nothing is left to tell, and a mislabelled text must not tilt the fit.
        return min(best, CERTAIN)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def _segmenter(model):
    """n_words and segments of each document; without a calibration only what its segments add as evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, tail = model.value
        finder, calibration = Segments(*arrays), Calibration(*tail) if tail else None
        passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for low, high, data, offsets in pieces(batch):
                counts, found, fresh = finder.of_piece(data, offsets)
                columns = [batch.column(0).slice(low, high - low), pa.array(counts, pa.int64())]
                names = ["doc_id", "n_words"]
                if calibration:
                    evidence = [calibration.evidence(f, int(n)) for f, n in zip(fresh, counts, strict=True)]
                    columns.append(pa.array([calibration.probability(e) for e in evidence], pa.float64()))
                    names.append("score")
                    found = [[x for x in f if calibration.expected(x[2], int(n)) < 0.05] for f, n in zip(found, counts, strict=True)]
                else:
                    found = [[(0, 0, s) for s in f] for f in fresh]
                rows = [[dict(zip(("first", "end", "score"), x, strict=True)) for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(passage))], [*names, "passages"])

    return run


_PASSAGES = "passages array<struct<first:bigint,end:bigint,score:double>>"


def _calibrate(rows: list, counts: dict[int, int]) -> tuple[float, ...]:
    """Tail of the segment scores of clean documents, then label 1 against the evidence."""
    clean = [r for r in rows if r["label"] == 0]
    scores = np.array([p["score"] for r in clean for p in r["passages"]])
    words = max(1, sum(r["n_words"] for r in clean))
    # The tail falls tenfold between these quantiles; a few mislabelled texts do not move them.
    low, high = np.quantile(scores, [0.9, 0.99]) if len(scores) else (0.0, 1.0)
    scale = math.log(10) / max(0.1, high - low)
    rate = max(1, len(scores)) / 10 / words * math.exp(scale * low)
    calibration = Calibration(rate, scale, 0.0, 1.0)
    x = np.array([calibration.evidence([p["score"] for p in r["passages"]], r["n_words"]) for r in rows])
    y = np.array([r["label"] for r in rows], float)
    share = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    intercept, slope = logistic_fit(x, y, weight / max(weight.mean(), 1e-9) if len(y) else weight)
    return calibration.rate, calibration.scale, intercept, max(slope, 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and passages (first word, end, score) per row of ``docs``.

    Learned from at most PER_CLASS labelled documents of each class outside the
    held-out fold: they give the log-odds of words and prefixes with a
    Dirichlet prior; the extreme-value tail of clean segments and the
    probability come from each half scored by what the other half taught. Every document is scanned whole; passages are its
    segments of which clean text of its length would have less than 0.05. In a
    run of telling words each word counts once (see repeats_in_runs); a passage
    that comes again is listed again, but is evidence only once.

    Null and empty texts have no words, no passages and the least score.
    Without labels of both classes every score is the share of label 1 (0 if
    there are none). Null doc_id: scored, not held out. Repeated rows are
    scored each. Null or contradicting labels are left out.
    """
    spark = docs.sparkSession
    held = in_fold(folds, held_out_fold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    sample, counts = labelled_sample(labels.select("doc_id", "toxic"), "toxic", held, PER_CLASS)
    texts = cut(source.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]))
    half = (F.xxhash64(F.lit(5), "doc_id") % 2 == 0).cast("int")
    kinds = texts.select("doc_id", (half * 2 + F.col("label")).cast("long").alias("kind"), "text")
    sizes = [0] * 4
    for r in kinds.groupBy("kind").count().collect():
        sizes[r["kind"]] = r["count"]
    counted = (
        kinds.mapInArrow(_counter, "feature long, above long, depth long, " + ", ".join(f"{k} long" for k in _KINDS))
        .groupBy("feature").agg(F.min("above").alias("above"), F.min("depth").alias("depth"), *[F.sum(k).alias(k) for k in _KINDS]).where(" + ".join(_KINDS) + f" >= {LEAST}")
    )
    # A bounded number of documents has a bounded number of features that LEAST of them share.
    table = counted.toArrow()
    known = {k: table.column(k).to_numpy() for k in ("feature", "above", "depth")}
    known |= {k: known[k].view(np.uint64) for k in ("feature", "above")}
    n = [table.column(k).to_numpy().astype(float) for k in _KINDS]
    halves = [_log_odds(known, n[2 * h], n[2 * h + 1], (sizes[2 * h], sizes[2 * h + 1])) for h in (0, 1)]
    arrays = _log_odds(known, n[0] + n[2], n[1] + n[3], (sizes[0] + sizes[2], sizes[1] + sizes[3]))

    # Each half is scored by what the other half taught.
    tuned = []
    for h in (0, 1):
        plain = spark.sparkContext.broadcast((halves[h], None))
        other = texts.where(half != h).select("doc_id", "text")
        found = other.mapInArrow(_segmenter(plain), f"doc_id {kind}, n_words long, {_PASSAGES}")
        # At most 2 * PER_CLASS rows.
        tuned += found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("label", "n_words", "passages").collect()
    model = spark.sparkContext.broadcast((arrays, _calibrate(tuned, counts)))
    scored = source.mapInArrow(_segmenter(model), f"doc_id {kind}, n_words long, score double, {_PASSAGES}")
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "passages"
    )
