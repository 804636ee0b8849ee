"""Text quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coratings.llm.learning import in_fold, labelled_sample
from coratings.llm.staging import cut, text_key
from coratings.llm.text import SPACED, Words, mix, pieces, salt

TERMS = 1024  # hashed terms
LATENT = 64  # latent dimensions
PER_CLASS = 2048  # labelled documents per class: 4096 vectors of 64 floats, 1 MB, go to every task
NEIGHBOURS = 25
BLOCK = 1024  # documents multiplied with all labelled vectors at once

_KIND = np.arange(256)  # byte classes: punctuation stands for itself
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[128:] = 128


def _shape_terms(words: Words) -> list[np.ndarray]:
    """Term numbers of every word: its shape, its repetition, and the word itself."""
    upper = np.concatenate(([0], np.cumsum(_KIND[words.data] == ord("A"))))
    plain = np.concatenate(([0], np.cumsum((_KIND[words.data] == ord("a")) | (words.data >= 128))))
    length = words.end - words.start
    uppers, plains = (x[words.end] - x[words.start] for x in (upper, plain))
    case = np.where(uppers == 0, 0, np.where(uppers == 1, 1, np.where(uppers * 2 >= length, 2, 3)))
    symbols = np.minimum(length - uppers - plains, 3)
    tail = _KIND[words.data[words.end - 1]] if len(length) else length
    size = np.minimum(length // 4, 3)
    hashed = words.hashes()
    again = np.zeros(len(length), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (words.row[1:] == words.row[:-1])
    # A pair of words that the document already had counts as repetition too.
    pair = mix(hashed[:-1] + mix(hashed[1:] + salt(3)))
    order = np.lexsort((np.arange(len(pair)), pair, words.row[:-1]))
    seen = np.zeros(len(length), bool)
    same = (pair[order][1:] == pair[order][:-1]) & (words.row[:-1][order][1:] == words.row[:-1][order][:-1])
    seen[order[1:][same]] = True
    shape = ((case * 4 + symbols) * 256 + tail) * 4 + size
    codes = [(shape, 11), (case * 4 + symbols, 12), (again * 2 + seen, 13), (np.where(again, 7, tail), 14)]
    terms = [(mix(code.astype(np.uint64) + salt(s)) % np.uint64(TERMS)).astype(np.int64) for code, s in codes]
    return [*terms, (mix(hashed + salt(15)) % np.uint64(TERMS)).astype(np.int64)]


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed terms per document, sparse."""
    for batch in batches:
        for low, high, data, offsets in pieces(batch):
            words = Words(data, offsets, SPACED, lower=False)
            key = np.concatenate([words.row * TERMS + t for t in _shape_terms(words)]) if len(words.row) else np.zeros(0, np.int64)
            key, count = np.unique(key, return_counts=True)
            at = pa.array(np.searchsorted(key // TERMS, np.arange(high - low + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((key % TERMS).astype(np.int16), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(low, high - low) for i in (0, 1, 2)], *lists], ["doc_id", "key_a", "key_b", "terms", "counts"]
            )


def _matrix(terms: pa.Array, counts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Rows of damped term frequencies times idf, of length 1 (0 without terms)."""
    size = np.diff(terms.offsets.to_numpy())
    out = np.zeros((len(terms), TERMS), np.float32)
    row, term = np.repeat(np.arange(len(terms)), size), terms.flatten().to_numpy()
    out[row, term] = np.sqrt(counts.flatten().to_numpy()) * idf[term]
    return _unit(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, one row per term and task."""
    total = np.zeros(TERMS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=TERMS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS, dtype=np.int32)), pa.array(total)], ["term", "n"])


class NeighbourVote:
    """Labelled vectors and how their votes become a score."""

    def __init__(self, idf, axes, vectors, labels, weight, empty):
        self.idf, self.axes, self.vectors, self.labels, self.weight, self.empty = idf, axes, vectors, labels, weight, empty

    def __call__(self, terms: pa.Array, counts: pa.Array) -> np.ndarray:
        latent = _unit(_matrix(terms, counts, self.idf) @ self.axes)
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        vote = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 8 * self.weight[best]
        total = vote.sum(axis=1)
        score = np.where(total > 0, (vote * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1), self.empty)
        return np.where(np.abs(latent).sum(axis=1) > 0, np.clip(score, 0, 1), self.empty)


def _fit(sample: pa.Table, idf: np.ndarray, counts: dict[int, int]) -> NeighbourVote | None:
    """Latent axes and vectors of the labelled sample (at most 2 * PER_CLASS sparse rows)."""
    labels = sample.column("label").to_numpy().astype(np.float64)
    if not len(labels):
        return None
    sample = sample.combine_chunks()
    matrix = _matrix(sample.column("terms").chunk(0), sample.column("counts").chunk(0), idf)
    _, axes = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
    axes = axes[:, ::-1][:, :LATENT].astype(np.float32)
    drawn = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    weight = np.array([counts.get(0, 0) / drawn[0], counts.get(1, 0) / drawn[1]])[labels.astype(int)]
    blank = np.abs(matrix).sum(axis=1) == 0
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    empty = (rate + (weight * labels)[blank].sum()) / (1 + weight[blank].sum())
    return NeighbourVote(idf, axes, _unit(matrix @ axes), labels, weight, float(empty))


def _voter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = NeighbourVote(**model.value) if model.value else None
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                some = batch.slice(low, BLOCK)
                score = np.full(some.num_rows, 0.5) if vote is None else vote(*map(_fresh, (some.column(3), some.column(4))))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in (0, 1, 2)], pa.array(score)], ["doc_id", "key_a", "key_b", "score"])

    return run


def _fresh(lists: pa.Array) -> pa.Array:
    """A slice of lists with offsets from 0."""
    return pa.concat_arrays([lists, lists.slice(0, 0)]) if lists.offset else lists


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and key_a, key_b per row of ``docs``.

    Terms are hashed word shapes, repetitions and words; their idf is taken
    over all documents. At most PER_CLASS labelled documents of each class
    outside the held-out fold span the latent space; every document's cosine
    with all of them is computed exactly, in blocks, and its NEIGHBOURS nearest
    vote with a power of their cosine, weighted back to the classes' shares.

    Null and empty texts have no direction: they get the labelled rate of such
    texts, drawn to the overall rate. Without any labels every score is 0.5.
    Null doc_id: scored, not held out. Repeated rows are scored each. Labels
    of unknown doc_ids and contradicting or null labels are left out.
    """
    held = in_fold(folds, held_out_fold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", *text_key(), F.coalesce(docs["text"], F.lit("")).alias("text"))
    features = cut(source.mapInArrow(_featurer, f"doc_id {kind}, key_a long, key_b long, terms array<smallint>, counts array<int>"))
    seen = features.select("terms").mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(TERMS)
    for term, n in seen.collect():  # TERMS rows
        found[term] = n
    total = features.count()
    idf = np.log((1 + total) / (1 + found)).astype(np.float32) + np.float32(0.05)

    sample, counts = labelled_sample(labels.select("doc_id", "quality"), "quality", held, PER_CLASS)
    drawn = features.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("label", "terms", "counts")
    fitted = _fit(drawn.toArrow(), idf, counts)
    model = docs.sparkSession.sparkContext.broadcast(vars(fitted) if fitted else None)
    return features.mapInArrow(_voter(model), f"doc_id {kind}, key_a long, key_b long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "key_a", "key_b"
    )
