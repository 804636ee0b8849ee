"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are learned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coratings.llm.staging import cut, text_key
from coratings.llm.text import SPACED, Words, mix, pieces, salt, span_hash, prefix

SYMBOLS = np.zeros(256, bool)  # [#*$%&|<>]
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_capital_words", "n_distinct_words", "n_marked_words", "n_alike_neighbours")

# name -> SQL giving 1 (good), 0 (bad) or null (abstains). Texts without words have no votes.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN 0 WHEN n_words BETWEEN 50 AND 100000 THEN 1 END",
    "word_length": "CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 0 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN 0 WHEN 50 * n_symbols < n_words THEN 1 END",
    "duplicate_lines": "CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 0 WHEN n_lines > 1 AND n_dup_lines = 0 THEN 1 END",
    "repeated_words": "CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 0 WHEN 100 * n_repeat_words < 10 * n_words THEN 1 END",
    "capitals": "CASE WHEN 10 * n_capital_words > 5 * n_words THEN 0 WHEN 10 * n_capital_words < n_words THEN 1 END",
    "distinct_words": "CASE WHEN 10 * n_distinct_words < n_words THEN 0 WHEN n_words < 1000 AND 10 * n_distinct_words > 3 * n_words THEN 1 END",
    "marked_words": "CASE WHEN 10 * n_marked_words > 4 * n_words THEN 0 WHEN 10 * n_marked_words < 2 * n_words THEN 1 END",
    "alike_neighbours": "CASE WHEN 10 * n_alike_neighbours > 2 * n_words THEN 0 WHEN 50 * n_alike_neighbours < n_words THEN 1 END",
}


def _line_repeats(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and those equal to an earlier line."""
    rows = len(offsets) - 1
    if not len(words.start):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = np.where(data[end - 1] == 10, end - 1, end)
    worded = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[worded], end[worded]
    row = np.searchsorted(offsets, start, "right") - 1
    value = span_hash(prefix(data), start, end)
    order = np.lexsort((value, row))
    same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row, minlength=rows), np.bincount(row[order][1:][same], minlength=rows)


def _repeats(words: Words, hashed: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words lie in a window of ``size`` words that the same row has twice or more."""
    n = len(hashed) - size + 1
    inside = np.zeros(len(hashed) + 1, np.int64)
    if n > 0:
        value = np.zeros(n, np.uint64)
        for i in range(size):
            value += mix(hashed[i : i + n] + salt(i)) * (salt(i) | np.uint64(1))
        row = words.row[:n]
        at = np.flatnonzero(words.row[size - 1 :] == row)
        order = at[np.lexsort((mix(value[at]), row[at]))]
        value, row = mix(value[order]), row[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
        twice = order[same[1:] | same[:-1]]
        inside[twice] += 1
        np.add.at(inside, twice + size, -1)
    return np.cumsum(inside)[:-1] > 0


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch):
            words = Words(data, offsets, SPACED, lower=False)
            rows, hashed = high - low, words.hashes()
            per = lambda mask: np.bincount(words.row[mask], minlength=rows)
            length = words.end - words.start
            sums = {
                name: np.concatenate(([0], np.cumsum(mask)))
                for name, mask in (("code", (data & 0xC0) != 0x80), ("symbol", SYMBOLS[data]), ("upper", (data >= 65) & (data <= 90)), ("lower", (data >= 97) & (data <= 122)))
            }
            of_words = {k: s[words.end] - s[words.start] for k, s in sums.items()}
            lines, again = _line_repeats(words, data, offsets)
            order = np.lexsort((hashed, words.row))
            new = np.ones(len(order), bool)
            new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
            alike = np.zeros(len(length), bool)
            alike[1:] = (hashed[1:] == hashed[:-1]) & (words.row[1:] == words.row[:-1])
            last = data[words.end - 1] if len(length) else data[:0]
            marked = (last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 65) & (last <= 90)) & ~((last >= 48) & (last <= 57))
            columns = {
                "n_words": words.count,
                "word_chars": np.bincount(words.row, of_words["code"], rows).astype(np.int64),
                "n_symbols": sums["symbol"][offsets[1:]] - sums["symbol"][offsets[:-1]],
                "n_dup_lines": again,
                "n_repeat_words": per(_repeats(words, hashed)),
                "n_lines": lines,
                "n_capital_words": per((of_words["upper"] >= 2) & (of_words["lower"] == 0)),
                "n_distinct_words": np.bincount(words.row[order][new], minlength=rows),
                "n_marked_words": per(marked),
                "n_alike_neighbours": per(alike),
            }
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(low, rows) for i in (0, 1, 2)], *[pa.array(c.astype(np.int64)) for c in columns.values()]],
                ["doc_id", "key_a", "key_b", *columns],
            )


def learn_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and per rule log P(vote | good) / P(vote | bad) of votes bad, good and none.

    Expectation-maximisation over the distinct patterns of votes (1, 0, -1 for
    none), with one imagined document of each kind. A rule knows one kind of bad
    text and has nothing against the others, so the start takes two bad votes
    for a bad document. Rules are taken as independent given quality.
    """
    said = np.stack([votes == 0, votes == 1, votes == -1], axis=2).astype(float)  # pattern, rule, vote
    good = 1 / (1 + np.exp(3.0 * (votes == 0).sum(axis=1) - 4.0))
    odds, share = np.zeros(said.shape[1:]), 0.5
    for _ in range(rounds):
        share = ((good * counts).sum() + 1) / (counts.sum() + 2)
        chance = [np.einsum("p,prv->rv", w * counts, said) + 1 for w in (good, 1 - good)]
        chance = [c / c.sum(axis=1, keepdims=True) for c in chance]
        odds = np.log(chance[0]) - np.log(chance[1])
        # A good vote never counts against a document, nor a bad one for it.
        odds[:, 0], odds[:, 1] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 1], 0)
        odds[:, 2] = 0
        now = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + np.einsum("prv,rv->p", said, odds), -30, 30)))
        if np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
    return share, odds


def quality_rules(docs: DataFrame, rules: dict[str, str] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, good (posterior probability), kept and key_a, key_b per row of ``docs``.

    Every rule votes good or bad or abstains. The patterns of votes over all
    documents, at most three to the power of the number of rules, are counted
    in Spark; expectation-maximisation on them gives each rule's accuracy. A
    document is kept if its posterior reaches ``threshold`` and it is not
    base_failed (fewer than 50 words, or more than half in repeated windows of
    three).

    Null and empty texts have no words: all counts 0, base_failed. Repeated
    rows are judged each, null doc_id or not. Empty input: no rows.
    """
    rules = RULES if rules is None else rules
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", *text_key(), F.coalesce(docs["text"], F.lit("")).alias("text"))
    columns = ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    measured = source.mapInArrow(_measurer, f"doc_id {kind}, key_a long, key_b long, {columns}")
    voice = [F.when(F.col("n_words") > 0, F.expr(sql)).cast("int").alias(f"vote_{name}") for name, sql in rules.items()]
    voted = cut(measured.select("*", *voice))
    names = [f"vote_{n}" for n in rules]
    patterns = voted.where("n_words > 0").groupBy(*names).count().orderBy(*names).collect()
    votes = np.array([[-1 if r[n] is None else r[n] for n in names] for r in patterns], int).reshape(-1, len(names))
    share, odds = learn_accuracies(votes, np.array([r["count"] for r in patterns], float))
    log_odds = F.lit(float(np.log(share / (1 - share))))
    for name, (bad, good, _) in zip(names, odds.tolist(), strict=True):
        log_odds = log_odds + F.when(F.col(name) == 1, F.lit(good)).when(F.col(name) == 0, F.lit(bad)).otherwise(F.lit(0.0))
    good = F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-log_odds))).otherwise(F.lit(0.0))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return voted.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), good.alias("good"), (~failed & (good >= threshold)).alias("kept"), "key_a", "key_b"
    )
