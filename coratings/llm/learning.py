"""What the two learned operators share: which rows are learned from, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from coratings.llm.staging import cut


def in_fold(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, held_out: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled rows of each class, by least hash of doc_id, and the classes' full counts.

    doc_ids with null or contradicting labels are left out.
    """
    rows = labels.where(~held_out & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    rows = cut(rows.select("doc_id", F.col("label").cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return cut(parts[0].union(parts[1])), counts


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by short Newton steps, with a weak prior on both that holds them where the classes part clean."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(2)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 0.1 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -np.array([1.0, 0.2]), np.array([1.0, 0.2]))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
