"""Bounded samples of labelled rows for fitting, and the fold rule of the queries."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """``fit`` over all rows of a bounded sample, in one task, so that the driver holds the model alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else fit([])  # no partition at all


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (i, y, text): at most ``per_class`` texts of each label value 0 and 1, those with the smallest id hashes. Only
    ids of labels are ordered; then at most 2 * per_class ids (a proven bound) are broadcast to fetch the whole texts. Null
    labels and ids are left out; an id with several labels takes the largest, one with several texts the smallest."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    ids = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), id_col)
    return rows.groupBy(F.col(id_col).cast("string").alias("i"), "y").agg(F.min("text").alias("text"))


def by_class(rows: list[tuple]) -> dict[int, list[str]]:
    """Texts of labelled_texts() by label, in the order of their ids."""
    rows = sorted(rows)
    return {y: [t for _, k, t in rows if k == y] for y in (0, 1)}


def rate_of(labels: DataFrame, label: str) -> float:
    """The share of label 1 among all labels 0 and 1, a half if there are none; never 0 or 1."""
    rate = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return min(max(0.5 if rate is None else rate, 0.01), 0.99)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last for the constant) of a logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = l2 * weight.sum() * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w
