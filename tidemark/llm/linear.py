"""Labelled texts, and fitting weights to all of them by passes over blocks of rows, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labelled(labels: DataFrame, label: str, usable, limit: int | None = None) -> DataFrame:
    """Rows (_id, y): all ids with a usable label, or with ``limit`` the first so many in hash order.

    Repeated or conflicting labels of an id are averaged; a tie counts as 1. ``usable`` is a condition on doc_id.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("_id").isNotNull() & F.col("y").isNotNull()).where(usable)
    known = known.groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return known if limit is None else known.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, usable, limit: int | None = None) -> DataFrame:
    """(key, y, text) of the documents that ``labelled`` chooses, text as bytes, written: one row for each id at most.

    ``key`` is a hash of the id, to deal rows by. Of several texts under one id the one that hashes lowest is taken.
    """
    chosen = labelled(labels, label, usable, limit)
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("text")).where(F.col("_id").isNotNull()).where(usable)
    found = texts.join(chosen, "_id").groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return common.cut(found.select(F.xxhash64("_id").alias("key"), "y", "text"))


def summed(blocks: DataFrame, of: Callable[[dict], np.ndarray]) -> np.ndarray:
    """The sum of ``of(block)``, a vector, over all rows of ``blocks``; the driver receives one vector from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.to_pylist():
                one = of(block)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    return np.sum([np.frombuffer(r.total) for r in blocks.mapInArrow(run, "total binary").collect()], axis=0)


def minimized(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, keep: int = 10, least: float = 1e-6) -> np.ndarray:
    """Where a smooth convex ``loss`` (value and gradient) is least, by L-BFGS in at most ``steps`` evaluations."""
    x = start
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < steps and np.abs(slope).max() > least:
        d, alphas = slope.copy(), []
        for s, y in reversed(moves):
            alphas.append((s @ d) / (s @ y))
            d -= alphas[-1] * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1.0 / max(np.abs(slope).sum(), 1e-12)
        for (s, y), a in zip(moves, reversed(alphas), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        rate, fall = 1.0, slope @ d
        while used < steps:
            nxt = x - rate * d
            got, turned = loss(nxt)
            used += 1
            if got <= value - 1e-4 * rate * fall:
                break
            rate *= 0.5
        else:
            break
        if (nxt - x) @ (turned - slope) > 0:
            moves = [*moves[-keep + 1 :], (nxt - x, turned - slope)]
        x, value, slope = nxt, got, turned
    return x


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of the only column, between two values in proportion as numpy has it, by a distributed sort."""
    at = share * (values.count() - 1)
    low = int(at)
    tied = values.withColumn("_tie", F.rand(0))  # equal values go to several tasks
    ranked = tied.orderBy(*tied.columns).rdd.zipWithIndex().filter(lambda r: low <= r[1] <= low + 1)
    near = [v for (v, _), _ in sorted(ranked.collect(), key=lambda r: r[1])]
    return float(near[0] + (near[-1] - near[0]) * (at - low))


def logistic(blocks: DataFrame, scale: np.ndarray, n: int, l2: float, start: float = 0.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of L2-regularized logistic regression, by L-BFGS in at most ``steps`` passes over ``blocks``.

    A block (y, sizes, cols) holds rows: their labels, how many features each has, and which; feature i has the value
    ``scale[i]`` where it is present. ``n`` is the number of rows in all blocks.
    """

    def lost(point: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = point[:-1], point[-1]

        def of(block: dict) -> np.ndarray:
            y, sizes, cols = (np.frombuffer(block[k], dtype=t) for k, t in (("y", np.int8), ("sizes", np.int32), ("cols", "<u2")))
            rows = np.repeat(np.arange(len(y)), sizes)
            z = np.bincount(rows, weights=(scale * w)[cols], minlength=len(y)) + b
            e = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - y
            return np.r_[np.logaddexp(0, z).sum() - z @ y, scale * np.bincount(cols, weights=e[rows], minlength=len(w)), e.sum()]

        got = summed(blocks, of) / n
        return got[0] + 0.5 * l2 * float(w @ w), got[1:] + np.r_[l2 * w, 0.0]

    best = minimized(lost, np.r_[np.full(len(scale), start), 0.0], steps)
    return best[:-1], float(best[-1])
