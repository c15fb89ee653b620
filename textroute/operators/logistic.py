"""Multinomial logistic regression with an L2 penalty, by L-BFGS: each step is one pass over the records.

The executors keep the records as sparse arrays and add up the gradient in arrays as long as the coefficients, which a tree
of tasks sums. Steps are scaled by the diagonal of the loss's curvature, since rare terms are bent by the penalty and frequent
ones by the data; without it a fit takes hundreds of passes.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row

# Values of a block of records, steps a direction looks back on, halvings of a step.
VALUES, HISTORY, HALVINGS = 1 << 20, 10, 40

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blobs(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Each record's numbers as bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def packed(rows: Iterable[Row]) -> Iterator[Block]:
    """`(labels, weights, sizes, indices, values)` of some records at a time."""
    def block() -> Block:
        return (np.array([r["label"] for r in held], np.int64), np.array([r["weight"] for r in held]),
                np.array([len(r["indices"]) // 4 for r in held]),
                np.frombuffer(b"".join(r["indices"] for r in held), "<i4"), np.frombuffer(b"".join(r["values"] for r in held), "<f8"))

    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row["indices"]) // 4 + 1
        if n >= VALUES:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def _squares(blocks: Iterable[Block], size: int, total: float) -> np.ndarray:
    """Per feature, the weighted mean square of its values."""
    out = np.zeros(size)
    for _, weight, sizes, index, value in blocks:
        out += np.bincount(index, value * value * np.repeat(weight / total, sizes), size)
    return out


def _pass(blocks: Iterable[Block], coefficients: np.ndarray, intercepts: np.ndarray, total: float) -> list[np.ndarray]:
    """The mean loss without its penalty, its gradient, and per class the mean of `p (1 - p)`."""
    k, size = coefficients.shape
    loss, slopes, shifts, spread = np.zeros(1), np.zeros((k, size)), np.zeros(k), np.zeros(k)
    for label, weight, sizes, index, value in blocks:
        n = len(label)
        record, share = np.repeat(np.arange(n), sizes), weight / total
        z = np.stack([np.bincount(record, value * coefficients[c][index], n) for c in range(k)], axis=1) + intercepts
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        whole = e.sum(axis=1)
        p = e / whole[:, None]
        loss += share @ (np.log(whole) - z[np.arange(n), label])
        spread += share @ (p * (1 - p))
        p[np.arange(n), label] -= 1
        missed = share[:, None] * p
        shifts += missed.sum(axis=0)
        for c in range(k):
            slopes[c] += np.bincount(index, value * missed[:, c][record], size)
    return [loss, slopes, shifts, spread]


def _sum(parts: RDD) -> list[np.ndarray]:
    return parts.treeReduce(lambda a, b: [x + y for x, y in zip(a, b)], depth=3)


@dataclass
class Fitted:
    """One row of coefficients and one intercept per class, and how many steps were taken."""
    coefficients: np.ndarray
    intercepts: np.ndarray
    steps: int


@dataclass
class LogisticRegression:
    """Stops where no partial derivative of the mean loss exceeds `slope`, or where ten steps gain less than `tol` of the
    loss at the start, or after `max_iter` steps. `penalty` is the factor of half the squared coefficients; intercepts are free."""
    classes: int
    size: int
    penalty: float
    max_iter: int
    tol: float
    slope: float

    def fit(self, rows: DataFrame) -> Fitted:
        """`rows`: (indices binary, values binary, label int, weight double)."""
        total = rows.groupBy().sum("weight").first()[0]
        blocks = rows.select("label", "weight", "indices", "values").rdd.mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._descend(blocks, total)
        finally:
            blocks.unpersist()

    def _loss(self, blocks: RDD, total: float, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss at the coefficients and intercepts, its gradient, and its curvature's scale per class."""
        k, size = self.classes, self.size
        shared = blocks.context.broadcast((x[:k * size].reshape(k, size), x[k * size:]))
        loss, slopes, shifts, spread = _sum(blocks.mapPartitions(lambda part: [_pass(part, *shared.value, total)]))
        shared.destroy()
        held = x[:k * size]
        return loss[0] + self.penalty / 2 * (held @ held), np.concatenate([slopes.ravel() + self.penalty * held, shifts]), spread

    def _descend(self, blocks: RDD, total: float) -> Fitted:
        k, size = self.classes, self.size
        squares = _sum(blocks.mapPartitions(lambda part: [[_squares(part, size, total)]]))[0]
        x, past, losses = np.zeros(k * size + k), [], []
        loss, gradient, spread = self._loss(blocks, total, x)
        while len(losses) < self.max_iter and np.abs(gradient).max() > self.slope:
            losses.append(loss)
            if len(losses) > HISTORY and losses[-1 - HISTORY] - loss <= self.tol * losses[0]:
                break
            curve = np.maximum(np.concatenate([(spread[:, None] * squares + self.penalty).ravel(), spread]), 1e-12)
            direction = _direction(gradient, curve, past)
            step, falling = 1.0, gradient @ direction
            for _ in range(HALVINGS):
                tried = self._loss(blocks, total, x + step * direction)
                if tried[0] <= loss + 1e-4 * step * falling:
                    break
                step /= 2
            else:
                break
            moved, turned = step * direction, tried[1] - gradient
            if moved @ turned > 1e-10 * np.sqrt((moved @ moved) * (turned @ turned)):
                past = [*past, (moved, turned)][-HISTORY:]
            x, (loss, gradient, spread) = x + moved, tried
        return Fitted(x[:k * size].reshape(k, size), x[k * size:], len(losses))


def _direction(gradient: np.ndarray, curve: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the curvature that the last steps showed."""
    q, shares = gradient.copy(), []
    for moved, turned in reversed(past):
        shares.append((moved @ q) / (moved @ turned))
        q -= shares[-1] * turned
    if past:
        moved, turned = past[-1]
        q *= (moved @ turned) / (turned @ (turned / curve))
    back = zip(past, reversed(shares))
    return -reduce(lambda q, at: q + at[0][0] * (at[1] - (at[0][1] @ q) / (at[0][0] @ at[0][1])), back, q / curve)
