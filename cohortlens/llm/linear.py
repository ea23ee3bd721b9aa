"""A linear model over hashed features, fitted by full passes that Spark makes.

The training rows are a table ``ids array<int>, signs array<float> or null, y float, weight
float``. A row with ``y`` is an example: its margin is the sum of the weights of its features. A row
without ``y`` is a pair of texts that should score alike: ``ids`` and ``signs`` are what they differ
in, and the square of the difference in score is the loss. Every pass sums losses and gradients in
tasks; the driver only sees sums, as long as the weights, and takes the next L-BFGS step.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of weights is two to this power.
HASH_BITS = 18
#: Words whose features a task remembers; beyond it forgets them and hashes anew.
REMEMBERED = 100_000
LETTERS = re.compile(r"[^\W\d_]+")

Featurize = Callable[[str], np.ndarray]


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def word_features(words: Iterable[str], known: dict[str, tuple[int, ...]]) -> set[int]:
    """Each word, and its first four and five letters where it has more."""
    ids: set[int] = set()
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        own = known.get(w)
        if own is None:
            own = known[w] = (hashed(w), *[hashed(f"{n} {w[:n]}") for n in (4, 5) if len(w) > n])
        ids.update(own)
    return ids


@dataclass
class HashedLinear:
    """``score = sigmoid(bias + sum of weights)`` of a text's distinct features."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[pa.Scalar], features: Callable[[str], Iterable[int]]) -> np.ndarray:
        """Scores of a batch, one text at a time: the features of all take many times their bytes."""

        def margin(text: pa.Scalar) -> float:
            ids = np.fromiter(features(text.as_py() or ""), np.int64)
            return float(self.weights[np.sort(ids)].sum())  # one order of summing

        margins = np.fromiter(map(margin, texts), float) + self.bias
        return 1 / (1 + np.exp(-np.clip(margins, -60, 60)))

    def score(self, featurize: Callable[[], Callable[[str], Iterable[int]]], text: str = "text") -> Column:
        """Scores of a text column, null counting as the empty text. ``featurize()`` makes, in
        each task, the function from a text to its distinct feature numbers."""
        model = self

        @F.arrow_udf("double")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            features = featurize()
            for texts in batches:
                yield pa.array(model.scores(texts, features))

        return of(F.col(text))


def _pass(rows: DataFrame, point: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``point`` (weights, then the bias), summed over all rows.

    The point goes out as a broadcast that is given up right after the pass: inside the function
    each pass would leave one on the driver until its garbage is collected. Which slopes are sent
    back is a bit each."""
    size = len(point)
    shared = rows.sparkSession.sparkContext.broadcast(point)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, grad, point = 0.0, np.zeros(size), shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            sizes = pdf["ids"].map(len).to_numpy()
            ids = np.concatenate(pdf["ids"].tolist()).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            sign = np.concatenate([np.ones(n) if s is None else np.asarray(s) for s, n in zip(pdf["signs"], sizes.tolist())])
            raw = np.bincount(row, sign * point[ids], minlength=len(pdf))
            y, w = pdf["y"].to_numpy(dtype=float), pdf["weight"].to_numpy(dtype=float)
            example = ~np.isnan(y)
            margin = raw + np.where(example, point[-1], 0.0)
            p = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
            yy = np.where(example, y, 0.0)
            loss += float(np.sum(w * np.where(example, np.logaddexp(0, margin) - yy * margin, raw * raw)))
            slope = w * np.where(example, p - yy, 2 * raw)
            grad += np.bincount(ids, sign * slope[row], minlength=size)
            grad[-1] += slope[example].sum()
        at = grad != 0
        yield pd.DataFrame({"loss": [loss], "at": [np.packbits(at).tobytes()], "grad": [grad[at].astype("<f4").tobytes()]})

    total, grad = 0.0, np.zeros(size)
    try:
        for part in rows.mapInPandas(run, "loss double, at binary, grad binary").collect():
            total += part.loss
            grad[np.unpackbits(np.frombuffer(part.at, np.uint8), count=size).view(bool)] += np.frombuffer(part.grad, "<f4")
    finally:
        shared.destroy()
    return total, grad


def fit(rows: DataFrame, l2: float = 1.0, passes: int = 30, memory: int = 8, tolerance: float = 1e-4) -> HashedLinear:
    """Minimise loss plus ``l2 / 2`` times the squared weights (not the bias) by L-BFGS.

    ``rows`` is read once a pass, so it should be a written table. Without examples of ``y`` over
    one half, or without any, the model is the smoothed share of such examples for every text.
    """
    count = rows.where("y IS NOT NULL").agg(F.sum("y").alias("y"), F.count("*").alias("n")).first()
    yes, n = float(count.y or 0.0), int(count.n)
    point = np.zeros((1 << HASH_BITS) + 1)
    point[-1] = np.log((yes + 0.5) / (n - yes + 1.0))
    if yes == 0 or yes == n:
        return HashedLinear(point[:-1], float(point[-1]))
    penalty = np.full(len(point), l2)
    penalty[-1] = 0.0

    def at(p: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = _pass(rows, p)
        return loss + float(penalty @ (p * p)) / 2, grad + penalty * p

    loss, grad = at(point)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used, start = 1, float(np.abs(grad).max())
    while used < passes and np.abs(grad).max() > tolerance * start:
        direction, kept = grad.copy(), []
        for s, g in reversed(steps):
            kept.append((s @ direction) / (s @ g))
            direction -= kept[-1] * g
        direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(grad))
        for (s, g), a in zip(steps, reversed(kept)):
            direction += s * (a - (g @ direction) / (s @ g))
        rate = 1.0
        while used < passes:
            new = point - rate * direction
            new_loss, new_grad = at(new)
            used += 1
            if new_loss <= loss - 1e-4 * rate * float(grad @ direction):
                break
            rate /= 4
        else:
            break
        if (new - point) @ (new_grad - grad) > 1e-12:
            steps = [*steps[-(memory - 1):], (new - point, new_grad - grad)]
        point, loss, grad = new, new_loss, new_grad
    return HashedLinear(point[:-1].astype(np.float32), float(point[-1]))
