"""Quality scores without quality labels: heuristics vote, EM weighs them, a linear model learns.

Each heuristic says good, bad or nothing about a text. Texts are hidden to be good or to have one
of several faults, one for each heuristic to begin with; votes are independent given that. The accuracy of
each heuristic on good texts and on each fault is estimated by expectation-maximisation from where
they agree and disagree. Votes are counted by pattern, of which there are at most 3 to the power of
the number of heuristics, so EM over the counts uses every document and is exact. The posteriors
label texts for a hashed linear model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import linear, rules
from cohortlens.llm.common import staged, text_or_empty
from cohortlens.llm.linear import HASH_BITS, HashedLinear, hashed

#: Texts the linear model learns from, at most: those with the smallest hash of id and text.
MAX_TRAIN = 20_000
#: Share of a heuristic's votes on good texts that may be wrong, at most.
MOST_WRONG = 0.02


def _length(m: rules.Measure, text: str) -> int:
    return 1 if m.n_words >= 50 else -1 if m.n_words == 0 else 0


def _repetition(m: rules.Measure, text: str) -> int:
    share = m.n_repeat_words / max(1, m.n_words)
    return -1 if share > 0.5 else 1 if share < 0.2 and m.n_words >= 30 else 0


def _lines(m: rules.Measure, text: str) -> int:
    lines = text.count("\n") + 1
    return -1 if m.n_dup_lines > 0.3 * lines else 1 if m.n_dup_lines == 0 and lines > 3 else 0


def _symbols(m: rules.Measure, text: str) -> int:
    return -1 if m.n_symbols > 0.05 * m.word_chars else 1 if m.n_symbols <= 0.002 * m.word_chars and m.n_words >= 20 else 0


def _word_length(m: rules.Measure, text: str) -> int:
    mean = m.word_chars / max(1, m.n_words)
    return -1 if mean > 14 or mean < 2 else 1 if 3 <= mean <= 10 else 0


def _variety(m: rules.Measure, text: str) -> int:
    share = len(m.words) / max(1.0, m.n_words ** 0.8)
    return -1 if share < 0.25 and m.n_words >= 30 else 1 if share > 0.7 else 0


def _sentences(m: rules.Measure, text: str) -> int:
    stops = sum(map(text.count, ".!?"))
    rate = stops / max(1, m.n_words)
    return 1 if 0.02 <= rate <= 0.3 else -1 if m.n_words >= 50 and (stops == 0 or rate > 0.6) else 0


def _letters(m: rules.Measure, text: str) -> int:
    counts = rules.class_counts(text)
    letters = counts[[rules.CLASSES.index(c) for c in ("lower", "upper", "latin", "other")]].sum()
    share = letters / max(1, counts.sum())
    return -1 if share < 0.7 else 1 if share > 0.85 and counts.sum() >= 50 else 0


#: The heuristics: 1 good, -1 bad, 0 nothing to say.
LABELLERS: dict[str, Callable[[rules.Measure, str], int]] = {
    "length": _length, "repetition": _repetition, "lines": _lines, "symbols": _symbols, "word_length": _word_length,
    "variety": _variety, "sentences": _sentences, "letters": _letters,
}


def _pattern(m: rules.Measure, text: str) -> str:
    return "".join("012"[f(m, text) + 1] for f in LABELLERS.values())


def pattern_of(text: str) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_pattern(rules.measure(t), t or "") for t in texts], dtype=object)

    return of(F.col(text))


def votes(docs: DataFrame) -> DataFrame:
    """``doc_id, body, pattern`` for every row: a digit per heuristic, 0 bad, 1 nothing, 2 good."""

    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("body"), pattern_of("text").alias("pattern"))


@dataclass
class Accuracies:
    """``shares`` of good texts and of each fault, and for each of these rows how often each
    heuristic's vote is ``bad``."""

    shares: np.ndarray
    bad: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good and of each fault, by rows of votes (-1, 0, 1)."""
        logs = np.log(self.shares) + (votes < 0) @ np.log(self.bad).T + (votes > 0) @ np.log1p(-self.bad).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, 0]

    def right_on_good(self) -> np.ndarray:
        return 1 - self.bad[0]

    def right_on_bad(self) -> np.ndarray:
        return self.shares[1:] @ self.bad[1:] / self.shares[1:].sum()


def estimate(votes: np.ndarray, counts: np.ndarray, most_wrong: float = MOST_WRONG, rounds: int = 300, tolerance: float = 1e-8) -> Accuracies:
    """EM from a start at which four of five texts are good and each fault is seen by one heuristic.

    On good texts a heuristic's vote is bad in ``most_wrong`` of its votes at most: heuristics are
    made to be sure when they say bad, and without that a fault seen by one of them only could as
    well be its habit. The start counts as ten votes, so nothing becomes certain.
    """
    n = votes.shape[1]
    begin = np.full((n + 1, n), 0.1)
    begin[0] = most_wrong / 2
    np.fill_diagonal(begin[1:], 0.9)
    at = Accuracies(np.concatenate(([0.8], np.full(n, 0.2 / n))), begin)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds):
        w = at.classes(votes).T * counts
        shares = w.sum(axis=1) + 0.01
        bad = (w @ down + 10 * begin) / (w @ (up + down) + 10)
        bad[0] = np.minimum(bad[0], most_wrong)
        new = Accuracies(shares / shares.sum(), bad)
        moved = max(np.abs(new.shares - at.shares).max(), np.abs(new.bad - at.bad).max())
        at = new
        if moved < tolerance:
            break
    return at


_MASK = (1 << HASH_BITS) - 1


def features(m: rules.Measure, text: str) -> set[int]:
    """Hashed features: the distinct words (ASCII in lower case) and their first four and five bytes,
    and how symbols, digits, capitals, stops, lengths, repeated words and lines stand, in steps."""
    words = {w.lower() for w in m.words}
    ids = {crc32(w) & _MASK for w in words}
    for size in (4, 5):
        ids |= {crc32(w[:size], size) & _MASK for w in words if len(w) > size}
    n, chars = max(1, m.n_words), rules.class_counts(text)
    total = max(1, int(chars.sum()))
    shape = {"words": m.n_words.bit_length(), "mean": min(30, m.word_chars // n), "variety": int(10 * len(m.words) / n ** 0.8),
             "repeat": 10 * m.n_repeat_words // n, "lines": 10 * m.n_dup_lines // (text.count("\n") + 1), "symbols": min(20, 100 * m.n_symbols // total)}
    shape |= {c: min(40, 40 * int(k) // total) for c, k in zip(rules.CLASSES, chars)}
    return ids | {hashed(f"{k}={v}") for k, v in shape.items()}


@dataclass
class QualityModel:
    accuracies: Accuracies
    scorer: HashedLinear
    posteriors: DataFrame  # pattern, posterior


def fit(docs: DataFrame, voted: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel:
    """EM over all rows of ``voted`` (``votes`` of ``docs``), then the linear model on the
    posteriors of at most ``max_train`` texts."""
    spark = docs.sparkSession
    patterns = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    table = np.array([[int(c) - 1 for c in r.pattern] for r in patterns], float).reshape(len(patterns), len(LABELLERS))
    counts = np.array([r.n for r in patterns], float)
    accuracies = estimate(table, counts)
    soft = list(zip([r.pattern for r in patterns], accuracies.posterior(table).tolist()))
    soft = spark.createDataFrame(soft, "pattern string, y double")  # at most 3 ** 8 rows

    # a bound on the hash leaves about max_train rows; texts repeated often pass or fail together
    bound = min(1.0, max_train / max(1.0, counts.sum()))
    lot = F.shiftrightunsigned(F.xxhash64("doc_id", "body", F.lit(1)), 11) / F.lit(float(1 << 53))
    chosen = voted.where(lot < bound).groupBy(F.col("doc_id").alias("id"), F.col("body").alias("b")).agg(F.min("pattern").alias("pattern"))
    chosen = chosen.join(F.broadcast(soft), "pattern").orderBy(F.xxhash64("id", "b", F.lit(1))).limit(max_train)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("body"), "text")
    rows = rows.join(F.broadcast(chosen), rows["doc_id"].eqNullSafe(chosen["id"]) & (rows["body"] == chosen["b"]))

    def examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pd.DataFrame({"ids": [sorted(features(rules.measure(t), t or "")) for t in pdf["text"]], "y": pdf["y"].astype(float)})
            yield out.assign(signs=None, weight=1.0)[["ids", "signs", "y", "weight"]]

    training = rows.select("text", "y").mapInPandas(examples, "ids array<int>, signs array<float>, y double, weight double")
    scorer = linear.fit(staged(training, "quality-training"))
    return QualityModel(accuracies, scorer, soft.withColumnRenamed("y", "posterior"))


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern, posterior, score, kept`` for every row of ``docs``.

    ``posterior`` is what the heuristics' votes say, ``score`` what the linear model says of the
    text; rows with a score of one half or more are kept. Null and empty texts are scored like any
    other. Other columns are ignored; repeated rows appear each; an empty table gives an empty one.
    """
    voted = staged(votes(docs), "votes")
    model = fit(docs, voted)
    weights, bias = model.scorer.weights, model.scorer.bias

    @F.pandas_udf("pattern string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        patterns, margins = [], []
        for t in texts:
            m = rules.measure(t)
            patterns.append(_pattern(m, t or ""))
            margins.append(bias + float(weights[np.sort(np.fromiter(features(m, t or ""), np.int64))].sum()))
        return pd.DataFrame({"pattern": patterns, "score": 1 / (1 + np.exp(-np.clip(np.array(margins, float), -60, 60)))})

    rows = docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.pattern", "j.score")
    rows = rows.join(F.broadcast(model.posteriors), "pattern", "left")  # at most 3 ** 8 patterns
    return rows.select("doc_id", "pattern", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
