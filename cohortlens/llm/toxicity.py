"""Toxicity scores from a counterfactually regularised linear classifier.

Labelled texts train a hashed linear model. Besides, every sentence of theirs that names an
identity is written anew with each other term of the same group, and without any, and the model is
charged for the square of the change in score: a group's name alone must not move it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import linear
from cohortlens.llm.common import free_name, staged
from cohortlens.llm.linear import LETTERS, HashedLinear, word_features
from cohortlens.runtime import hash_first

#: Labelled rows used for training, at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
#: Weight of a toxic example: they are few, and one missed costs more than one flagged wrongly.
TOXIC_WEIGHT = 3.0
#: Weight of a squared change in score against an example's loss.
COUNTERFACTUAL_WEIGHT = 1.0

# Terms that may be swapped for each other, group by group.
IDENTITY_TERMS = [
    ["man", "woman"], ["men", "women"], ["boy", "girl"], ["boys", "girls"], ["male", "female"], ["he", "she"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european", "arab"], ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"],
    ["transgender", "cisgender", "trans", "cis"], ["immigrant", "citizen", "refugee", "foreigner"], ["immigrants", "citizens", "refugees", "foreigners"],
    ["disabled", "abled", "deaf", "blind", "autistic"], ["old", "young", "elderly"],
    ["mann", "frau"], ["männer", "frauen"], ["christ", "muslim", "jude"], ["christen", "muslime", "juden"], ["schwul", "hetero", "lesbisch"],
    ["homme", "femme"], ["hommes", "femmes"], ["chrétien", "musulman", "juif"], ["chrétiens", "musulmans", "juifs"],
    ["hombre", "mujer"], ["hombres", "mujeres"], ["cristiano", "musulmán", "judío"], ["cristianos", "musulmanes", "judíos"],
]
_SENTENCE = re.compile(r"[.!?\n]+")


def featurizer() -> Callable[[str], Iterable[int]]:
    """From a text to the hashed features of its distinct words, lower-cased."""
    known: dict[str, list[int]] = {}
    return lambda text: word_features(set(LETTERS.findall(text.lower())), known)


def swaps(text: str, groups: list[list[str]] = IDENTITY_TERMS) -> Iterator[tuple[list[str], list[str]]]:
    """Words of each sentence that names an identity, and of the sentence with one term swapped for
    another of its group, or left out."""
    others = {term: [o for g in groups if term in g for o in g if o != term] for g in groups for term in g}
    for sentence in _SENTENCE.split(text.lower()):
        words = LETTERS.findall(sentence)
        for term in sorted(set(words) & others.keys()):
            for other in others[term]:
                yield words, [other if w == term else w for w in words]
            yield words, [w for w in words if w != term]


def training_rows(labelled: DataFrame, counterfactual_weight: float, groups: list[list[str]] = IDENTITY_TERMS) -> DataFrame:
    """From ``text, y``: an example for each text, and a pair row for each swap in its sentences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, known = featurizer(), {}
        for pdf in frames:
            rows = []
            for text, y in zip(pdf["text"], pdf["y"]):
                rows.append((sorted(features(text or "")), None, y, TOXIC_WEIGHT if y > 0.5 else 1.0))
                for words, swapped in swaps(text or "", groups) if counterfactual_weight else ():
                    a, b = word_features(set(words), known), word_features(set(swapped), known)
                    gone, come = sorted(a - b), sorted(b - a)
                    if gone or come:
                        rows.append((gone + come, [-1.0] * len(gone) + [1.0] * len(come), None, counterfactual_weight))
            yield pd.DataFrame(rows, columns=["ids", "signs", "y", "weight"]).astype({"y": float, "weight": float})

    return labelled.select("text", "y").mapInPandas(run, "ids array<int>, signs array<float>, y double, weight double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row may not be learned from: crc32 of the id as text is a multiple of 5. A null
    id counts as the empty text, and so is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, counterfactual_weight: float = COUNTERFACTUAL_WEIGHT,
        groups: list[list[str]] = IDENTITY_TERMS) -> HashedLinear:
    """Learn from ``labels`` (``doc_id, toxic``) outside the held-out fold, at most ``max_train``
    of them. Null labels or ids are left out; of several labels of one id the larger counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("double").alias("y"))
    sample = hash_first(known, max_train, 2, known.count())  # a proven bound, so it may be broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    rows = staged(training_rows(picked, counterfactual_weight, groups), "toxicity-training")
    return linear.fit(rows, l2=0.3, passes=40)


def score(docs: DataFrame, model: HashedLinear) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, empty and null texts too) and ``predicted`` (score >= 0.5)."""
    docs = docs.withColumn("score", model.score(featurizer))
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``. Other columns are ignored;
    without any labels every score is one third, which is not toxic."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model, name = fit(docs, labels), free_name(docs, "__toxic")
    return docs.withColumn(name, model.score(featurizer)).where(F.col(name) < 0.5).drop(name)
