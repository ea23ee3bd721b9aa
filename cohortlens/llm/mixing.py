"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token weights of the cells are raked
until their sums by source, by language and by topic meet the targets; a document is then kept with
its cell's probability, by a hash of its id and text, so the sample is the same on every run.

A margin names its categories; all others together are one. So there are only as many cells as the
targets allow, whatever the data holds: their sums are small, are raked on the driver, and are
broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import free_name, staged

#: The category of all values that a margin doesn't name.
REST = "__rest__"
#: Topics by default: parts of a hash of the text's keyword.
TOPICS = 8
#: More cells than this are refused.
MAX_CELLS = 1_000_000
_LONG_WORD = re.compile(r"[^\W\d_]{6,}")


def topic_and_tokens(text: str = "text") -> Column:
    """A struct of ``topic`` and ``n_tokens`` (words) of a text.

    The topic is the part that the text's keyword hashes to: of its words with six letters or more
    the most frequent, if tied the first in order. A text without such words has topic ``none``.
    """

    @F.pandas_udf("topic string, n_tokens bigint")
    def of(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh32_intdigest

        topics, sizes = [], []
        for t in texts:
            t = t or ""
            counts = Counter(_LONG_WORD.findall(t.lower()))
            most = max(counts.values(), default=0)
            word = min((w for w, n in counts.items() if n == most), default=None)
            topics.append("none" if word is None else f"t{xxh32_intdigest(word) % TOPICS}")
            sizes.append(len(t.encode().split()))
        return pd.DataFrame({"topic": topics, "n_tokens": sizes})

    return of(F.col(text))


@dataclass
class Margins:
    """Target shares by category of each of the columns; ``REST`` stands for all others."""

    shares: dict[str, dict[str, float]]

    def category(self, column: str) -> Column:
        named = [c for c in self.shares[column] if c != REST]
        value = F.coalesce(F.col(column), F.lit(""))
        return F.when(value.isin(named), value).otherwise(REST) if named else F.lit(REST)


def smoothed_margins(rows: DataFrame, columns: list[str], power: float = 0.5, least: float = 0.002) -> Margins:
    """Targets for ``rows`` (with ``n_tokens``): each category's share to the power, made to sum to
    one, which lifts small categories. Those with less than the share ``least`` go into ``REST``,
    so at most ``1 / least`` are named."""
    shares = {}
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    for c in columns:
        sums = rows.groupBy(F.coalesce(F.col(c), F.lit("")).alias("v")).agg(F.sum("n_tokens").alias("n"))
        named = {r.v: r.n / total for r in sums.where(F.col("n") >= least * total).collect()} if total else {}
        rest = 1 - sum(named.values())
        lifted = {v: s ** power for v, s in sorted(named.items()) if s > 0} | ({REST: rest ** power} if rest > 1e-9 else {})
        shares[c] = {v: s / sum(lifted.values()) for v, s in lifted.items()}
    return Margins(shares)


def rake(tokens: np.ndarray, targets: list[np.ndarray], fraction: float, rounds: int = 500, tolerance: float = 1e-6) -> np.ndarray:
    """Keeping probabilities of cells: ``min(1, product of one factor for each category)``, such
    that the kept tokens are ``fraction`` of all and meet the target shares on every axis.

    A target that the tokens at hand can't meet is met as far as they go: all of them are kept.
    Targets of categories without tokens are spread over the others.
    """
    axes = range(tokens.ndim)
    factors = [np.ones(n) for n in tokens.shape]
    goals = []
    for axis in axes:
        have = tokens.sum(axis=tuple(a for a in axes if a != axis))
        t = np.where(have > 0, targets[axis], 0.0)
        t = t / t.sum() if t.sum() else t
        goals.append(np.minimum(t * fraction * tokens.sum(), have))
    factors[0] *= fraction

    def probabilities() -> np.ndarray:
        p = np.ones(tokens.shape)
        for axis in axes:
            p = p * factors[axis].reshape([-1 if a == axis else 1 for a in axes])
        return np.minimum(p, 1.0)

    for _ in range(rounds):
        worst = 0.0
        for axis in axes:
            now = (tokens * probabilities()).sum(axis=tuple(a for a in axes if a != axis))
            ratio = np.where(now > 0, goals[axis] / np.where(now > 0, now, 1.0), 1.0)
            factors[axis] = np.clip(factors[axis] * ratio, 0.0, 1e9)
            worst = max(worst, float(np.abs(ratio - 1).max(initial=0.0)))
        if worst < tolerance:
            break
    return probabilities()


def probabilities(rows: DataFrame, margins: Margins, fraction: float) -> DataFrame:
    """``cell_<column>`` for each margin, and ``probability``: one row per cell of ``rows``."""
    columns = list(margins.shares)
    cells = rows.groupBy(*[margins.category(c).alias(c) for c in columns]).agg(F.sum("n_tokens").alias("n_tokens"))
    found = cells.limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"the margins make more than {MAX_CELLS} cells; name fewer categories")
    names = [list(margins.shares[c]) + [REST] * (REST not in margins.shares[c]) for c in columns]
    place = [{v: i for i, v in enumerate(n)} for n in names]
    tokens = np.zeros([len(n) for n in names])
    at = [tuple(place[k][r[c]] for k, c in enumerate(columns)) for r in found]
    for r, i in zip(found, at):
        tokens[i] = r.n_tokens
    targets = [np.array([margins.shares[c].get(v, 0.0) for v in n]) for c, n in zip(columns, names)]
    p = rake(tokens, targets, fraction)
    table = [(*[r[c] for c in columns], float(p[i]) if r.n_tokens else fraction) for r, i in zip(found, at)]
    schema = ", ".join([*[f"cell_{c} string" for c in columns], "probability double"])
    return rows.sparkSession.createDataFrame(table, schema)


def lot(seed: int) -> Column:
    """A number from 0 to 1 that id and text decide (where null, they count as empty)."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _with_probability(rows: DataFrame, margins: Margins, table: DataFrame, name: str) -> DataFrame:
    """``rows`` with the probability of their cell in the new column ``name``."""
    own = {c: free_name(rows, f"__category_{c}") for c in margins.shares}
    rows = rows.withColumns({o: margins.category(c) for c, o in own.items()})
    table = table.select(*[F.col(f"cell_{c}").alias(o) for c, o in own.items()], F.col("probability").alias(name))
    # as many rows as the margins make cells
    return rows.join(F.broadcast(table), list(own.values()), "left").drop(*own.values())


def mixed(docs: DataFrame, fraction: float = 0.5, margins: Margins | None = None, seed: int = 6) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, kept`` for every row of ``docs``.

    Without ``margins`` the targets are ``smoothed_margins`` over source, language and topic. Null
    and empty texts have no tokens and topic ``none``; a null source or language is the category
    ''. Rows with one id and equal texts share their lot. Other columns are ignored.
    """
    rows = docs.select("doc_id", "source", "lang", lot(seed).alias("lot"), topic_and_tokens().alias("t"))
    rows = staged(rows.select("doc_id", "source", "lang", "lot", "t.topic", "t.n_tokens"), "mixing")
    margins = margins or smoothed_margins(rows, ["source", "lang", "topic"])
    out = _with_probability(rows, margins, probabilities(rows, margins, fraction), "probability")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", (F.col("lot") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, fraction: float = 0.5, margins: Margins | None = None, seed: int = 6) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with all their columns."""
    rows = docs.select("source", "lang", topic_and_tokens().alias("t")).select("source", "lang", "t.topic", "t.n_tokens")
    margins = margins or smoothed_margins(rows := staged(rows, "mixing"), ["source", "lang", "topic"])
    table = probabilities(rows, margins, fraction)
    t, p = free_name(docs, "__topic"), free_name(docs, "__probability")
    clear = Margins({(t if c == "topic" else c): s for c, s in margins.shares.items()})
    table = table.withColumnRenamed("cell_topic", f"cell_{t}")
    picked = _with_probability(docs.withColumn(t, topic_and_tokens()["topic"]), clear, table, p)
    return picked.where(lot(seed) < F.col(p)).select(*[F.col(f"`{c}`") for c in docs.columns])
