"""Repeated passages by a sparse suffix array.

A passage of ``min_words`` words that two documents share has ``window`` places where ``gram`` words
begin (``min_words = window + gram - 1``). The one with the smallest hash is chosen by content
alone, so both documents retain their suffix there. Suffixes are sorted by their first ``gram``
words; those that begin alike and lie in different documents are then compared over the words
around: for every way to take the missing ``window - 1`` words from the left and from the right,
rows are sorted by them and neighbours compared. What is equal is a shared passage of ``min_words``
words, and the union of these is the whole shared passage. Nothing shorter is ever reported.

Only suffixes whose first words occur twice get their context, and only their positions meet the
texts again. Of a start shared by more than ``CLASS_ROWS`` suffixes, those with the same words around
are one kind, which knows the least and the greatest of its documents: kinds are compared in their
place, and their members get the result. Only where more than ``CLASS_ROWS`` kinds share a start, it
is not compared inside one task but by grouping the passages themselves, which gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, staged, text_or_empty

#: Suffixes with one start that a task compares at once; larger classes are grouped by passage.
CLASS_ROWS = 5_000
_WORD = re.compile(WORD)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class WordHashes:
    """64-bit hashes of the words of a text; remembers those of frequent words."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words, known = _WORD.findall(text or ""), self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, put together from runs of powers of two."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width, base = np.zeros(len(words), np.uint64), 0, words, 1, _BASE
    with np.errstate(over="ignore"):
        left = size
        while left:
            if left & 1:  # what is done, then this power's run after it
                m = len(words) - done - width + 1
                out = out[:m] * base + power[done:done + m] if done else power[:m].copy()
                done += width
            left >>= 1
            if left:
                m = len(power) - width
                power = power[:m] * base + power[width:width + m]
                base, width = base * base, width * 2
        return _mix(out[:n])


def minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest value (the first, if tied) of some ``window`` in a row."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    at, width = np.arange(len(values)), 1
    while 2 * width <= window:
        at, width = lower(at[:-width], at[width:]), 2 * width
    rest = window - width
    return np.unique(lower(at[:n], at[rest:rest + n]) if rest else at[:n])


def _retained(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, body, pos, start``: the retained suffixes and the hash of their first words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            values = [rolling(hashes(t), gram) for t in pdf["text"]]
            places = [minimisers(v, window) for v in values]
            of = np.repeat(np.arange(len(pdf)), [len(p) for p in places])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].take(of).reset_index(drop=True), "body": pdf["body"].to_numpy()[of],
                "pos": np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32),
                "start": np.concatenate([np.zeros(0, np.uint64), *[v[p] for v, p in zip(values, places)]]).view(np.int64)})

    return _keyed(docs).mapInPandas(run, "doc_id bigint, body bigint, pos int, start bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("body"), "text")


def _contexts(docs: DataFrame, places: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds to ``doc_id, body, places`` the text, and turns the places into rows with the hashes of
    the ``window - 1`` words before them and after their first words (0 where the text ends). Places
    of a text with the same words there are one row: a line said a thousand times is few rows."""
    wide = window - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in frames:
            of, rows = [], []
            for i, (text, found) in enumerate(zip(pdf["text"], pdf["places"])):
                words = (_mix(hashes(text)) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
                words = np.concatenate([np.zeros(wide, np.uint32), words, np.zeros(wide, np.uint32)])
                found = sorted(found, key=lambda p: p["pos"])
                pos = np.array([p["pos"] for p in found], np.int64)
                left = words[pos[:, None] + np.arange(wide)[None, :]]
                right = words[pos[:, None] + wide + gram + np.arange(wide)[None, :]]
                same: dict[tuple, list[int]] = {}
                for p, before, after in zip(found, left, right):
                    same.setdefault((p["start"], p["alike"], before.tobytes(), after.tobytes()), []).append(p["pos"])
                of += [i] * len(same)
                rows += [(at, *key) for key, at in same.items()]
            out = pd.DataFrame(rows, columns=["pos", "start", "alike", "left_words", "right_words"])
            out.insert(0, "body", pdf["body"].to_numpy()[of])
            out.insert(0, "doc_id", pdf["doc_id"].take(of).reset_index(drop=True))
            if len(out):
                yield out.astype({"doc_id": "Int64"})

    found = places.withColumnsRenamed({"doc_id": "d", "body": "b"})
    keyed = _keyed(docs)
    same = keyed["doc_id"].eqNullSafe(found["d"]) & (keyed["body"] == found["b"])
    rows = keyed.join(found, same).select("doc_id", "body", "text", "places")
    return rows.mapInPandas(run, "doc_id bigint, body bigint, pos array<int>, start bigint, alike bigint, left_words binary, right_words binary")


class _Passages:
    """Hashes of the passages round some suffixes: of any number of words before and the rest of
    the missing ones after, put together from running hashes outward on either side."""

    def __init__(self, rows: pd.DataFrame):
        left, right = _matrix(rows["left_words"]), _matrix(rows["right_words"])
        self.wide = left.shape[1]
        self.before, self.after = (left > 0).sum(axis=1), (right > 0).sum(axis=1)  # words up to the text's ends
        start = rows["start"].to_numpy().view(np.uint64)
        self.left, self.right = [_mix(start)], [_mix(start + np.uint64(1))]
        with np.errstate(over="ignore"):
            for i in range(self.wide):
                self.left.append(_mix(self.left[-1] * _BASE + left[:, self.wide - 1 - i]))
                self.right.append(_mix(self.right[-1] * _BASE + right[:, i]))

    def take(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each row's passage with so many ``words`` before, and whether its text has it."""
        rest = self.wide - words
        with np.errstate(over="ignore"):
            said = _mix(self.left[words] * _BASE + self.right[rest] + np.uint64(words))
        return said.view(np.int64), (self.before >= words) & (self.after >= rest)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), -1)


HITS = "doc_id bigint, body bigint, start_word int, end_word int, first_id bigint"


def _classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``start`` as frames of whole classes."""
    # rows are gathered until a later start comes, so classes stay whole
    held = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) < CLASS_ROWS:
            continue
        pdf = pd.concat(held, ignore_index=True)
        whole = pdf["start"] != pdf["start"].iloc[-1]
        if whole.any():
            yield pdf[whole].reset_index(drop=True)
        held = [pdf[~whole]]
    if held and any(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _numbered(doc: pd.Series, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents numbered in order of their ids, nulls last, and a row of each."""
    doc_id, null = doc.fillna(0).to_numpy(np.int64), doc.isna().to_numpy()
    order = np.lexsort((body, doc_id, null))
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[order][1:] != doc_id[order][:-1]) | (null[order][1:] != null[order][:-1]) | (body[order][1:] != body[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[np.flatnonzero(new)]


def _shared(rows: pd.DataFrame, low: np.ndarray, high: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, whose documents' numbers go from ``low`` to ``high``: the least and the most words
    before its first ones (-1: none) in a passage that two documents have, and the least such number."""
    least, most, first = np.full(len(rows), wide + 1), np.full(len(rows), -1), np.full(len(rows), high.max() + 1)
    passages = _Passages(rows)
    for words in range(wide + 1):
        said, whole = passages.take(words)
        order = np.flatnonzero(whole)
        order = order[np.lexsort((low[order], said[order]))]
        if not len(order):
            continue
        new = np.ones(len(order), bool)  # neighbours that differ begin a group
        new[1:] = said[order][1:] != said[order][:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        shared = (low[order[heads]] != np.maximum.reduceat(high[order], heads))[group]
        hit = order[shared]
        least[hit], most[hit] = np.minimum(least[hit], words), words
        first[hit] = np.minimum(first[hit], low[order[heads]][group][shared])
    return least, most, first


def _hits(rows: pd.DataFrame, least: np.ndarray, most: np.ndarray, first: np.ndarray | pd.Series, size: int) -> pd.DataFrame:
    """The words that each row's passages cover, as ``HITS``: runs of its places that touch are one."""
    of = np.repeat(np.arange(len(rows)), rows["pos"].map(len).to_numpy(np.int64))
    pos = np.concatenate([np.zeros(0, np.int64), *rows["pos"]])
    # all these passages hold the suffix's first words, so together they are one run; places ascend
    start, end = pos - most[of], pos - least[of] + size
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    last, of = np.r_[head[1:], len(new)][:len(head)] - 1, of[head]
    return pd.DataFrame({
        "doc_id": rows["doc_id"].astype("Int64").take(of).to_numpy(), "body": rows["body"].to_numpy()[of], "start_word": start[head].astype(np.int32),
        "end_word": end[last].astype(np.int32), "first_id": pd.Series(first).astype("Int64").take(of).to_numpy()}).astype({"doc_id": "Int64", "first_id": "Int64"})


def _compare(rows: DataFrame, wide: int, size: int) -> DataFrame:
    """What each suffix of a class that fits a task shares with other documents, as ``HITS``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _classes(frames):
            doc = pdf["doc_id"].astype("Int64")
            number, some = _numbered(doc, pdf["body"].to_numpy())
            least, most, first = _shared(pdf, number, number, wide)
            hit = np.flatnonzero(most >= 0)
            yield _hits(pdf.iloc[hit], least[hit], most[hit], doc.iloc[some[first[hit]]], size)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "start").sortWithinPartitions("start").mapInPandas(run, HITS)


SHARED = "start bigint, around bigint, least int, most int, first_id bigint"


def _compare_kinds(kinds: DataFrame, wide: int) -> DataFrame:
    """What the kinds of a class that fits a task share, as ``SHARED``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _classes(frames):
            doc = pd.concat([pdf["low_id"], pdf["high_id"]], ignore_index=True).astype("Int64")
            number, some = _numbered(doc, np.concatenate([pdf["low_body"], pdf["high_body"]]))
            least, most, first = _shared(pdf, number[:len(pdf)], number[len(pdf):], wide)
            hit = np.flatnonzero(most >= 0)
            yield pd.DataFrame({
                "start": pdf["start"].to_numpy()[hit], "around": pdf["around"].to_numpy()[hit], "least": least[hit].astype(np.int32),
                "most": most[hit].astype(np.int32), "first_id": doc.iloc[some[first[hit]]].to_numpy()}).astype({"first_id": "Int64"})

    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kinds.repartition(parts, "start").sortWithinPartitions("start").mapInPandas(run, SHARED)


def _group_kinds(kinds: DataFrame, wide: int) -> DataFrame:
    """The same for classes of any number of kinds: every passage is a row, grouped by what it says."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            passages, own = _Passages(pdf), pdf[["start", "around", "low_id", "low_body", "high_id", "high_body"]].astype({"low_id": "Int64", "high_id": "Int64"})
            for words in range(wide + 1):
                said, whole = passages.take(words)
                yield own.assign(words=np.int32(words), said=said)[whole]

    schema = "start bigint, around bigint, low_id bigint, low_body bigint, high_id bigint, high_body bigint, words int, said bigint"
    said = staged(kinds.mapInPandas(run, schema), "passages")

    def who(end: str):
        return F.struct(F.col(f"{end}_id").isNull().alias("none"), F.col(f"{end}_id").alias("doc_id"), F.col(f"{end}_body").alias("body"))

    shared = said.groupBy("said").agg(F.min(who("low")).alias("low"), F.max(who("high")).alias("high")).where("low <> high")
    shared = staged(shared.select("said", F.col("low.doc_id").alias("first_id")), "shared")
    found = said.join(shared.hint("merge"), "said").groupBy("start", "around")
    return found.agg(F.min("words").alias("least"), F.max("words").alias("most"), F.min("first_id").alias("first_id"))


def _of_kinds(rows: DataFrame, wide: int, size: int) -> DataFrame:
    """As :func:`_compare` for classes of any size: rows with the same words around share the same
    passages, so they are compared as one kind, with the least and the greatest of its documents."""
    rows = rows.withColumn("around", F.xxhash64("left_words", "right_words"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    kinds = rows.groupBy("start", "around").agg(
        F.min(who).alias("low"), F.max(who).alias("high"), F.first("left_words").alias("left_words"), F.first("right_words").alias("right_words"))
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{name}") for end in ("low", "high") for c, name in (("doc_id", "id"), ("body", "body"))]
    kinds = staged(kinds.select("start", "around", *ends, "left_words", "right_words"), "kinds")
    held = kinds.groupBy("start").agg((F.count("*") > CLASS_ROWS).alias("many"))
    kinds = kinds.join(staged(held, "kinds-of-starts"), "start")
    shared = _compare_kinds(kinds.where("NOT many").drop("many"), wide).unionByName(_group_kinds(kinds.where("many").drop("many"), wide))
    shared = staged(shared, "shared-by-kinds")
    found = rows.select("doc_id", "body", "pos", "start", "around").join(shared.hint("merge"), ["start", "around"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield _hits(pdf, pdf["least"].to_numpy(), pdf["most"].to_numpy(), pdf["first_id"], size)

    return found.select("doc_id", "body", "pos", "least", "most", "first_id").mapInPandas(run, HITS)


def repeated_passages(docs: DataFrame, window: int = 25, gram: int = 26) -> DataFrame:
    """Every maximal run of words of a document that is covered by passages of at least
    ``window + gram - 1`` words (50) found in another document too.

    Returns ``doc_id, start_word, end_word, n_words, first_id, is_first``: words are counted from
    0, the end is exclusive; ``first_id`` is the smallest id that shares one of the passages,
    ``is_first`` says that it is the document's own. Texts with fewer words, null and empty ones
    have no rows. Rows that repeat both id and text are one document; a null id sorts last.
    Repeats inside one document alone are not reported. Other columns are ignored.
    """
    rows = staged(_retained(docs, window, gram), "suffixes")
    common = rows.groupBy("start").agg(F.count("*").alias("alike")).where("alike > 1")
    common = staged(common, "common-starts")
    where = F.collect_set(F.struct("pos", "start", "alike")).alias("places")
    places = rows.join(common.hint("merge"), "start").groupBy("doc_id", "body").agg(where)
    found, size = staged(_contexts(docs, places, window, gram), "contexts"), window + gram - 1
    few = _compare(found.where(F.col("alike") <= CLASS_ROWS), window - 1, size)
    many = _of_kinds(found.where(F.col("alike") > CLASS_ROWS), window - 1, size)

    # runs that touch are one: a run starts where no earlier one of its document reaches
    hits = few.unionByName(many)
    document = Window.partitionBy("doc_id", "body").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(document.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.coalesce(F.col("start_word") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("doc_id", "body", "run").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_id").alias("first_id"))
    first = F.coalesce(F.col("first_id") == F.col("doc_id"), F.col("first_id").isNull())
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_id", first.alias("is_first"))
