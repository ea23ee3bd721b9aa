"""Quality rules: base counts of a text, and its distance from what its language looks like.

Every language of ``MIN_REFERENCE`` words or more has two reference histograms of its own, over all
its texts: characters by class, and its common words (those that are at least ``COMMON_SHARE`` of
its words) with all others in one bin. A document fails if the Jensen-Shannon distance of one of its
own histograms from the reference is over the limit. Short texts scatter, so a histogram needs a
least length, and the limit is raised by the divergence that sampling alone would cause. Documents
of smaller languages are compared with nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

#: Least words of a text for its words to be compared.
MIN_WORDS = 100
#: Least words of a language for it to have a reference.
MIN_REFERENCE = 1_000
#: Least characters in words for the classes to be compared.
MIN_CHARS = 200
#: A language's words with at least this share of them are common: at most 1,000 a language.
COMMON_SHARE = 0.001
#: References of languages with this share of all words or rows (at most 2,000) go to every task; those of smaller ones
#: are joined with their rows.
LANGUAGE_SHARE = 0.001
#: Largest Jensen-Shannon divergence (base 2) from the reference, of classes and of words.
CHAR_LIMIT, WORD_LIMIT = 0.10, 0.22
#: Words counted by a task before the counts are passed on.
COUNTED = 300_000

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
#: Character classes by the first byte of UTF-8; the rest of a character's bytes count for none.
CLASSES = ["lower", "upper", "digit", "stop", "mark", "symbol", "latin", "other"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "'\"()[]{}-/@_", SYMBOLS + "^~`+=\\")):
        table[list(chars.encode())] = i
    table[0xC2:0xC6], table[0xC6:] = CLASSES.index("latin"), CLASSES.index("other")
    return table


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text.encode(), np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]


@dataclass
class Measure:
    """The base counts of one text, and its distinct words with their numbers of occurrences."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: dict[bytes, int]
    counts: np.ndarray


def measure(text: str | None) -> Measure:
    text = text or ""
    words = text.encode().split()  # of bytes: at ASCII white space
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return Measure(
        len(words), len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(codes, len(number)), number, np.bincount(codes, minlength=len(number)))


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(codes) < 3:
        return 0
    pairs = codes[:-2] * distinct + codes[1:-1]
    if distinct > 1 << 20:  # keep the product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, times = np.unique(pairs * distinct + codes[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(len(codes), bool)
    for shift in range(3):
        inside[shift:len(again) + shift] |= again
    return int(inside.sum())


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two histograms over the same bins."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def half(a: np.ndarray) -> float:
        on = a > 0
        return float(np.sum(a[on] * np.log2(a[on] / m[on])))

    return (half(p) + half(q)) / 2


@dataclass
class Reference:
    chars: np.ndarray
    words: dict[bytes, int]
    word_counts: np.ndarray  # one for each of words, then all others

    @classmethod
    def of(cls, n: int, classes: list[int], words: list[bytes], counts: list[int]) -> Reference:
        others = n - sum(counts)
        return cls(np.array(classes, float), {bytes(w): i for i, w in enumerate(words)}, np.array([*counts, others], float))


def word_sums(docs: DataFrame) -> DataFrame:
    """``lang, kind, token, n``: occurrences of each word and character class by language, and its
    words and rows in total. Counted in tasks and summed by a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(lang, kind, token, n) for (lang, kind, token), n in counts.items()], columns=["lang", "kind", "token", "n"])
            counts.clear()
            return out

        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                lang, text = lang or "", text or ""
                words = Counter(text.encode().split())
                counts[lang, "rows", b""] += 1
                counts[lang, "total", b""] += words.total()
                for w, times in words.items():
                    counts[lang, "word", w] += times
                for c, times in zip(CLASSES, class_counts(text).tolist()):
                    counts[lang, "class", c.encode()] += times
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    parts = docs.select("lang", "text").mapInPandas(run, "lang string, kind string, token binary, n bigint")
    return staged(parts.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")), "word-counts")


#: A reference as a row: the language's words, its classes as in ``CLASSES``, its common words and their counts.
REFERENCE = "lang string, total bigint, classes array<bigint>, words array<binary>, counts array<bigint>"


def _reference_rows(sums: DataFrame, totals: DataFrame) -> DataFrame:
    """One row as in ``REFERENCE`` for each language of ``sums``; ``totals`` has all of them."""
    common = sums.join(totals, "lang").where((F.col("kind") == "class") | ((F.col("kind") == "word") & (F.col("n") >= COMMON_SHARE * F.col("total"))))
    classes = [F.coalesce(F.sum(F.when((F.col("kind") == "class") & (F.col("token") == F.lit(c).cast("binary")), F.col("n"))), F.lit(0)) for c in CLASSES]
    words = F.sort_array(F.collect_list(F.when(F.col("kind") == "word", F.struct("token", "n"))))  # at most 1,000
    found = common.groupBy("lang").agg(F.first("total").alias("total"), F.array(*classes).alias("classes"), words.alias("w"))
    return found.select("lang", "total", "classes", F.col("w.token").alias("words"), F.col("w.n").alias("counts"))


def references(docs: DataFrame) -> tuple[list[str], dict[str, Reference], DataFrame | None]:
    """The large languages (by words or rows, see ``LANGUAGE_SHARE``), the references of those that
    have one, and a table as in ``REFERENCE`` of the others' (None if none of them has one).

    Of words only the common ones of large languages come to the driver.
    """
    sums = word_sums(docs)
    totals = sums.where("kind IN ('total', 'rows')").groupBy("lang").pivot("kind", ["total", "rows"]).agg(F.sum("n"))
    every = totals.agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).first()
    if not every.rows:
        return [], {}, None
    is_large = (F.col("total") >= LANGUAGE_SHARE * every.total) | (F.col("rows") >= LANGUAGE_SHARE * every.rows)
    large = totals.where(is_large).collect()
    names, enough = [r.lang for r in large], [(r.lang, r.total) for r in large if r.total >= MIN_REFERENCE]
    own = sums.sparkSession.createDataFrame(enough, "lang string, total bigint")
    rows = _reference_rows(sums, F.broadcast(own)).collect() if enough else []
    found = {r.lang: Reference.of(r.total, r.classes, r.words, r.counts) for r in rows}
    small = totals.where(~is_large & (F.col("total") >= MIN_REFERENCE)).select("lang", "total")
    if not small.limit(1).count():
        return names, found, None
    # a large language's words would all meet in one task of the join
    return names, found, staged(_reference_rows(sums.where(~F.col("lang").isin(names)), small), "references")


def distances(text: str, m: Measure, ref: Reference | None) -> tuple[float | None, float | None, bool]:
    """Divergence of classes and of words from the reference (None where the text is too short or
    there is no reference), and whether both are within their limits."""
    chars = words = None
    fine = True
    if ref is None:
        return chars, words, fine

    def scatter(bins: np.ndarray, n: int) -> float:
        return (np.count_nonzero(bins) - 1) / (8 * math.log(2)) * (1 / n + 1 / bins.sum())

    if m.word_chars >= MIN_CHARS and ref.chars.sum():
        own = class_counts(text)
        if own.sum():
            chars = divergence(own, ref.chars)
            fine = chars <= CHAR_LIMIT + scatter(ref.chars, m.word_chars)
    if m.n_words >= MIN_WORDS and ref.words:
        own = np.zeros(len(ref.words) + 1)
        for w in m.words.keys() & ref.words.keys():
            own[ref.words[w]] = m.counts[m.words[w]]
        own[-1] = m.n_words - own.sum()
        words = divergence(own, ref.word_counts)
        fine = fine and words <= WORD_LIMIT + scatter(ref.word_counts, m.n_words)
    return chars, words, fine


RESULT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, char_divergence double, word_divergence double")


def _verdict(doc: int | None, text: str | None, ref: Reference | None) -> tuple:
    m = measure(text)
    failed = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
    chars, words, fine = distances(text or "", m, ref)
    return doc, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and fine, chars, words


def _results(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "char_divergence": float, "word_divergence": float})


def _judged_small(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """The verdicts of rows in small languages: each task gets its languages one after another, of
    each the reference first, so that it holds one reference and no language as a whole."""
    rows = docs.withColumn("is_doc", F.lit(True)).unionByName(refs.withColumn("is_doc", F.lit(False)), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ref = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if not r.is_doc:
                    current, ref = r.lang, Reference.of(r.total, r.classes, r.words, r.counts)
                else:
                    out.append(_verdict(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, ref if r.lang == current else None))
            yield _results(out)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lang").sortWithinPartitions("lang", "is_doc").mapInPandas(run, RESULT)


def judged(docs: DataFrame) -> DataFrame:
    """The base counts and the verdict of every row of ``docs``, as in ``RESULT``.

    A null text has no words and fails; a null language is one of its own, the same as ''. Other
    columns are ignored; repeated rows appear each; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    names, found, small = references(docs)
    shared = docs.sparkSession.sparkContext.broadcast(found)  # at most 2,000 languages of 1,000 words

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = shared.value
        for pdf in frames:
            yield _results([_verdict(doc, text, refs.get(lang)) for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"])])

    if small is None:
        return docs.mapInPandas(run, RESULT)
    large = F.col("lang").isin(names)
    return docs.where(large).mapInPandas(run, RESULT).unionByName(_judged_small(docs.where(~large), small))
