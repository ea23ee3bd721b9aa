"""SimHash near-deduplication by hashing the ball round every fingerprint.

Two fingerprints within ``2 * r`` bits have a value in common that is within ``r`` bits of both.
So every distinct fingerprint emits all values within ``r`` bits, and rows that meet on a value
are candidates. At most as many fingerprints as a ball has values can meet on one, so there are
no hot groups, whatever copies there are: copies share one fingerprint and are counted before.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged, text_or_empty, whole_rows
from cohortlens.llm.components import components

BITS, SEED = 64, 42


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The SimHash of one text as a signed 64-bit number.

    Words are runs of non-white-space, A-Z lower-cased. Each shingle of ``shingle`` words (a
    shorter text: all of it) votes with the bits of its XXH64; a bit is set if over half the
    shingles have it. No words: 0.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII only, both of them
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for any length
        step = slice(at, at + (1 << 16))
        raw = b"".join([digest(body[s:e], SEED) for s, e in zip(starts[step], ends[step])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprint(text: str = "text", shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return of(F.col(text))


def ball(radius: int) -> list[int]:
    """Masks with at most ``radius`` bits set, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``a, b`` of the distinct fingerprints ``fp`` that hold together all that differ in at
    most ``max_bits`` bits (an even number).

    All that meet on a value are within ``max_bits`` of each other, so a chain of neighbours in
    sorted order stands for all their pairs. Every pair's bits are counted before it is returned.
    """
    if max_bits % 2 or max_bits < 2:
        raise ValueError("max_bits must be even, so that half of it is the radius of a ball")
    masks = F.array(*[F.lit(m) for m in ball(max_bits // 2)])
    near = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    pairs = near.select(before.alias("a"), F.col("fp").alias("b")).where("a IS NOT NULL").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Each row's ``doc_id, body, fp``, and each fingerprint's ``fp, first``: the first row of its
    group as a struct of whether the id is null, the id, and a hash of the text."""
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("body"), fingerprint("text", shingle).alias("fp"))
    rows = staged(rows, "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    prints = staged(rows.groupBy("fp").agg(F.min(order).alias("first")), "prints")
    roots = components(links(prints.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    known = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    known = staged(known, "rooted")
    firsts = known.groupBy("root").agg(F.min("first").alias("first"))
    return rows, staged(known.drop("first").join(firsts.hint("merge"), "root").select("fp", "first"), "firsts")


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    The component is the smallest id reachable over links of at most ``max_bits`` bits. Null and
    empty texts have fingerprint zero and link like any other. A null id is never a component
    unless all ids in it are null. Repeated rows appear each; other columns are ignored; an empty
    table gives an empty one.
    """
    rows, firsts = _grouped(docs, shingle, max_bits)
    found = rows.join(firsts.hint("merge"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (rows that
    share it: the smallest hash)."""
    _, firsts = _grouped(docs, shingle, max_bits)
    stay = firsts.select("first.doc_id", "first.body").distinct()
    return whole_rows(docs, {"doc_id": F.col("doc_id"), "body": F.xxhash64(text_or_empty())}, stay)
