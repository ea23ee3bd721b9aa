"""Benchmark decontamination by a broadcast hash set of test windows.  [native]

Texts are lower-cased in A-Z only and cut into words (``WORD``). Every benchmark item gives its
windows of ``window`` consecutive words; an item of fewer words, but not none, is one window.
The windows go into a set keyed by two independently seeded 64-bit hashes of their words (128
bits in all, so a hit is verified on the whole window, not on a short fingerprint) and their
length. That set is broadcast once its size is checked, beyond the limit it is joined by a
shuffle of hashes instead. Words are hashed once, windows hash slices of those numbers. Training
texts are scanned window by window in their own task: each window's hashes probe the set, and
only a header row per document and its hits leave the task, gathered by a unique row id. A document word inside any hit is hit.

Defined cases: a null text has no words; an item with a null text or no words has no windows;
a null ``item_id`` is an item of its own, written as the empty string in ``items``; repeated
rows and repeated items each count as what they are, rows alike in id and text get equal
results; a text of any length is read whole; an empty table gives an empty result; columns of
``docs`` other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.runtime import small

# Fixed values of the contract: words and the letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Words in a window.
WINDOW = 10
#: A second seed for the check hash of a window.
CHECK_SEED = "decontamination check"


def words(text: Column | str = "text") -> Column:
    """The words of a text after A-Z is lower-cased; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def _word_hashes(w: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of every word: 128 bits a word."""
    return F.transform(w, lambda x: F.xxhash64(x)), F.transform(w, lambda x: F.xxhash64(F.lit(CHECK_SEED), x))


def _probe(length: int):
    """The probe of the window of ``length`` words at a start (a one-argument lambda: ``transform``
    would hand a second argument the element's index)."""

    def at(p: Column) -> Column:
        return F.struct(p.alias("start"), F.lit(length).alias("length"),
                        F.xxhash64(F.slice("wh1", p, F.lit(length))).alias("h1"),
                        F.xxhash64(F.slice("wh2", p, F.lit(length))).alias("h2"))

    return at


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, length, h1, h2``: one row per distinct window of each item."""
    w = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    w = w.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    wh1, wh2 = _word_hashes(F.col("w"))
    at = w.select("item", "length", wh1.alias("wh1"), wh2.alias("wh2"),
                  F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("p"))
    return at.select("item", "length", F.xxhash64(F.slice("wh1", "p", "length")).alias("h1"),
                     F.xxhash64(F.slice("wh2", "p", "length")).alias("h2")).distinct()


def _probed(docs: DataFrame, bench: DataFrame, window: int, keep: list[Column], header: bool) -> DataFrame:
    """The windows of every text of ``docs`` that are windows of ``bench``'s items: ``keep``
    columns and ``start, length, item``, probed against the broadcast set of those windows.
    With ``header`` every row gives one more row with start 0 and a null item, whatever its
    words; all else stays in the scan task."""
    table = windows(bench, window)
    lengths = sorted(r.length for r in table.select("length").distinct().collect())  # at most ``window`` numbers
    rows = docs.select(*keep, words("text").alias("w"))
    wh1, wh2 = _word_hashes(F.col("w"))
    rows = rows.select(*[c for c in rows.columns if c != "w"], F.size("w").alias("__n"), wh1.alias("wh1"), wh2.alias("wh2"))
    n = F.col("__n")
    probes = [F.when(n >= length, F.transform(F.sequence(F.lit(1), n - length + 1), _probe(length)))
              .otherwise(F.array().cast("array<struct<start:int,length:int,h1:bigint,h2:bigint>>")) for length in lengths]
    if header:
        probes.append(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"),
                                       F.lit(None).cast("bigint").alias("h1"), F.lit(None).cast("bigint").alias("h2"))))
    probe = F.flatten(F.array(*probes)) if probes else F.array().cast("array<struct<start:int,length:int,h1:bigint,h2:bigint>>")
    scanned = rows.select(*[c for c in rows.columns if c not in ("wh1", "wh2")], F.explode(probe).alias("x"))
    scanned = scanned.select(*[c for c in scanned.columns if c != "x"], "x.*")
    # The set of windows is small by nature (test sets); its size is checked before broadcasting.
    found = scanned.join(small(table, width=6), ["length", "h1", "h2"], "left" if header else "inner")
    return found.where((F.col("start") == 0) | F.col("item").isNotNull()) if header else found


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    ``n_hit`` counts the words inside any hit window, ``n_items`` the items with a window in the
    text, ``items_sha256`` is the SHA-256 of those item ids, sorted as strings and joined by
    commas (of the empty string where there are none).

    One pass: a row gets a unique id in its scan task, its windows probe the broadcast set, and
    its header and its hits (bounded by its own words) are gathered by one aggregate on that id.
    """
    keep = [F.monotonically_increasing_id().alias("__rid"), F.col("doc_id").alias("__doc")]
    probed = _probed(docs, bench, window, keep, header=True)
    hit = F.when(F.col("item").isNotNull(), F.struct("start", "length", "item"))
    per_row = probed.groupBy("__rid").agg(F.first("__doc").alias("doc_id"), F.max("__n").alias("n_words"),
                                          F.collect_list(hit).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return per_row.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with no hit window, all their columns as they were.

    Texts with a hit are known by two hashes of the whole text; that set is broadcast if its
    size allows, else joined by a shuffle of hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    bad = _probed(docs, bench, window, keys, header=False).select("k1", "k2").distinct()
    bad = small(bad, width=2)
    k1, k2 = "__decontam_k1", "__decontam_k2"
    while k1 in docs.columns or k2 in docs.columns:
        k1, k2 = "_" + k1, "_" + k2
    marked = docs.withColumns({k1: keys[0], k2: keys[1]})
    return marked.join(bad, (marked[k1] == bad["k1"]) & (marked[k2] == bad["k2"]), "left_anti").drop(k1, k2)
