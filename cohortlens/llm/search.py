"""Ranked lexical search over a k²-treap of impacts.

The grid has a row per term and a column per document; a cell holds the document's factor of the
term's impact, ``(10^9 * tf) div (1000 * tf + 12 * m)``; the term's weight ``w`` is the same in its
whole row and is put in when the row is asked for. The treap keeps, for every height ``h`` from
``LOWEST`` on, each term row cut into ranges of ``fanout**h`` documents, and a cell stores the
largest factor in its range; only cells that hold anything exist (the compressed tree). Postings are
height 0; the cells between, nearly as many as postings, are made for the rows that are asked for.
A query item names term rows with their repeats; its row paths are descended together, best-first,
level by level over document ranges: a range's upper bound is the sum over the item's terms of
repeats times weight times the cell maximum, its lower bound the largest single such product (the
document holding that maximum scores at least that). The bound to beat is the 20th best lower bound
among ranges that are sure to hold different documents, or the 20th best score of the documents in
a few ranges of high upper bounds, which are opened first; ranges whose upper bound falls below it
are dropped, the others are opened. At height 0 a range is one document and the bound is its exact
score.

Scale: documents get a row id, and their terms are counted, in their scan task, which writes the
postings (term, document, tf) without a shuffle. Only the asked terms' ``df`` are counted, from
their postings. Every level of cells is one ``groupBy``. The search joins candidate ranges to cells
by (term, parent range), so no task sees more than ``fanout**2`` cells of a term and range. Lower
bounds are kept per item and hash group (``GROUPS`` numbers an item), never sorted as a whole.

Defined cases: a null text has no terms and is no document of ``N``; an item without terms gets
no rows; repeated rows are documents each (equal rows get equal scores; of equal scores the
smaller ``doc_id`` ranks first, a null id last); texts are read whole at any length; empty
tables give an empty result; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.decontam import LOWER, UPPER
from cohortlens.runtime import shared_dir, small

# Fixed values of the contract: terms and the scoring constants.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TF_SCALE = 1_000_000_000
TF_NORM = 1000
LENGTH_WEIGHT = 12
M_BASE = 100 - 25
M_SLOPE = 25

#: Documents in a range are ``FANOUT ** h`` at height ``h``.
FANOUT = 16
#: Results per item.
TOP = 20
#: Hash groups of ranges whose best lower bounds give the bound to beat.
GROUPS = 64
#: Height from which on cells are stored.
LOWEST = 2
#: Ranges of an item whose documents are scored before the others, for a bound to beat.
SEEDS = 8
#: Postings that a task puts together at once.
PIECE = 100_000


def _stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the folder's path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _drop(spark, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def terms(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


#: Bytes of UTF-8 with A-Z lower-cased and every byte that is in no term as a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _split(text: bytes | None) -> list[bytes]:
    """As :func:`terms`, in UTF-8."""
    return (text or b"").translate(_TERM_BYTES).split()


@dataclass
class Index:
    """``cells[h]``: ``term, block, top`` (``doc_id`` too at height 0, where ``block`` is the
    document's place); ``height``: the height of the single range that holds every document."""

    cells: dict[int, DataFrame]
    height: int
    fanout: int
    n_docs: int
    paths: list[str]

    def drop_upper(self) -> None:
        """Delete the written cells (a search that is done with them)."""
        _drop(self.cells[0].sparkSession, *self.paths)


def postings(docs: DataFrame) -> tuple[DataFrame, int, int, str]:
    """``(postings, N, L, path)``: ``place, doc_id, n, term, tf`` of every document with a term,
    written at ``path``."""
    kind = docs.schema["doc_id"].dataType
    fields = [("rid", T.LongType()), ("doc_id", kind), ("n", T.LongType()), ("term", T.StringType()), ("tf", T.LongType()), ("head", T.BooleanType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, lengths, words, counts = [], [], [], [], []

            def piece(batch=batch):
                of = pa.array([i for i, n in zip(rows, sizes) for _ in range(n)], pa.int64())
                long = pa.array([x for x, n in zip(lengths, sizes) for _ in range(n)], pa.int64())
                head = pa.array([j == 0 for n in sizes for j in range(n)], pa.bool_())
                term = pa.array(words, pa.binary()).view(pa.string())
                columns = [batch.column("rid").take(of), batch.column("doc_id").take(of), long, term, pa.array(counts, pa.int64()), head]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                found = _split(text.as_py())
                if not found:
                    continue
                tf = Counter(found)
                rows.append(i)
                sizes.append(len(tf))
                lengths.append(len(found))
                words += tf
                counts += tf.values()
                if len(words) >= PIECE:
                    yield piece()
                    rows, sizes, lengths, words, counts = [], [], [], [], []
            if words:
                yield piece()

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    post, path = _stage(numbered.mapInArrow(run, schema), "search-postings")
    # Places: the task's number above the bits of its largest row number, so ranges stay dense.
    span = post.agg(F.count_if("head").alias("N"), F.sum("tf").alias("L"),
                    F.max(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))).alias("top")).first()
    bits = int(span.top or 0).bit_length()
    place = F.shiftleft(F.shiftright("rid", 33), bits).bitwiseOR(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)))
    return post.select(place.alias("place"), "doc_id", "n", "term", "tf"), int(span.N or 0), int(span.L or 0), path


def build(docs: DataFrame, fanout: int = FANOUT) -> Index:
    post, n_docs, n_terms, path = postings(docs)
    m = f"({M_BASE} + ({M_SLOPE} * n * {n_docs}) div {max(n_terms, 1)})"
    factor = F.expr(f"({TF_SCALE} * tf) div ({TF_NORM} * tf + {LENGTH_WEIGHT} * {m})")
    base = post.select("term", F.col("place").alias("block"), "doc_id", factor.alias("top"))
    paths = [path]
    top = base.agg(F.max("block")).first()[0]
    height = 0
    while top is not None and top // fanout**height > 0:  # the single range at ``height`` holds every place
        height += 1
    cells, below = {0: base}, 0
    for h in range(LOWEST, height):
        wide = F.expr(f"block div {fanout ** (h - below)}").alias("block")
        cells[h], path = _stage(cells[below].groupBy("term", wide).agg(F.max("top").alias("top")), "search-cells")
        paths.append(path)
        below = h
    return Index(cells, height, fanout, n_docs, paths)


def search(index: Index, items: DataFrame, top: int = TOP, groups: int = GROUPS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item (score above 0)."""
    asked = items.select("item_id", F.explode(terms("text")).alias("term")).groupBy("item_id", "term").agg(
        F.count("*").cast("long").alias("mult"))
    asked = small(asked, width=4)
    names = small(asked.select("term").distinct(), width=2)
    # the rows asked for: their postings are read again and again
    opened = index.cells[0].join(names, "term", "left_semi").select("term", F.col("block").alias("place"), "doc_id", "top")
    opened, _ = _stage(opened, "search-opened")
    weight = F.expr(f"CAST(floor(1000.0D * ln((2.0D * {index.n_docs} + 2.0D) / (2.0D * df + 1.0D))) AS BIGINT)")
    weighted = asked.join(opened.groupBy("term").agg(F.count("*").alias("df")), "term")
    asked = small(weighted.select("item_id", "term", (F.col("mult") * weight).alias("weight")).where("weight > 0"), width=4)
    worth = F.col("weight") * F.col("top")

    def beaten(lower: DataFrame, name: str) -> DataFrame:
        """Per item the ``top``-th largest ``lower``, 0 if there are fewer; a few an item."""
        lists = lower.groupBy("item_id").agg(F.sort_array(F.collect_list("lower"), asc=False).alias("l"))
        return small(lists.select("item_id", F.when(F.size("l") >= top, F.element_at("l", top)).otherwise(F.lit(0)).alias(name)), width=2)

    def scores(ranges: DataFrame, width: int, *keep: str) -> DataFrame:
        """``score`` of every document in the ``ranges`` (``item_id, block``) of ``width`` places."""
        cells = opened.withColumn("block", F.expr(f"place div {width}"))
        found = ranges.join(asked, "item_id").join(cells, ["term", "block"])
        return found.groupBy("item_id", "place", "doc_id", *keep).agg(F.sum(worth).alias("score"))

    cand_path = None
    cand = asked.select("item_id").distinct().select("item_id", F.lit(0).cast("long").alias("block"),
                                                    F.lit(0).cast("long").alias("bound"))
    for h in range(index.height - 1, 0, -1):
        if h in index.cells:
            cells = index.cells[h].join(names, "term", "left_semi")
        else:
            cells = opened.groupBy("term", F.expr(f"place div {index.fanout ** h}").alias("block")).agg(F.max("top").alias("top"))
        cells = cells.select("term", F.col("block").alias("child"), F.expr(f"block div {index.fanout}").alias("block"), "top")
        probe = cand.join(asked, "item_id").join(cells, ["term", "block"])
        ranges = probe.groupBy("item_id", "child", "bound").agg(F.sum(worth).alias("upper"), F.max(worth).alias("lower"))
        ranges, ranges_path = _stage(ranges, "search-ranges")
        best = ranges.groupBy("item_id", F.pmod(F.xxhash64("child"), F.lit(groups)).alias("g")).agg(F.max("lower").alias("lower"))
        kept = ranges.join(beaten(best, "beat"), "item_id").withColumn("bound", F.greatest("bound", "beat"))
        if h == min(LOWEST, index.height - 1):
            # the best range of each of a few hash groups is opened at once: scores of documents are a better bound
            first = ranges.groupBy("item_id", F.pmod(F.xxhash64("child"), F.lit(SEEDS)).alias("g")).agg(F.max_by("child", "upper").alias("block"))
            seen = scores(first.select("item_id", "block"), index.fanout**h).select("item_id", F.col("score").alias("lower"))
            kept = kept.join(beaten(seen, "known"), "item_id", "left").withColumn("bound", F.greatest("bound", "known"))
        kept = kept.where((F.col("upper") >= F.col("bound")) & (F.col("upper") > 0))
        cand_before = cand_path
        cand, cand_path = _stage(kept.select("item_id", F.col("child").alias("block"), "bound"), "search-candidates")
        _drop(items.sparkSession, ranges_path, *([cand_before] if cand_before else []))
    scored = scores(cand, index.fanout if index.height else 1, "bound")
    scored = scored.where((F.col("score") > 0) & (F.col("score") >= F.col("bound")))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    salted = scored.withColumn("r", F.row_number().over(Window.partitionBy("item_id", F.pmod("place", F.lit(groups))).orderBy(*order)))
    ranked = salted.where(F.col("r") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", F.col("score").cast("long").alias("score"))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Every item of ``items`` (``item_id, text``) against all of ``docs`` (``doc_id, text``)."""
    index = build(docs)
    found = search(index, items, top)
    index.drop_upper()  # the result reads the last candidates and the postings asked for only
    return found
