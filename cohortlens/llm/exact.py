"""Exact deduplication through a persistent digest index.

The index is a Parquet table of the catalog, bucketed and sorted by the SHA-256 digest of the
text. New rows are reduced to one per digest, compared with the index by a sort-merge anti-join,
and those not found are appended. Texts never take part in a shuffle, only their digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import staged, text_or_empty, whole_rows


def digest(text: str = "text") -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; a null text counts as the empty one."""
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


class DigestIndex:
    """``digest, keep_id`` of every text seen so far, in the table ``name``.

    ``path`` names the table's folder; a later session that passes the same name, path and
    ``buckets`` goes on with the index it finds there.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 48):
        self.spark, self.name, self.buckets = spark, name, buckets
        where = f" LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """``digest, keep_id`` of the texts in ``rows`` (``digest, doc_id``) that the index lacks;
        of equal ones the largest id, null only where all are null."""
        new = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add the unseen texts of ``rows``. What the index has already stays as it is."""
        (self.unseen(rows).select("digest", "keep_id").repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``.

    Rows go into the index from the largest id down, in two batches, so that of equal texts the
    largest id is the one found first. Rows that repeat both id and text count each; one of them
    is kept. A null id ranks lowest. With an ``index`` that holds earlier data, texts known to it
    keep the id it has. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    rows = docs.select("doc_id", digest().alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = staged(rows, "digests")
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = ((span.low or 0) + (span.high or 0)) // 2
    index.append(rows.where(F.col("doc_id") > middle))
    index.append(rows.where(~F.coalesce(F.col("doc_id") > middle, F.lit(False))))

    sizes = rows.groupBy("digest").agg(F.sum("n").alias("group_size"))
    # Written first: read back, both sides of the next join are dealt out afresh, so that the
    # rows of a digest with very many copies can be split over tasks.
    sizes = staged(sizes.join(index.read(), "digest"), "digest-groups")
    member = rows.join(sizes.hint("merge"), "digest")
    copy = member.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copy.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Where several rows share both the id and the text that stay, the one whose columns have the
    smallest hash is taken.
    """
    stay = groups(docs, index).where("kept").select("doc_id", "digest")
    return whole_rows(docs, {"doc_id": F.col("doc_id"), "digest": digest()}, stay)


def duplicate_report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    found = groups(docs, index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
