"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bpe, decontam, exact, merkle, search, html_main, mixing, ring, rules, simhash, suffixes, toxicity, weak_quality
from cohortlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_hash_ring_shards")
def hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(read(spark, sf_dir, "documents"))


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_report(read(spark, sf_dir, "documents"))


@query("op8_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), bpe.public_ranks())


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op2_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_sparse_suffix_repeats")
def sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


@query("op3_divergence_rules")
def divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"))


@query("op6_raked_mixture")
def raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


@query("op1_weak_label_quality")
def weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.scored(read(spark, sf_dir, "documents"))


@query("op4_tree_main_text")
def tree_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(read(spark, sf_dir, "pages"))


@query("op13_broadcast_decontamination", r"""
WITH bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, w[p : p + least(len(w), 10) - 1] AS win
  FROM bw, LATERAL generate_series(1, len(w) - least(len(w), 10) + 1) AS g(p)
  WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hit AS (
  SELECT DISTINCT dw.rid, s.p, lens.l, win.item
  FROM dw CROSS JOIN lens, LATERAL generate_series(1, len(dw.w) - lens.l + 1) AS s(p)
  JOIN win ON win.l = lens.l AND win.win = dw.w[s.p : s.p + lens.l - 1]),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hit, LATERAL generate_series(p, p + l - 1) AS c(q) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items,
               array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM hit GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
""")
def broadcast_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_merkle_manifest")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(read(spark, sf_dir, "documents"))


@query("op12_treap_ranked_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
dd AS (SELECT * FROM d WHERE len(t) > 0),
stats AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM dd),
post AS (SELECT rid, doc_id, CAST(len(t) AS BIGINT) AS n, term, count(*) AS tf
         FROM dd, unnest(t) AS u(term) GROUP BY rid, doc_id, len(t), term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
imp AS (
  SELECT p.rid, p.doc_id, p.term,
         CAST(floor(1000.0 * ln((2.0 * s.n_docs + 2.0) / (2.0 * df.df + 1.0))) AS BIGINT)
         * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms))) AS impact
  FROM post p JOIN df USING (term) CROSS JOIN stats s),
q AS (
  SELECT item_id, term, count(*) AS mult
  FROM benchmark, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term)
  GROUP BY item_id, term),
sc AS (SELECT q.item_id, imp.rid, imp.doc_id, sum(q.mult * imp.impact) AS score
       FROM q JOIN imp USING (term) GROUP BY q.item_id, imp.rid, imp.doc_id),
rk AS (SELECT item_id, doc_id, score,
              row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
       FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM rk WHERE rank <= 20
""")
def treap_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
