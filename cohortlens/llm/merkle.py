"""A Merkle manifest of a corpus, with a proof for every document found by pointer jumping.

Every row is a leaf: ``H`` of its fields (lowercase hex SHA-256 of the concatenation, a field
written ``-`` if null, else its UTF-8 byte count, ``:`` and its value). Per source the leaves
ascend by ``doc_id`` (null first, then by leaf); while a tree has several nodes, every ``fanout``
consecutive ones (the last run fewer, even one) become the ``H`` of their digests. The top of a
source's tree (a lone leaf itself) is its subroot. Subroots, ordered by source (null first,
UTF-8 bytewise), make the top tree in the same way; its top is the root.

A level is one ``groupBy`` of runs, so no task holds more than ``fanout`` nodes, whatever a
source's size; leaves are ranked inside a source by range partitions, so a source with a third
of the rows is split. The proof of a node is the list of its sibling entries ``(left, right)``
level by level up to the root. Pointer jumping finds them: every inner node holds its entry and
a pointer to its parent; each round joins the table with itself, so a node takes its ancestor's
segment and pointer, the distance doubles, and after ``log2(height)`` rounds every node reaches
the root. Leaves take the last jump from their run, so the jumping table has one row per run,
not per document. An ancestor side is broadcast when its counted size allows it (it shrinks
sixteen-fold with every level, while the rows that point to one ancestor grow as fast); else it
is joined by a shuffle. Every round is written to the shared folder.

Defined cases: null fields are written ``-``; repeated rows are leaves each (rows alike in all
five fields get equal results whatever their order); texts are hashed whole at any length; an
empty table has no leaves and no root; other columns may be carried and never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.runtime import distributed_rank

#: Nodes that become one node of the next level.
FANOUT = 16
#: Bytes of an ancestor side that may be broadcast in a jumping round.
BROADCAST_BYTES = 32 << 20

ENTRY = "struct<left:string,right:string,hash:boolean>"
KEY = ["tree", "src", "level", "idx"]
ANC = ["atree", "asrc", "alevel", "aidx"]


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def proof_sha256(path: Column) -> Column:
    """``H`` of the siblings along ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda acc, e: F.when(e["hash"], F.sha2(F.concat(e["left"], acc, e["right"]), 256)).otherwise(acc))


@dataclass
class Manifest:
    """``rows``: per document the carried columns and ``doc_id, source, leaf, subroot, path``;
    ``root``: the digest of the whole corpus (None for an empty one)."""

    rows: DataFrame
    root: str | None


def _entry(left: Column, right: Column, hashed: bool) -> Column:
    return F.struct(left.alias("left"), right.alias("right"), F.lit(hashed).alias("hash"))


def _levels(nodes: DataFrame, payload: list[str], fanout: int, leaves: bool = True):
    """Runs of ``nodes`` (``tree, src, level, idx, digest`` and ``payload``) level by level.

    Returns ``(runs0, lone, records)``: the runs of the first level (not lone), the tops of all
    trees (``tree, src, level, digest`` and, at level 0, the payload), and the jumping records
    of the nodes above the first level (of all levels where ``nodes`` are not leaves).
    """
    records, tops, runs0, level = [], [], None, 0
    cur = nodes
    while True:
        kid = F.struct("idx", "digest", *payload)
        runs = cur.groupBy("tree", "src", "level", F.floor(F.col("idx") / fanout).alias("pidx")).agg(
            F.sort_array(F.collect_list(kid)).alias("kids"))
        runs = staged(runs, "merkle-runs")
        alone = (F.col("pidx") == 0) & (F.size("kids") == 1)
        top = runs.where(alone).select("tree", "src", "level", F.col("kids")[0].alias("k"))
        tops.append(top.select("tree", "src", "level", "k.digest", *[F.col(f"k.{p}").alias(p) for p in payload]))
        runs = runs.where(~alone)
        if level == 0 and leaves:
            runs0 = runs
        else:
            records.append(_run_entries(runs))
        parents = runs.select("tree", "src", (F.col("level") + 1).alias("level"), F.col("pidx").alias("idx"),
                              F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"),
                              *[F.lit(None).cast(nodes.schema[p].dataType).alias(p) for p in payload])
        cur = staged(parents, "merkle-level")
        level += 1
        if cur.limit(1).count() == 0:
            return runs0, tops, records


def _run_entries(runs: DataFrame) -> DataFrame:
    """Jumping records of the members of ``runs``: the entry of each and its parent."""
    at = runs.select("*", F.posexplode("kids").alias("i", "k"))
    left = F.array_join(F.transform(F.slice("kids", 1, F.col("i")), lambda k: k["digest"]), "")
    right = F.array_join(F.transform(F.slice("kids", F.col("i") + 2, F.size("kids")), lambda k: k["digest"]), "")
    return at.select("tree", "src", "level", F.col("k.idx").alias("idx"),
                     F.col("tree").alias("atree"), F.col("src").alias("asrc"), (F.col("level") + 1).alias("alevel"),
                     F.col("pidx").alias("aidx"), F.array(_entry(left, right, True)).alias("path"),
                     F.lit(None).cast("string").alias("sub"))


def _jump(records: DataFrame) -> DataFrame:
    """Pointer jumping until every record points nowhere: its path then reaches the root."""
    rnd = 0
    while records.where(F.col("atree").isNotNull()).limit(1).count():
        reach = 1 + (1 << rnd)  # the lowest level that a record of the first tree can point to now
        right = records.where((F.col("tree") == 1) | (F.col("level") >= reach)).select(
            *[F.col(k).alias(f"t_{k}") for k in KEY], *[F.col(a).alias(f"n_{a}") for a in ANC],
            F.col("path").alias("t_path"), F.col("sub").alias("t_sub"))
        count, widest = right.agg(F.count("*"), F.max(F.size("t_path"))).first()
        if count * (64 + 2 * FANOUT * 64 * (widest or 0)) <= BROADCAST_BYTES:
            right = F.broadcast(right)
        on = ((records["atree"] == right["t_tree"]) & records["asrc"].eqNullSafe(right["t_src"])
              & (records["alevel"] == right["t_level"]) & (records["aidx"] == right["t_idx"]))
        joined = records.join(right, on, "left")
        records = staged(joined.select(
            *KEY, *[F.col(f"n_{a}").alias(a) for a in ANC],
            F.concat("path", F.coalesce("t_path", F.array().cast(f"array<{ENTRY}>"))).alias("path"),
            F.coalesce("sub", "t_sub").alias("sub")), "merkle-jump")
        rnd += 1
    return records


def build(docs: DataFrame, carry: list[str] = (), fanout: int = FANOUT) -> Manifest:
    """The manifest of ``docs`` (``doc_id, source, lang, n_chars, text``), carrying ``carry``.

    Other columns of ``docs`` are left out; a carried column may not take a name of the result.
    """
    clash = set(carry) & {"doc_id", "source", "leaf", "subroot", "path"}
    if clash:
        raise ValueError(f"carried columns may not be named {sorted(clash)}")
    own = {c: f"__m{i}" for i, c in enumerate(carry)}
    leaves = docs.select(
        F.lit(0).alias("tree"), F.col("source").alias("src"), F.lit(0).alias("level"),
        leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")).alias("digest"),
        F.col("doc_id").alias("__doc"), *[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    payload = ["__doc", *own.values()]
    # Ranked per (null flag, source): the ranking joins on its group, where null would not meet null.
    keyed = leaves.withColumns({"__snull": F.col("src").isNull(), "__skey": F.coalesce("src", F.lit(""))})
    ranked = distributed_rank(keyed, ["__snull", "__skey"], ["__doc", "digest"], "idx")
    ranked = ranked.withColumn("idx", F.col("idx") - 1).drop("__snull", "__skey")
    runs0, tops, records = _levels(ranked, payload, fanout)

    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = staged(subroots, "merkle-subroots")
    order = distributed_rank(subroots.select("src", "level", "digest", *payload), [], ["src"], "rank")
    order = staged(order, "merkle-order")
    junction = order.select(F.lit(0).alias("tree"), "src", "level", F.lit(0).cast("long").alias("idx"),
                            F.lit(1).alias("atree"), F.lit(None).cast("string").alias("asrc"), F.lit(0).alias("alevel"),
                            (F.col("rank") - 1).alias("aidx"), F.array(_entry(F.lit(""), F.lit(""), False)).alias("path"),
                            F.col("digest").alias("sub"))
    top_nodes = order.select(F.lit(1).alias("tree"), F.lit(None).cast("string").alias("src"), F.lit(0).alias("level"),
                             (F.col("rank") - 1).alias("idx"), "digest",
                             *[F.lit(None).cast(ranked.schema[p].dataType).alias(p) for p in payload])
    _, top_tops, top_records = _levels(top_nodes, payload, fanout, leaves=False)
    roots = [r.digest for t in top_tops for r in t.select("digest").collect()]  # one row, or none for an empty table
    root = roots[0] if roots else None
    root_rec = top_tops[-1].select(F.lit(1).alias("tree"), "src", "level", F.lit(0).cast("long").alias("idx"),
                                   *[F.lit(None).cast(t).alias(a) for a, t in zip(ANC, ["int", "string", "int", "long"])],
                                   F.array().cast(f"array<{ENTRY}>").alias("path"), F.lit(None).cast("string").alias("sub"))
    table = junction.unionByName(root_rec)
    for part in records + top_records:
        table = table.unionByName(part)
    paths = _jump(staged(table, "merkle-records"))

    # Leaves in runs take their entry and then their parent's path; a lone leaf is its own subroot.
    at = runs0.select("src", "pidx", "kids", F.posexplode("kids").alias("i", "k"))
    left = F.array_join(F.transform(F.slice("kids", 1, F.col("i")), lambda k: k["digest"]), "")
    right = F.array_join(F.transform(F.slice("kids", F.col("i") + 2, F.size("kids")), lambda k: k["digest"]), "")
    members = at.select("src", "pidx", "k", _entry(left, right, True).alias("entry"))
    parents = paths.where((F.col("tree") == 0) & (F.col("level") == 1)).select(
        F.col("src").alias("p_src"), F.col("idx").alias("p_idx"), F.col("path").alias("p_path"), F.col("sub").alias("p_sub"))
    in_runs = members.join(parents, members["src"].eqNullSafe(parents["p_src"]) & (members["pidx"] == parents["p_idx"]))
    in_runs = in_runs.select("src", "k.*", F.concat(F.array("entry"), "p_path").alias("path"), F.col("p_sub").alias("subroot"))
    lone = paths.where((F.col("tree") == 0) & (F.col("level") == 0)).select(
        F.col("src").alias("l_src"), F.col("path").alias("l_path"), F.col("sub").alias("l_sub"))
    single = order.where(F.col("level") == 0).join(lone, order["src"].eqNullSafe(lone["l_src"]))
    single = single.select("src", F.lit(0).cast("long").alias("idx"), "digest", *payload,
                           F.col("l_path").alias("path"), F.col("l_sub").alias("subroot"))
    rows = in_runs.unionByName(single)
    rows = rows.select(*[F.col(o).alias(c) for c, o in own.items()], F.col("__doc").alias("doc_id"), F.col("src").alias("source"),
                       F.col("digest").alias("leaf"), "subroot", "path")
    return Manifest(rows, root)


def tamper_check(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Rows where 5 divides the unsigned CRC-32 of the decimal ``doc_id`` are tampered with: A-Z of
    their text is lower-cased (a null text or id stays as it is). ``folded_root`` folds the leaf
    of the row as it is now with the siblings of the manifest, ``verified`` says whether that
    gives the root. Everything else is of the untampered rows.
    """
    from cohortlens.llm.decontam import LOWER, UPPER
    from cohortlens.llm.common import free_name

    now = free_name(docs, "now_leaf")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    marked = docs.withColumn(now, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    made = build(marked, carry=[now])
    root = F.lit(made.root).cast("string")
    folded = fold(F.col(now), F.col("path"))
    return made.rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof_sha256(F.col("path")).alias("proof_sha256"),
                            folded.alias("folded_root"), (folded == root).alias("verified"))
