"""Exact density hierarchy: spanning tree, Kruskal tree, condensed tree, excess of mass.

The classical method sorts the edges of the minimum spanning tree of mutual reachability and
merges them one after another. Here every step is a Spark job over all rows:

* *Spanning tree* by Borůvka rounds: every component takes its shortest edge to another
  (one order of all edges: weight, then the smaller and the larger id, so ties never close a
  cycle), components merge, at most ``log2(n)`` rounds.
* *Kruskal tree* (the single-linkage dendrogram) by halving the edges by rank: the lighter half
  of a block forms components; the heaviest edge of such a component gets as parent the lightest
  edge of the heavier half that touches it; the heavier half goes on with those components
  contracted into single weighted nodes. All blocks of a level are one components job, so
  ``log2(edges)`` levels give every edge its parent and its cluster size.
* *Condensed tree*: a node of the Kruskal tree starts a cluster where it and its sibling both
  hold at least ``min_cluster_size`` points; every node finds the cluster it lies in by
  pointer jumping. Stabilities are sums of ``points * lambda`` per cluster.
* *Excess of mass* from the leaves of the condensed tree up, one level of clusters at a time,
  and labels from the top down; the root cluster is not chosen.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.runtime import cut, distributed_rank

#: lambda = 1 / distance; a distance of zero gives this instead of infinity.
LAMBDA_OF_ZERO = 1e12


def spanning_tree(points: DataFrame, core: DataFrame, **how) -> DataFrame:
    """``src, dst, weight`` (src < dst): the minimum spanning tree of mutual reachability of
    ``points`` (``id, features``) with ``core`` (``id, core``), by Borůvka rounds."""
    from cohortlens.clustering.density import closest_outside, components

    marked = cut(points.join(core, "id"))
    comp = marked.select("id", F.col("id").alias("comp"))
    tree = None
    while marked.limit(2).count() == 2:  # rows without a core distance take no part
        state = cut(marked.join(comp, "id"))
        step = cut(closest_outside(state, pair_order=True, **how))
        if step.limit(1).count() == 0:
            break
        fresh = step.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()
        tree = fresh if tree is None else tree.unionByName(fresh)
        level = lambda df: df.withColumn("level", F.lit(0))
        merged = components(level(step.select(F.col("comp").alias("src"), F.col("other").alias("dst"))),
                            level(state.select(F.col("comp").alias("id")).distinct()))
        comp = state.select("id", F.col("comp").alias("c")).join(merged.select(F.col("id").alias("c"), F.col("comp")), "c").select("id", "comp")
    if tree is None:
        return points.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")).limit(0)
    return cut(tree)


def kruskal_tree(tree: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merges, leaves)`` of the single-linkage dendrogram of the forest ``tree``.

    ``merges``: ``rank, src, dst, weight, size, parent`` — one row per edge, in the order
    (weight, src, dst); ``size`` counts the points that the edge joins, ``parent`` is the rank
    of the next merge of that cluster (null at a top). ``leaves``: ``id, parent`` for every row
    of ``nodes`` (``id``), null where the row has no edge.
    """
    from cohortlens.clustering.density import components

    ranked = distributed_rank(tree.withColumn("g", F.lit(0)), ["g"], ["weight", "src", "dst"]).drop("g")
    ranked = cut(ranked.withColumn("rank", F.col("rank") - 1))
    m = ranked.count()
    k = max(1, ceil(log2(max(m, 2))))
    # state: every edge with its block's labels of its ends; weights of the labels per block
    edges = ranked.select("rank", F.col("src").alias("a"), F.col("dst").alias("b"))
    weights = nodes.select(F.lit(0).cast("long").alias("s"), F.col("id").alias("label"), F.lit(1).cast("long").alias("w"))
    parent = None
    for bit in range(k, 0, -1):
        e = edges.withColumns({"s": F.shiftright("rank", bit), "heavy": F.shiftright("rank", bit - 1).bitwiseAND(F.lit(1)) == 1})
        light = e.where(~F.col("heavy"))
        ends = light.select("s", F.col("a").alias("id")).unionByName(light.select("s", F.col("b").alias("id"))).distinct()
        comp = cut(components(light.select("s", F.col("a").alias("src"), F.col("b").alias("dst")), ends, keys=("s",)))
        # the heaviest light edge of a component is its top; its parent is the lightest heavy edge touching it
        tops = light.join(comp.withColumnRenamed("id", "a"), ["s", "a"]).groupBy("s", "comp").agg(F.max("rank").alias("top"))
        heavy = e.where("heavy")
        touch = heavy.select("s", "rank", F.col("a").alias("id")).unionByName(heavy.select("s", "rank", F.col("b").alias("id")))
        touch = touch.join(comp, ["s", "id"], "left").select("s", F.coalesce("comp", "id").alias("comp"), "rank")
        first = touch.groupBy("s", "comp").agg(F.min("rank").alias("up"))
        found = tops.join(first, ["s", "comp"]).select(F.col("top").alias("rank"), F.col("up").alias("parent"))
        parent = found if parent is None else parent.unionByName(found)
        # the heavy half goes on with light components as weighted nodes, the light half as it is
        to = comp.select("s", F.col("id").alias("label"), "comp")
        grown = weights.join(to, ["s", "label"], "left").select("s", F.coalesce("comp", "label").alias("label"), "w")
        heavy_w = grown.groupBy("s", "label").agg(F.sum("w").alias("w")).select((F.col("s") * 2 + 1).alias("s"), "label", "w")
        light_w = weights.select((F.col("s") * 2).alias("s"), "label", "w")
        moved = heavy.join(to.withColumnRenamed("label", "a").withColumnRenamed("comp", "ca"), ["s", "a"], "left")
        moved = moved.join(to.withColumnRenamed("label", "b").withColumnRenamed("comp", "cb"), ["s", "b"], "left")
        moved = moved.select("rank", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        edges = cut(light.select("rank", "a", "b").unionByName(moved))
        used = edges.select(F.shiftright("rank", bit - 1).alias("s"), "a").unionByName(
            edges.select(F.shiftright("rank", bit - 1).alias("s"), F.col("b").alias("a"))).withColumnRenamed("a", "label").distinct()
        weights = cut(light_w.unionByName(heavy_w).join(used, ["s", "label"], "left_semi"))
        parent = cut(parent)
    # one edge a block: its ends are the two clusters it joins
    wa = weights.select(F.col("s").alias("rank"), F.col("label").alias("a"), F.col("w").alias("wa"))
    wb = weights.select(F.col("s").alias("rank"), F.col("label").alias("b"), F.col("w").alias("wb"))
    sized = edges.join(wa, ["rank", "a"]).join(wb, ["rank", "b"]).select("rank", (F.col("wa") + F.col("wb")).alias("size"))
    merges = ranked.join(sized, "rank").join(parent if parent is not None else sized.select("rank", F.lit(None).cast("long").alias("parent")).limit(0), "rank", "left")
    merges = cut(merges.select("rank", "src", "dst", "weight", "size", "parent"))
    ends = ranked.select(F.col("src").alias("id"), "rank").unionByName(ranked.select(F.col("dst").alias("id"), "rank"))
    leaves = nodes.select("id").join(ends.groupBy("id").agg(F.min("rank").alias("parent")), "id", "left")
    return merges, cut(leaves)


def _lam(weight):
    return F.when(weight > 0, 1.0 / weight).otherwise(F.lit(LAMBDA_OF_ZERO))


def _first_marked(table: DataFrame, node: str, up: str, mark: str) -> DataFrame:
    """``node, found``: the nearest node at or above each one (by ``up``) whose ``mark`` holds."""
    state = table.select(F.col(node).alias("n"), F.when(F.col(mark), F.col(node)).alias("found"),
                         F.when(~F.col(mark), F.col(up)).alias("next"))
    state = cut(state)
    while state.where(F.col("found").isNull() & F.col("next").isNotNull()).limit(1).count():
        ahead = state.select(F.col("n").alias("next"), F.col("found").alias("f2"), F.col("next").alias("n2"))
        state = cut(state.join(ahead, "next", "left").select(
            "n", F.coalesce("found", "f2").alias("found"), F.when(F.col("found").isNull(), F.col("n2")).alias("next")))
    return state.select(F.col("n").alias(node), "found")


def condensed_labels(merges: DataFrame, leaves: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """``(labels, births)``: ``id, cluster`` (-1 for noise) and ``cluster, birth`` (the distance
    below which the chosen cluster stands alone), by excess of mass on the condensed tree."""
    kids = merges.where(F.col("parent").isNotNull()).select(F.col("parent").alias("rank"), F.col("size").alias("s")).unionByName(
        leaves.where(F.col("parent").isNotNull()).select(F.col("parent").alias("rank"), F.lit(1).cast("long").alias("s")))
    pair = kids.groupBy("rank").agg(F.min("s").alias("s1"), F.max("s").alias("s2"))
    big = F.lit(min_cluster_size)
    node = merges.join(pair, "rank").withColumn("split", (F.col("s1") >= big) & (F.col("s2") >= big))
    node = cut(node)
    # a merge starts a cluster where it is a top, or where its parent splits (then its sibling is big too)
    up = node.select(F.col("rank").alias("parent"), F.col("split").alias("parent_split"), F.col("weight").alias("parent_weight"))
    node = cut(node.join(up, "parent", "left").withColumn("starts", F.col("parent").isNull() | F.coalesce("parent_split", F.lit(False))))
    home = _first_marked(node, "rank", "parent", "starts").withColumnRenamed("found", "cluster")
    node = cut(node.join(home, "rank"))
    # points leave a cluster at its merges: the small sides, or all at a split
    small = F.when(F.col("s1") < big, F.col("s1")).otherwise(0) + F.when(F.col("s2") < big, F.col("s2")).otherwise(0)
    leaving = F.when(F.col("split"), F.col("size")).otherwise(small)
    mass = node.groupBy("cluster").agg(F.sum(leaving * _lam(F.col("weight"))).alias("mass"))
    born = node.where("starts").select(F.col("rank").alias("cluster"), "size", F.col("parent").alias("up_rank"),
                                        F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(_lam(F.col("parent_weight"))).alias("birth_lam"),
                                        F.col("parent_weight").alias("birth"))
    clusters = born.join(mass, "cluster", "left").withColumn("stab", F.coalesce("mass", F.lit(0.0)) - F.col("birth_lam") * F.col("size"))
    owner = node.select(F.col("rank").alias("up_rank"), F.col("cluster").alias("up"))
    clusters = cut(clusters.join(owner, "up_rank", "left").select("cluster", "up", "stab", "birth"))
    # depth of every cluster, then excess of mass from the deepest up
    depth = clusters.select("cluster", "up", F.lit(0).alias("depth"))
    ups = clusters.select(F.col("cluster").alias("up"), F.col("up").alias("up2"))
    level = cut(depth.withColumn("hop", F.col("up")))
    while level.where(F.col("hop").isNotNull()).limit(1).count():
        level = cut(level.join(ups.withColumnRenamed("up", "hop"), "hop", "left").select(
            "cluster", "up", (F.col("depth") + F.when(F.col("hop").isNotNull(), 1).otherwise(0)).alias("depth"), F.col("up2").alias("hop")))
    table = cut(clusters.join(level.select("cluster", "depth"), "cluster"))
    deepest = table.agg(F.max("depth")).first()[0]
    best = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = table.where(F.col("depth") == d)
        if best is not None:
            below = best.groupBy(F.col("up").alias("cluster")).agg(F.sum("best").alias("kids"))
            here = here.join(below, "cluster", "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("double"))
        here = here.withColumn("own", (F.col("kids").isNull() | (F.col("stab") >= F.col("kids"))) & F.col("up").isNotNull())
        here = here.withColumn("best", F.when(F.col("own") | F.col("kids").isNull(), F.col("stab")).otherwise(F.col("kids")))
        here = cut(here.select("cluster", "up", "depth", "birth", "own", "best"))
        best = here if best is None else cut(best.unionByName(here))
    if best is None:
        none = leaves.select("id", F.lit(-1).alias("cluster"))
        return none, none.select("cluster", F.lit(0.0).alias("birth")).limit(0)
    # chosen: own choice, and no chosen cluster above
    chosen = None
    for d in range(0, deepest + 1):
        here = best.where(F.col("depth") == d)
        if chosen is None:
            here = here.withColumn("label", F.when(F.col("own"), F.col("cluster")))
        else:
            above = chosen.select(F.col("cluster").alias("up"), F.col("label").alias("above"))
            here = here.join(above, "up", "left").withColumn("label", F.coalesce("above", F.when(F.col("own"), F.col("cluster"))))
        here = cut(here.select("cluster", "up", "depth", "birth", "label"))
        chosen = here if chosen is None else cut(chosen.unionByName(here))
    # a point falls out of the cluster of its first merge
    at = node.select(F.col("rank").alias("parent"), F.col("cluster").alias("c"))
    points = leaves.join(at, "parent", "left").join(chosen.select(F.col("cluster").alias("c"), "label"), "c", "left")
    points = cut(points.select("id", "label"))
    found = points.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("first"))
    named = distributed_rank(found.withColumn("g", F.lit(0)), ["g"], ["first"]).select("label", (F.col("rank") - 1).cast("int").alias("cluster"))
    named = cut(named)
    labels = points.join(named, "label", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    births = named.join(chosen.select(F.col("cluster").alias("label"), "birth"), "label").select("cluster", "birth")
    return labels, births


def exact_hdbscan_fit(df: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, **how):
    """Exact density clusters of ``id, features``: the spanning tree of mutual reachability, its
    Kruskal tree, the condensed tree and the excess-of-mass choice, all on Spark. Returns a
    ``DensityModel`` like ``density.hdbscan_fit``, whose levels it does without."""
    from cohortlens.clustering.density import DensityModel, core_distances

    min_samples = min_samples or min_cluster_size
    points = df.select(F.col("id").cast("bigint").alias("id"), "features")
    core = cut(core_distances(points, min_samples, **how))
    tree = spanning_tree(points, core, **how)
    merges, leaves = kruskal_tree(tree, points.select("id"))
    labels, births = condensed_labels(merges, leaves, min_cluster_size)
    train = points.join(core, "id", "left").join(labels, "id", "left").fillna(-1, ["cluster"])
    return DensityModel(cut(train), cut(births), min_samples)
