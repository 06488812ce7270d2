"""Networks as edge tables (src, dst[, weight]) with src <= dst, and node tables (node)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, mirror, running, seeded_order
from weftgraph.operators.components import connected_components
from weftgraph.operators.selection import sample_exact

SWAP_BUCKET = 4096  # edges that are paired in one task, about


def _as(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(_as(nodes, "src"), "src", "left_semi").join(_as(nodes, "dst"), "dst", "left_semi").select(*edges.columns)


def weighted(edges: DataFrame, weights: DataFrame) -> DataFrame:
    return edges.select("src", "dst").join(weights.select("src", "dst", "weight").where("weight is not null"), ["src", "dst"])


def unweighted_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges that have no weight."""
    return edges.select("src", "dst").join(weights.where("weight is not null"), ["src", "dst"], "left_anti")


def list_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of a list of pairs in either order, repeats kept."""
    named = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return named.join(weights.select("src", "dst", "weight"), ["src", "dst"])


def background(weights: DataFrame, edges: DataFrame, literal: bool = False) -> DataFrame:
    """Every defined cell that the network doesn't use; ``literal`` leaves an edge's mirrored cell in."""
    used = edges.select("src", "dst") if literal else mirror(edges.select("src", "dst"))
    return mirror(weights.select("src", "dst", "weight")).where("weight is not null").join(used, ["src", "dst"], "left_anti")


def _ends_in(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = _as(nodes, "src").distinct().withColumn("in_src", F.lit(True))
    b = _as(nodes, "dst").distinct().withColumn("in_dst", F.lit(True))
    return edges.join(a, "src", "left").join(b, "dst", "left").na.fill(False, ["in_src", "in_dst"])


def module_weights(edges: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, dst, weight) of the edges with both ends in the module."""
    return weighted(induced(edges, nodes), weights)


def module_subgraph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges inside the module, all its nodes that the network has with their degree inside; lone ones have 0)."""
    inside = induced(edges, nodes)
    known = nodes.select("node").distinct().join(nodes_of(edges), "node", "left_semi")
    return inside, degree(inside, known)


def outside_module(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those that have both ends in the module."""
    return _ends_in(edges, nodes).where("not (in_src and in_dst)").select(*edges.columns)


def module_non_edges(edges: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of ordered pairs of distinct module nodes that are no edges; starts from the weights, not from all pairs."""
    cells = mirror(weights.select("src", "dst", "weight")).where("src != dst")
    return induced(cells, nodes).join(mirror(edges.select("src", "dst")), ["src", "dst"], "left_anti")


def cross_weights(weights: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Weights of pairs (one of left, one of right), equal pairs left out."""
    cells = mirror(weights.select("src", "dst", "weight")).where("src != dst")
    return cells.join(_as(left, "src").distinct(), "src", "left_semi").join(_as(right, "dst").distinct(), "dst", "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct first neighbours, which may be among the nodes."""
    return mirror(edges.select("src", "dst")).join(_as(nodes, "src").distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def hop_bins(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(node, hop): breadth-first layers 0..hops."""
    seen = checkpointed(nodes.select("node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        last = seen.where(F.col("hop") == hop - 1)
        fresh = neighbours(edges, last).join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = checkpointed(seen.unionByName(fresh))
    return seen


def largest_component(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes of the largest component (of the induced subgraph, lone nodes included); ties: the smallest label."""
    work = edges.select("src", "dst")
    if nodes is not None:
        alone = nodes.join(nodes_of(edges), "node", "left_semi").select(F.col("node").alias("src"), F.col("node").alias("dst"))
        work = induced(work, nodes).unionByName(alone)
    part = checkpointed(connected_components(work))
    best = part.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return part.join(F.broadcast(best), "component").select("node")


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree): lone nodes have 0, a self loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return ends
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def strength(edges: DataFrame) -> DataFrame:
    return mirror(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))


def total_weights(edges: DataFrame, weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, total, degree): weight to all nodes of the weight table, and degree in the network."""
    total = mirror(weights.select("src", "dst", "weight")).groupBy(F.col("src").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("total"))
    return degree(edges, nodes).join(total, "node").select("node", "total", "degree")


def by_degree(totals: DataFrame) -> DataFrame:
    return totals.groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"))


def similarity_to_distance(edges: DataFrame) -> DataFrame:
    """1 + (max - w) / (max - min), in [1, 2]; 1 if all weights are equal."""
    span = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    d = 1 + F.coalesce(F.try_divide(F.col("hi") - F.col("weight"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return edges.crossJoin(F.broadcast(span)).withColumn("weight", d).drop("lo", "hi")


def degree_preserving_shuffle(edges: DataFrame, seed: int, n_swaps: int | None = None, max_tries: int = 10) -> tuple[DataFrame, int]:
    """(edges, swaps): the simple graph after exactly n_swaps double-edge swaps, as many as it has edges if None.

    In a round all edges are paired at random, inside buckets of about SWAP_BUCKET edges that are dealt anew each time. A
    pair u-v, x-y becomes u-y, x-v or u-x, v-y, by a bit of its hash; it stays if that would give a self loop or an edge that
    is there or that another pair of the round proposes. So the swaps of a round can be done in any order. Rounds go on
    until n_swaps are done, the last one doing only what is missing; an error after max_tries * n_swaps proposals. Self
    loops are left out at the start. Degrees don't change."""
    work = checkpointed(edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    m = work.count()
    wanted = m if n_swaps is None else n_swaps
    buckets, done, tried, turn = max(1, m // SWAP_BUCKET), 0, 0, 0
    while done < wanted:
        if tried >= max_tries * wanted or m < 2:
            raise RuntimeError(f"{done} of {wanted} swaps after {tried} tries")
        tag = seeded_order(f"{seed}:{turn}", F.col("src"), F.col("dst"))
        b = F.pmod(F.xxhash64("src", "dst", F.lit(seed * 1000 + turn)), F.lit(buckets))
        w = Window.partitionBy("b").orderBy("tag", "src", "dst")
        numbered = work.withColumns({"tag": tag, "b": b}).withColumn("k", F.row_number().over(w) - 1)
        two = numbered.groupBy("b", F.floor(F.col("k") / 2).alias("pair")).agg(
            F.min(F.struct("k", "src", "dst", "tag")).alias("x"), F.max(F.struct("k", "src", "dst", "tag")).alias("y"), F.count(F.lit(1)).alias("n"))
        across = F.conv(F.substring("x.tag", 1, 1), 16, 10).cast("int") % 2 == 0
        two = checkpointed(two.select(
            F.concat_ws("-", "b", "pair").alias("id"), "n", "x.src", "x.dst", F.col("y.src").alias("src2"), F.col("y.dst").alias("dst2"),
            F.when(across, F.col("y.dst")).otherwise(F.col("y.src")).alias("to"), F.when(across, F.col("y.src")).otherwise(F.col("y.dst")).alias("other")))
        ends = [F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("src", "to"), ("other", "dst"))]
        fit = two.where("n = 2 and src != to and other != dst")
        swap = fit.select("id", F.explode(F.array(*ends)).alias("e")).select("id", "e.*")
        clash = swap.join(work, ["src", "dst"], "left_semi").select("id").unionByName(
            swap.groupBy("src", "dst").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select(F.explode("ids").alias("id")))
        swap = checkpointed(swap.join(clash.distinct(), "id", "left_anti"))
        ids = swap.select("id").distinct()
        count = ids.count()
        if count > wanted - done:
            ids = sample_exact(ids, wanted - done, seed + turn, "id")
            swap, count = swap.join(ids, "id", "left_semi"), wanted - done
        stay = two.join(ids, "id", "left_anti")
        old = stay.select("src", "dst").unionByName(stay.where("n = 2").select(F.col("src2").alias("src"), F.col("dst2").alias("dst")))
        work = checkpointed(old.unionByName(swap.select("src", "dst")))
        done, tried, turn = done + count, tried + m // 2, turn + 1
    return work, done


def _permuted(number, side: int, seed: int):
    """A permutation of the numbers below side * side: six Feistel rounds on (number / side, number % side)."""
    def turn(halves, key):
        x = (halves["r"] * 2654435769 + key) % (1 << 32)
        for _ in range(2):
            x = F.shiftright(x, 16).bitwiseXOR(x) * 73244475 % (1 << 32)
        return F.struct(halves["r"].alias("l"), ((halves["l"] + x) % side).alias("r"))

    keys = F.array(*[F.lit((seed * 6 + i) * 40503).cast("long") for i in range(6)])
    return F.aggregate(keys, F.struct(F.floor(number / side).alias("l"), (number % side).alias("r")), turn, lambda h: h["l"] * side + h["r"])


def uniform_random_graph(edges: DataFrame, seed: int) -> DataFrame:
    """As many distinct random edges between the same nodes, without self loops, every graph of that size alike likely.

    The pairs of nodes are numbered; the first m numbers under a keyed permutation are the edges, so none comes twice and
    nothing is sorted or cut. The permutation is of a square somewhat larger than the number of pairs: what falls outside is
    permuted again until it falls inside. Then numbers become pairs of node numbers, and these nodes."""
    nodes = checkpointed(nodes_of(edges))
    n, m = nodes.count(), edges.select("src", "dst").distinct().count()
    pairs = n * (n - 1) // 2
    if m > pairs:
        raise ValueError("more edges than pairs of nodes")
    side = math.isqrt(max(pairs - 1, 0)) + 1
    inside, left = None, edges.sparkSession.range(m).select(F.col("id").alias("t"))
    while m:
        left = checkpointed(left.select(_permuted(F.col("t"), side, seed).alias("t")))
        now = left.where(F.col("t") < pairs)
        inside, left = now if inside is None else inside.unionByName(now), left.where(F.col("t") >= pairs)
        if left.isEmpty():
            break
    if inside is None:
        return edges.select("src", "dst").limit(0)
    y = F.floor((1 + F.sqrt(1 + 8 * F.col("t").cast("double"))) / 2).cast("long")
    # a double may be one off near the numbers at which y changes
    y = F.when(y * (y - 1) / 2 > F.col("t"), y - 1).when((y + 1) * y / 2 <= F.col("t"), y + 1).otherwise(y)
    ends = inside.withColumn("y", y).select((F.col("t") - (F.col("y") * (F.col("y") - 1) / 2).cast("long")).alias("x"), "y")
    numbered = checkpointed(running(nodes, [F.col("node")], {}).select((F.col("rank") - 1).alias("k"), "node"))
    a, b = numbered.select(F.col("k").alias("x"), F.col("node").alias("p")), numbered.select(F.col("k").alias("y"), F.col("node").alias("q"))
    return ends.join(a, "x").join(b, "y").select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"))
