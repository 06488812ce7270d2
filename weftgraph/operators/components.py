"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, mirror


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """(keys, node, component) for each node of ``edges(keys, src, dst)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round links nodes to smaller neighbours only, so the number of
    edges never grows and the rounds needed follow the logarithm of the diameter. Self loops make their node known;
    null ends are left out; without edges the result is empty.
    """
    k = list(keys)
    # the input is read once; its nodes and its edges both come from this
    named = checkpointed(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*k, "src", "dst").distinct())
    nodes = named.select(*k, F.explode(F.array("src", "dst")).alias("node")).distinct()
    work = checkpointed(
        named.where("src != dst")
        .select(*k, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )

    def summed(df):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = summed(work)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u goes to u's smallest neighbour (or u itself)
        both = work.select(*k, "u", "v").union(work.select(*k, F.col("v"), F.col("u")))
        low = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [*k, "u"])
            .select(*k, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        work = checkpointed(small)
        after = summed(work)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = work.select(*k, F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, [*k, "node"], "left").select(
        *k, "node", F.coalesce("root", "node").alias("component")
    )


def keys_with_component_above(edges: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """(keys): those of ``edges(keys, src, dst)`` that have a component of more than ``least`` nodes.

    A node with ``least`` neighbours or more settles its key, for it is in a component with all of them. Only the edges of
    other keys, whose nodes have few neighbours each, go through the rounds of ``connected_components``.
    """
    k = list(keys)
    pairs = mirror(edges.where("src != dst").select(*k, "src", "dst")).distinct()
    settled = pairs.groupBy(*k, "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*k).distinct()
    settled = checkpointed(settled)
    part = connected_components(edges.join(settled, k, "left_anti"), keys)
    sizes = part.groupBy(*k, "component").agg(F.count(F.lit(1)).alias("size"))
    return settled.unionByName(sizes.where(F.col("size") > least).select(*k).distinct())
