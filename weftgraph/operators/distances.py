"""Shortest paths from many sources at once over undirected edges (src, dst[, weight]).

Hops: sources are numbered, and 64 of them share a word. A row (node, word, bits) says which of them reach a node; a round
sends the rows of the last generation along all edges and joins what arrives by bit_or, so its rows are bounded by edges
times words, however many sources there are. Edges go both ways, so what a round reaches lies in the last two
generations or is new; older ones aren't looked at again.

Weights: tentative distances are settled bucket by bucket, nearest first (delta stepping). With a bucket as wide as the
smallest weight all rows of a bucket are final, and each (source, node) is sent along the edges once. An offer to a settled
node comes from at most the largest weight further on, so only buckets that near are compared with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, mirror, running

WORD = 64
MERGE = 32  # generations after which their tables are written as one
FINE = 4  # buckets at most for each largest weight; beyond that a bucket is relaxed until nothing in it falls


def steps_of(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, once for each pair, dealt by src; w is 1.0 without weights."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    both = mirror(edges.select("src", "dst", w.alias("w"))).where("src != dst")
    return checkpointed(both.groupBy("src", "dst").agg(F.min("w").alias("w")).repartition("src"))


def hop_generations(steps: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, word, bits, dist): the sources of a word that reach a node in dist steps and not in fewer.

    start(node, word, bits): where the sources are."""
    along = steps.select("src", "dst")
    last = checkpointed(start.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    before, done, fresh = last.limit(0), last.withColumn("dist", F.lit(0)), 1
    for turn in range(1, max_rounds + 1):
        zero = F.lit(0).cast("long")
        sent = last.withColumnRenamed("node", "src").join(along, "src").select(F.col("dst").alias("node"), "word", F.col("bits").alias("new"), zero.alias("old"))
        known = last.unionByName(before).select("node", "word", zero.alias("new"), F.col("bits").alias("old"))
        met = sent.unionByName(known).groupBy("node", "word").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        found = checkpointed(met.select("node", "word", F.expr("new & ~old").alias("bits")).where("bits != 0"))
        if found.isEmpty():
            return done
        done, fresh = done.unionByName(found.withColumn("dist", F.lit(turn))), fresh + 1
        if fresh == MERGE:
            done, fresh = checkpointed(done), 1
        before, last = last, found
    raise RuntimeError(f"sources still reach new nodes after {max_rounds} rounds")


def settled_distances(steps: DataFrame, start: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, node, dist) by weights above 0; start(source, node)."""
    low, high = steps.agg(F.min("w"), F.max("w")).first()
    if low is not None and not low > 0:
        raise ValueError("weights must be above 0")
    open_ = checkpointed(start.distinct().withColumn("dist", F.lit(0.0)))
    if low is None:
        return open_
    wide = max(low, high / FINE)
    done, near, fresh = open_.limit(0), [], 0
    for _ in range(max_rounds):
        first = open_.agg(F.min("dist")).first()[0]
        if first is None:
            return done
        end, before = first + wide, None
        # settled buckets that an offer of this one may go back to
        near = [(d, table) for d, table in near if d >= first - high - wide]
        while True:
            now = open_.where(F.col("dist") < end)
            offers = now.withColumnRenamed("node", "src").join(steps, "src").select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
            offers = offers.groupBy("source", "node").agg(F.min("dist").alias("dist"))
            for _, table in near:
                offers = offers.join(table.select("source", "node"), ["source", "node"], "left_anti")
            open_ = checkpointed(open_.unionByName(offers).groupBy("source", "node").agg(F.min("dist").alias("dist")))
            if wide <= low:
                break
            inside = open_.where(F.col("dist") < end).agg(F.count(F.lit(1)), F.sum("dist")).first()
            if inside == before:
                break
            before = inside
        settled = open_.where(F.col("dist") < end)
        near.append((first, settled))
        done, fresh = done.unionByName(settled), fresh + 1
        if fresh == MERGE:
            done, fresh = checkpointed(done), 1
        open_ = open_.where(F.col("dist") >= end)
    raise RuntimeError(f"distances aren't settled after {max_rounds} buckets")


def distances(edges: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(source, node, dist): shortest paths from sources(source, node); weights (above 0) if there are any, else hops.

    A source with several nodes gives the distance to its nearest one. Nodes that aren't reached have no row."""
    steps = steps_of(edges)
    if "weight" in edges.columns:
        return settled_distances(steps, sources.select("source", "node"))
    numbered = running(sources.select("source").distinct(), [F.col("source")], {}).withColumn("at", F.col("rank") - 1)
    numbered = checkpointed(numbered.select("source", F.floor(F.col("at") / WORD).alias("word"), (F.col("at") % WORD).cast("int").alias("bit")))
    start = sources.select("source", "node").distinct().join(numbered, "source").select("node", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    reached = hop_generations(steps, start, max_rounds)
    names = numbered.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", "source"))).alias("names"))
    mine = F.expr("filter(names, n -> (shiftright(bits, n.bit) & 1L) = 1L)")
    rows = reached.join(names, "word").select("node", F.col("dist").cast("double").alias("dist"), F.explode(mine).alias("n"))
    return rows.select(F.col("n.source").alias("source"), "node", "dist")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def all_pairs(edges: DataFrame) -> DataFrame:
    return distances(edges, nodes_of(edges).select(F.col("node").alias("source"), "node"))


def distance_counts(edges: DataFrame) -> DataFrame:
    """(node, dist, nodes): how many nodes are dist hops from each node, itself at 0; pairs are never made."""
    steps = steps_of(edges)
    at = running(nodes_of(edges), [F.col("node")], {}).withColumn("at", F.col("rank") - 1)
    start = at.select("node", F.floor(F.col("at") / WORD).alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bits"))
    return hop_generations(steps, start).groupBy("node", "dist").agg(F.sum(F.bit_count("bits").cast("long")).alias("nodes"))


PACKED_BYTES = 16 << 20  # of rows of a packed table that a task holds at a time, about; a row at least


def packed_table(edges: DataFrame, numbered: DataFrame, n: int) -> tuple[DataFrame, np.dtype]:
    """(number, cells) and the cells' type: of each node its distances to all n nodes, by their numbers, in one array.

    numbered(node, number): all nodes of the edges, from 0. Hops take a byte (two, where a distance is over 250); weights
    a double. The largest value, or infinity, stands for nodes that aren't reached."""
    a, b = (numbered.select(F.col("node").alias(c), F.col("number").alias(f"{c}_number")) for c in ("src", "dst"))
    rest = ["weight"] if "weight" in edges.columns else []
    own = edges.join(a, "src").join(b, "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), *rest)
    steps, number = steps_of(own), numbered.select(F.col("number").cast("long").alias("number"))
    if rest:
        kind = np.dtype(np.float64)
        found = settled_distances(steps, number.select(F.col("number").alias("source"), F.col("number").alias("node")))
        cells = found.groupBy("node").agg(F.collect_list("source").alias("at"), F.collect_list("dist").alias("dist"), F.lit(None).cast("array<bigint>").alias("bits"))
    else:
        start = number.select(F.col("number").alias("node"), F.floor(F.col("number") / WORD).alias("word"), F.expr("shiftleft(1L, CAST(number % 64 AS INT))").alias("bits"))
        found = checkpointed(hop_generations(steps, start))
        kind = np.dtype(np.uint8 if (found.agg(F.max("dist")).first()[0] or 0) <= 250 else np.uint16)
        cells = found.groupBy("node").agg(F.collect_list("word").alias("at"), F.collect_list(F.col("dist").cast("double")).alias("dist"), F.collect_list("bits").alias("bits"))
    far = np.inf if kind.kind == "f" else np.iinfo(kind).max

    at_once = max(1, PACKED_BYTES // max(1, n * kind.itemsize))

    def pack(batches):
        for batch in (b.slice(a, at_once) for b in batches for a in range(0, b.num_rows, at_once)):
            out = []
            for i in range(batch.num_rows):
                row = np.full(-(-n // WORD) * WORD, far, kind)
                at, dist, bits = (None if not batch.column(c)[i].is_valid else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                if bits is None:
                    row[at] = dist
                else:
                    which = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    k, bit = np.nonzero(which)
                    row[at[k] * WORD + bit] = dist[k]
                out.append(row[:n].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["number", "cells"])

    return checkpointed(cells.select("node", "at", "dist", "bits").mapInArrow(pack, "number long, cells binary")), kind
