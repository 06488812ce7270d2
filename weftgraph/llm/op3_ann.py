"""Nearest neighbours by inner product: probed lists, scanned adaptively by dimension.

Vectors are rotated by a random orthogonal matrix and dealt to the lists of a coarse clustering, each list in blocks of
bounded size, stored by columns. A query first scans its nearest lists for a threshold; in the other probed lists the
inner product grows by blocks of columns, and a candidate is dropped once a test says that it can't reach the
threshold: after a random rotation the rest of the product is about normal with deviation |q rest| |x rest| / sqrt(rest).
What remains is scored exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, table

NEAREST = 20
FIT_ROWS = 20_000  # vectors at most that the clustering is fitted to
BLOCK_ROWS = 8192  # vectors at most of a list in one task, about
QUERY_ROWS = 32_768  # queries at most in one task, about
PROBE_SHARE = 0.75  # share of the lists that a query probes, nearest centroids first
FIRST_LISTS = 2  # of them scanned whole for the threshold
COLUMNS = 16
CONFIDENCE = 3.0  # standard deviations of the test


def _lists(n: int) -> int:
    return int(max(1, min(4096, round(np.sqrt(n) / 2))))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows whose vector is not null or zero and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    )


def _clusters(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(3)
    centre = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-300), centre)
    return centre


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, the query's own id excepted.

    Null, zero and non-finite vectors take no part; vectors of another dimension than the most frequent one neither.
    Ties go to the smaller vec_id; with fewer candidates than k all are returned whose lists are probed, and a query
    whose probed lists hold fewer than k is scanned against all lists. A repeated vec_id is a candidate once, with its best score. Extra columns are ignored.
    """
    rows = materialize(usable(vectors), "vectors")
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim, n = top["d"], top["n"]
    rows = rows.where(F.size("v") == dim)
    share = min(1.0, FIT_ROWS / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.stack(drawn.select("v").limit(2 * FIT_ROWS).toPandas()["v"].to_list())
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))[0]
    lists = min(_lists(n), len(sample))
    centre = _clusters(sample, lists)
    probes = int(np.ceil(PROBE_SHARE * lists))

    def place(batches):
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            own = np.argmax(x @ centre.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["vec_id", "v", "list"])

    placed = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, list int"), "lists")
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)  # at most 4096 rows
    held = placed.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int"))
    wanted = materialize(usable(queries).where(F.size("v") == dim), "queries")
    parts = max(1, -(-wanted.count() // QUERY_ROWS))  # both sides of a group are bounded: candidates and queries
    part = F.pmod(F.xxhash64("query_id", F.lit(6)), F.lit(parts)).cast("int")

    def probe(batches):
        for batch in batches:
            q = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            order = np.argsort(-(q @ centre.T), axis=1)[:, :probes].astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], ["query_id", "q", "near"])

    probing = wanted.mapInArrow(probe, "query_id long, q array<double>, near array<int>")
    probing = materialize(probing, "probes")

    def scan(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = candidates["vec_id"].to_numpy(np.int64)
        x = np.stack(candidates["v"].to_list())
        turned = x @ rotation
        blocks_ = [np.ascontiguousarray(turned[:, a : a + COLUMNS]) for a in range(0, dim, COLUMNS)]
        rest = [np.linalg.norm(turned[:, a:], axis=1) for a in range(0, dim, COLUMNS)]
        found = []
        for qid, q, least in zip(asked["query_id"], asked["q"], asked["least"]):
            alive = np.flatnonzero(ids != qid)
            if np.isfinite(least):
                t = q @ rotation
                part = np.zeros(len(alive))
                for b, a in enumerate(range(0, dim, COLUMNS)):
                    if a:
                        allow = CONFIDENCE * np.linalg.norm(t[a:]) / np.sqrt(dim - a)
                        ok = part + allow * rest[b][alive] >= least
                        alive, part = alive[ok], part[ok]
                        if not len(alive):
                            break
                    part = part + blocks_[b][alive] @ t[a : a + COLUMNS]
            if not len(alive):
                continue
            exact = np.zeros(len(alive))
            exact = (x[alive] * q).sum(axis=1)
            if len(alive) > k:
                cut = np.partition(exact, len(exact) - k)[len(exact) - k]
                alive, exact = alive[exact >= cut], exact[exact >= cut]
            found.append((np.full(len(alive), qid), ids[alive], exact))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, c = map(np.concatenate, zip(*found))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(df: DataFrame) -> DataFrame:
        df = df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return df.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    def round_(asked: DataFrame) -> DataFrame:
        asked = asked.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = each.select("list", "block", "part", "vec_id", "v").groupBy("list", "block", "part").cogroup(
            asked.select("list", "block", part.alias("part"), "query_id", "q", "least").groupBy("list", "block", "part")
        )
        return best(met.applyInPandas(scan, "query_id long, vec_id long, score double"))

    first = probing.select("query_id", "q", F.explode(F.slice("near", 1, FIRST_LISTS)).alias("list"), F.lit(float("-inf")).alias("least"))
    one = materialize(round_(first).drop("rank"), "first")
    least = one.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = (
        probing.where(F.size("near") > FIRST_LISTS).join(least, "query_id", "left")
        .select("query_id", "q", F.explode(F.slice("near", FIRST_LISTS + 1, probes)).alias("list"), F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    )
    two = best(one.unionByName(round_(rest).drop("rank"))).drop("rank")
    if probes < lists:
        two = materialize(two, "second")
        few = two.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = probing.join(few, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select("query_id", "q")
        every = short.select("query_id", "q", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), F.lit(float("-inf")).alias("least"))
        two = two.join(short.select("query_id"), "query_id", "left_anti").unionByName(round_(every).drop("rank"))
    return best(two).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
