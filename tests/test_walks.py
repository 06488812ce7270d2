"""Walks in packs of edges against dense matrices."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import registry
from weftgraph.operators import walks


def test_walks_equal_dense_matrices(spark, monkeypatch):
    """Two networks with parallel edges, loops and nodes of weight 0, in several parts; 8 rounds are enough."""
    monkeypatch.setattr(walks, "PACK", 40)
    monkeypatch.setattr(walks, "WIDTH", 2)
    rng = np.random.default_rng(5)
    rows, seeds, want = [], [], {}
    for net in ("a", "b"):
        ends, weight = rng.integers(0, 25, (70, 2)), rng.integers(0, 4, 70).astype(float)
        rows += [(net, f"n{i}", f"n{j}", w) for (i, j), w in zip(ends.tolist(), weight.tolist())]
        m, used = np.zeros((25, 25)), sorted(set(ends.ravel().tolist()))
        for (i, j), w in zip(ends, weight):
            m[j, i] += w
            m[i, j] += w * (i != j)
        total = m.sum(0)
        step = np.divide(m, total, out=np.zeros_like(m), where=total != 0)
        for rep in range(3):
            own = rng.choice(used, 4, replace=False).tolist()
            seeds += [(net, rep, f"n{i}") for i in own]
            x = np.array([(i in used) / len(used) for i in range(25)])
            for _ in range(50):
                x = 0.1 * step @ x + 0.9 * np.isin(np.arange(25), own) / 4
            want |= {(net, rep, f"n{i}"): x[i] for i in used}
    edges = spark.createDataFrame(rows, "network string, src string, dst string, weight double")
    seeds = spark.createDataFrame(seeds, "network string, rep int, node string")
    got = walks.random_walk(edges, seeds, ("network", "rep"), 0.9, tol=1e-15, max_iter=8)
    got = {(r["network"], r["rep"], r["node"]): r["score"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_a_walk_without_seeds_in_the_network_has_no_rows(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert walks.random_walk(edges, spark.createDataFrame([("x",)], "node string")).collect() == []


@pytest.mark.parametrize("named", [0, 1000])
def test_packs_of_several_rows_equal_dense_matrices(spark, monkeypatch, named):
    """The same with places that are looked up by a shuffle or a broadcast; each task adds rows to a pack."""
    monkeypatch.setattr(walks, "NAMED", named)
    monkeypatch.setattr(walks, "HELD", 10)
    test_walks_equal_dense_matrices(spark, monkeypatch)


def test_an_edge_takes_four_bytes_and_is_shuffled_in_a_pack(spark, monkeypatch):
    seen, packs_of = [], walks._packs

    def packs(*args):
        packs = packs_of(*args)
        size = packs.agg(F.count(F.lit(1)), F.sum(F.length("i") + F.length("j") + F.length("weight"))).first()
        seen.append((*size, packs._jdf.queryExecution().executedPlan().toString()))
        return packs

    monkeypatch.setattr(walks, "_packs", packs)
    edges = spark.range(0, 3000, 1, 2).select((F.col("id") % 50).cast("string").alias("src"), (F.col("id") % 47).cast("string").alias("dst"))
    walks.random_walk(edges, spark.createDataFrame([("1",)], "node string"), max_iter=1).count()
    rows, size, plan = seen[0]
    assert size <= 3000 * 4 + rows * 8  # 16 before: two orders of two integers
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan  # the one pack goes to one partition


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_networks_of_one_graph_are_stored_once(spark, monkeypatch):
    stored, nets = [], []

    def checkpointed(df):
        stored.append(df.columns)
        return df.cache()

    def detection(edges, *args, **kwargs):
        nets.append(edges)
        raise InterruptedError

    monkeypatch.setattr(registry, "checkpointed", checkpointed)
    monkeypatch.setattr(registry.pipelines, "module_detection", detection)
    with pytest.raises(InterruptedError):
        registry.module_detection_areas(spark, "/root/testdata/sf0.001")
    assert stored == [["src", "dst", "weight"]]
    by = {r.network: (r.n, r.ones) for r in nets[0].groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("weight") == 1).cast("int")).alias("ones")).collect()}
    assert by["plain"][0] == by["plain"][1] == by["weighted"][0] > 0 == by["weighted"][1]
