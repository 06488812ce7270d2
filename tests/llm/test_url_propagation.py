"""op10_url_trust: propagation to its end, and ties through domains without pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import op10_url_trust as op10


def test_distrust_reaches_the_far_end_of_a_chain_and_siblings(spark):
    n = 12
    rows = [(i, f"http://h{i}.test/", f'<a href="http://h{i + 1}.test/">') for i in range(n)]
    rows += [(n, f"http://h{n}.test/", '<a href="http://far.org/">'), (50, "http://far.org/es/1", ""), (51, "http://good.net/de/1", "")]
    rows += [(60, "http://blog.x.site.org/es/1", ""), (61, "http://m.x.site.org/", ""), (62, "http://10.1.0.9/", ""), (63, "http://b.other.org/", "")]
    got = {r.page_id: r.verdict for r in op10.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(n + 1)] == ["block"] * (n + 1)
    assert got[61] == "block" and got[62] == got[63] == "allow"


def test_propagation_equals_the_solved_equations(spark):
    pairs = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 0.5), (3, 2, 0.5), (4, 0, 1.0), (3, 5, 1.0)]
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for a, b, w in pairs], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", "t", 3.0), ("h4", "t", 1.0), ("h5", "d", 2.0)], "host string, kind string, seed double")
    got = {(r.host, r.kind): r.score for r in op10.propagate(edges, seeds).collect()}
    for kind, start in (("t", [0.75, 0, 0, 0, 0.25, 0]), ("d", [0, 0, 0, 0, 0, 1])):
        m = np.zeros((6, 6))
        for a, b, w in pairs:
            m[(a, b) if kind == "t" else (b, a)] += w
        m = np.array([r / r.sum() if r.sum() else np.eye(6)[i] for i, r in enumerate(m)])
        want = np.linalg.solve(np.eye(6) - 0.85 * m.T, 0.15 * np.array(start, float))
        for i in range(6):
            assert abs(got.get((f"h{i}", kind), 0.0) - want[i]) <= 1e-5 * want[i]


def test_edges_to_domains_without_pages(spark):
    pages = spark.createDataFrame([("a.b.site.org", ""), ("site.org", ""), ("10.0.0.1", "")], "host string, html string")
    got = {(r.src, r.dst) for r in op10.host_edges(pages).where(F.col("src") < F.col("dst")).collect()}
    assert got == {("a.b.site.org", "b.site.org"), ("b.site.org", "site.org")}


@pytest.mark.parametrize("edges_of_a_task", [100_000, 2])
def test_rounds_on_a_small_graph_have_few_tasks(spark, monkeypatch, edges_of_a_task):
    """Many session partitions, as on a cluster: the rounds' tasks follow the edges, and the scores are the same."""
    monkeypatch.setattr(op10, "EDGES_OF_A_TASK", edges_of_a_task)
    edges = spark.createDataFrame([(f"h{i}", f"h{(i * 3 + 1) % 7}", 1.0 + i) for i in range(7)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", "t", 1.0), ("h3", "d", 2.0), ("h5", "d", 1.0)], "host string, kind string, seed double")
    want = {(r.host, r.kind): r.score for r in op10.propagate(edges, seeds).collect()}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "41"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rank = op10.propagate(edges, seeds)
        assert rank.rdd.getNumPartitions() <= -(-7 // edges_of_a_task)
        got = {(r.host, r.kind): r.score for r in rank.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
