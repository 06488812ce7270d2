"""Memory of a screen's tasks is bounded, whatever the number of nodes."""

import tracemalloc

import numpy as np

from weftgraph.operators import distances, screening


def test_draws_are_looked_up_in_stretches():
    rng = np.random.default_rng(3)
    n, genes, targets, iterations = 400, 150, 30_000, np.arange(250)
    table = rng.integers(0, 9, (n, n)).astype(np.uint8)

    def nodes(size):
        return rng.integers(0, 1 << 32, size), rng.integers(0, n - 40, size), rng.integers(1, 40, size), rng.integers(0, n, size)

    g, t = nodes(genes), nodes(targets)
    starts = [0, 1, 7000, 7001, 29_000]
    for real in (True, False):
        at, to = (x[3][None, :] if real else x[1][None, :] + screening.drawn(x[0], iterations, x[2]) for x in (g, t))
        near = np.array([table[row].min(axis=0) for row in at])
        found = np.take_along_axis(near, np.where((to >= 100) & (to < 300), to, 0), axis=1)
        known = (to >= 100) & (to < 300) & (found != 5)
        ends = [*starts[1:], targets]
        want = np.array([[(found[i, a:b][known[i, a:b]].astype(float).sum(), known[i, a:b].sum()) for a, b in zip(starts, ends)] for i in range(len(to))])
        tile = np.ascontiguousarray(table[:, 100:300])
        tracemalloc.start()
        sums, counts = screening._look_up(tile, 5, g, (t, 100), starts, iterations, real)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (sums == want[..., 0]).all() and (counts == want[..., 1]).all()
        assert peak < 120 << 20


def test_a_packed_table_is_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(distances, "PACKED_BYTES", 100)
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(39)], "src string, dst string")
    numbered = spark.createDataFrame([(f"n{i:02}", i) for i in range(40)], "node string, number long")
    cells, kind = distances.packed_table(edges, numbered, 40)
    got = {r.number: np.frombuffer(r.cells, kind) for r in cells.collect()}
    assert len(got) == 40 and all((got[i] == np.abs(np.arange(40) - i)).all() for i in got)
