"""Modules' weights before and after: edges are computed once, and only modules without a hub go through rounds."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components, statistics
from weftgraph.plans import pipelines


def counted(rows):
    """The same rows, and how often one was computed."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def _edges(spark):
    draw = random.Random(5)
    rows = {(f"{draw.choice('ab')}{draw.randrange(9)}", f"{draw.choice('ab')}{draw.randrange(9)}") for _ in range(60)}
    rows = [(*sorted(p), round(draw.random(), 3)) for p in {tuple(sorted(p)) for p in rows}]
    rows += [(f"c{i}", f"c{i + 1}", i / 10) for i in range(7)] + [("d0", "d1", 0.5), ("d2", "d3", 0.25)]
    return spark.createDataFrame(rows, "src string, dst string, weight double").withColumn("squared", F.col("weight") * F.col("weight"))


def _members(spark):
    return spark.createDataFrame([(m, f"{m}{i}") for m in "abcd" for i in range(10)], "disease string, node string")


def test_columns_of_edges_give_what_tables_give_and_are_computed_once(spark):
    e = _edges(spark)
    rows, seen = counted(e)
    got = {r.disease: r.emd for r in pipelines.shift_by_disease("weight", "squared", _members(spark), rows, 5).collect()}
    assert seen.value == e.count()
    tables = pipelines.shift_by_disease(e, e.withColumn("weight", F.col("squared")), _members(spark), e, 5)
    assert got == pytest.approx({r.disease: r.emd for r in tables.collect()})
    # c is a path: no node has 5 neighbours, but its component has 8 nodes; the components of d have 2
    assert set(got) == {"a", "b", "c"}


def test_both_sides_of_a_shift_are_computed_once(spark):
    a, seen_a = counted(spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", 4.0)], "k string, value double"))
    b, seen_b = counted(spark.createDataFrame([("k", 2.0), ("k", 5.0)], "k string, value double"))
    got = statistics.signed_emd(a, b, ("k",)).first().emd
    assert (seen_a.value, seen_b.value) == (3, 2)
    assert got == pytest.approx((2 / 3) * 1 + (2 / 3 - 1 / 2) * 2 + (1 / 2) * 1)


@pytest.mark.parametrize("least", [0, 1, 3, 7, 30])
def test_keys_with_component_above(spark, least):
    draw = random.Random(least)
    rows = [(k, draw.randrange(12), draw.randrange(12)) for k in range(8) for _ in range(k * 2)] + [(9, i, i + 1) for i in range(8)] + [(10, 3, 3), (11, 0, None)]
    want = set()
    for k in {r[0] for r in rows}:
        sets = []
        for _, a, b in (r for r in rows if r[0] == k and r[2] is not None):
            met = [s for s in sets if a in s or b in s]
            sets = [s for s in sets if s not in met] + [set().union({a, b}, *met)]
        if any(len(s) > least for s in sets):
            want.add(k)
    got = components.keys_with_component_above(spark.createDataFrame(rows, "k int, src int, dst int"), ("k",), least)
    assert sorted(r.k for r in got.collect()) == sorted(want)


def test_hubs_settle_their_module_without_rounds(spark, monkeypatch):
    looked = []
    whole = components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges, keys=(): looked.append(sorted({r.k for r in edges.collect()})) or whole(edges, keys))
    rows = [("hub", 0, i) for i in range(1, 7)] + [("path", i, i + 1) for i in range(6)]
    got = components.keys_with_component_above(spark.createDataFrame(rows, "k string, src int, dst int"), ("k",), 5)
    assert sorted(r.k for r in got.collect()) == ["hub", "path"] and looked == [["path"]]
