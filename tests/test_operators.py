"""Hand-made cases with results worked out by hand, and invariants."""

import collections
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import running
from weftgraph.operators import distances, encoding, network, pairs, ranking, screening, selection, statistics, tiles, walks
from weftgraph.operators.components import connected_components
from weftgraph.sources import tables


def _edges(spark, rows, schema="src string, dst string"):
    return spark.createDataFrame(rows, schema)


M1 = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "e")]


def test_degree_components_and_hops(spark):
    e = _edges(spark, M1)
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert dict(map(tuple, network.degree(e, nodes).collect())) == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 2, "f": 0}
    assert dict(map(tuple, connected_components(e).collect())) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    assert dict(map(tuple, network.hop_bins(e, nodes.where("node = 'a'"), 4).collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r[0] for r in network.largest_component(e).collect()} == set("abcd")
    assert connected_components(e.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    path = _edges(spark, [(i, i + 1) for i in range(300)], "src long, dst long")
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_walk_keeps_its_mass(spark):
    e = _edges(spark, M1[:4])
    seeds = spark.createDataFrame([("a",)], "node string")
    got = dict(map(tuple, walks.random_walk(e, seeds, tol=1e-6).collect()))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] == max(got.values())


def test_weighted_distances(spark):
    e = _edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("s", "a")], "source string, node string")
    assert {(r.node, r.dist) for r in distances.distances(e, s).collect()} == {("a", 0.0), ("b", 1.0), ("c", 2.0)}


def test_shuffled_graph_keeps_degrees(spark):
    e = _edges(spark, [(f"x{i}", f"y{(i * j) % 11}") for i in range(30) for j in (1, 2, 5)]).distinct()
    got, swaps = network.degree_preserving_shuffle(e, 3)
    assert swaps == e.count()
    assert sorted(map(tuple, network.degree(got).collect())) == sorted(map(tuple, network.degree(e).collect()))
    assert got.count() == got.distinct().count() and got.where("src = dst").count() == 0


def test_cooccurrence(spark):
    rows = [("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("3", "a"), ("3", "b"), ("3", "c")]
    got = {(r.src, r.dst): r.n for r in pairs.cooccurrence(spark.createDataFrame(rows, "sample_id string, gene_id string")).collect()}
    assert got[("a", "b")] == 2 and got[("b", "c")] == 2 and got[("a", "c")] == 1 and got[("b", "b")] == 3


def test_rank_encoding_breaks_ties_by_gene(spark):
    rows = [("s", "b", 2, 1.0), ("s", "a", 1, 1.0), ("s", "c", 3, 4.0)]
    got = encoding.rank_encode(spark.createDataFrame(rows, "sample_id string, gene_id string, token int, value double"), 2).first()
    assert list(got.input_ids) == [3, 1] and got.length == 2


def test_roc_conventions_and_area(spark):
    r = spark.createDataFrame([("a", 4.0, 1), ("b", 3.0, 0), ("c", 2.0, 1), ("d", 1.0, 0)], "Name string, score double, label int")
    c = ranking.cumulative(r, [F.desc("score")])
    points = [(round(p.tpr, 6), round(p.fpr, 6)) for p in ranking.roc_points(c).orderBy("rank").collect()]
    assert points == [(0.5, 0.0), (0.5, 0.5), (1.0, 0.5), (1.0, 1.0)]
    assert ranking.roc_points(c, "literal").orderBy("rank").first().fpr == -0.5
    assert abs(ranking.auc_tied(r).first().area - 0.75) < 1e-12
    flipped = r.withColumn("label", 1 - F.col("label"))
    assert abs(ranking.auc_tied(flipped).first().area - 0.25) < 1e-12


def test_running_equals_a_window(spark):
    r = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("weight"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = {(x.weight, x.rank, x.m) for x in running(r, [F.desc("weight")], {"m": "label"}).collect()}
    w = Window.orderBy(F.desc("weight"))
    want = r.select("weight", F.row_number().over(w).alias("rank"), F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    assert got == {(x.weight, x.rank, x.m) for x in want.collect()} == {(x.weight, x.rank, x.m) for x in ranking.cumulative(r, [F.desc("weight")]).collect()}
    assert running(r.limit(0), [F.desc("weight")], {"m": "label"}).count() == 0


def test_unkeyed_metrics_equal_keyed_ones(spark):
    rows = [(f"n{i:02}", float(i * 7 % 5), int(i % 3 == 0)) for i in range(40)]
    r = spark.createDataFrame(rows, "Name string, score double, label int").withColumn("k", F.lit(1))
    assert ranking.auc_tied(r).first().area == pytest.approx(ranking.auc_tied(r, keys=("k",)).first().area)
    points = ranking.roc_points(ranking.cumulative(r, [F.desc("score"), "Name"]))
    keyed = ranking.roc_points(ranking.cumulative(r, [F.desc("score"), "Name"], keys=("k",)))
    assert ranking.area(points, "fpr", "tpr", ["rank"]).first().area == pytest.approx(ranking.area(keyed, "fpr", "tpr", ["rank"], ("k",)).first().area)
    a, b = r.select("k", F.col("score").alias("value")), r.select("k", (F.col("score") * 2 + F.col("label")).alias("value"))
    assert statistics.signed_emd(a.drop("k"), b.drop("k")).first().emd == pytest.approx(statistics.signed_emd(a, b, ("k",)).first().emd)


def test_log_bins_merge_small_classes(spark):
    rows = [(f"n{i}", v) for i, v in enumerate([0, 1, 1, 1, 2, 3, 5, 9, 20, 40])]
    bins = collections.defaultdict(list)
    for r in screening.log_bins(spark.createDataFrame(rows, "node string, value long"), 3).collect():
        bins[r.bin].append((r.slot, r.node))
    assert {b: sorted(n for _, n in x) for b, x in bins.items()} == {0: ["n0", "n1", "n2", "n3"], 1: ["n4", "n5", "n6"], 2: ["n7", "n8", "n9"]}
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in bins.values())
    assert screening.log_bins(spark.createDataFrame([], "node string, value long"), 3).count() == 0


def test_random_graphs_change_edges_and_follow_the_seed(spark):
    e = _edges(spark, [(f"a{i}", f"b{i * j % 17}") for i in range(30) for j in range(1, 5)]).distinct()
    plain = {tuple(r) for r in e.collect()}
    for make in (lambda seed: network.degree_preserving_shuffle(e, seed)[0], lambda seed: network.uniform_random_graph(e, seed)):
        one, same, other = ({tuple(r) for r in make(seed).collect()} for seed in (5, 5, 6))
        assert one == same and one != other and len(one) == len(plain) and len(one & plain) < 0.8 * len(plain)


def test_logistic_fusion_is_at_the_optimum(spark):
    rows = [(i, i % 7 / 3.0, i * i % 11 / 4.0, int(i % 5 == 0 or i % 7 > 4)) for i in range(60)]
    got = {r.Name: r.score for r in ranking.logistic_fusion(spark.createDataFrame(rows, "Name long, s1 double, s2 double, label int")).collect()}
    n1 = sum(r[3] for r in rows)
    weight = {1: 60 / (2 * n1), 0: 60 / (2 * (60 - n1))}
    # the weighted residuals vanish against the intercept, and equal the L2 term's pull for both slopes
    logit = {i: math.log(p / (1 - p)) for i, p in got.items()}
    x = np.array([[1.0, a, b] for _, a, b, _ in rows])
    w = np.linalg.lstsq(x, np.array([logit[r[0]] for r in rows]), rcond=None)[0]
    pull = x.T @ np.array([weight[y] * (y - got[i]) for i, _, _, y in rows])
    assert pull == pytest.approx(np.array([0, w[1], w[2]]), abs=2e-3)


def test_cosine_blocks_give_every_pair_once(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))]
    v = spark.createDataFrame(rows, "run int, id long, v array<double>")
    one, more = ({(r.src, r.dst): round(r.weight, 9) for r in pairs.cosine_pairs(v, ["run"], "id", "v", b).collect()} for b in (1, 5))
    assert one == more and len(one) == 435 and pairs.cosine_pairs(v, ["run"], "id", "v", 5).count() == 435


def test_draws_are_with_replacement_and_layers_count_from_the_end(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(5)], "sample_id string")
    drawn = [r.sample_id for r in encoding.draw_samples(ids, 40, 3).orderBy("draw_no").collect()]
    assert len(drawn) == 40 and len(set(drawn)) == 5
    assert [r.sample_id for r in encoding.samples_at(ids, spark.range(1, 9, 2).withColumnRenamed("id", "position")).orderBy("position").collect()] == ["s1", "s3"]
    layers = spark.createDataFrame([(k, k * 10) for k in range(4)], "layer int, w int")
    assert [r.w for r in pairs.select_layer(layers, -1).collect()] == [30] and [r.w for r in pairs.select_layer(layers, 0).collect()] == [0]


def test_fusion_with_ties(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 3.0), ("z", 1.0)], "Name string, score double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0), ("w", 9.0)], "Name string, score double")
    assert dict(map(tuple, ranking.borda(a, b).collect())) == {"x": 1.5, "y": 2.5, "z": 2.0}
    assert dict(map(tuple, ranking.dowdall(a, b).collect())) == {"x": 1 + 1 / 3, "y": 1.5, "z": 1 / 3 + 1}
    assert ranking.coverage(a, b).collect()[0].Name == "w"


def test_emd(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "value double")
    assert statistics.signed_emd(a, a).first().emd == 0
    assert abs(statistics.signed_emd(a, a.select((F.col("value") + 2).alias("value"))).first().emd - 2) < 1e-12


def test_labels_leave_out_drugs_that_share_a_target(spark):
    rows = [("p", "heart", "t1"), ("q", None, "t1"), ("r", "skin", "t2")]
    d = spark.createDataFrame(rows, "Name string, Indication string, Gene_Target string")
    assert {(x.Name, x.Positive) for x in selection.labels_by_name(d, ["HEART"]).collect()} == {("p", 1), ("r", 0)}


def test_constant_weights_give_distance_one(spark):
    e = _edges(spark, [("a", "b", 2.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    assert {r.weight for r in network.similarity_to_distance(e).collect()} == {1.0}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "e.csv").write_text("hgnc1,hgnc2,weight\nb,a,1\na,b,3\nc,a,0\n")
    assert list(map(tuple, tables.read_weighted_edges(spark, str(tmp_path / "e.csv")).collect())) == [("a", "b", 3.0)]
    (tmp_path / "x.csv").write_text("gene,s1,s2\ng1,1,2\ng2,0,\n")
    long = tables.read_expression(spark, str(tmp_path / "x.csv"), "genes")
    assert {tuple(r) for r in long.collect()} == {("s1", "g1", 1.0), ("s2", "g1", 2.0), ("s1", "g2", 0.0)}
    w = spark.createDataFrame([("m", 4, "max", "a", "b", 0.5, 2)], tables.SCHEMAS["pair_weights"])
    tables.write_pair_weights(w, str(tmp_path / "w"))
    assert tables.read_pair_weights(spark, str(tmp_path / "w")).where("layer = 4").count() == 1
    first = tables.cached_table(spark, str(tmp_path / "c"), lambda: spark.range(3).toDF("x"))
    again = tables.cached_table(spark, str(tmp_path / "c"), lambda: spark.range(9).toDF("x"))
    assert first.count() == again.count() == 3


def test_quantiles_of_one_value(spark):
    v = spark.createDataFrame([("k", 2.0)], "k string, v double")
    assert math.isclose(statistics.quartiles(v, ["k"], "v").first().iqr, 0.0)


def _shortest(adjacent, starts):
    found, heap = {}, [(0.0, s) for s in starts]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u not in found:
            found[u] = d
            for v, w in adjacent.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return found


@pytest.mark.parametrize("kind", ["hops", "near", "wide"])
def test_distances_equal_dijkstra(spark, kind):
    """Three words of sources; weights in [1, 2], and weights so unlike that a bucket is relaxed several times."""
    rng, size = random.Random(2), 150 if kind == "hops" else 30
    edges = {}
    for _ in range(190 if kind == "hops" else 60):
        a, b = rng.randrange(size), rng.randrange(size)
        edges[min(a, b), max(a, b)] = {"hops": 1.0, "near": rng.uniform(1, 2), "wide": rng.choice([0.01, 0.5, 1.0])}[kind]
    adjacent = collections.defaultdict(list)
    for (a, b), w in edges.items():
        adjacent[f"n{a}"].append((f"n{b}", w))
        adjacent[f"n{b}"].append((f"n{a}", w))
    e = spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    e = e.drop("weight") if kind == "hops" else e
    got = {(r.source, r.node): r.dist for r in distances.all_pairs(e).collect()}
    want = {(s, v): d for s in adjacent for v, d in _shortest(adjacent, [s]).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    some = sorted(adjacent)
    sources = spark.createDataFrame([("x", u) for u in some[:5]] + [("y", some[7]), ("z", "nowhere")], "source string, node string")
    got = {(r.source, r.node): r.dist for r in distances.distances(e, sources).collect()}
    want = {("x", v): d for v, d in _shortest(adjacent, some[:5]).items()} | {("y", v): d for v, d in _shortest(adjacent, [some[7]]).items()} | {("z", "nowhere"): 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    if kind == "hops":
        counts = {(r.node, r.dist): r.nodes for r in distances.distance_counts(e).collect()}
        assert counts == collections.Counter((s, int(d)) for s in adjacent for d in _shortest(adjacent, [s]).values())
    assert distances.all_pairs(e.limit(0)).count() == 0


@pytest.mark.parametrize("weighted,tile", [(False, 1 << 28), (True, 1 << 28), (False, 700)])
def test_screening_equals_its_draws(spark, monkeypatch, weighted, tile):
    """Moments against the draws as rows and all shortest paths; with a small tile the table comes in several parts."""
    monkeypatch.setattr(screening, "TILE_BYTES", tile)
    monkeypatch.setattr(screening, "DRAWS", 7)
    rng = random.Random(8)
    rows = sorted({(f"a{rng.randrange(25)}", f"b{rng.randrange(20)}", rng.choice([1.0, 1.5])) for _ in range(55)})
    rows = list({(a, b): (a, b, w) for a, b, w in rows}.values())
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    e = e if weighted else e.drop("weight")
    adjacent = collections.defaultdict(list)
    for a, b, w in rows:
        adjacent[a].append((b, w if weighted else 1.0))
        adjacent[b].append((a, w if weighted else 1.0))
    names = sorted(adjacent)
    targets = [(f"d{i % 6}", rng.choice(names)) for i in range(20)] + [("d1", "unknown")]
    diseases = [(f"x{i % 3}", rng.choice(names)) for i in range(9)]
    t, g = spark.createDataFrame(targets, "drug string, node string"), spark.createDataFrame(diseases, "disease string, node string")
    bins = screening.degree_bins(network.degree(e).withColumnRenamed("degree", "value"), 6).cache()
    drawn = {}
    for name, sets, seed in (("t", t.withColumnRenamed("drug", "set"), 1), ("g", g.withColumnRenamed("disease", "set"), 2)):
        for r in screening.random_sets(bins, sets.distinct(), 40, seed).collect():
            drawn.setdefault((name, r.set, r.iter), []).append(r.node)
    far = {u: _shortest(adjacent, [u]) for u in names}

    def mean(to, of):
        near = [min((far[x][u] for x in of if u in far[x]), default=None) for u in to]
        near = [x for x in near if x is not None]
        return sum(near) / len(near) if near else None

    got = {(r.drug, r.disease): r for r in screening.screening(e, t, g, bins, 40).collect()}
    want = {}
    for drug in {d for d, _ in targets}:
        for disease in {x for x, _ in diseases}:
            d = mean({u for k, u in targets if k == drug and u in far}, {u for k, u in diseases if k == disease})
            x = [mean(drawn["t", drug, i], drawn["g", disease, i]) for i in range(40)]
            x = np.array([v for v in x if v is not None])
            if d is not None and len(x):
                want[drug, disease] = d, x.mean(), x.std(), (x <= d + 1e-12).mean()
    assert got.keys() == want.keys()
    for k, (d, m, s, p) in want.items():
        assert (got[k].d, got[k].mean, got[k]["std"]) == pytest.approx((d, m, s), abs=1e-9) and abs(got[k].p - p) < 0.026
        assert got[k].z is None or got[k].z == pytest.approx((d - m) / s)


def test_draws_are_even():
    x = screening.drawn(np.array([12345, 987654321]), np.arange(50_000), np.array([10, 7]))
    for column, size in zip(x.T, (10, 7)):
        share = np.bincount(column, minlength=size) / len(x)
        assert abs(share - 1 / size).max() < 0.006 and abs(np.corrcoef(column[1:], column[:-1])[0, 1]) < 0.015
    assert abs(np.corrcoef(*x.T)[0, 1]) < 0.015


def test_common_values_are_binned_whole(spark):
    measure = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("value"))
    rows = screening.degree_bins(measure, 30).collect()
    assert len({(r.bin, r.slot) for r in rows}) == 1000 and collections.Counter(r.bin for r in rows) == {**{b: 30 for b in range(32)}, 32: 40}


def test_swaps_are_as_many_as_asked(spark):
    e = _edges(spark, [(f"a{i}", f"b{i * j % 17}") for i in range(30) for j in range(1, 5)]).distinct()
    plain = {tuple(r) for r in e.collect()}
    some, swaps = network.degree_preserving_shuffle(e, 5, 3)
    some = {tuple(r) for r in some.collect()}
    assert swaps == 3 and len(some) == len(plain) and 0 < len(plain - some) <= 6
    degrees = lambda rows: collections.Counter(x for r in rows for x in r)
    assert degrees(some) == degrees(plain) and network.degree_preserving_shuffle(e, 5, 0)[1] == 0
    with pytest.raises(RuntimeError):
        network.degree_preserving_shuffle(_edges(spark, [("a", "b"), ("a", "c")]), 5)  # no swap is possible


def test_uniform_graphs_take_every_pair(spark):
    e = _edges(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")])
    assert {tuple(r) for r in network.uniform_random_graph(e, 1).collect()} == {tuple(r) for r in e.collect()}
    assert network.uniform_random_graph(e.limit(0), 1).count() == 0


def test_tiles_equal_dense_matrices(spark, monkeypatch):
    """Samples of up to 2,048 genes from 3,000, several heads; and small holds, so that tasks send a tile several times."""
    monkeypatch.setattr(tiles, "HELD", 100_000)
    rng = np.random.default_rng(1)
    samples = [rng.choice(3000, n, replace=False).tolist() for n in (2048, 300, 300, 5, 1)] + [[], None]

    def score(ids):
        i = np.arange(len(ids))
        w = ((31 * ids[:, None] + 17 * ids[None, :] + 7 * i[None, :]) % 97) / 97.0 - 0.5
        w = np.stack([w, w * 0.5, -w])
        w[1][(ids[:, None] % 5 == 0) & (ids[None, :] % 7 == 0)] = np.nan
        return w

    df = spark.createDataFrame([(x,) for x in samples], "input_ids array<int>").repartition(3)
    for method, direction in (("max", "both"), ("max", "upper"), ("avg", "both")):
        got = tiles.attention_tiles(df, score, method=method, direction=direction, floor=None).toPandas()
        total, n = np.full((3000, 3000), -np.inf if method == "max" else 0.0), np.zeros((3000, 3000), int)
        for x in samples:
            if not x:
                continue
            ids = np.array(x)
            w, at = score(ids) * len(x) / 2048, np.ix_(ids, ids)
            if method == "avg":
                total[at] += np.nanmean(w, axis=0)
                n[at] += 1
                continue
            one = np.fmax.reduce(w, axis=0)
            one = np.fmax(one, one.T) if direction == "both" else np.where(np.triu(np.ones_like(one)) > 0, one, -np.inf)
            total[at] = np.maximum(total[at], np.maximum(one, one.T))
            n[at] += 1
        if method == "max":
            total, n = np.where(np.triu(np.ones_like(total)) > 0, total, 0), np.triu(n)
        src, dst = np.nonzero(n)
        want = total[src, dst] if method == "max" else total[src, dst] / n[src, dst]
        got = got.sort_values(["src", "dst"])
        assert (got["src"].to_numpy() == src).all() and (got["dst"].to_numpy() == dst).all()
        assert len(got) == len(src) and np.allclose(got["weight"].to_numpy(), want) and (got["n"].to_numpy() == n[src, dst]).all()


def test_samples_scored_together_and_cosines_by_blocks_of_genes(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MANY", 30)  # samples of one length in several calls
    monkeypatch.setattr(tiles, "SIDE", 8)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(rng.choice(40, n, replace=False).tolist(),) for n in (1, 3, 3, 3, 3, 5, 5)] + [(None,), ([],)], "input_ids array<int>").repartition(2)
    one = lambda ids: ((31 * ids[..., :, None] + 17 * ids[..., None, :]) % 97)[..., None, :, :] / 97.0
    for method in ("max", "avg"):
        a, b = (sorted(map(tuple, tiles.attention_tiles(df, one, method=method, together=t).collect())) for t in (False, True))
        assert a == b and a
    x = rng.normal(size=(3, 30, 6))
    x[1, 4] = 0
    rows = [(s, g, x[s, g].tolist()) for s in range(3) for g in range(30) if (s, g) != (2, 9)] + [(0, 3, x[0, 3].tolist()), (0, 5, None)]
    hidden = spark.createDataFrame(rows, "sample_id int, gene_id int, embedding array<double>").repartition(3)
    unit = x / np.where(np.linalg.norm(x, axis=2) > 0, np.linalg.norm(x, axis=2), np.nan)[..., None]
    w = np.einsum("sgd,shd->sgh", unit, unit)
    w[2, 9] = w[2, :, 9] = np.nan
    n = np.full((30, 30), 3) - (np.arange(30) == 9)[:, None] - (np.arange(30) == 9)[None, :]
    for method, want in (("max", np.maximum(np.nanmax(w, axis=0), 0)), ("avg", np.nanmean(w, axis=0))):
        got = {(r.src, r.dst): (r.weight, r.n) for r in tiles.embedding_tiles(hidden, method).collect()}
        assert got.keys() == {(a, b) for a in range(30) for b in range(a + 1, 30)}
        assert all(abs(v - want[k]) < 1e-12 and c == n[k] for k, (v, c) in got.items())


def test_screen_of_an_empty_network(spark):
    e = _edges(spark, [("a", "b")]).limit(0)
    sets = [spark.createDataFrame([("x", "a")], f"{c} string, node string") for c in ("drug", "disease")]
    bins = screening.degree_bins(network.degree(e).withColumnRenamed("degree", "value"), 2)
    got = screening.screening(e, *sets, bins, 300)
    assert got.columns == ["drug", "disease", "d", "mean", "std", "p", "z"] and got.count() == 0
    assert distances.packed_table(e, bins.select("node", F.col("slot").alias("number")), 0)[0].count() == 0


def test_quantiles_of_one_large_group(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(v)) for v in np.round(rng.normal(size=5000), 2)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: list(r.q) for r in statistics.exact_quantiles(df, ["k"], "v", at).collect()}
    assert got.keys() == {"big", "one", "two"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for x, v in rows if x == k], at).tolist())
    assert list(statistics.exact_quantiles(df, [], "v", at).first().q) == pytest.approx(np.quantile([v for _, v in rows if v is not None], at).tolist())
    assert statistics.exact_quantiles(df.limit(0), [], "v", at).count() == 0


def test_binned_density_is_near_the_exact_one(spark):
    v = np.random.default_rng(3).gamma(2.0, size=30_000)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", float(x)) for x in v[:50]], "k string, v double")
    exact = {(r.k, round(r.x, 6)): r.density for r in statistics.density(df, "k", "v", 20, fine=1e-9).collect()}
    binned = {(r.k, round(r.x, 6)): r.density for r in statistics.density(df, "k", "v", 20).collect()}
    assert exact.keys() == binned.keys() and max(abs(exact[k] - binned[k]) for k in exact) < 1e-6
    assert all(exact[k] == pytest.approx(binned[k], abs=1e-12) for k in exact if k[0] == "b")


def test_cosine_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 40)
    x = np.random.default_rng(4).normal(size=(150, 40)) * np.linspace(3, 0.1, 40)
    x[7] = 0
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(x)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    unit = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), np.nan)[:, None]
    w = unit @ unit.T
    for least in (None, 0.4, 0.9, 1.1):
        got = {(r.src, r.dst): r.weight for r in tiles.cosine_pairs_above(df, "id", "v", least).collect()}
        want = {(3 * i, 3 * j): w[i, j] for i in range(150) for j in range(i + 1, 150) if (w[i, j] > least if least else w[i, j] == w[i, j])}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_a_bucketed_store_is_not_shuffled_again(spark, tmp_path):
    e = _edges(spark, [(f"a{i}", f"b{i % 7}") for i in range(50)])
    store = tables.store_pair_weights(e.withColumn("weight", F.lit(1.0)), "weights_of_a_test", f"{tmp_path}/w", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = network.weighted(e, store)
        assert joined.count() == 50
        plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("AdaptiveSparkPlan"):]
        assert side.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE weights_of_a_test")


@pytest.mark.parametrize("rows_of_a_task", [1_000_000, 2])
def test_drug_labels_dealt_to_tasks(spark, monkeypatch, rows_of_a_task):
    """Many drugs are dealt by count, which Spark doesn't merge into fewer tasks, with the same labels."""
    from weftgraph.functions import iterate

    monkeypatch.setattr(iterate, "TASK_ROWS", rows_of_a_task)
    drugs = spark.createDataFrame([("x", "URGENT", 1), ("y", "low", 1), ("z", "low", 2), ("z", "low", 3), ("v", "low", 3)], "Name string, Indication string, Gene_Target long")
    assert iterate.dealt(drugs, iterate.tasks_for(drugs), "Name").rdd.getNumPartitions() >= (1 if rows_of_a_task > 5 else 3)
    assert dict(map(tuple, selection.labels_by_name(drugs, ["urgent"]).collect())) == {"x": 1, "z": 0, "v": 0}
    ids = spark.createDataFrame([(1, "G1"), (3, "G3")], "symbol long, gene_id string")
    got = selection.targets_mapped(drugs, drugs.select("Name", F.lit(1).alias("Positive")).distinct(), ids)
    assert sorted(map(tuple, got.collect())) == [("v", "G3", 1), ("x", "G1", 1), ("y", "G1", 1), ("z", "G3", 1)]


def test_fusions_of_one_ranking_need_no_window_by_method(spark):
    """Areas and hits equal those of the keyed form, and no window takes a whole method as its partition."""
    rng = random.Random(3)
    rows = [(f"n{i}", *[float(rng.randrange(9)) for _ in ranking.METHODS], int(rng.random() < 0.3)) for i in range(60)]
    every = spark.createDataFrame(rows, ["Name", *ranking.METHODS, "label"]).withColumn("label", F.col("label").cast("int"))
    fused, labels = every.drop("label"), every.select("Name", "label")
    got = ranking.evaluate_fusions(fused, labels, 10)
    keyed = ranking.evaluate_fusions(fused.withColumn("k", F.lit(1)), labels.withColumn("k", F.lit(1)), 10, ("k",))
    rounded = lambda df: sorted((r["method"], round(r["auroc"], 12), r["hits"]) for r in df.collect())
    assert rounded(got) == rounded(keyed)
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in line]
    assert windows and not any("windowspecdefinition(method" in line for line in windows)
