"""Encoded samples are computed once, draws need no ranking, and pairs are dealt by count."""

import pytest

from weftgraph.functions import iterate
from weftgraph.operators import encoding, pairs
from weftgraph.plans import pipelines


def counted(rows):
    """The same rows, and how often one was computed."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def test_draws_rank_nothing(spark):
    expr = spark.createDataFrame([("s1", "a", 2.0), ("s1", "x", 1.0), ("s2", "x", 3.0), ("s3", "b", None), ("s4", "b", 1.0), ("s4", "a", 1.0)], "sample_id string, gene_id string, value double")
    vocab = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 0.0), ("c", 3, 1.0)], "gene_id string, token int, median double")
    got = encoding.encodable(expr, vocab)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = encoding.rank_encode(encoding.normalize_by_vocab(expr, vocab))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.select("sample_id").collect()) == ["s1", "s3", "s4"]
    ids, seen = counted(got)
    # range partitions are sampled, then dealt; they are not computed again to be counted
    assert encoding.draw_samples(ids, 20, 7).count() == 20 and seen.value <= 6


def test_saturation_computes_samples_once(spark):
    rows = [(f"s{i:02}", [i % 5, 5 + i % 3, 40_000 + i]) for i in range(30)]
    encoded, seen = counted(spark.createDataFrame(rows, "sample_id string, input_ids array<int>"))
    got = {r.n: (r.mean_tokens, r.std_tokens) for r in encoding.saturation(encoded, [1, 4, 50], 3).collect()}
    assert seen.value == 30
    ids = encoded.select("sample_id")
    tokens, sizes = dict(rows), {n: [] for n in (1, 4, 50)}
    for seed in range(3):
        draws = {r.draw_no: r.sample_id for r in encoding.draw_samples(ids, 50, seed).collect()}
        for n in sizes:
            sizes[n].append(len({t for k in range(n) for t in tokens[draws[k]]}))
    for n, x in sizes.items():
        mean = sum(x) / 3
        assert abs(got[n][0] - mean) < 1e-9 and abs(got[n][1] - (sum((v - mean) ** 2 for v in x) / 3) ** 0.5) < 1e-9


@pytest.mark.parametrize("rows_of_a_task", [1_000_000, 10])
def test_pairs_are_dealt_by_count(spark, monkeypatch, rows_of_a_task):
    monkeypatch.setattr(iterate, "TASK_ROWS", rows_of_a_task)
    members = spark.createDataFrame([(f"s{i}", f"g{(i * j) % 11}") for i in range(12) for j in range(5)], "sample_id string, gene_id string")
    out = pairs.cooccurrence(members)
    sets = {}
    for r in members.collect():
        sets.setdefault(r.sample_id, set()).add(r.gene_id)
    want = {}
    for g in sets.values():
        for a in g:
            for b in g:
                if a <= b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.n for r in out.collect()} == want
    if rows_of_a_task == 10:
        assert out.rdd.getNumPartitions() >= sum(want.values()) / 10


def test_lengths_scale_a_samples_largest_weight(spark, monkeypatch):
    rows = [("s", 1, 2, 0.5, 0, 1), ("s", 2, 1, 0.75, 1, 0), ("s", 1, 1, None, 0, 0), ("t", 1, 2, 0.6, 0, 1), ("u", 1, 2, 0.9, 0, 1)]
    attn = spark.createDataFrame(rows, "sample_id string, src int, dst int, weight double, pos_i int, pos_j int")
    lengths = spark.createDataFrame([("s", 2048), ("t", 4096)], "sample_id string, length int")
    for kind in ("both", "upper"):
        got, want = pairs.attention_max(attn, kind, lengths=lengths), pairs.attention_max(pairs.by_length(attn, lengths), kind)
        assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("rows_of_a_task", [1_000_000, 5])
def test_expression_is_read_once(spark, monkeypatch, rows_of_a_task):
    monkeypatch.setattr(iterate, "TASK_ROWS", rows_of_a_task)
    expr, seen = counted(spark.createDataFrame([(f"s{i}", f"g{j}", float(i + j)) for i in range(4) for j in range(3)], "sample_id string, gene_id string, value double"))
    vocab = spark.createDataFrame([(f"g{j}", j, 1.0 + j) for j in range(3)], "gene_id string, token int, median double")

    def score(frames):
        for f in frames:
            yield f.explode("input_ids").assign(src=lambda x: x.input_ids, dst=lambda x: x.input_ids, pos_i=0, pos_j=0, weight=1.0)[["sample_id", "src", "dst", "pos_i", "pos_j", "weight"]].astype({"src": "int32", "dst": "int32"})

    out = pipelines.expression_to_weights(expr, vocab, score, "sample_id string, src int, dst int, pos_i int, pos_j int, weight double")
    got = {(r.src, r.dst): (r.weight, r.n) for r in out.collect()}
    assert got == {(j, j): (3 / 2048, 4) for j in range(3)} and seen.value == 12
