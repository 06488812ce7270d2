"""Periodic runs, exact nearest neighbours and lexical search against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from weftgraph.llm import op11_periodic_runs as op11
from weftgraph.llm import op12_exact_topk as op12
from weftgraph.llm import op13_lexical_search as op13

EXTRA = "n long, h long, w string, runs string, terms long, item long, items string, kind string, bound long, score long, rank int, v string, e string, norm double"


def plain_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            a = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x - a >= max(least - q, q):
                out.setdefault((a, x + q), q)
            x += 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng, letters):
    kind, words = rng.random(), []
    if kind < 0.3:
        return [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
    while len(words) < 60:
        u = [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        words += u * rng.randint(1, 6) + u[: rng.randint(0, len(u))]
    if kind < 0.6:
        return words
    u = [rng.randrange(letters) for _ in range(rng.randint(1, 3))]
    v = u * rng.randint(1, 20) + u[: rng.randint(0, len(u))]
    return v * rng.randint(1, 4) + ([9] + v if rng.random() < 0.5 else [])


def test_runs_equal_all_lags():
    rng = random.Random(4)
    for _ in range(400):
        a, b, least = made(rng, rng.choice([1, 2, 3, 5])), made(rng, 2), rng.choice([2, 3, 5, 12, 12])
        words = np.array([*a, -1, *b, -2], np.int64)
        got = op11.find(words, np.array([0] * (len(a) + 1) + [1] * (len(b) + 1)), least)
        shift = len(a) + 1
        want = plain_runs(a, least) + [(s + shift, n, q) for s, n, q in plain_runs(b, least)]
        assert sorted((s, e - s, q) for (s, e), q in got.items()) == sorted(want), (a, b, least)


def test_runs_of_rows(spark):
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(30_000)) + " x y" * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 12), (5, "a " * 11), (6, "a\vb\fc\r" * 5 + "é ß"), (6, "a\vb\fc\r" * 5 + "é ß"), (7, long), (8, "A a " * 6)]
    rows += [(100 + i, " ".join(f"t{w}" for w in made(rng, 4))) for i in range(60)]
    extra = [None] * EXTRA.count(",") + [None]
    docs = spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id long, text string, {EXTRA}")
    got = collections.Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in op11.periodic_runs(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(30_000, 60_000, 2)] if t is long else plain_runs(words)
        want[i, len(words), tuple(runs), plain_collapsed(words, runs)] += 1
    assert got == want
    assert op11.periodic_runs(docs.limit(0)).count() == 0


def test_planted_tails(spark, tmp_path):
    texts = [None, "", "one", "two words", " ".join(f"w{i}" for i in range(97))]
    rows = [(i, texts[i % 5]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (x - a) % p] if x >= a else w[x] for x in range(n)]
            changed += n > 2
        runs = plain_runs(w)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert changed > 20 and any(r.n_runs for r in got.values())


def plain_topk(vectors, queries, k):
    ids, best = sorted({i for i, _ in vectors}), {}
    for i, q in queries:
        for j, x in vectors:
            if i != j:
                s = sum(a * b for a, b in zip(q, x))
                best[i, j] = max(s, best.get((i, j), s))
    return {i: sorted(((-best[i, j], j) for j in ids if (i, j) in best))[:k] for i in {i for i, _ in queries}}


@pytest.mark.parametrize("scale,dim", [(1.0, 40), (65_000.0, 80), (0.01, 16)])
def test_topk_equals_all_products(spark, monkeypatch, scale, dim):
    monkeypatch.setattr(op12, "BLOCK_ROWS", 64)
    monkeypatch.setattr(op12, "PART_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.uniform(-1, 1, dim) * scale * rng.beta(2, 1)).tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1300)]  # a third are copies
    rows += [(8, rows[3][1]), (50, rows[9][1]), (1300, [0.0] * dim)]  # repeated ids, zeros
    bad = [(2000, None), (2050, [None] + [0.0] * (dim - 1)), (2051, [float("nan")] * dim), (2052, [float("inf")] * dim), (2053, [1.0] * (dim + 1)), (None, [1.0] * dim), (2054, []), (2055, [1e300] * dim)]
    extra = [None] * (EXTRA.count(",") + 1)
    table = spark.createDataFrame([(i, v, *extra) for i, v in rows + bad], f"vec_id long, embedding array<double>, {EXTRA}").repartition(4)
    got = collections.defaultdict(list)
    for r in op12.nearest(table, table.where("vec_id % 50 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    assert got == plain_topk(whole, [r for r in whole if r[0] % 50 == 0], 7)


def test_topk_of_few(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in op12.nearest(table, table.where("vec_id % 50 = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert op12.nearest(table.where("vec_id = 0"), table).where("query_id = 0").count() == 0
    assert op12.nearest(table.limit(0), table).count() == 0 and op12.nearest(table, table.limit(0)).count() == 0


def plain_search(docs, items, top):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    rows = [(i, collections.Counter(split(t))) for i, t in docs if i is not None and split(t)]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = collections.Counter(t for _, c in rows for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(split(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in rows:
            m = 50 + 50 * sum(c.values()) * n // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t]), i))
        best = sorted(((-s, i) for s, i in scores if s > 0))[:top]
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,cells,part", [(512, 4_000_000, 1000), (16, 60, 3)])
def test_search_equals_all_scores(spark, monkeypatch, block, cells, part):
    monkeypatch.setattr(op13, "BLOCK_DOCS", block)
    monkeypatch.setattr(op13, "TASK_CELLS", cells)
    monkeypatch.setattr(op13, "PART_ITEMS", part)
    rng = random.Random(5)
    word = lambda: f"W{int(rng.paretovariate(0.6)) % 900}é"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(250)]  # a third are copies
    docs += [(3, docs[3][1]), (4, "other words w1é w2é of the same id"), (2000, None), (2001, ""), (2002, "--- !!"), (None, "w1é w2é"), (2003, "w5é, " * 200_000 + "W7É w8é")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 30])))) for i in range(12)]
    items += [(3, "w1é w2é w1é"), (20, None), (21, ""), (None, "w1é"), (22, "never seen"), (23, docs[3][1])]
    extra = [None] * (EXTRA.count(",") + 1)
    d = spark.createDataFrame([(i, t, *extra) for i, t in docs], f"doc_id long, text string, {EXTRA}").repartition(3)
    q = spark.createDataFrame([(i, t, *extra) for i, t in items], f"item_id long, text string, {EXTRA}")
    got = sorted(tuple(r) for r in op13.search(d, q, 20).collect())
    assert got == plain_search(docs, items, 20)


def test_search_without_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert op13.search(d.limit(0), q).count() == 0 and op13.search(d, q.limit(0)).count() == 0
    assert [tuple(r) for r in op13.search(d, q).collect()] == plain_search([(1, "a b")], [(1, "a")], 50)
    # an index is built once and searched again
    index = op13.build(d)
    assert op13.search(d, q, 5, index).collect() == op13.search(d, q, 5).collect()
