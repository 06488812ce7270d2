"""The text operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import op1_suffix_dedup as op1
from weftgraph.llm import op2_pii as op2
from weftgraph.llm import op3_ann as op3
from weftgraph.llm import op4_token_ids as op4
from weftgraph.llm import op5_ngram_jaccard as op5
from weftgraph.llm import op6_toxicity as op6
from weftgraph.llm import op7_decontaminate as op7
from weftgraph.llm import op8_byte_bpe as op8
from weftgraph.llm import op9_kd_shards as op9
from weftgraph.llm import op10_url_trust as op10

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1].upper(), base[2].replace(" ", "\n", 9)]
    for i in range(20):
        w = base[3].split()
        w[rng.randrange(120)] = word()
        texts.append(" ".join(w))
    texts += [base[4][:400] + " " + base[5][100:700], "", None, "one", "one", " \t ", "a" * 300, "a" * 180, "x" + "a" * 60, base[6] * 30]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "clash") for i, t in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_repeats_equal_brute_force(docs):
    first, want = {}, {}
    for i, t in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in op1.remove_repeats(docs).collect()} == want


def test_repeats_of_an_empty_table(docs):
    assert op1.remove_repeats(docs.limit(0)).count() == 0


def test_similar_documents_equal_brute_force(docs):
    sets = {}
    for i, t in corpus():
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_pairs_share_an_early_key_under_every_order_whichever_component_is_main(spark):
    """The main component is that of 1, of 2, or a third one by turns."""
    rows = []
    for o in range(op5.ORDERS):
        for key in range(3):
            rows += [(o, key, 11, 1, 100, 0, 1), (o, key, 11, 2, 100, 0, 2)]
            rows += [(o, key, 0, 1000 * (key % 3 + 1) + i, 9, 0, key % 3 + 1) for i in range(3)]
    places = spark.createDataFrame(rows, "o int, key long, place long, doc long, n long, own long, comp long")
    pairs = lambda p: [(r.a, r.b) for r in op5._candidate_pairs(p).collect() if r.b < 1000]
    assert pairs(places) == [(1, 2)]
    assert pairs(places.where("o = 0 or key > 5")) == []
    assert pairs(places.withColumn("place", F.col("place") + 1)) == []  # 88 of 100 each are not 4/9 of 200


def test_base_spans_equal_the_plain_patterns():
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    rng = random.Random(2)
    parts = ["1", "2", "12", "255", ".", "@", "a", "b.", "+1", "+", " ", "-", "(", ")", "4111111111111111", "x@y.z", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        want = []
        for k, p in kinds.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if k == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[k]
                want += [(k, *m.span())] * ok
        assert op2.base_spans(t) == want


def test_redaction_keeps_rows_and_columns(spark, docs):
    more = spark.createDataFrame([(99, "mail a.b@c.org or +1 (555) 123-4567", "en", "s", 3, "x")], docs.schema)
    got = {r.doc_id: r.text for r in op2.redact(docs.unionByName(more), op2.Booster()).collect()}
    assert got[99] == "mail [EMAIL] or [PHONE]" and got[38] is None and len(got) == docs.count() + 1


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 32, 0), (2001, [float("nan")] * 32, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in op3.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hits = sum(len({i for i, _ in got[q]} & set(np.argsort(-s[q])[:20].tolist())) for q in range(0, 1500, 20))
    assert hits >= 0.9 * 75 * 20 and set(got) == set(range(0, 1500, 20)) and all(len(g) == 20 for g in got.values())
    assert all(abs(score - s[q, i]) < 1e-9 for q in got for i, score in got[q])
    assert op3.nearest(v.limit(0), v).count() == 0


def test_token_blocks_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in op4.token_blocks(docs, path, str(tmp_path / "t")).collect()}
    at = 0
    for i, text in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (at, len(ids), zlib.crc32(raw))
        at += len(ids)


def test_variable_length_coding():
    r = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], np.uint32)
    for n in range(len(r) + 1):
        assert op4.unpack(*op4.pack(r[:n]), n).tolist() == r[:n].tolist()


def test_what_is_kept_of_words_changes_no_ids():
    from weftgraph.llm.spans_cache import Encoded

    bpe = op8.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab!") * rng.randint(1, 70) + rng.choice(["", "ing", ", ", "\n"]) for _ in range(40)) for _ in range(600)]
    few, many = (Encoded(bpe._after, bpe._alone, kept) for kept in (5, 1 << 20))
    assert few(texts) == many(texts)
    assert len(few.known.older) < len(many.known)


def test_bpe_equals_the_library(docs):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = op8.load(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "the", "tion", " ", "  ", "\n", "1", "23", "é", "!", "\xa0", "😀", "ing", "'s", "'", "\t", "\x85", "\x1c", "zz", "aaaa"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(bpe.encode([s])[0], "<u4").tolist() == enc.encode_ordinary(s)
    rows = op8.round_trip(docs, path, public_tokenizers.PATTERN, text_too=True).collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in corpus()}


def test_contamination_equals_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    texts = dict(corpus())
    items = [(1, " ".join(texts[7].split()[20:45])), (2, "One"), (3, None), (10, "..."), (4, " ".join(texts[8].split()[:10]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts.items():
        w, hit, ids = cut(t), set(), set()
        for k, x in items:
            x = cut(x)
            n = min(10, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(k))
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    assert {r[0]: tuple(r[1:]) for r in op7.contamination(docs, bench).collect()} == want
    assert op7.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert {r.doc_id for r in op7.remove_documents(docs, bench).collect()} == {i for i in want if not want[i][4]}


def test_shards_are_even_and_slots_gapless(spark):
    d = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.concat(F.lit("w"), "id"), (F.col("id") % 40).cast("int"))).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 40).alias("n_chars"))
    rows = op9.kd_shards(d).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])
    assert op9.kd_shards(d.limit(0)).count() == 0


def test_url_rules_and_propagation(spark):
    rows = [
        (1, "https://A.example.com/en/7?x", '<a href="http://good.org/x">'), (2, "http://b.example.com/en/1", '<a href="//bad.org/">'), (3, "http://bad.org/q", '<a href="http://b.example.com/en/2">'),
        (4, "http://good.org", None), (5, None, "x"), (6, "no scheme", ""), (7, "http://x.net/de/5#a", ""), (8, "http://example.net/de/8", ""), (9, "http://far.org/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op10.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "allow") and got[5] == ("", "", None, "allow") == got[6]
    assert got[7][2:] == ("net/de/", "allow") and got[8][2:] == ("example.net/de/8", "block") and got[9][3] == "allow"


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    plain = ["tree", "river", "stone", "walk", "green", "paper", "light", "window"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 6 == 0:
            words[rng.randrange(60)] = "vileword"
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op6.fit(d.where("doc_id % 5 > 0"))
    got = {r.doc_id: r.predicted for r in op6.score(d, model).collect()}
    assert sum(got[i] == t for i, _, t in rows) >= 595
    assert op6.score(d.select("doc_id", F.lit(None).cast("string").alias("text")), model).first().score < 1
    assert len(op6.fit(d.where("toxic = 0")).features) == 0


def test_toxicity_counts_do_not_depend_on_batches(spark):
    rows = [(i, f"{'vile' if i % 4 == 0 else 'calm'} {i % 7} words", int(i % 4 == 0)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    c = [collections.Counter(int(g) for _, t, y in rows if y == k for g in op6.grams(t)) for k in (0, 1)]
    want = {g: np.log((c[1][g] + 1) / 12) - np.log((c[0][g] + 1) / 32) for g in {*c[0], *c[1]}}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (1, 7, 10_000):
            spark.conf.set(size, n)
            model = op6.fit(d.repartition(5))
            assert dict(zip(model.features.tolist(), model.ratios)) == pytest.approx(want)
    finally:
        spark.conf.set(size, before)


def test_pipeline_runs(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
