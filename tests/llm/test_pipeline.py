"""The corpus pipeline against a plain version of each stage, on the smallest tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import string

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from weftgraph.llm import op2_pii as op2
from weftgraph.llm import op6_toxicity as op6

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_score(model, text):
    """Bias and the weights of the features that the text has, gram by gram."""
    have = set(op6.grams(text).tolist())
    at = [i for i, g in enumerate(model.features.tolist()) if g in have]
    return 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[i] * model.ratios[i] for i in at), -30, 30)))


def without_similar(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: t for i, t in texts.items() if find(i) == i}


def without_passages(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for t in items:
        w = cut(t)
        n = min(10, len(w))
        if n:
            windows.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    kept = {}
    for i, t in texts.items():
        w = cut(t)
        if not any(tuple(w[k : k + n]) in known for n, known in windows.items() for k in range(len(w) - n + 1)):
            kept[i] = t
    return kept


def redacted(text, booster):
    base = op2.base_spans(text)
    mark, first = [False] * len(text), {}
    for k, a, b in sorted(base + booster.added(text, base), key=lambda s: (s[1], -s[2])):
        if not mark[a]:
            first[a] = k
        mark[a:b] = [True] * (b - a)
    return "".join(f"[{first[i].upper()}]" if i in first else "" if mark[i] else c for i, c in enumerate(text))


def test_run_equals_the_plain_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = op6.fit(op6.training_rows(docs, labels))
    clean = {i: t for i, t in texts.items() if plain_score(model, t) < 0.5}
    single = without_similar(clean)
    left = without_passages(single, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert len(texts) > len(clean) > len(single) > len(left) > 0
    booster = op2.fit(spark.createDataFrame(list(left.items()), "doc_id long, text string"))

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in left.items():
        t = redacted(t or "", booster)
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(rows) == len(want)
    assert {r[0]: tuple(r[1:]) for r in rows} == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).selectExpr("doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == 5


def test_stages_on_repeats_long_texts_and_clashing_columns(spark):
    rng = random.Random(5)
    a, b, c = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(90)) for _ in range(3))
    long = " ".join(f"wörd{i % 977} x{i}" for i in range(30_000))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    rows = [
        (1, a), (1, a), (1, b), (2, a + " more"), (3, None), (4, ""), (5, long), (6, long), (None, c), (None, c), (7, c),
        (8, f"{item} {b[:200]}"), (8, "mail a.b@c.org now"), (9, " \t"),
    ]
    clash = "key string, node long, first long, n long, id long, sha string, hit_words string, component_id long, digest long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *[None] * 9) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")

    def texts(frame):
        assert frame.columns == list(corpus_pipeline.COLUMNS)
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)

    stages = dict(corpus_pipeline.STAGES)
    assert texts(stages["toxicity"](spark, docs, SF)) == sorted(rows, key=repr)
    gone = [(1, a), (2, a + " more"), (6, long)]
    assert texts(stages["near_duplicates"](spark, docs, SF)) == sorted((collections.Counter(rows) - collections.Counter(gone)).elements(), key=repr)
    assert texts(stages["decontaminate"](spark, docs, SF)) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)
    assert texts(stages["redact"](spark, docs, SF)) == sorted(((i, t and t.replace("a.b@c.org", "[EMAIL]")) for i, t in rows), key=repr)
    out = stages["tokens"](spark, docs, SF).collect()
    digest = collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in out) == digest
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
