"""Rows that repeat a doc_id, with the same text or another: no row and no link is lost."""

import hashlib
import random

from weftgraph.llm import op1_suffix_dedup, op5_ngram_jaccard

RNG = random.Random(3)
A, B, C = (" ".join("".join(RNG.choices("abcdefghij", k=6)) for _ in range(120)) for _ in range(3))
SCHEMA = "doc_id long, text string"


def _components(spark, rows):
    got = op5_ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["doc_id"], r["component_id"]) for r in got)


def test_links_of_all_texts_of_an_id_count(spark):
    rows = [(1, A), (2, A), (2, B), (3, B + " extra")]
    assert _components(spark, rows) == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_rows_repeated_whole_and_ids_with_unlike_texts(spark):
    rows = [(1, A), (1, A), (4, B), (4, C), (5, C + " extra"), (6, B), (7, None), (7, None), (8, "")]
    assert _components(spark, rows) == [(1, 1), (1, 1), (4, 4), (4, 4), (5, 4), (6, 4), (7, 7), (7, 7), (8, 8)]


def _brute_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(d, first.get(b[k : k + window], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < d:
                gone[k : k + window] = b"\1" * window
        out.append((d, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_with_repeated_ids(spark):
    rows = [(1, A), (2, A), (2, B), (2, B), (3, B), (3, C + B[100:300]), (3, B[200:400] + C), (4, C), (5, None), (5, None), (5, "short")]
    got = op1_suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == _brute_repeats(rows)


def test_empty_table(spark):
    assert _components(spark, []) == []
