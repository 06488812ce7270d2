"""Removal of long repeated passages with a logarithmic family of suffix arrays.

Windows of ``window`` bytes that occur in more than one document are found by their anchors (anchors.py,
shared_keys.py). Segments around shared anchors are dealt by anchor; for each anchor bucket a family of sorted suffix
arrays is kept. Batches arrive in doc_id order: each gets a suffix array, is merge-scanned against the existing levels,
and what is new becomes a level; levels of like size merge, so a suffix is merged a logarithmic number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import anchors
from weftgraph.llm.common import materialize, partitions, table
from weftgraph.llm.shared_keys import bucket_bits, effective, shared_keys

WINDOW = 50
BROADCAST_IDS = 500_000  # rows at most in a broadcast (about 50 MB); more are joined by shuffle
DOCS_PER_PARTITION = 2000  # of the scan: bounds the suffixes that a task keeps
_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class SuffixFamily:
    """Levels of sorted, distinct window strings with the smallest document of each."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which strings also start in a smaller document; batches come in doc order."""
        order = np.argsort(strings, kind="stable")  # the batch's suffix array; equal strings stay in doc order
        ranked = strings[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        start = np.flatnonzero(head)
        new, first = ranked[start], docs[order][start]
        old = np.zeros(len(new), bool)
        for level, owner in self.levels:
            at = np.searchsorted(level, new)
            at[at == len(level)] = 0
            hit = level[at] == new
            first[hit] = np.minimum(first[hit], owner[at[hit]])
            old |= hit
        removed = np.empty(len(strings), bool)
        removed[order] = docs[order] > np.repeat(first, np.diff(np.append(start, len(ranked))))
        if not old.all():
            self.levels.append((new[~old], first[~old]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, owner = np.concatenate((b, a)), np.concatenate((y, x))
            merged = np.argsort(both, kind="stable")
            self.levels.append((both[merged], owner[merged]))
        return removed


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _anchor_keys(window: int):
    def keys(batch):
        owners, found = [], []
        for data, owner, bounds in anchors.packed(_text_bytes(batch.column(1)), window):
            piece, key, _, _ = anchors.window_anchors(data, bounds, window)
            owners.append(owner[piece]), found.append(key)
        return np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.uint64), *found])

    return keys


def _segments(batches, window: int, bits: int):
    """The text around each shared anchor of each document."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            ids, version = part.column("doc_id").to_numpy().astype(np.int64), part.column("version").to_numpy()
            texts = _text_bytes(part.column("text"))
            lists = part.column("keys")
            values = lists.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum([len(x) for x in lists])
            step = anchors._LONGEST // 2
            seen: dict[int, int] = {}
            for data, owner, bounds in anchors.packed(texts, window):
                piece, key, lo, hi = anchors.window_anchors(data, bounds, window)
                key = effective(key, bits)
                doc = owner[piece]
                wanted = np.zeros(len(key), bool)
                edges = np.searchsorted(doc, np.arange(owner[0], owner[-1] + 2)).tolist()
                for d, x, y in zip(range(owner[0], owner[-1] + 1), edges, edges[1:]):
                    if y > x:
                        wanted[x:y] = np.isin(key[x:y], values[ends[d - 1] if d else 0 : ends[d]])
                base = np.empty(len(owner), np.int64)
                for i, o in enumerate(owner.tolist()):
                    base[i] = seen.get(o, 0) * step
                    seen[o] = seen.get(o, 0) + 1
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                size = hi[at] - lo[at] + window
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                flat = np.arange(offsets[-1], dtype=np.int64) + np.repeat(lo[at] - offsets[:-1], size)
                segs = pa.Array.from_buffers(
                    pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[flat].tobytes())]
                )
                start = lo[at] - bounds[piece[at]] + base[piece[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at]), pa.array(ids[doc[at]]), pa.array(version[doc[at]]), pa.array(start), segs],
                    ["bucket", "doc_id", "version", "start", "seg"],
                )


def _scan(batches, window: int):
    """Removed stretches of each segment; rows come in doc_id order.

    A segment seen before needs no look-up: all its strings started in its first document. What is kept grows with the
    distinct segments of the partition, which the number of partitions bounds.
    """
    family, known = SuffixFamily(), {}
    for batch in batches:
        docs, start = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy()
        version, segs = batch.column("version").to_numpy(), batch.column("seg").to_pylist()
        fresh, gone = [], []
        for i, (s, d) in enumerate(zip(segs, docs.tolist())):
            if known.setdefault(s, d) < d:
                gone.append(i)
            else:
                fresh.append(i)
        rows, spans = [], []
        if fresh:
            fresh = np.array(fresh, np.int64)
            size = np.array([len(segs[i]) for i in fresh])
            data = np.frombuffer(b"".join(segs[i] for i in fresh), np.uint8)
            count = size - window + 1
            run = np.concatenate(([0], np.cumsum(count)))
            at = np.arange(run[-1]) - np.repeat(run[:-1], count)
            begin = np.repeat(np.cumsum(size) - size, count) + at
            views = np.lib.stride_tricks.sliding_window_view(data, window)
            strings = np.ascontiguousarray(views[begin]).view(f"S{window}").ravel()
            row = np.repeat(fresh, count)
            removed = family.add(strings, docs[row])
            on, off = removed.copy(), removed.copy()
            on[1:] &= ~(removed[:-1] & (row[1:] == row[:-1]))
            off[:-1] &= ~(removed[1:] & (row[1:] == row[:-1]))
            rows.append(row[on])
            spans.append((start[row[on]] + at[on]) << 20 | (at[off] - at[on] + window))
        if gone:
            rows.append(np.array(gone))
            spans.append(start[gone] << 20 | np.array([len(segs[i]) for i in gone]))
        if rows:
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[rows]), pa.array(version[rows]), pa.array(np.concatenate(spans))], ["doc_id", "version", "span"]
            )


def _covered(spans: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the spans cover."""
    lo, hi = spans >> 20, np.minimum((spans >> 20) + (spans & 0xFFFFF), n)
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return lo[start], reach[np.append(start[1:], len(lo)) - 1]


def _apply(batches, full: bool):
    for batch in batches:
        out = []
        texts = _text_bytes(batch.column("text"))
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans")):
            kept, removed, runs = text, 0, 0
            if spans.is_valid and len(spans):
                lo, hi = _covered(spans.values.to_numpy(), len(text))
                at = [0, *hi.tolist()]
                kept = b"".join(text[a:b] for a, b in zip(at, [*lo.tolist(), len(text)]))
                removed, runs = int((hi - lo).sum()), len(lo)
            row = (doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "replace")) if full else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * full
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema(
            [(n, pa.string() if n in ("kept_sha256", "kept_text") else pa.int64()) for n in names]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, digest of (and, if asked for, the) remaining text.

    A byte goes if a ``window``-byte string over it also starts in a document with a smaller doc_id. Null texts are
    empty; shorter texts lose nothing; rows with a null doc_id have no place in the order and are left out; rows that
    repeat a doc_id, with the same text or another, remove nothing from each other and each has a row of its own. Very
    long texts are taken whole; without rows the result is empty. Columns besides doc_id and text are ignored. Cuts may leave incomplete UTF-8 sequences, which kept_text replaces and kept_sha256 does not.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(text, 256))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), sha.alias("sha"))
    digest = docs.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    first = digest.where(F.col("n_bytes") >= window).groupBy("sha").agg(F.min("doc_id").alias("rep"))
    copies = materialize(digest.join(first, "sha").where("doc_id > rep").select("doc_id", "sha", "n_bytes"), "copies")
    n_docs, gone = docs.count(), copies.select("doc_id", "sha").distinct()
    reps = docs.join(F.broadcast(gone) if copies.count() <= BROADCAST_IDS else gone, ["doc_id", "sha"], "left_anti")
    # A row is known by its id and its text's hash: ids may be repeated with other texts.
    reps = reps.select("doc_id", F.hash("sha").alias("version"), "text").withColumn("row", F.xxhash64("doc_id", "version"))
    bits = bucket_bits(n_docs)
    found = shared_keys(reps.select("row", "text"), _anchor_keys(window), n_docs)
    lists = found.groupBy(F.col("id").alias("row")).agg(F.collect_list("key").alias("keys"))
    segments = reps.join(lists, "row").select("doc_id", "version", "text", "keys")
    segments = segments.mapInArrow(
        lambda it: _segments(it, window, bits), "bucket long, doc_id long, version int, start long, seg binary"
    )
    spans = (
        segments.repartition(max(partitions(spark), n_docs // DOCS_PER_PARTITION), "bucket")
        .sortWithinPartitions("doc_id")
        .mapInArrow(lambda it: _scan(it, window), "doc_id long, version int, span long")
    )
    spans = spans.groupBy("doc_id", "version").agg(F.collect_list("span").alias("spans"))
    schema = f"doc_id long, {_DIGEST}" + ", kept_text string" * keep_text
    # both joins deal the texts by row alone, so that they are shuffled once; what else must agree is no key of the join
    found = spans.select(F.xxhash64("doc_id", "version").alias("r"), F.col("doc_id").alias("d"), F.col("version").alias("v"), "spans")
    agree = (F.col("row") == F.col("r")) & (F.col("doc_id").bitwiseXOR(F.col("d")) == 0) & (F.col("version").bitwiseXOR(F.col("v")) == 0)
    kept = reps.join(found, agree, "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _apply(it, keep_text), schema)
    whole = copies.select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"), *[F.lit("").alias("kept_text")] * keep_text,
    )
    return kept.unionByName(whole)


ORACLE_SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), blocks AS (
  SELECT doc_id, o, substr(x, 2 * o + 1, 610) AS y
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 256)) AS o FROM bytes)
), windows AS (
  SELECT doc_id, o + j AS i, hash(substr(y, 2 * j + 1, 100)) AS h
  FROM (SELECT doc_id, o, y, unnest(range(greatest(0, least(256, length(y) // 2 - 49)))) AS j FROM blocks)
), early AS (
  SELECT h, min(doc_id) AS d FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), starts AS (
  SELECT w.doc_id, w.i FROM windows w JOIN early e ON w.h = e.h AND w.doc_id > e.d
), ordered AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS head FROM starts
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ordered)
  GROUP BY doc_id, run
), gaps AS (
  SELECT r.doc_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS before FROM runs r
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(g.b - g.a) AS n_removed, max(g.b) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (g.a - before)), '' ORDER BY g.a) AS k
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
