"""Periodic runs of words: seeds on diagonals of a document, extended to maximal stretches of one lag.

A run of period q and length L has L - q words that equal the word q further on, so every k-gram among them, k being
the least such overlap, occurs twice at lag q. Lags are taken in classes: below ``least`` with k = least / 2, then
[B, 2B) with k = B, doubling B. In a class the pairs of equal k-grams of one document whose lag is of the class are
enumerated, and each is extended both ways; a table of how far a lag is covered skips the pairs that a found stretch
holds. A k-gram with a period of at most k / 2 lies in a run found before: it would pair with every later turn of that
run, so only the pairs are enumerated in which one side is the first of its run. The first seed of a stretch between two
such runs is of that kind, so nothing is lost, and a text of one word, repeated n times, has no n * n pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import table

LEAST = 12  # words of the shortest run
TASK_WORDS = 400_000  # words that are looked at together, about; a longer document is taken by itself
_BASE = 0xD6E8FEB86659FD93
_WORD = r"[^\x20\x09-\x0D]+"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Grams:
    """Hashes of the k-grams at given places, by prefix sums; equal k-grams of one document have equal hashes."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        power, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words.astype(np.uint64)) * np.multiply.accumulate(power)[:n], out=self.total[1:])
        self.inverse = np.multiply.accumulate(inverse)
        self.salt = _mixed(doc.astype(np.uint64))

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        return _mixed((self.total[places + k] - self.total[places]) * self.inverse[places]) ^ self.salt[places]


def _right(w: np.ndarray, i: int, lag: int) -> int:
    """The first place from i on whose word differs from the one lag further on."""
    step, last = 64, len(w) - lag
    while i < last:
        differ = w[i : min(i + step, last)] != w[i + lag : min(i + step, last) + lag]
        at = int(differ.argmax())
        if differ[at]:
            return i + at
        i, step = i + len(differ), step * 4
    return i


def _left(w: np.ndarray, i: int, lag: int) -> int:
    """The first place of the stretch of lag that ends before i."""
    step = 64
    while i > 0:
        a = max(0, i - step)
        differ = w[a:i] != w[a + lag : i + lag]
        if differ.any():
            return a + int(np.flatnonzero(differ)[-1]) + 1
        i, step = a, step * 4
    return i


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number and first, first + 1, ... (count of them)."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def _pairs(places: np.ndarray, group: np.ndarray, k: int, lags: tuple[int, int], runs: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, lag) of the equal k-grams, sorted places of each group in turn, with lags[0] <= lag < lags[1]."""
    key = group * (size + 1) + places
    base = key - places

    def partners(rows, low, high):
        a = np.searchsorted(key, base[rows] + np.clip(low, 0, size))
        b = np.searchsorted(key, base[rows] + np.clip(high, 0, size))
        row, at = _spread(a, np.maximum(b - a, 0))
        return rows[row], at

    # runs whose period is at most k / 2: where they hold k-grams, and up to where
    own, end = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    for (a, b), q in runs.items():
        if 2 * q <= k <= b - a:
            own[a : b - k + 1], end[a : b - k + 1] = a, b
    held = own[places]
    free = np.flatnonzero(held < 0)
    one = partners(free, places[free] + lags[0], places[free] + lags[1])
    first = np.flatnonzero(held == places)
    two = partners(first, np.maximum(places[first] + lags[0], end[places[first]] - k + 1), places[first] + lags[1])
    three = partners(first, places[first] - lags[1] + 1, places[first] - lags[0] + 1)
    i = places[np.concatenate((one[0], two[0], three[1]))]
    j = places[np.concatenate((one[1], two[1], three[0]))]
    return i, j - i


def find(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the maximal runs of ``least`` words or more, two periods at least.

    words: numbers, documents one after the other, each followed by a number of its own; doc: the document of each."""
    size, runs = len(words), {}
    grams, alive = _Grams(words, doc), np.arange(size)
    k, lags = max(1, -(-least // 2)), (1, max(least, 2))
    while True:
        alive = alive[alive + k <= size]
        h = grams.at(alive, k)
        order = np.argsort(h, kind="stable")
        h, places = h[order], alive[order]
        same = h[1:] == h[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
        if not twice.any():
            return runs
        group = np.cumsum(np.concatenate(([0], ~same)))[twice].astype(np.int64)
        places = places[twice]
        i, lag = _pairs(places, group, k, lags, runs, size)
        seeds = np.unique(lag * (size + 1) + i)
        at = 0
        while at < len(seeds):
            q, i = divmod(int(seeds[at]), size + 1)
            right = _right(words, i, q)
            if right - i >= k:
                left = _left(words, i, q)
                if right - left >= max(least - q, q):
                    runs.setdefault((left, right + q), q)  # lags ascend: the first one is the smallest period
            # covered up to right: the next seed of this lag begins after its last k-gram
            at = int(np.searchsorted(seeds, q * (size + 1) + max(right - k, i), "right"))
        alive = np.sort(places)
        k, lags = lags[1], (lags[1], 2 * lags[1])


def _look(texts: list, least: int):
    """Per text: words, runs (start, length, period) by start and period, and the words without repeated periods."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    begins = np.cumsum(counts + 1) - counts - 1
    size = int(counts.sum()) + len(split)
    ends = begins + counts
    words, doc = np.zeros(size, np.int64), np.repeat(np.arange(len(split)), counts + 1)
    inside = np.ones(size, bool)
    inside[ends] = False
    words[ends] = -1 - np.arange(len(split))
    words[inside] = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode().indices.to_numpy()
    found = find(words, doc, least)
    of = [[] for _ in split]
    for (a, b), q in found.items():
        d = int(doc[a])
        of[d].append((a - int(begins[d]), b - a, q))
    for s, n, runs in zip(split, counts, of):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            edge = np.zeros(n + 1, np.int64)
            for a, length, q in runs:
                edge[a + q] += 1
                edge[a + length] -= 1
            kept = np.flatnonzero(np.cumsum(edge[:n]) == 0)
            s = [s[x] for x in kept.tolist()]
        yield n, runs, b" ".join(s)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs(doc_id, text).

    runs: array of (start, length, period) by start and period: maximal stretches of words with smallest period
    ``period`` that are ``least`` words and two periods long at least. collapsed: the words, joined by one space, without
    those that a run holds after its first period. Words are split at ASCII white space.

    A null text has no words and no runs, like an empty one; a null doc_id stays. Each row is looked at by itself, so
    repeated rows have equal results. Texts are taken whole; memory follows the longest one. An empty table gives an
    empty result. Columns besides doc_id and text are ignored, whatever their names.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def look(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, room = a, TASK_WORDS * 6
                while b < len(texts) and (b == a or room > 0):
                    room -= len(texts[b] or "") + 1
                    b += 1
                rows = list(_look(texts[a:b], least))
                flat = np.array([r for _, runs, _ in rows for r in runs], np.int64).reshape(-1, 3)
                offsets = np.concatenate(([0], np.cumsum([len(runs) for _, runs, _ in rows]))).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), parts), pa.array([c.decode("utf-8", "surrogatepass") for _, _, c in rows]),
                ], ["doc_id", "n_words", "runs", "collapsed"])
                a = b

    runs = "array<struct<start: long, length: long, period: long>>"
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, n_words long, runs {runs}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), a tenth of them with a tail that repeats: the rows whose h = crc32(doc_id) ends in 0, with
    word i >= a replaced by word a + (i - a) % p; g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    # nullif: other rows have no words here
    a = g % F.when(n > 0, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turns = F.flatten(F.array_repeat(F.slice("w", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    tail = F.slice(turns, F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a.cast("int")), tail), " ")
    return some.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), listed.alias("listed"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.q")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.q")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b:
      list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) AS h
  FROM documents),
sized AS (SELECT doc_id, w0, h, len(w0) AS n, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM hashed),
doc AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
      list_transform(range(n), lambda i: w0[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END])
    ELSE w0 END AS w FROM sized),
gram AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM doc WHERE len(w) >= 12)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM island GROUP BY doc_id, q, k),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
digest AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    max({'length': length, 's': -start, 'q': -period}) AS top FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM doc) p
  WHERE NOT EXISTS (SELECT 1 FROM gone z WHERE z.doc_id = p.doc_id AND z.i = p.i) GROUP BY doc_id)
SELECT doc.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-top.s AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(-top.q AS BIGINT) AS period,
  CAST(1000 * top.length // -top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM doc LEFT JOIN digest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
