"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents lie in blocks of similar numbers of distinct terms. A block is a matrix of bits, a slice for each
position of a Bloom signature, with a bit for each document; so the documents that may hold a term are the conjunction of
the term's slices. A term that occurs tf times is put in at every level 1, 2, 3, 4, 6, 8, 12 ... up to tf, so that the levels
bound how often it occurs. Besides, the index has each document's number of terms and each task's counts of documents by term.

Search: the levels of a query's terms, times what a term is worth at most at its level, add up to an upper bound of each
document's score, which Bloom signatures never put too low. The documents with the highest bounds are scored exactly
from their texts; their k-th best score is the threshold, and every other document whose bound reaches it is scored too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, table

TOP = 50
BLOCK_DOCS = 512  # documents of a block at most, whose slices have 64 bytes each then
BLOCK_BITS = 8_000_000  # bits of a block, about, unless one document has more
TASK_BYTES = 4_000_000  # texts that are indexed together, about; their documents are dealt to blocks by size
HASHES = 6
BITS_PER_TERM = 16  # of the largest document of a block: at most some 0.1 % of absent terms look present
LEVELS = np.unique([*(1 << k for k in range(40)), *(3 << k for k in range(40))])  # occurrences that each level stands for
PART_ITEMS = 1_000  # items of one scan of the index, about: what is broadcast at a time
TASK_CELLS = 1_000_000  # terms of items times documents that are weighed together
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BLOCK = "kind string, ids binary, sizes binary, slices binary, width int, terms array<binary>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def _hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def _places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """(terms, HASHES): the slices of a term at a level (0: once or more, 1: twice or more ...)."""
    h = (hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(width)).astype(np.int64)


def _blocks(ids: np.ndarray, texts: list):
    """Rows of the index for some documents: their blocks, then one row with the counts of documents by term."""
    split = [terms_of(t) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    words = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    names = words.dictionary.to_pylist()
    if not names:
        return
    # (document, term) pairs with how often each occurs
    pair, tf = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(names) + words.indices.to_numpy(), return_counts=True)
    doc, term = pair // len(names), pair % len(names)
    levels = np.searchsorted(LEVELS, tf, "right")
    keys = np.bincount(doc, levels, len(texts)).astype(np.int64)
    hashes = np.array([_hash(n) for n in names], np.uint64)
    order = np.argsort(keys, kind="stable")
    order = order[sizes[order] > 0]  # a document without terms is found by nothing
    begins = np.searchsorted(doc, np.arange(len(texts) + 1))
    width_of = np.maximum(64, keys[order] * BITS_PER_TERM)
    a = 0
    while a < len(order):
        # widths rise, so the block is as wide as its last document
        cells = width_of[a : a + BLOCK_DOCS] * np.arange(1, len(order[a : a + BLOCK_DOCS]) + 1)
        b = a + max(1, int(np.searchsorted(cells, BLOCK_BITS, "right")))
        mine, width = order[a:b], int(width_of[b - 1])
        a = b
        bits = np.zeros((width, len(mine)), bool)
        count = begins[mine + 1] - begins[mine]
        row = np.repeat(np.arange(len(mine)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begins[mine][row]
        for level in range(int(levels[at].max())):
            on = levels[at] > level
            bits[_places(hashes[term[at[on]]], level, width), row[on, None]] = True
        yield "block", ids[mine].tobytes(), sizes[mine].tobytes(), np.packbits(bits, axis=1).tobytes(), width, None, None
    yield "terms", None, None, None, None, names, np.bincount(term, minlength=len(names)).astype(np.int32)


def build(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text) as rows of two kinds: blocks of signatures, and counts of documents by term."""
    def index(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, room = a, TASK_BYTES
                while b < len(texts) and (b == a or room > 0):
                    room -= len(texts[b] or "")
                    b += 1
                for row in _blocks(ids[a:b], texts[a:b]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], t) for c, t in zip(row, (pa.string(), *[pa.binary()] * 3, pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32())))],
                        ["kind", "ids", "sizes", "slices", "width", "terms", "counts"])
                a = b

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(index, _BLOCK), "signatures")


def _share(tf, m):
    """What tf occurrences are worth in a document of measure m, in integers."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _bound(sent, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(items, documents): sums of the weighted slices; rows: slices of some documents, n: their numbers of terms."""
    hashes, _, term, weight, starts, total, terms = sent
    m = 50 + 50 * n * total // terms
    worth = np.zeros((len(hashes), len(n)), np.int64)
    some, there, level = np.arange(len(hashes)), None, 0
    while len(some):
        both = np.bitwise_and.reduce(rows[_places(hashes[some], level, len(rows))], axis=1)
        both = both if there is None else both & there
        on = both.any(axis=1)
        some, there = some[on], both[on]
        if len(some):
            # at this level, and not at the next: fewer times than that stands for, and at most n
            most = _share(np.minimum(LEVELS[level + 1] - 1, n), m)
            worth[some] = np.where(np.unpackbits(there, axis=1, count=len(n)).astype(bool), most, worth[some])
        level += 1
    return np.add.reduceat(worth[term] * weight[:, None], starts, axis=0)


def _bounds(sent, least, top: int):
    """mapInArrow function over blocks: (item, doc_id, bound) of documents; without thresholds the ``top`` highest bounds of
    each item in the task, with them all that reach the item's threshold."""
    def scan(batches):
        _, item, term, _, _, _, _ = sent.value
        step = max(1, TASK_CELLS // len(term) // 8)  # bytes of a slice that are looked at together
        held = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, slices = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.uint8)))
                rows = slices.reshape(batch.column(3)[i].as_py(), -1)
                for a in range(0, -(-len(ids) // 8), step):
                    some = ids[8 * a : 8 * (a + step)]
                    bound = _bound(sent.value, rows[:, a : a + step], sizes[8 * a : 8 * (a + step)])
                    if least is not None:
                        low, last = least.value
                        # a document that only ties with the k-th best must come before it
                        who, doc = np.nonzero((bound > low[:, None]) | ((bound == low[:, None]) & (some < last[:, None])))
                        if len(who):
                            yield pa.RecordBatch.from_arrays([pa.array(item[who]), pa.array(some[doc]), pa.array(bound[who, doc])], ["item", "doc_id", "bound"])
                        continue
                    for k, b in enumerate(bound):
                        old_ids, old = held.get(k, (ids[:0], b[:0]))
                        on = b > (old.min() if len(old) >= top else 0)
                        if not on.any():
                            continue
                        all_ids, both = np.concatenate((old_ids, some[on])), np.concatenate((old, b[on]))
                        first = np.argsort(-both, kind="stable")[:top]
                        held[k] = all_ids[first], both[first]
        for k, (some, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), item[k])), pa.array(some), pa.array(b)], ["item", "doc_id", "bound"])

    return scan


def _scored(docs: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """(item, doc_id, score) of pairs(item, doc_id), exact, from the documents' whole texts; a row for each row of docs."""
    def score(batches):
        wanted, total, terms = sent.value
        for batch in batches:
            out = []
            for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = terms_of(text)
                if not words:
                    continue
                count = {}
                for w in words:
                    count[w] = count.get(w, 0) + 1
                m = 50 + 50 * len(words) * total // terms
                for i in items:
                    got = sum(w * _share(count[t], m) for t, w in wanted[i] if t in count)
                    if got > 0:
                        out.append((i, doc_id, got))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    some = pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.join(some, "doc_id").select("doc_id", "text", "items").mapInArrow(score, "item long, doc_id long, score long"), "scored")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items(item_id, text) the ``top`` documents with the highest scores
    above 0, equal scores by doc_id. index: what ``build`` has returned for docs; built if None.

    Null texts and texts without terms, of items as of documents, find nothing and are not found; they don't count among
    the documents. Rows with a null item_id or doc_id are left out. A repeated doc_id is ranked once a row, by its own
    text. Rows that repeat an item_id are one item with the terms of all. Texts are taken whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = build(docs) if index is None else index
    blocks = index.where("kind = 'block'").select("ids", "sizes", "slices", "width")
    # N and L: from the sizes in the index
    def sizes(batches):
        n = total = 0
        for batch in batches:
            for s in batch.column(0).to_pylist():
                s = np.frombuffer(s, np.int64)
                n, total = n + len(s), total + int(s.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "terms"])

    whole = blocks.select("sizes").mapInArrow(sizes, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    kind = dict(items.dtypes)["item_id"]
    named = items.where("item_id is not null and text is not null").select("item_id", "text")
    names = materialize(named.select("item_id").distinct().withColumn("item", F.xxhash64("item_id")), "items")
    parts = -(-names.count() // PART_ITEMS)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not whole["n"] or not parts:
        return out
    n, terms = whole["n"], whole["terms"]
    found = None
    for p in range(parts):
        mine = named.where(F.pmod(F.xxhash64("item_id", F.lit(13)), F.lit(parts)) == p)
        rows = mine.select(F.xxhash64("item_id").alias("item"), "text").toPandas()  # PART_ITEMS about
        wanted = {}
        for i, t in zip(rows["item"].tolist(), rows["text"]):
            wanted.setdefault(i, set()).update(terms_of(t))
        wanted = {i: sorted(t) for i, t in wanted.items() if t}
        listed = sorted(set().union(*wanted.values()))
        if not listed:
            continue
        asked = spark.createDataFrame([(t,) for t in listed], "term binary")
        counts = index.where("kind = 'terms'").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("c"))
        df = counts.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("c").alias("df"))
        weight = {bytes(r["term"]): math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in df.collect()}  # a row for each term of the part
        wanted = {i: [(t, weight[t]) for t in ts if t in weight] for i, ts in wanted.items()}
        wanted = {i: ts for i, ts in wanted.items() if ts}
        if not wanted:
            continue
        listed = sorted(weight)
        number = {t: k for k, t in enumerate(listed)}
        sent = spark.sparkContext.broadcast((
            np.array([_hash(t) for t in listed], np.uint64), np.array(list(wanted), np.int64),
            np.array([number[t] for ts in wanted.values() for t, _ in ts]), np.array([w for ts in wanted.values() for _, w in ts], np.int64),
            np.cumsum([0] + [len(ts) for ts in wanted.values()])[:-1], n, terms,
        ))
        exact = spark.sparkContext.broadcast((wanted, n, terms))
        schema = "item long, doc_id long, bound long"
        high = blocks.mapInArrow(_bounds(sent, None, top), schema)
        high = high.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))).where(F.col("r") <= top)
        high = materialize(high.select("item", "doc_id"), "high")
        one = _scored(docs, high, exact)
        kth = one.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("r") == top)
        kth = {r["item"]: (r["score"], r["doc_id"]) for r in kth.collect()}  # a row for each item of the part
        least = spark.sparkContext.broadcast(np.array([kth.get(i, (0, -(1 << 63))) for i in wanted], np.int64).T)
        rest = blocks.mapInArrow(_bounds(sent, least, top), schema).select("item", "doc_id")
        rest = materialize(rest.join(high, ["item", "doc_id"], "left_anti"), "rest")
        both = one.unionByName(_scored(docs, rest, exact))
        found = both if found is None else found.unionByName(both)
    if found is None:
        return out
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return best.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH term AS (
  SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL)),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY 1),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
measured AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM size, whole),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM wanted) GROUP BY 1, 2),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (t) JOIN weight USING (t) JOIN measured USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 50
"""
