"""Exact nearest neighbours by integer inner product: columns scanned group by group under bounds on what remains.

Vectors of integers lie in blocks in vertical layout: a matrix for every few dimensions, and for each vector the norm of
what remains from there on; blocks are dealt by falling norm. A scan adds up the products of one matrix after the other.
After each, those candidates go whose partial product plus |rest of query| * |rest of candidate| is below the query's
threshold, and the others are compacted. What is added up to the end is the exact product. The threshold is the k-th
best product found: in a first scan of the blocks of the largest norms, then in the blocks that a task has scanned since.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, table

NEAREST = 5
COLUMNS = 16  # dimensions of a group
BLOCK_ROWS = 4096  # vectors of a block, about
PART_ROWS = 65_536  # queries of one scan, about: what is broadcast at a time (34 MB with 64 dimensions)
FIRST_SHARE = 16  # one of so many blocks is scanned first
LIMIT = 1 << 24  # components are below it in size, so that products of up to 32,768 dimensions fit in 64 bits
_NONE = -(1 << 63)  # threshold of a query that has found fewer than k
_FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v = floor(scale * component). Left out: null ids, null and empty vectors, and those with a component
    that is null, not finite, or 2^24 or more in size once scaled."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LIMIT))
    kept = rows.where(F.col("e").isNotNull() & (F.size("e") > 0)).where(good)
    return kept.select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists that all have dim elements."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False).reshape(-1, dim)


def _order(rows: DataFrame, dim: int) -> np.ndarray:
    """Dimensions by falling sum of squares, so that little remains early; tasks add up, then Spark adds a row of each."""
    def add(batches):
        total = np.zeros(dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["at", "e"])

    sums = rows.select("v").mapInArrow(add, "at int, e double").groupBy("at").agg(F.sum("e").alias("e"))
    return np.array([r["at"] for r in sums.orderBy(F.desc("e"), "at").collect()])  # a row for each dimension


def _rests(x: np.ndarray) -> np.ndarray:
    """Norms of what remains from each group of dimensions on."""
    squares = x.astype(np.float64) ** 2
    return np.sqrt(np.stack([squares[:, a:].sum(axis=1) for a in range(0, x.shape[1], COLUMNS)]))


def columnar(rows: DataFrame, dim: int, order: np.ndarray) -> DataFrame:
    """(norm, ids, columns, rest): blocks of rows(vec_id, v) by falling norm, written as a table. norm: the largest one;
    columns: matrices of rows by COLUMNS, one after the other, dimensions in the given order."""
    def pack(batches):
        ids, held, have = [], [], 0

        def block():
            x = np.concatenate(held)[:, order]
            rest = _rests(x)
            columns = b"".join(np.ascontiguousarray(x[:, a : a + COLUMNS]).tobytes() for a in range(0, dim, COLUMNS))
            cells = [float(rest[0].max())], [np.concatenate(ids).tobytes()], [columns], [rest.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["norm", "ids", "columns", "rest"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                ids.append(part.column(0).to_numpy())
                held.append(_matrix(part.column(1), dim))
                have += part.num_rows
                if have >= BLOCK_ROWS:
                    yield block()
                    ids, held, have = [], [], 0
        if have:
            yield block()

    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    # equal norms are told apart by the id, so that a range is never one norm
    dealt = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return materialize(dealt.select("vec_id", "v").mapInArrow(pack, "norm double, ids binary, columns binary, rest binary"), "columns")


def _top(ids: np.ndarray, scores: np.ndarray, k: int, distinct: bool):
    """The k best ids by falling score, then id; an id counts once, with its best score."""
    if distinct and len(ids) > k:
        on = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[on], scores[on]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if not distinct:
        first = np.sort(np.unique(ids, return_index=True)[1])
        ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


def _survivors(first, r, q, rest_q, slack, floor, parts, rest):
    """(rows, exact products) of the candidates that no bound excludes; first: their products over the first group."""
    alive, partial = None, first
    for b in range(1, len(parts)):
        if floor > _NONE:
            ahead = rest[b] if alive is None else rest[b][alive]
            on = np.flatnonzero(partial + (rest_q[b, r] * ahead + slack) >= floor)
            alive, partial = on if alive is None else alive[on], partial[on]
            if not len(alive):
                break
        mine = parts[b] if alive is None else parts[b][alive]
        partial = partial + mine @ q[r, b * COLUMNS : (b + 1) * COLUMNS].astype(mine.dtype)
    alive = np.arange(len(partial)) if alive is None else alive
    score = partial.astype(np.int64)
    on = score >= floor
    return alive[on], score[on]


def _scanner(sent, dim: int, k: int):
    """mapInArrow function over blocks: of each query that was sent, the k best candidates of the task's blocks."""
    def scan(batches):
        qid, q, rest_q, given = sent.value
        least, best = given.copy(), {}  # thresholds rise in a task
        for batch in batches:
            for ids, columns, rest in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                ids = np.frombuffer(ids, np.int64)
                n, distinct = len(ids), len(np.unique(ids)) == len(ids)
                rest = np.frombuffer(rest, np.float64).reshape(-1, n)
                top = rest[0].max()
                # doubles hold the sums exactly up to 2^53; beyond, 64-bit integers do
                kind = np.float64 if rest_q[0].max() * top < 2.0**52 else np.int64
                parts, at = [], 0
                for a in range(0, dim, COLUMNS):
                    wide = min(COLUMNS, dim - a)
                    parts.append(np.frombuffer(columns, np.int32, n * wide, at).reshape(n, wide).astype(kind))
                    at += 4 * n * wide
                for g in range(0, len(qid), 256):
                    reach = rest_q[0, g : g + 256] * top * (1 + 1e-9)
                    rows = g + np.flatnonzero(reach >= least[g : g + 256])  # the longest vector of the block may do
                    if not len(rows):
                        continue
                    firsts = q[rows, : parts[0].shape[1]].astype(kind) @ parts[0].T
                    for r, first in zip(rows.tolist(), firsts):
                        slack = 1e-9 * rest_q[0, r] * top
                        alive, score = _survivors(first, r, q, rest_q, slack, least[r], parts, rest)
                        other = ids[alive] != qid[r]
                        if not other.any():
                            continue
                        new, score = _top(ids[alive[other]], score[other], k, distinct)
                        if r in best:
                            new, score = _top(np.concatenate((best[r][0], new)), np.concatenate((best[r][1], score)), k, False)
                        best[r] = new, score
                        if len(new) == k:
                            least[r] = max(least[r], score[-1])
        if best:
            rows = list(best)
            cells = [np.repeat(qid[rows], [len(best[r][0]) for r in rows]), *(np.concatenate([best[r][c] for r in rows]) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "vec_id", "score"])

    return scan


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the k largest inner products, exact, its own id excepted.

    Components become floor(scale * component). See ``integers`` for what takes no part; vectors of another dimension than
    the most frequent one (ties: the smaller) take no part either. Ties go to the smaller vec_id. A repeated vec_id is a
    candidate once, with its best product; a repeated query has its best candidates over its rows. With fewer candidates
    than k all are returned, without any no row. Zero vectors take part. Columns besides vec_id and embedding are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, scale), "integers")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    wanted = None if common is None else materialize(integers(queries, scale).where(F.size("v") == common["d"]), "queries")
    asked = 0 if common is None else wanted.count()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = common["d"]
    rows = rows.where(F.size("v") == dim)
    order = _order(rows, dim)
    blocks = columnar(rows, dim, order)
    cut = blocks.agg(F.percentile_approx("norm", 1 - 1 / FIRST_SHARE, 1000)).first()[0]
    parts, found = -(-asked // PART_ROWS), None
    for p in range(parts):
        part = wanted.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(parts)) == p).toPandas()  # PART_ROWS about
        if not len(part):
            continue
        q = np.stack(part["v"].to_list()).astype(np.int32)[:, order]
        qid = part["vec_id"].to_numpy(np.int64)

        def scanned(some: DataFrame, least: np.ndarray) -> DataFrame:
            sent = spark.sparkContext.broadcast((qid, q, _rests(q), least))
            return materialize(_best(some.mapInArrow(_scanner(sent, dim, k), _FOUND), k).drop("rank"), "found")

        one = scanned(blocks.where(F.col("norm") >= cut), np.full(len(qid), _NONE))
        known = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        known = {r["query_id"]: r["least"] for r in known.collect()}  # a row for each query of the part
        least = np.array([known.get(i, _NONE) for i in qid.tolist()], np.int64)
        two = scanned(blocks.where(F.col("norm") < cut), least)
        both = one.unionByName(two)
        found = both if found is None else found.unionByName(both)
    return _best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pair)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
