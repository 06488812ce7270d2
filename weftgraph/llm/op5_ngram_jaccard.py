"""N-gram Jaccard join by prefixes under several global orders of the shingles.

Two documents of Jaccard similarity 0.8 with n and m shingles have at least a = ceil(4 (n + m) / 9) in common, so they
share a shingle among the first n - a + 1 and m - a + 1 of each, whatever order is used for all. Candidates must do so
under every one of ``ORDERS`` orders; what passes all filters is verified on whole shingle sets.

All orders put shingles that one document has first, then the rarer before the more frequent ones; they differ among
shingles that are about as frequent. So a document that has over a fifth of its shingles to itself has no prefix to
share: these are found first (private_keys.py), and only the others' sets are made and shipped. Exact copies collapse
before that; groups of near copies are linked to their most central documents before pairs are made between documents
that are not linked yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shingles
from weftgraph.llm.common import materialize, table
from weftgraph.llm.private_keys import private_counts
from weftgraph.operators.components import connected_components

ORDERS = 2
BROADCAST_IDS = 500_000  # documents at most in a broadcast (about 50 MB); more are joined by shuffle
WORTH = 0.02  # leaders are tried again while a round links this share of the documents that may have links


def _needed(n):
    """Shingles that a set of n must share with a similar one: ceil(0.8 n)."""
    return F.floor((n * 4 + 4) / 5)


def _enough(own, place, other):
    """Whether a set of own shingles, the first common one at that place, can share enough with one of other shingles."""
    return (own - place) * 9 >= (own + other) * 4


def _all_sets(texts: list[str]) -> list[np.ndarray]:
    return [shingles.shingle_set(shingles.normal(t)) for t in texts]


def _sets(batches):
    for batch in batches:
        own = [s.view(np.int64) for s in _all_sets(batch.column(1).to_pylist())]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc", "version", "own"])


def _only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents in (left_semi) or not in (left_anti) a list of (doc_id, sha)."""
    few = rows.count() <= BROADCAST_IDS
    got = docs.join(F.broadcast(rows) if few else rows, ["doc_id", "sha"], how)
    return got if few else materialize(got, "docs")  # what a shuffle has dealt has no order to rely on


def _places(sets: DataFrame) -> DataFrame:
    """(o, key, place, doc, n, own): the prefix shingles, under each order, that two or more sets have.

    place: shingles of the document before this one; own: shingles that no other document has.
    """
    keys = sets.select("doc", "version", F.size("own").alias("n"), F.explode("own").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = shared.select("key", F.floor(F.log2("df")).cast("int").alias("class"))
    held = keys.join(shared, "key").groupBy("doc", "version", "n").agg(F.collect_list(F.struct("class", "key")).alias("held"))
    held = held.withColumn("own", F.col("n") - F.size("held")).where(F.size("held") >= _needed(F.col("n")))
    out = None
    for o in range(ORDERS):
        by = F.transform("held", lambda x: F.struct(x["class"].alias("class"), F.xxhash64(x["key"], F.lit(o)).alias("h"), x["key"].alias("key")))
        prefix = F.slice(F.array_sort(by), F.lit(1), (F.col("n") - _needed(F.col("n")) + 1 - F.col("own")).cast("int"))
        one = held.select("doc", "n", "own", F.posexplode(prefix).alias("i", "x"))
        one = one.select(F.lit(o).alias("o"), F.col("x.key").alias("key"), (F.col("own") + F.col("i")).alias("place"), "doc", "n", "own")
        out = one if out is None else out.unionByName(one)
    return out


def _leader_pairs(places: DataFrame, turn: int) -> DataFrame:
    """For each document the leader that it shares most prefix shingles with, of those not linked to it yet.

    A shingle's leader is first its document with the least share of shingles of its own, then one drawn by turn.
    """
    here = places.where("o = 0")
    by = (F.col("own") / F.col("n")) if turn == 0 else F.xxhash64("doc", F.lit(turn))
    rank = F.struct(by.alias("by"), F.col("doc").alias("leader"), F.col("comp").alias("lcomp"), F.col("n").alias("ln"), F.col("place").alias("lplace"))
    lead = here.groupBy("key").agg(F.min(rank).alias("l"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    lead = lead.where("x != y").select("key", "l.leader", "l.lcomp", "l.ln", "l.lplace")
    best = (
        here.join(lead, "key")
        .where((F.col("comp") != F.col("lcomp")) & _enough(F.col("n"), F.col("place"), F.col("ln")) & _enough(F.col("ln"), F.col("lplace"), F.col("n")))
        .groupBy("doc", "leader")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("doc")
        .agg(F.max(F.struct("c", (-F.col("leader")).alias("less"))).alias("m"))
    )
    return best.select(F.least("doc", -F.col("m.less")).alias("a"), F.greatest("doc", -F.col("m.less")).alias("b")).distinct()


def _candidate_pairs(places: DataFrame) -> DataFrame:
    """Pairs of documents not linked yet that share, under every order, a shingle early enough in both."""
    size = places.groupBy("o", "key", "comp").agg(F.count(F.lit(1)).alias("g"))
    main = size.groupBy("o", "key").agg(F.max(F.struct("g", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    main = main.where("comps > 1").select("o", "key", F.col("m.comp").alias("main"))
    live = places.join(main, ["o", "key"])
    left = live.where("comp != main").select("o", "key", *[F.col(c).alias(f"{c}_l") for c in ("doc", "n", "place", "comp")])
    right = live.select("o", "key", "main", *[F.col(c).alias(f"{c}_r") for c in ("doc", "n", "place", "comp")])
    early = _enough(F.col("n_l"), F.col("place_l"), F.col("n_r")) & _enough(F.col("n_r"), F.col("place_r"), F.col("n_l"))
    once = (F.col("comp_r") == F.col("main")) | (F.col("doc_l") < F.col("doc_r"))
    met = left.join(right, ["o", "key"]).where((F.col("comp_l") != F.col("comp_r")) & early & once)
    met = met.select(F.least("doc_l", "doc_r").alias("a"), F.greatest("doc_l", "doc_r").alias("b"), "o").distinct()
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") == ORDERS).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("own").alias(f"own_{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("same", F.size(F.array_intersect("own_a", "own_b")))
    return met.where(F.col("same") * 9 >= (F.size("own_a") + F.size("own_b")) * 4).select("a", "b").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: similar ones are linked, components are their closure.

    Null and empty texts have no shingles and stay alone. Rows with a null doc_id are left out; rows that repeat a
    doc_id are one node, and the links of all their texts count for it. Very long texts are taken whole; without rows
    the result is empty. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text)).alias("sha"))
    known = materialize(docs.select("doc_id", "sha"), "known")
    rep = known.groupBy("sha").agg(F.min("doc_id").alias("rep"))
    same = materialize(known.join(rep, "sha").where("doc_id > rep").distinct(), "copies")
    reps = _only(docs, same.select("doc_id", "sha"), "left_anti")
    sizes = materialize(private_counts(reps.select("sha", "text"), _all_sets, known.count()), "sizes")

    may = sizes.where((F.col("n") > 0) & (F.col("n") - F.col("private") >= _needed(F.col("n")))).join(rep, F.col("id") == F.col("sha"))
    may = materialize(may.select(F.col("rep").alias("doc_id"), "sha"), "may")
    version = F.hash("sha").alias("version")  # tells the texts of a repeated doc_id apart
    sets = _only(docs, may, "left_semi").select("doc_id", "text", version).mapInArrow(_sets, "doc long, version int, own array<long>")
    sets = materialize(sets.dropDuplicates(["doc", "version"]), "sets")
    base = materialize(_places(sets), "places")

    # Of the copies, only ids that have other texts too can link anything; the rest follow their first document.
    several = known.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    some = sizes.where("n > 0").select(F.col("id").alias("sha"))
    links = same.join(several, "doc_id", "left_semi").join(some, "sha", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = materialize(links, "links")
    whole = lambda: connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    n_may, turn, part = may.count(), 0, whole()
    while True:
        comps = part.select(F.col("node").alias("doc"), "component")
        places = base.join(comps, "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
        pairs = _candidate_pairs(places) if turn is None else _leader_pairs(places, turn)
        new = materialize(_verified(materialize(pairs, "pairs"), sets), "links")
        found = new.count()
        if found:
            links = links.unionByName(new)
            part = whole()
        if turn is None:
            break
        turn = turn + 1 if found > WORTH * n_may else None
    n = sizes.groupBy(F.col("id").alias("sha")).agg(F.max("n").alias("n_shingles")).join(rep, "sha")
    node = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("node")
    rows = known.join(n, "sha").select("doc_id", "n_shingles", node).join(part, "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s
  FROM words
), same AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, list(doc_id) AS ids FROM sets GROUP BY list_sort(s)
), shingle AS (
  SELECT rep, len(s) AS n, hash(unnest(s)) AS h FROM same
), pairs AS (
  SELECT a.rep AS a, b.rep AS b
  FROM shingle a JOIN shingle b ON a.h = b.h AND a.rep < b.rep AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
  UNION SELECT rep, unnest(ids) FROM same WHERE len(s) > 0
  UNION SELECT unnest(ids), rep FROM same WHERE len(s) > 0
), reach AS (
  SELECT doc_id AS node, doc_id AS to_id FROM sets
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.to_id = e.a
), comp AS (
  SELECT node, min(to_id) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN comp ON node = doc_id
"""


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
