"""Benchmark decontamination: windows of document words against a broadcast hash set of the benchmark's word n-grams.

A document is cut into words once. At every word the hash of it and the next ones is looked up among the hashes that
begin a window of the benchmark; only where one fits, the window is built and compared with the hash set itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import lower_ascii, materialize, table

WINDOW = 10
MAX_GRAMS = 400_000  # n-grams at most in a broadcast hash set (about 40 MB); with more, several sets have a scan each
BEGIN = 3  # words of a window that are looked up first
_OTHER = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())  # each by itself: looked up in a table, unlike ranges
_WORD = f"[^{_OTHER}]+"


def words(text):
    """The words in their own case."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _gram(w, start, length):
    return lower_ascii(F.array_join(F.slice(w, start, length), " "))


def _begin(w, at, n: int):
    """Hash of n words from at (from 0). Equal but for the case of A-Z gives equal hashes; lower() may equate more."""
    parts = [F.get(w, at + i) for i in range(n)]
    return F.xxhash64(F.lower(F.concat_ws(" ", *parts)))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, gram, length, begins, begin): windows of each item; an item of fewer words is one window; without words none.

    begin: hash of the window's first ``begins`` words.
    """
    item = benchmark.select("item_id", words("text").alias("w")).withColumn("n", F.size("w")).where("n > 0")
    size = F.least(F.lit(window), F.col("n"))
    one = item.select("item_id", "w", size.alias("length"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("at"))
    begins = F.least(F.lit(BEGIN), F.col("length"))
    hashed = F.coalesce(*[F.when(begins == k, _begin(F.col("w"), F.col("at"), k)) for k in range(1, BEGIN + 1)])
    return one.select("item_id", _gram("w", F.col("at") + 1, F.col("length")).alias("gram"), "length", begins.alias("begins"), hashed.alias("begin")).distinct()


def _key(doc_id, text):
    """What hits belong to: a text of a doc_id, so that rows which repeat an id are told apart."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("digest"))


def _marked(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, n_words, start, length, gram): a row without length for each row of docs(key, text), and one for each hit."""
    sets = -(-max(1, grams.select("gram").distinct().count()) // MAX_GRAMS)
    out = None
    for i in range(sets):
        one = _scanned(docs, grams.where(F.pmod(F.xxhash64("gram"), F.lit(sets)) == i))
        one = one if i == 0 else one.where("length is not null")
        out = one if out is None else out.unionByName(one)
    return out


def _scanned(docs: DataFrame, grams: DataFrame) -> DataFrame:
    kinds = sorted(r[0] for r in grams.select("begins").distinct().collect())  # at most BEGIN numbers
    begins = F.broadcast(grams.select("begins", "begin", "length").distinct())
    only = F.broadcast(grams.select("gram", F.lit(True).alias("listed")).distinct())
    w = docs.select("key", F.coalesce(words("text"), F.array().cast("array<string>")).alias("w")).withColumn("n_words", F.size("w"))
    at = w.select("key", "w", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("start"))
    if len(kinds) > 1:
        at = at.withColumn("begins", F.explode(F.array(*[F.lit(k) for k in kinds])))
        hashed = F.coalesce(*[F.when(F.col("begins") == k, _begin(F.col("w"), F.col("start"), k)) for k in kinds])
        row = (F.col("start") == F.col("n_words")) & (F.col("begins") == kinds[0])
    else:
        k = kinds[0] if kinds else 1
        at, hashed = at.withColumn("begins", F.lit(k)), _begin(F.col("w"), F.col("start"), k)
        row = F.col("start") == F.col("n_words")
    # the document's own row meets nothing: no window begins after the last word
    begin = F.when(F.col("start") < F.col("n_words"), hashed)
    met = at.withColumn("begin", begin).join(begins, ["begins", "begin"], "left").where(row | F.col("length").isNotNull())
    fits = F.col("start") + F.col("length") <= F.col("n_words")
    met = met.withColumn("gram", F.when(fits, _gram("w", F.col("start") + 1, F.col("length"))))
    # the join compares the n-gram itself, so a hit of the hashes is verified with it
    return met.join(only, "gram", "left").where(row | F.col("listed")).select("key", "n_words", "start", "length", "gram")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, items found, verdict.

    Null texts and texts without words have no hits. Rows with a null doc_id or item_id are left out. Rows that repeat a
    doc_id have each the words and hits of their own text. Items that repeat a text are all counted. Without items nothing
    is hit. Texts are taken whole, however long. Columns besides doc_id/item_id and text are ignored.
    """
    docs = docs.where("doc_id is not null").select(_key(F.col("doc_id").cast("long"), F.col("text")).alias("key"), "text")
    benchmark = benchmark.where("item_id is not null").select("item_id", "text")
    grams = materialize(benchmark_grams(benchmark, window), "grams")
    marked = materialize(_marked(docs, grams), "hits")
    counted = marked.where("length is null").select("key", F.col("n_words").cast("long").alias("n_words"))
    found = marked.where("length is not null")
    covered = (
        found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        found.select("key", "gram").distinct().join(grams.select("gram", "item_id"), "gram")
        .groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    return (
        counted.join(covered.join(items, "key"), "key", "left")
        .select(
            F.col("key.id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    grams = benchmark_grams(benchmark.where("item_id is not null").select("item_id", "text"), window)
    rows = docs.where("doc_id is not null and text is not null").select(_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return _marked(rows, materialize(grams, "grams")).where("length is not null")


def _is(docs: DataFrame, keys: DataFrame):
    return (docs["doc_id"] == keys["key.id"]) & (F.xxhash64(docs["text"]) == keys["key.digest"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window; all columns stay, documents with a null doc_id or text too.

    Rows that repeat a doc_id are judged each by its own text.
    """
    dirty = materialize(_hits(docs, benchmark, window).select("key").distinct(), "dirty")
    return docs.join(dirty, _is(docs, dirty), "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, without the words that stand in an occurrence of a benchmark window; all columns stay.

    What stands between words stays. Rows that repeat a doc_id lose each what is hit in its own text.
    """
    found = _hits(docs, benchmark, window).select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
    hit = materialize(found.groupBy("key").agg(F.collect_set("at").alias("hit_words")), "covered")
    parts = F.regexp_extract_all(docs["text"], F.lit(f"{_WORD}|[{_OTHER}]+"), F.lit(0))  # words and gaps take turns
    first = F.when(F.regexp_like(docs["text"], F.lit(f"\\A[{_OTHER}]")), 1).otherwise(0)
    kept = F.filter(parts, lambda x, i: (i % 2 != first) | ~F.array_contains(hit["hit_words"], F.floor(i / 2).cast("int")))
    text = F.when(hit["hit_words"].isNull(), docs["text"]).otherwise(F.array_join(kept, "")).alias("text")
    return docs.join(hit, _is(docs, hit), "left").select(*[text if c == "text" else docs[c] for c in docs.columns])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS length
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
hit AS (
  SELECT doc_id, i, length, gram FROM (
    SELECT doc_id, i, length, array_to_string(w[i:i + length - 1], ' ') AS g FROM (
      SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS i
      FROM doc, (SELECT DISTINCT length FROM grams) WHERE len(w) >= length)) x
  JOIN (SELECT DISTINCT gram FROM grams) ON gram = g),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + length)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit JOIN grams USING (gram)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
