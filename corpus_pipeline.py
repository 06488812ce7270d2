"""Cleaning a corpus: toxicity, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Every stage judges rows, each by
its own whole text, however long: rows with a null doc_id or text and empty texts pass all of them, rows that repeat a
doc_id are judged one by one, an empty table stays empty, and columns besides those of documents are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import op2_pii, op5_ngram_jaccard, op6_toxicity, op7_decontaminate, op8_byte_bpe
from weftgraph.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # SQL can't express the trained stages; tests/llm compares run() with a brute-force version


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled rows, doesn't reject.

    Null and empty texts have the model's bias, which is far below rejection unless most labels are toxic. Rows that are
    equal are scored alike; a score of 0.5 is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    model = op6_toxicity.fit(op6_toxicity.training_rows(table(spark, sf_dir, "documents"), labels))
    return op6_toxicity.reject_toxic(docs.select(*COLUMNS), model)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest doc_id.

    Texts without words are similar to none. Of rows that repeat doc_id and text one stays (which of their other columns
    is open); texts that share a doc_id are documents of their own, of which the one with the smallest digest goes first.
    Rows with a null doc_id are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("first"))
    again = materialize(again.where("n > 1").select("doc_id", "first"), "again")
    if again.isEmpty():
        return _one_of_each(docs.withColumn("node", F.col("doc_id"))).select(*COLUMNS)
    own = F.shiftrightunsigned(F.xxhash64("doc_id", digest), 2).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col("first") != digest, own).otherwise(F.col("doc_id"))
    rows = docs.join(again, "doc_id", "left").withColumn("node", node)
    once = rows.where("first is not null").dropDuplicates(["node", "text"])
    return _one_of_each(materialize(rows.where("first is null").unionByName(once), "rows")).select(*COLUMNS)


def _one_of_each(rows: DataFrame) -> DataFrame:
    groups = op5_ngram_jaccard.jaccard_components(rows.select(F.col("node").alias("doc_id"), "text"))
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("node")).distinct()
    return rows.join(materialize(gone, "gone"), "node", "left_anti")


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. A row goes for what its own text holds, not for another row of its doc_id."""
    docs = docs.select(*COLUMNS)
    return op7_decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind; null texts stay null, no row goes."""
    docs = docs.select(*COLUMNS)
    return op2_pii.redact(docs, op2_pii.fit(docs.select("doc_id", "text")))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token ids, with each document's digests of ids and decoded bytes: a row for each row."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return op8_byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("tokens", tokens),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
