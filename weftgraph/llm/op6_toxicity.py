"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The ratios come from all labelled training documents (counts in Spark). The n-grams that tell most about the class (by the
likelihood ratio of their two-by-two table) become features; a logistic regression over the scaled features is fitted to a bounded sample of the labelled
rows, weighted by the inverse of their class's sampling share. Scoring sums the weights of the features that occur in the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, slices, table

SIZES = (3, 4, 5)
HASH_BITS = 22
FEATURES = 1024  # of the classifier: those that tell most, of all n-grams; chosen by cross-validation in the training rows
SAMPLE = 12_000  # labelled rows at most in the fit, half of them toxic where there are as many
SMOOTHING = 1.0
BROADCAST_LABELS = 2_000_000  # labels at most in a broadcast (about 80 MB); more are joined by shuffle
_MULT = np.uint32(0x9E3779B1)


def grams(text: str | None) -> np.ndarray:
    """Distinct hashed character n-grams of the whole lower-cased text."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in SIZES:
        if len(chars) >= n:
            found.append(_hashed(chars, n))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _hashed(chars: np.ndarray, n: int) -> np.ndarray:
    h = chars[: len(chars) - n + 1] * _MULT + np.uint32(n)
    for k in range(1, n):
        h ^= h >> np.uint32(15)
        h = (h + chars[k : len(chars) - n + 1 + k]) * _MULT
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)


def _entropy(n):
    return F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)


@dataclass
class Model:
    features: np.ndarray  # hashed n-grams, sorted
    ratios: np.ndarray  # naive Bayes log-count ratios
    weights: np.ndarray  # of the scaled features
    bias: float

    def scores(self, texts) -> np.ndarray:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[self.features] = np.arange(len(self.features))
        product = self.weights * self.ratios
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            hit = np.zeros(len(product), bool)
            for n in SIZES:
                if len(chars) >= n:
                    at = place[_hashed(chars, n)]
                    hit[at[at >= 0]] = True
            out[i] = 1 / (1 + np.exp(-np.clip(self.bias + product[hit].sum(), -30, 30)))
        return out


def _class_counts(batches):
    """For each n-gram of a task's rows: documents of either class that have it. Summed, they are counts over all rows."""
    count = [np.zeros(1 << HASH_BITS, np.int32) for _ in range(2)]
    for part in slices(batches):
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            count[toxic][grams(text)] += 1
    found = np.flatnonzero(count[0] + count[1])
    for a in range(0, len(found), 1 << 16):
        at = found[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at].astype(np.int64)) for c in count)], ["gram", "c0", "c1"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to labelled(doc_id, text, toxic), which is read three times. Rows with a null label are left out; null texts
    are empty; repeated rows count each time.

    With one class only, or no rows, the model has no features and its bias is the smoothed share of that class.
    """
    labelled = labelled.where("toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), prior)
    counts = labelled.select("text", "toxic").mapInArrow(_class_counts, "gram long, c0 long, c1 long")
    counts = counts.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    ratio = F.log((F.col("c1") + SMOOTHING) / (n1 + 2 * SMOOTHING)) - F.log((F.col("c0") + SMOOTHING) / (n0 + 2 * SMOOTHING))
    both = F.col("c0") + F.col("c1")
    cells = (F.col("c0"), F.col("c1"), n0 - F.col("c0"), n1 - F.col("c1"))
    # Likelihood ratio of n-gram against class, but for its factor and constant; rounded, so that ties go by n-gram.
    tells = F.round(sum(map(_entropy, cells)) - _entropy(both) - _entropy(n0 + n1 - both), 6)
    best = counts.withColumn("r", ratio).orderBy(tells.desc(), "gram").limit(FEATURES).toPandas().sort_values("gram")
    features, ratios = best["gram"].to_numpy(np.uint32), best["r"].to_numpy(float)

    share = F.when(F.col("toxic") == 1, min(1.0, sample / 2 / n1)).otherwise(min(1.0, sample / 2 / n0))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / (1 << 20)
    # A row stands for 1 / share rows of its class, so that intercept and weights are those of the classes' real shares.
    chosen = labelled.where(chance < share).withColumn("weight", 1 / share)

    def vectors(batches):
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[features] = np.arange(len(features))
        for part in slices(batches):
            rows = np.zeros((part.num_rows, len(features)))
            for i, text in enumerate(part.column(0).to_pylist()):
                at = place[grams(text)]
                at = at[at >= 0]
                rows[i, at] = ratios[at]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(features)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([flat, part.column(1).cast(pa.float64()), part.column(2)], ["x", "label", "weight"])

    x = chosen.select("text", "toxic", "weight").mapInArrow(vectors, "x array<double>, label double, weight double")
    x = materialize(x, "vectors").select(array_to_vector("x").alias("features"), "label", "weight")
    got = LogisticRegression(maxIter=60, regParam=0.001, standardization=False, weightCol="weight").fit(x)
    return Model(features, ratios, got.coefficients.toArray(), float(got.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row; null and empty texts get the model's bias. Other columns are ignored."""

    def run(batches):
        for part in slices(batches):
            got = model.scores(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fifth; a document labelled twice is toxic if any label says so."""
    one = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    one = materialize(one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if one.count() <= BROADCAST_LABELS:
        return docs.join(F.broadcast(one), "doc_id")
    return materialize(docs.join(one, "doc_id"), "labelled")  # read more than once, so that texts are shuffled once


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Documents scored below 0.5, with all their columns; each row is judged by its own text."""

    def run(batches):
        for part in slices(batches):
            got = model.scores(part.column("text").to_pylist())
            yield part.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
