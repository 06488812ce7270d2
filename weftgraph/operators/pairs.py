"""Pair weights: co-occurrence, attention and cosine aggregation; pairs are (src, dst) with src <= dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, dealt, mirror, tasks_for

ATTENTION_LENGTH = 2048


def cooccurrence(members: DataFrame, sample: str = "sample_id", item: str = "gene_id") -> DataFrame:
    """(src, dst, n): samples that hold both, the diagonal included; members(sample, item).

    Pairs are dealt by count before they are counted, so that no task holds more than its share of them; few are equal
    within a task, so little would be gained by counting there first."""
    lists = checkpointed(members.groupBy(sample).agg(F.array_sort(F.collect_set(item)).alias("items")))
    size = F.size("items").cast("long")
    tasks = tasks_for(lists, F.floor(size * (size + 1) / 2))
    rest = lists.select(F.posexplode("items").alias("i", "src"), "items")
    pairs = rest.select("src", F.explode(F.slice("items", F.col("i") + 1, F.size("items"))).alias("dst"))
    return dealt(pairs, tasks, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def dealt_samples(encoded: DataFrame) -> DataFrame:
    """Encoded samples, computed once and dealt so that a task meets about TASK_ROWS pairs of positions."""
    kept = checkpointed(encoded)
    length = F.size("input_ids").cast("long")
    return dealt(kept, tasks_for(kept, length * length), "sample_id")


def prune_heads(attn: DataFrame, heads: DataFrame) -> DataFrame:
    """Without the heads(layer, head)."""
    return attn.join(F.broadcast(heads), ["layer", "head"], "left_anti")


def by_length(attn: DataFrame, lengths: DataFrame) -> DataFrame:
    """Weights times sample length / 2048."""
    scaled = F.col("weight") * F.col("length") / ATTENTION_LENGTH
    return attn.join(lengths.select("sample_id", "length"), "sample_id").withColumn("weight", scaled).drop("length")


def attention_max(attn: DataFrame, direction: str = "both", floor: float | None = 0.0, lengths: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, n): largest weight over samples, heads and, for ``both``, directions; attn(sample_id, src, dst, weight, pos_i, pos_j).

    With lengths(sample_id, length > 0), a row a sample, the result is that of ``by_length``: a sample's largest weight is
    scaled instead of each of its rows."""
    rows = attn if direction == "both" else attn.where("pos_i <= pos_j")
    top = F.max("weight") if floor is None else F.greatest(F.max("weight"), F.lit(floor))
    # one row a sample and pair first, so that samples are counted without a distinct count
    each = rows.groupBy("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    each = each if lengths is None else by_length(each, lengths)
    return each.groupBy("src", "dst").agg(top.alias("weight"), F.count(F.lit(1)).alias("n"))


def attention_avg(attn: DataFrame) -> DataFrame:
    """Directed mean over the heads present, then over samples."""
    return (
        attn.groupBy("sample_id", "src", "dst").agg(F.avg("weight").alias("w"))
        .groupBy("src", "dst").agg(F.avg("w").alias("weight"), F.count(F.lit(1)).alias("n"))
    )


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_pairs(vectors: DataFrame, key: list[str], item: str, vector: str, blocks: int = 1) -> DataFrame:
    """(key, src, dst, weight) for pairs of a key's items, src < dst; norms are computed once a vector.

    With ``blocks`` a key's vectors are dealt by hash to so many blocks, and the pairs of two blocks meet in a cell of
    their own: cells are joined by equality and no task has more than two blocks."""
    v = vectors.select(*key, F.col(item).alias("id"), F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("len"))
    v = v.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.withColumns({"c1": F.least("own", "other"), "c2": F.greatest("own", "other")})
    a = v.select(*key, "c1", "c2", F.col("own").alias("own_a"), F.col("id").alias("src"), F.col("v").alias("va"), F.col("len").alias("la"))
    b = v.select(*key, "c1", "c2", F.col("own").alias("own_b"), F.col("id").alias("dst"), F.col("v").alias("vb"), F.col("len").alias("lb"))
    met = a.join(b, [*key, "c1", "c2"]).where("src < dst and (own_a != own_b or c1 = c2)")
    return met.select(*key, "src", "dst", F.try_divide(dot(F.col("va"), F.col("vb")), F.col("la") * F.col("lb")).alias("weight"))


def select_layer(weights: DataFrame, layer: int) -> DataFrame:
    """Rows of one layer; a negative number counts from the last layer (-1)."""
    if layer >= 0:
        return weights.where(F.col("layer") == layer)
    last = weights.agg(F.max("layer").alias("last"))
    return weights.join(F.broadcast(last.select((F.col("last") + 1 + layer).alias("layer"))), "layer", "left_semi")


def embedding_aggregate(hidden: DataFrame, method: str = "max", floor: float | None = 0.0) -> DataFrame:
    """Cosine of hidden(sample_id, gene_id, embedding) by sample, then max or mean over samples."""
    cos = cosine_pairs(hidden, ["sample_id"], "gene_id", "embedding")
    top = F.avg("weight") if method != "max" else F.max("weight") if floor is None else F.greatest(F.max("weight"), F.lit(floor))
    return cos.groupBy("src", "dst").agg(top.alias("weight"), F.count(F.lit(1)).alias("n"))


def seen_only(dense: DataFrame) -> DataFrame:
    return dense.where("n > 0")


def off_diagonal(weights: DataFrame) -> DataFrame:
    return weights.where("src != dst")


def flattened(weights: DataFrame) -> DataFrame:
    """All defined cells, both triangles."""
    return mirror(weights).where("weight is not null and not isnan(weight)").select("weight")


def index_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene_id, side): genes that only one of two weight tables has."""
    one, two = (w.select(F.explode(F.array("src", "dst")).alias("gene_id")).distinct() for w in (a, b))
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst", F.col("weight").alias("weight_a")).join(b.select("src", "dst", F.col("weight").alias("weight_b")), ["src", "dst"])


def rescaled_cosine(weights: DataFrame) -> DataFrame:
    return weights.withColumn("weight", (F.col("weight") + 1) / 2)


def score_batches(samples: DataFrame, score, schema: str) -> DataFrame:
    """Batch scoring hook: ``score`` gets pandas frames of samples and yields frames of pair weights or hidden states."""
    return samples.mapInPandas(score, schema)
