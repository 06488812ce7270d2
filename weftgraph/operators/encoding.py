"""Rank encoding of expression samples; expr(sample_id, gene_id, value), vocab(gene_id, token, median)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, running
from weftgraph.operators.statistics import exact_quantiles

MAX_LENGTH = 2048


def normalize_by_gene_median(expr: DataFrame) -> DataFrame:
    """Divide by the gene's own median over samples; a zero median gives null."""
    median = exact_quantiles(expr, ["gene_id"], "value", [0.5]).select("gene_id", F.col("q")[0].alias("median"))
    return expr.join(median, "gene_id").select("sample_id", "gene_id", F.try_divide("value", "median").alias("value"))


def convert_ids(expr: DataFrame, id_map: DataFrame) -> DataFrame:
    """Symbols to gene ids; the unmapped go, several ids of a symbol give the smallest."""
    one = id_map.groupBy("symbol").agg(F.min("gene_id").alias("new_id"))
    return expr.join(one, expr["gene_id"] == one["symbol"]).select("sample_id", F.col("new_id").alias("gene_id"), "value")


def unmapped_ids(expr: DataFrame, id_map: DataFrame) -> DataFrame:
    return expr.select("gene_id").distinct().join(id_map, F.col("gene_id") == id_map["symbol"], "left_anti")


def keep_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes, "gene_id", "left_semi")


def missing_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return genes.join(expr, "gene_id", "left_anti")


def normalize_by_vocab(expr: DataFrame, vocab: DataFrame) -> DataFrame:
    """value / corpus median with the token; genes outside the vocabulary go. A vocabulary within the session's
    broadcast threshold is broadcast by the optimizer, which knows its size; a larger one is joined by shuffle."""
    return expr.join(vocab, "gene_id").select("sample_id", "gene_id", "token", F.try_divide("value", "median").alias("value"))


def rank_encode(normalized: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """(sample_id, input_ids, length): tokens by falling value, ties by gene_id, cut before they are collected."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("value"), "gene_id")
    top = normalized.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_length)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda x: x["token"])
    return top.groupBy("sample_id").agg(ids.alias("input_ids")).withColumn("length", F.size("input_ids"))


def encodable(expr: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sample_id): the samples that ``rank_encode`` gives, those with a gene of the vocabulary; nothing is ranked."""
    return expr.join(vocab, "gene_id", "left_semi").select("sample_id").distinct()


def pad(encoded: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - F.size("input_ids"), F.lit(0)))
    return encoded.withColumn("input_ids", F.concat("input_ids", zeros))


def padding_mask(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("mask", F.transform("input_ids", lambda x: (x != 0).cast("int")))


def draw_samples(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement from ids(sample_id): (draw_no, sample_id)."""
    draws = ids.sparkSession.range(n).select(F.col("id").alias("draw_no"))
    return _drawn(ids, draws, F.lit(seed)).select("draw_no", "sample_id")


def _drawn(ids: DataFrame, draws: DataFrame, seed) -> DataFrame:
    """draws with the sample that each picks by a hash of seed and draw_no, whatever was picked before."""
    numbered = running(ids.select("sample_id"), [F.col("sample_id")], {}).withColumn("row_no", F.col("rank") - 1)
    total = max(numbered.count(), 1)  # of what is checkpointed; ids may be long to compute
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", seed, "draw_no")), 1, 8), 16, 10).cast("long") % total
    return draws.withColumn("row_no", pick).join(numbered, "row_no")


def samples_at(ids: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, sample_id): the samples at listed positions (from 0, in sample_id order); others are left out."""
    numbered = running(ids.select("sample_id"), [F.col("sample_id")], {}).withColumn("position", F.col("rank") - 1)
    return numbered.join(positions.select("position").distinct(), "position").select("position", "sample_id")


def decode(encoded: DataFrame, vocab: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """(sample_id, genes): tokens back to genes in order; with id_map to symbols where there is one."""
    rows = encoded.select("sample_id", F.posexplode("input_ids").alias("pos", "token")).join(vocab.select("token", "gene_id"), "token")
    name = F.col("gene_id")
    if id_map is not None:
        one = id_map.groupBy("gene_id").agg(F.min("symbol").alias("symbol"))
        rows, name = rows.join(one, "gene_id", "left"), F.coalesce("symbol", "gene_id")
    genes = F.transform(F.sort_array(F.collect_list(F.struct("pos", name.alias("g")))), lambda x: x["g"])
    return rows.groupBy("sample_id").agg(genes.alias("genes"))


def distinct_tokens(encoded: DataFrame) -> DataFrame:
    """(token, first): each token with its first place (sample, position)."""
    rows = encoded.select("sample_id", F.posexplode("input_ids").alias("pos", "token"))
    return rows.groupBy("token").agg(F.min(F.struct("sample_id", "pos")).alias("first"))


def saturation(encoded: DataFrame, sizes: list[int], seeds: int) -> DataFrame:
    """(n, mean_tokens, std_tokens): distinct tokens in n samples drawn with replacement by seed, over the seeds.

    The draws of a smaller size are the first ones of a larger size of the same seed, so a token counts from the first
    draw that holds it: a number for each seed and token, combined before anything is sent. Only samples that are drawn
    are looked into; encoded is computed once."""
    spark, steps, encoded = encoded.sparkSession, sorted(set(sizes)), checkpointed(encoded.select("sample_id", "input_ids"))
    runs = spark.range(seeds).select(F.col("id").alias("seed"))
    draws = runs.crossJoin(F.broadcast(spark.range(steps[-1]).select(F.col("id").alias("draw_no"))))  # seeds * sizes rows
    first = _drawn(encoded, draws, F.col("seed")).groupBy("seed", "sample_id").agg(F.min("draw_no").alias("r"))
    until = F.coalesce(*[F.when(F.col("r") < n, F.lit(n)) for n in steps])  # the smallest size that the draw belongs to
    tokens = encoded.join(first, "sample_id").select("seed", "r", F.explode("input_ids").alias("token"))
    seen = tokens.groupBy("seed", "token").agg(F.min("r").alias("r"))
    between = seen.groupBy("seed", until.alias("until")).agg(F.count("token").alias("tokens"))
    grid = spark.createDataFrame([(n,) for n in steps], "n int")
    counts = between.join(F.broadcast(grid), F.col("until") <= F.col("n")).groupBy("seed", "n").agg(F.sum("tokens").alias("tokens"))
    return counts.groupBy("n").agg(F.avg("tokens").alias("mean_tokens"), F.stddev_pop("tokens").alias("std_tokens"))
