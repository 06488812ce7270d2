"""Readers with explicit schemas, and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "edges": "ens1 string, ens2 string",
    "weighted_edges": "hgnc1 string, hgnc2 string, weight double",
    "associations": "NewName string, HGNC_Symbol string, Strong int, Weak int, DescriptorName string",
    "scored_associations": "`Disease name` string, `Gene Symbol` string, `Disease gene score` double",
    "drug_targets": "DB_id string, Name string, Status string, organism string, Indication string, Gene_Target string",
    "id_map": "symbol string, gene_id string",
    "vocab": "gene_id string, token int, median double",
    "tokenized": "sample_id string, input_ids array<int>, length int",
    "pair_weights": "model string, layer int, method string, src string, dst string, weight double, n long",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).csv(path, header=True)


def canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected simple edges (src <= dst) with the largest weight of parallel ones; self loops stay."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    named = ends.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), *[c for c in edges.columns if c == "weight"])
    if "weight" not in named.columns:
        return named.distinct()
    return named.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return canonical(read_csv(spark, path, "edges"), "ens1", "ens2")


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of weight other than zero."""
    return canonical(read_csv(spark, path, "weighted_edges").where("weight != 0"), "hgnc1", "hgnc2")


def read_scored_associations(spark: SparkSession, path: str, least: float = 0.3) -> DataFrame:
    return read_csv(spark, path, "scored_associations").where(F.col("Disease gene score") >= least)


def read_expression(spark: SparkSession, path: str, orientation: str = "samples") -> DataFrame:
    """Long (sample_id, gene_id, value) from a wide CSV; its rows are ``samples`` or ``genes``."""
    wide = spark.read.csv(path, header=True)  # the columns are named by the file; their type is fixed below
    first, *others = wide.columns
    row, column = ("sample_id", "gene_id") if orientation == "samples" else ("gene_id", "sample_id")
    named = wide.select(F.col(first).cast("string").alias(row), *[F.col(f"`{c}`").cast("double").alias(c) for c in others])
    return named.unpivot([row], others, column, "value").where("value is not null").select("sample_id", "gene_id", "value")


def write_tokenized(encoded: DataFrame, path: str) -> None:
    encoded.write.mode("overwrite").parquet(path)


def read_tokenized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["tokenized"]).parquet(path)


def write_pair_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").partitionBy("model", "layer", "method").parquet(path)


def read_pair_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["pair_weights"]).parquet(path)


def store_pair_weights(weights: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """weights(src, dst, ...) as a table of the catalogue, its files at path, bucketed and sorted by (src, dst).

    What joins it on both columns is dealt to its buckets; the table itself isn't shuffled again."""
    spread = weights.repartition(buckets, "src", "dst")
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, "src", "dst").sortBy("src", "dst").saveAsTable(name)
    return weights.sparkSession.table(name)


def cached_table(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; computed and written first if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        compute().write.parquet(path)
        return spark.read.parquet(path)


def read_catalogue(spark: SparkSession, inputs: dict[str, str], read: Callable[[SparkSession, str], DataFrame], key: str = "run_id") -> DataFrame:
    """One table of several inputs(name: path) with the name as a column, by which operators are keyed; at least one input."""
    tables = [read(spark, path).withColumn(key, F.lit(name)) for name, path in sorted(inputs.items())]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_runs(results: DataFrame, path: str) -> None:
    """Results of several runs, a folder for each run_id."""
    results.write.mode("overwrite").partitionBy("run_id").parquet(path)
