"""Selections of diseases, drugs and labels, and reproducible samples.

gda(NewName, HGNC_Symbol, Strong, Weak, DescriptorName); drugs(Name, Status, organism, Indication, Gene_Target).
``tasks``: to how many tasks the rows of drugs are dealt; counted if not given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import dealt, running, seeded_order, tasks_for


def disease_rows(gda: DataFrame, name: str) -> DataFrame:
    return gda.where((F.col("NewName") == name) & ((F.col("Strong") >= 1) | (F.col("Weak") >= 1)))


def disease_genes(gda: DataFrame, name: str) -> DataFrame:
    return disease_rows(gda, name).select("HGNC_Symbol").distinct()


def genes_by_pattern(gda: DataFrame, pattern: str, id_map: DataFrame, literal: bool = False) -> DataFrame:
    """Gene ids of diseases whose name contains (or matches) the pattern, case-sensitive."""
    hit = F.col("NewName").contains(pattern) if literal else F.col("NewName").rlike(pattern)
    return gda.where(hit).join(id_map, gda["HGNC_Symbol"] == id_map["symbol"]).select("gene_id").distinct()


def genes_in_network(gda: DataFrame, name: str, nodes: DataFrame) -> DataFrame:
    rows = gda.where(F.col("Disease name") == name).select(F.col("Gene Symbol").alias("node"))
    return rows.join(nodes, "node", "left_semi").distinct()


def approved_human(drugs: DataFrame) -> DataFrame:
    return drugs.where(F.col("Status").contains("approved") & (F.col("organism") == "Humans"))


def drug_targets(drugs: DataFrame) -> DataFrame:
    """(Name, targets): distinct targets by drug, sorted."""
    return drugs.groupBy("Name").agg(F.array_sort(F.collect_set("Gene_Target")).alias("targets"))


def _labelled(drugs: DataFrame, positive: DataFrame, tasks: int | None) -> DataFrame:
    rows = drugs.select("Name", "Gene_Target")
    touched = rows.join(positive, "Name", "left_semi").select("Gene_Target").distinct()
    near = dealt(rows, tasks or tasks_for(rows), "Gene_Target").join(touched, "Gene_Target", "left_semi").select("Name").distinct()
    negative = rows.select("Name").distinct().join(positive, "Name", "left_anti").join(near, "Name", "left_anti")
    return positive.withColumn("Positive", F.lit(1)).unionByName(negative.withColumn("Positive", F.lit(0)))


def labels_by_name(drugs: DataFrame, patterns: list[str], tasks: int | None = None) -> DataFrame:
    """(Name, Positive): 1 if any row's indication matches a pattern, whatever the case; 0 for drugs that share no
    target with those; other drugs are left out."""
    if not patterns:
        raise ValueError("no patterns")
    hit = F.col("Indication").rlike("(?i)" + "|".join(patterns))
    return _labelled(drugs, drugs.where(hit).select("Name").distinct(), tasks)


def labels_by_first_row(drugs: DataFrame, text: str, row_no: str, tasks: int | None = None) -> DataFrame:
    """The same with the case-sensitive substring in the drug's first row."""
    first = drugs.groupBy("Name").agg(F.min_by("Indication", row_no).alias("first"))
    return _labelled(drugs, first.where(F.col("first").contains(text)).select("Name"), tasks)


def screen_input(drugs: DataFrame, genes: DataFrame, nodes: DataFrame, patterns: list[str], tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(drug targets in the network with their label, disease genes in the network)."""
    tasks = tasks or tasks_for(drugs)
    inside = dealt(drugs, tasks, "Gene_Target").join(nodes.withColumnRenamed("node", "Gene_Target"), "Gene_Target", "left_semi")
    inside = dealt(inside, tasks, "Name")
    rows = inside.select("Name", "Gene_Target").distinct().join(labels_by_name(inside, patterns, tasks), "Name")
    return rows, genes.join(nodes, "node", "left_semi").distinct()


def targets_mapped(drugs: DataFrame, labels: DataFrame, id_map: DataFrame, tasks: int | None = None) -> DataFrame:
    tasks = tasks or tasks_for(drugs)
    named = dealt(drugs.select("Name", "Gene_Target").distinct(), tasks, "Gene_Target").join(id_map, F.col("Gene_Target") == id_map["symbol"])
    return dealt(named, tasks, "Name").join(labels, "Name").select("Name", "gene_id", "Positive").distinct()


def clean_scores(scores: DataFrame) -> DataFrame:
    s = F.col("Score")
    return scores.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))


def inverted(scores: DataFrame, column: str) -> DataFrame:
    return scores.withColumn(column, -F.col(column))


def class_split(gda: DataFrame, text: str) -> DataFrame:
    """(NewName, in_class): distinct names by whether the class contains the text; a null class is in neither."""
    return gda.where(F.col("DescriptorName").isNotNull()).select("NewName", F.col("DescriptorName").contains(text).alias("in_class")).distinct()


def large_modules(members: DataFrame, least: int = 40) -> DataFrame:
    """Modules of more than ``least`` nodes; members(module, node)."""
    return members.groupBy("module").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > least)


def sample_exact(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement: the least in a seeded order.

    A bound on the order's first bits is found from counts of its 4,096 slices, so that only about k rows are sorted."""
    tag = seeded_order(seed, F.col(key).cast("string"))
    tagged = rows.withColumns({"_tag": tag, "_slice": F.conv(F.substring(tag, 1, 3), 16, 10).cast("int")})
    total, last = 0, 4095
    for r in tagged.groupBy("_slice").agg(F.count(F.lit(1)).alias("c")).orderBy("_slice").collect():
        total += r["c"]
        if total >= k:
            last = r["_slice"]
            break
    ranked = running(tagged.where(F.col("_slice") <= last), [F.col("_tag"), F.col(key)], {})
    return ranked.where(F.col("rank") <= k).select(*rows.columns)


def hold_out(genes: DataFrame, repeats: DataFrame, part: int = 5) -> DataFrame:
    """(rep, node, tossed): int(n / part) genes of each repeat are tossed, the rest are seeds; repeats(rep)."""
    both = genes.select("node").crossJoin(F.broadcast(repeats.select("rep")))
    order = Window.partitionBy("rep").orderBy(seeded_order(F.col("rep").cast("string"), F.col("node").cast("string")), "node")
    n = F.count(F.lit(1)).over(Window.partitionBy("rep"))
    return both.select("rep", "node", (F.row_number().over(order) <= F.floor(n / part)).alias("tossed"))


def held_out_labels(ranking: DataFrame, tossed: DataFrame, keys: list[str]) -> DataFrame:
    flags = tossed.select(*keys).distinct().withColumn("label", F.lit(1))
    return ranking.join(flags, keys, "left").na.fill(0, ["label"])
