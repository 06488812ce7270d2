"""Building blocks for iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; a temporary folder only where the session names none."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; a temporary one only on a local master."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def running(rows: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """With ``rank`` (from 1) and the running sums values(name: column) in that order, without one task for all rows.

    Rows are dealt to range partitions; what comes before a partition is added to the sums inside it. Rows that tie in
    the whole order may be numbered in any way.
    """
    parted = checkpointed(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    totals = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    moved = totals.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals.columns[1:]])
    inside = Window.partitionBy("_pid").orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(c).over(up_to) + F.col(f"_t_{n}") for n, c in values.items()}
    out = parted.join(F.broadcast(moved), "_pid").withColumns({"rank": F.row_number().over(inside) + F.col("_c"), **sums})
    return out.drop(*moved.columns)


TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame, each=None) -> int:
    """How many tasks hold the rows at about TASK_ROWS each; 1 if one does, else no fewer than the session's. With
    ``each`` a row counts as so many."""
    n = -(-int((rows.count() if each is None else rows.agg(F.sum(each)).first()[0]) or 0) // TASK_ROWS)
    return 1 if n <= 1 else max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """Rows dealt by columns to so many tasks; as they are for one.

    Shuffles that Spark plans by itself are merged by compressed size, and 64 MB of narrow rows that compress well are
    tens of millions: what a task sorts would be bounded in bytes on disk only."""
    return rows if tasks <= 1 else rows.repartition(tasks, *columns)


def mirror(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both orientations of each edge; a self loop stays one row."""
    back = edges.where(F.col(src) != F.col(dst)).withColumns({src: F.col(dst), dst: F.col(src)})
    return edges.unionByName(back)


def seeded_order(seed, *keys):
    """A random order that depends on the seed and the keys alone, not on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed) if not hasattr(seed, "alias") else seed, *keys))
