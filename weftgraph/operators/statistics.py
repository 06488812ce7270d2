"""Fits, densities, distances between distributions, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, running


def log_linear_fit(totals: DataFrame) -> DataFrame:
    """total on ln(degree), degree 0 left out: slope, intercept, r2 and both standard errors."""
    x = totals.where("degree > 0").select(F.log("degree").alias("x"), F.col("total").cast("double").alias("y"))
    s = x.agg(*[getattr(F, f"regr_{k}")("y", "x").alias(k) for k in ("slope", "intercept", "r2", "sxx", "syy", "sxy", "count", "avgx")])
    var = F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.col("count") - 2)
    se = F.sqrt(F.try_divide(var, F.col("sxx")))
    return s.select("slope", "intercept", "r2", se.alias("slope_se"), F.sqrt(var * (1 / F.col("count") + F.try_divide(F.col("avgx") * F.col("avgx"), F.col("sxx")))).alias("intercept_se"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pearson, r2, n) of two score lists joined on Name."""
    j = a.select("Name", F.col("score").cast("double").alias("x")).join(b.select("Name", F.col("score").cast("double").alias("y")), "Name")
    return j.agg(F.corr("x", "y").alias("pearson"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))


def density(values: DataFrame, key: str, value: str, points: int = 300, log: bool = False, fine: float = 0.002) -> DataFrame:
    """(key, x, density): Gaussian kernels of Scott's width h on an even grid over all values; ``log`` drops v <= 0.

    Equal values are counted first. A key with more distinct values than cells of width fine * h is binned: a value is
    shared between the two cells beside it, and the kernels are summed over cells. That changes a density by fine^2 / 8 of
    the kernel's peak 0.4 / h at most (5e-7 of it by default); keys with fewer values are exact. So the kernel sums cost
    the same however many distinct values there are."""
    v = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    if log:
        v = v.where("v > 0").withColumn("v", F.log10("v"))
    counted = checkpointed(v.groupBy(key, "v").agg(F.count(F.lit(1)).cast("double").alias("c")))
    # moments about a mean, from counts
    mean = counted.groupBy(key).agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"))
    spread = counted.join(mean, key).groupBy(key).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("m2"), F.count(F.lit(1)).alias("values"), F.min("v").alias("first"), F.max("v").alias("end"))
    width = spread.withColumn("h", F.sqrt(F.try_divide("m2", F.col("n") - 1)) * F.pow("n", F.lit(-0.2))).where("h > 0").drop("m2")
    step = F.when(F.col("values") > (F.col("end") - F.col("first")) / (fine * F.col("h")), fine * F.col("h"))
    at = (F.col("v") - F.col("first")) / F.col("step")
    cell, rest = F.floor(at), at - F.floor(at)
    shares = F.when(F.col("step").isNull(), F.array(F.struct(F.col("v").alias("v"), F.col("c").alias("c")))).otherwise(F.array(
        F.struct((F.col("first") + cell * F.col("step")).alias("v"), (F.col("c") * (1 - rest)).alias("c")),
        F.struct((F.col("first") + (cell + 1) * F.col("step")).alias("v"), (F.col("c") * rest).alias("c"))))
    binned = counted.join(width.withColumn("step", step), key).select(key, "n", "h", F.explode(shares).alias("s"))
    cells = binned.groupBy(key, "n", "h", F.col("s.v").alias("v")).agg(F.sum("s.c").alias("c"))
    span = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    grid = span.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x"))
    u = (F.col("x") - F.col("v")) / F.col("h")
    each = cells.crossJoin(F.broadcast(grid))  # ``points`` rows
    return each.groupBy(key, "x").agg((F.sum(F.col("c") * F.exp(-u * u / 2)) / (F.max("n") * F.max("h") * 2.5066282746310002)).alias("density"))


def signed_emd(a: DataFrame, b: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys, emd): first Wasserstein distance of a and b(keys, value) times the sign of median(b) - median(a).

    Equal values are counted, and a and b computed, once; distance and medians both come from the counts."""
    k = list(keys)
    both = a.select(*k, "value").withColumn("s", F.lit(0)).unionByName(b.select(*k, "value").withColumn("s", F.lit(1)))
    by = checkpointed(both.groupBy(*k, "value").agg(F.sum(1 - F.col("s")).alias("x"), F.sum("s").alias("y")))
    if k:
        whole = Window.partitionBy(*k)
        run = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        f = F.sum("x").over(run) / F.sum("x").over(whole)
        g = F.sum("y").over(run) / F.sum("y").over(whole)
        steps = by.select(*k, "x", "y", f.alias("f"), g.alias("g"), (F.lead("value").over(whole.orderBy("value")) - F.col("value")).alias("gap"))
    else:
        placed = running(by, [F.col("value")], {"u": "x", "v": "y"})
        total = by.agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
        after = placed.select((F.col("rank") - 1).alias("rank"), F.col("value").alias("after"))
        steps = placed.join(after, "rank", "left").crossJoin(F.broadcast(total))
        steps = steps.select("x", "y", F.try_divide("u", "all_x").alias("f"), F.try_divide("v", "all_y").alias("g"), (F.col("after") - F.col("value")).alias("gap"))
    sides = by.groupBy(*k).agg(F.percentile("value", 0.5, F.col("x")).alias("ma"), F.percentile("value", 0.5, F.col("y")).alias("mb"))
    total = steps.where("x + y > 0").select(*k, (F.abs(F.col("f") - F.col("g")) * F.col("gap")).alias("part")).groupBy(*k).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("d"))
    joined = total.join(sides, k) if k else total.crossJoin(sides)
    return joined.where("ma is not null and mb is not null").select(*k, (F.col("d") * F.signum(F.col("mb") - F.col("ma"))).alias("emd"))


def histogram(values: DataFrame, key: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(key, bin from 1, density): even bins, the last one closed, values outside left out, empty bins 0."""
    inside = values.where(F.col(value).between(lo, hi))
    b = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins)).cast("int")
    counts = inside.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = inside.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    grid = total.select(key, "n", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, [key, "bin"], "left").select(key, "bin", (F.coalesce("c", F.lit(0)) / (F.col("n") * ((hi - lo) / bins))).alias("density"))


def exact_quantiles(values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, q): array of quantiles with linear interpolation, nulls left out, NaN above all numbers.

    Equal values are counted first and dealt to range partitions of (keys, value); a key's rows before a partition are
    known from counts by partition and key. So no key, however large, is held in one task."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parted = checkpointed(counted.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id()))
    totals = parted.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_t"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each partition of a key
    before = by.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(*keys, "_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(by).alias("_n"))
    inside = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.withColumn("_upto", F.sum("_c").over(inside)).join(moved, [*keys, "_pid"]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def value_at(place):
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col("_v")))

    places = [(F.col("_n") - 1) * q for q in at]
    picked = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[f(p).alias(f"_{n}{i}") for i, p in enumerate(places) for n, f in (("lo", lambda p: value_at(F.floor(p))), ("hi", lambda p: value_at(F.ceil(p))))])
    between = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p))) for i, p in enumerate(places)]
    return picked.where("_n is not null").select(*keys, F.array(*between).alias("q"))


def quartiles(values: DataFrame, keys: list[str], value: str, exact: bool = True) -> DataFrame:
    """(keys, q1, median, q3, iqr): linear interpolation, or approximate for large groups."""
    if exact:
        q = exact_quantiles(values, keys, value, [0.25, 0.5, 0.75])
    else:
        q = values.groupBy(*keys).agg(F.percentile_approx(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def positive_rate(labels: DataFrame, label: str) -> DataFrame:
    return labels.agg(F.avg(F.col(label).cast("double")).alias("rate"))


def distinct_counts(rows: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    f = F.count_distinct if exact else F.approx_count_distinct
    return rows.agg(*[f(c).alias(f"n_{c}") for c in columns])
