"""Ranking metrics and rank fusion. A ranking has keys, a label 0/1 and an order.

Rankings with keys are windows by key. A ranking without a key may be long: its ranks and sums go by range partitions
(``running``), so that no task orders all of it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, running


def _over(keys, *order):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order) if order else w


def cumulative(ranking: DataFrame, order: list, label: str = "label", keys: tuple = ()) -> DataFrame:
    """With rank (from 1), m (positives so far), P (positives) and n (rows)."""
    if not keys:
        whole = ranking.agg(F.sum(label).alias("P"), F.count(F.lit(1)).alias("n"))
        return running(ranking, order, {"m": label}).crossJoin(F.broadcast(whole))
    w = _over(keys, *order)
    return ranking.withColumns({
        "rank": F.row_number().over(w).cast("long"), "m": F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "P": F.sum(label).over(_over(keys)), "n": F.count(F.lit(1)).over(_over(keys)),
    })


def roc_points(c: DataFrame, convention: str = "standard") -> DataFrame:
    """tpr = m / P; fpr = (rank - m) / (n - P), or with ranks from 0 for ``literal``."""
    shift = 0 if convention == "standard" else 1
    return c.withColumns({"tpr": F.try_divide(F.col("m"), F.col("P")), "fpr": F.try_divide(F.col("rank") - shift - F.col("m"), F.col("n") - F.col("P"))})


def pr_points(c: DataFrame) -> DataFrame:
    return c.withColumns({"precision": F.col("m") / F.col("rank"), "recall": F.try_divide(F.col("m"), F.col("P"))})


def area(points: DataFrame, x: str, y: str, order: list, keys: tuple = ()) -> DataFrame:
    """(keys, area) by trapezoids in the given order."""
    if keys:
        w = _over(keys, *order)
        steps = points.withColumn("step", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    else:
        placed = running(points.withColumns({"x": F.col(x), "y": F.col(y)}), order, {}).select("rank", "x", "y")
        last = placed.select((F.col("rank") + 1).alias("rank"), F.col("x").alias("x0"), F.col("y").alias("y0"))
        steps = placed.join(last, "rank", "left").withColumn("step", (F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2)
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("area"))


def normalized_area(points: DataFrame, x: str, y: str, keys: tuple = ()) -> DataFrame:
    """Sorted by x, divided by its range; null without a range."""
    whole = area(points, x, y, [F.col(x), F.col(y)], keys)
    span = points.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("span"))
    joined = whole.join(span, list(keys)) if keys else whole.crossJoin(span)
    return joined.select(*keys, F.try_divide("area", "span").alias("area"))


def separated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two weight lists in one ranking: labels 1 and 0, falling weight, positives first on ties, cumulative.

    Equal rows are counted first and numbered from their count, so that a weight which most rows have is ordered once."""
    both = a.select("weight").withColumn("label", F.lit(1)).unionByName(b.select("weight").withColumn("label", F.lit(0)))
    by = both.groupBy("weight", "label").agg(F.count(F.lit(1)).alias("copies")).withColumn("positives", F.col("copies") * F.col("label"))
    placed = running(by, [F.desc("weight"), F.desc("label")], {"last": "copies", "found": "positives"})
    each = placed.select("weight", "label", "last", "found", "copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i"))
    back = F.col("copies") - F.col("i")  # rows of the same kind that come after
    return each.select("weight", "label", (F.col("last") - back).alias("rank"), (F.col("found") - F.col("label") * back).alias("m"))


def _tied(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, here, others, tp, fp, P, N) of each distinct score: positives and negatives at it and down to it; all."""
    by = scores.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("here"), F.count(F.lit(1)).alias("c"))
    by = by.select("threshold", "here", (F.col("c") - F.col("here")).alias("others"))
    run = running(by, [F.desc("threshold")], {"tp": "here", "fp": "others"})
    total = by.agg(F.sum("here").alias("P"), F.sum("others").alias("N")).where("P is not null")
    return run.crossJoin(F.broadcast(total))  # one row


def _roc(run: DataFrame, total: DataFrame, keys: tuple = ()) -> DataFrame:
    """Points of run(keys, threshold, tp, fp, P, N) and the starts of total(keys, P, N)."""
    zero = F.lit(0).cast("long")
    start = total.select(*keys, F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"), "P", "N")
    points = run.select(*keys, F.col("threshold").cast("double").alias("threshold"), "tp", "fp", "P", "N").unionByName(start)
    return points.select(*keys, "threshold", F.try_divide("tp", "P").alias("tpr"), F.try_divide("fp", "N").alias("fpr"), "tp", "fp")


def _roc_of(tied: DataFrame) -> DataFrame:
    return _roc(tied, tied.select("P", "N").distinct())


def _auc_of(tied: DataFrame) -> DataFrame:
    """By trapezoids: the point before has tp - here positives, so no row needs its neighbour."""
    whole = tied.agg(F.sum(F.col("others") * (F.col("tp") - F.col("here") / 2)).alias("s"), F.max(F.col("P") * F.col("N")).alias("all"))
    return whole.select(F.coalesce(F.try_divide("s", "all"), F.lit(0.0)).cast("double").alias("area"))


def _pr_of(tied: DataFrame) -> DataFrame:
    points = tied.select(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "P").alias("recall"), F.col("threshold").cast("double").alias("threshold"))
    end = tied.sparkSession.range(1).select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def _pr_area_of(tied: DataFrame) -> DataFrame:
    tp, fp = F.col("tp") - F.col("here"), F.col("fp") - F.col("others")  # at the threshold before
    last = F.when(tp + fp > 0, F.try_divide(tp, tp + fp)).otherwise(1.0)
    step = F.try_divide("here", "P") * (F.col("tp") / (F.col("tp") + F.col("fp")) + last) / 2
    return tied.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("area"))


def roc_tied(scores: DataFrame, score: str = "score", label: str = "label", keys: tuple = ()) -> DataFrame:
    """(keys, threshold, tpr, fpr, tp, fp): one point a distinct score and the start (0, 0) with an infinite threshold."""
    if not keys:
        return _roc_of(_tied(scores, score, label))
    by = scores.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    by = by.select(*keys, "threshold", "p", (F.col("c") - F.col("p")).alias("q"))
    total = by.groupBy(*keys).agg(F.sum("p").alias("P"), F.sum("q").alias("N"))
    w = _over(keys, F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select(*keys, "threshold", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp")).join(total, list(keys))
    return _roc(run, total, keys)


def auc_tied(scores: DataFrame, score: str = "score", label: str = "label", keys: tuple = ()) -> DataFrame:
    if not keys:
        return _auc_of(_tied(scores, score, label))
    return area(roc_tied(scores, score, label, keys), "fpr", "tpr", [F.desc("threshold")], keys)


def pr_tied(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(precision, recall, threshold): a point a distinct threshold and the end (1, 0)."""
    return _pr_of(_tied(scores, score, label))


def pr_area_tied(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(area) under pr_tied, by trapezoids from the highest recall to the end point."""
    return _pr_area_of(_tied(scores, score, label))


def ml_metrics(scores: DataFrame, score: str = "score", label: str = "label", name: str = "Name") -> dict[str, DataFrame]:
    """Bundle: ROC and its area, precision and recall for every N with those of a random ranking."""
    tied = _tied(scores, score, label)
    return {"roc": _roc_of(tied), "auc": _auc_of(tied), "at": with_baselines(scores, [F.desc(score), name], label)}


def precision_recall_at(ranking: DataFrame, order: list, label: str = "label", keys: tuple = ()) -> DataFrame:
    """(keys, top, precision, recall) for every N; recall is 0 without positives."""
    c = cumulative(ranking, order, label, keys)
    return c.select(*keys, F.col("rank").alias("top"), (F.col("m") / F.col("rank")).alias("precision"), F.coalesce(F.try_divide("m", "P"), F.lit(0.0)).alias("recall"))


def with_baselines(ranking: DataFrame, order: list, label: str = "label") -> DataFrame:
    """Precision and recall at N with those of a random ranking."""
    c = cumulative(ranking, order, label)
    return c.select(
        F.col("rank").alias("top"), (F.col("m") / F.col("rank")).alias("precision"), F.try_divide("m", "P").alias("recall"),
        (F.col("P") / F.col("n")).alias("base_precision"), (F.col("P") * F.col("rank") / (F.col("n") * F.col("n"))).alias("base_recall"),
    )


def top_hits(ranking: DataFrame, order: list, top: int, label: str = "label", keys: tuple = ()) -> DataFrame:
    """(keys, top, hits): positives among the first 1 .. top rows; without keys only those rows are ranked."""
    if keys:
        c = cumulative(ranking, order, label, keys).where(F.col("rank") <= top)
    else:
        w = Window.orderBy(*order)
        first = ranking.orderBy(*order).limit(top)
        c = first.withColumns({"rank": F.row_number().over(w).cast("long"), "m": F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return c.select(*keys, F.col("rank").alias("top"), F.col("m").alias("hits"))


def evaluate(scores: DataFrame, positives: DataFrame, top: int = 100, invert: bool = False) -> dict[str, DataFrame]:
    """Bundle: scores with labels, ROC, PR, hits; scores are counted and ordered once for all. scores(Name, Score);
    positives(Name, Positive)."""
    s = F.expr("try_cast(Score as double)")
    joined = scores.join(positives, "Name").select("Name", s.alias("Score"), "Positive").where("Score is not null")
    used = joined.withColumn("score", -F.col("Score") if invert else F.col("Score"))
    tied = _tied(used, "score", "Positive")
    return {
        "scores": joined, "roc": _roc_of(tied), "auc": _auc_of(tied), "pr": _pr_of(tied), "pr_area": _pr_area_of(tied),
        "hits": top_hits(used, [F.desc("score"), "Name"], top, "Positive"),
    }


def mean_curve(curves: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and standard error (population) at each position over repeats."""
    aggs = [f for v in values for f in (F.avg(v).alias(f"{v}_mean"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias(f"{v}_se"))]
    return curves.groupBy(*keys).agg(*aggs)


def thinned(curve: DataFrame, position: str, step: int = 100, n: str | None = None) -> DataFrame:
    """Every step-th point; with n the last row is left out."""
    keep = F.pmod(F.col(position), F.lit(step)) == 0
    return curve.where(keep & (F.col(position) < F.col(n) - 1) if n else keep)


def enrichment(c: DataFrame) -> DataFrame:
    return c.select((F.col("rank") / (F.col("n") + 1)).alias("fraction"), F.try_divide("m", "P").alias("found"))


def rank_edges(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight, label): cells labelled by whether they are edges; falling weight orders them."""
    flag = edges.select("src", "dst").distinct().withColumn("label", F.lit(1))
    return weights.join(flag, ["src", "dst"], "left").na.fill(0, ["label"]).select("src", "dst", "weight", "label")


def layer_summary(scores: DataFrame, label: str = "label") -> DataFrame:
    """(run_id, auroc, precision_area, recall_area) of each run; areas over thresholds, divided by their range."""
    r = roc_tied(scores, "score", label, ("run_id",)).where("threshold < double('infinity')")
    points = r.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.col("tpr")})
    one = auc_tied(scores, "score", label, ("run_id",)).withColumnRenamed("area", "auroc")
    for name in ("precision", "recall"):
        one = one.join(normalized_area(points, "threshold", name, ("run_id",)).withColumnRenamed("area", f"{name}_area"), "run_id")
    return one


# Fusion of two score lists (Name, score).

METHODS = ["borda", "dowdall", "average", "crank"]

def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("Name", F.col("score").alias("s1")).join(b.select("Name", F.col("score").alias("s2")), "Name")


def _ranked(rows: DataFrame, c: str, name: str) -> DataFrame:
    """With the least rank of ties, by falling c, and how many tie: counts by value are ranked, not rows."""
    by = rows.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
    placed = running(by, [F.desc(c)], {"m": "k"}).select(c, (F.col("m") - F.col("k") + 1).alias(name), F.col("k").alias(f"{name}_ties"))
    return rows.join(placed, c)


def borda(a: DataFrame, b: DataFrame) -> DataFrame:
    """(N - r1) + (N - r2) with average ranks for ties."""
    two = _two(a, b)
    ranked = _ranked(_ranked(two, "s1", "r1"), "s2", "r2").crossJoin(F.broadcast(two.agg(F.count(F.lit(1)).alias("n"))))
    average = lambda r: F.col(r) + (F.col(f"{r}_ties") - 1) / 2
    return ranked.select("Name", (2 * F.col("n") - average("r1") - average("r2")).alias("score"))


def crank(a: DataFrame, b: DataFrame, p: float = 4.0) -> DataFrame:
    """1 / r1^p + 1 / r2^p with the least rank for ties; p = 1 is Dowdall's count."""
    ranked = _ranked(_ranked(_two(a, b), "s1", "r1"), "s2", "r2")
    return ranked.select("Name", (F.pow("r1", F.lit(-p)) + F.pow("r2", F.lit(-p))).alias("score"))


def dowdall(a: DataFrame, b: DataFrame) -> DataFrame:
    return crank(a, b, 1.0)


def combined_counts(a: DataFrame, b: DataFrame, p: float = 4.0, keys: tuple = ()) -> DataFrame:
    """All fusions with ranks by position before the join; lists(keys, Name, score)."""
    def placed(x: DataFrame, r: str, n: str) -> DataFrame:
        c = cumulative(x.select(*keys, "Name", "score", F.lit(0).alias("label")), [F.desc("score"), "Name"], "label", keys)
        return c.select(*keys, "Name", F.col("rank").alias(r), F.col("n").alias(n))

    j = placed(a, "r1", "n1").join(placed(b, "r2", "n2"), [*keys, "Name"])
    return j.select(
        *keys, "Name", (F.col("n1") - F.col("r1") + F.col("n2") - F.col("r2")).cast("double").alias("borda"), (1 / F.col("r1") + 1 / F.col("r2")).alias("dowdall"),
        ((F.col("r1") + F.col("r2")) / 2).alias("average"), (F.pow("r1", F.lit(-p)) + F.pow("r2", F.lit(-p))).alias("crank"),
    )


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """(Name, side): names in one list only."""
    left = a.select("Name").join(b, "Name", "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select("Name").join(a, "Name", "left_anti").withColumn("side", F.lit("right")))


def evaluate_fusions(fused: DataFrame, labels: DataFrame, top: int = 100, keys: tuple = ()) -> DataFrame:
    """(keys, method, auroc, hits) of every fusion; average ranks ascend, the others descend. labels(keys, Name, label).

    Without keys each method's ranking goes by range partitions, and no row of it needs its neighbour: a negative adds the
    share of positives before it to the area."""
    if not keys:
        rows, each = checkpointed(fused.join(labels, "Name").select("Name", "label", *METHODS)), []
        for method in METHODS:
            score = -F.col(method) if method == "average" else F.col(method)
            c = cumulative(rows.select("Name", "label", score.alias("score")), [F.desc("score"), "Name"])
            before = F.sum(F.when(F.col("label") == 0, F.col("m")).otherwise(0))
            one = c.agg(before.alias("s"), F.max("P").alias("P"), F.max("n").alias("n"), F.max(F.when(F.col("rank") <= top, F.col("m"))).alias("hits")).where("n > 0")
            area_ = F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("P").cast("double") * (F.col("n") - F.col("P"))), F.lit(0.0))
            each.append(one.select(F.lit(method).alias("method"), area_.alias("auroc"), "hits"))
        return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    long = fused.unpivot([*keys, "Name"], METHODS, "method", "key")
    signed = long.withColumn("score", F.when(F.col("method") == "average", -F.col("key")).otherwise(F.col("key"))).join(labels, [*keys, "Name"])
    by = (*keys, "method")
    c = cumulative(signed, [F.desc("score"), "Name"], "label", by)
    roc = area(roc_points(c), "fpr", "tpr", ["rank"], by).withColumnRenamed("area", "auroc")
    hits = c.where(F.col("rank") <= top).groupBy(*by).agg(F.max("m").alias("hits"))
    return roc.join(hits, list(by))


def logistic_fusion(scores: DataFrame, label: str = "label") -> DataFrame:
    """(Name, score): probability of class 1 from (s1, s2), classes weighted to balance; L2 of strength 1 / n."""
    n = scores.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total = scores.count()
    rows = VectorAssembler(inputCols=["s1", "s2"], outputCol="x").transform(scores.join(F.broadcast(n), label).withColumn("w", total / (2 * F.col("c"))))
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", regParam=1.0 / total, standardization=False, maxIter=200).fit(rows)
    return model.transform(rows).select("Name", vector_to_array("probability")[1].alias("score"))


def linear_fusion(scores: DataFrame, label: str = "label"):
    """(scores by least squares on s1, s2 and s1 * s2; coefficients with the intercept last)."""
    rows = VectorAssembler(inputCols=["s1", "s2", "s12"], outputCol="x").transform(scores.withColumn("s12", F.col("s1") * F.col("s2")))
    model = LinearRegression(featuresCol="x", labelCol=label, solver="normal").fit(rows)
    return model.transform(rows).select("Name", F.col("prediction").alias("score")), [*model.coefficients, model.intercept]
