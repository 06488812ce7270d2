"""User-level pipelines, composed of operators and keyed so that no repeat or layer needs a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, mirror
from weftgraph.operators import distances, encoding, network, pairs, ranking, screening, selection, statistics, walks
from weftgraph.operators.components import keys_with_component_above


def expression_to_weights(expr: DataFrame, vocab: DataFrame, score, schema: str, max_length: int = encoding.MAX_LENGTH) -> DataFrame:
    """Expression to rank-encoded samples, to weights by the batch hook ``score``, to the largest weight of each pair."""
    encoded = pairs.dealt_samples(encoding.rank_encode(encoding.normalize_by_vocab(expr, vocab), max_length))
    return pairs.attention_max(pairs.score_batches(encoded, score, schema), lengths=encoded)


def separation(weights: DataFrame, edges: DataFrame, sample: int, seed: int = 1) -> DataFrame:
    """(auroc) of network weights against a sample of the background."""
    inside = network.weighted(edges, weights)
    cells = network.background(weights, edges).withColumn("key", F.concat_ws("|", "src", "dst"))
    outside = selection.sample_exact(cells, sample, seed, "key")
    c = ranking.separated(inside, outside)
    total = c.agg(F.sum("label").alias("P"))
    # the area under the steps: for each negative the share of positives before it
    return c.crossJoin(F.broadcast(total)).where("label = 0").agg(F.avg(F.col("m") / F.col("P")).alias("auroc"))


def separation_controls(weights: DataFrame, edges: DataFrame, sample: int, seed: int = 1) -> DataFrame:
    """(graph, weights, auroc): the network, its degree-preserving shuffle and a uniform random graph of its size, each
    against one sample of the network's background. A control's edges may lie in that background."""
    cells = network.background(weights, edges).withColumn("key", F.concat_ws("|", "src", "dst"))
    outside = checkpointed(selection.sample_exact(cells, sample, seed, "key").select("weight"))
    graphs = {"network": edges, "degrees kept": network.degree_preserving_shuffle(edges, seed)[0], "uniform": network.uniform_random_graph(edges, seed)}
    inside = [network.weighted(g, weights).select(F.lit(name).alias("graph"), "weight", F.lit(1).alias("label")) for name, g in graphs.items()]
    both = inside[0].unionByName(inside[1]).unionByName(inside[2])
    names = both.select("graph").distinct()
    both = checkpointed(both.unionByName(outside.crossJoin(F.broadcast(names)).select("graph", "weight", F.lit(0).alias("label"))))
    sizes = both.groupBy("graph").agg(F.sum("label").alias("weights"))
    return sizes.join(ranking.auc_tied(both, "weight", keys=("graph",)), "graph").select("graph", "weights", F.col("area").alias("auroc"))


def degree_dependence(edges: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log-linear fit of total weight on degree, mean and deviation by degree)."""
    totals = checkpointed(network.total_weights(edges, weights, network.nodes_of(edges)))
    return statistics.log_linear_fit(totals), network.by_degree(totals)


def module_detection(edges: DataFrame, genes: DataFrame, repeats: DataFrame, restart: float = 0.4, keys: tuple[str, ...] = (), digits: int | None = None, tol: float = 1e-10) -> DataFrame:
    """(keys, rep, node, score, rank, label, m, P, n): hold-outs of a module recovered by walks from the rest.

    edges may carry the keys of several networks or layers; repeats(rep); all walks run in one loop. With ``digits``
    scores are rounded before they are ranked, so that nodes which tie are ordered by name."""
    both = checkpointed(selection.hold_out(genes, repeats))
    runs = edges.select(*keys).distinct() if keys else None
    seeds = both.where("not tossed").select("rep", "node")
    seeds = checkpointed(seeds.crossJoin(F.broadcast(runs)) if keys else seeds)
    k = (*keys, "rep")
    scores = walks.random_walk(edges, seeds, k, restart, tol)
    scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    ranked = walks.ranked_without_seeds(scores, seeds, k)
    labelled = selection.held_out_labels(ranked, both.where("tossed"), ["rep", "node"])
    return ranking.cumulative(labelled, [F.desc("score"), "node"], "label", k)


def module_curves(detected: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and standard error of the curves at each rank over the repeats."""
    points = ranking.pr_points(ranking.roc_points(detected))
    return ranking.mean_curve(points, [*keys, "rank"], ["tpr", "fpr", "precision", "recall"])


def module_areas(detected: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean AUROC and AUPRC over the repeats."""
    k = (*keys, "rep")
    points = ranking.pr_points(ranking.roc_points(detected))
    roc = ranking.area(points, "fpr", "tpr", ["rank"], k).withColumnRenamed("area", "auroc")
    pr = ranking.area(points, "recall", "precision", ["rank"], k).withColumnRenamed("area", "auprc")
    both = roc.join(pr, list(k))
    return both.groupBy(*keys).agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))


def repurposing_screen(edges: DataFrame, drugs: DataFrame, genes: DataFrame, patterns: list[str], bin_size: int = 100, n_iter: int = 10_000, similarity: bool = True) -> dict[str, DataFrame]:
    """Proximity screen of labelled drugs against one disease on the largest component, and its evaluation.

    Random sets come from bins of strength where there are weights, else from logarithmic bins of degree."""
    lcc = checkpointed(network.largest_component(edges))
    net = network.induced(edges, lcc)
    net = checkpointed(network.similarity_to_distance(net) if similarity and "weight" in edges.columns else net)
    rows, inside = selection.screen_input(selection.approved_human(drugs), genes, lcc, patterns)
    rows = checkpointed(rows)
    if "weight" in net.columns:
        bins = screening.degree_bins(network.strength(net).withColumnRenamed("strength", "value"), bin_size)
    else:
        bins = screening.log_bins(network.degree(net).withColumnRenamed("degree", "value"), bin_size)
    bins = checkpointed(bins)
    targets = rows.select(F.col("Name").alias("drug"), F.col("Gene_Target").alias("node"))
    screen = screening.screening(net, targets, inside.withColumn("disease", F.lit("disease")), bins, n_iter)
    scores = checkpointed(selection.clean_scores(screen.select(F.col("drug").alias("Name"), F.col("z").alias("Score"))))
    return ranking.evaluate(scores, rows.select("Name", "Positive").distinct(), invert=True)


def fused_ranking(a: DataFrame, b: DataFrame, labels: DataFrame, top: int = 100) -> DataFrame:
    """(method, auroc, hits) of every fusion of two rankings."""
    return ranking.evaluate_fusions(ranking.combined_counts(a, b), labels, top)


def shift_by_disease(before: DataFrame | str, after: DataFrame | str, members: DataFrame, edges: DataFrame, least: int = 40) -> DataFrame:
    """(disease, emd): signed distance of a module's edge weights before and after; members(disease, node).

    before and after are tables (src, dst, weight), or the names of columns of edges where those have them: they are
    carried along then, and no weights are looked up. Edges with both ends in a module are found once, and all else is
    taken from these."""
    sides = {"before": before, "after": after}
    carried = [F.col(w).alias(name) for name, w in sides.items() if isinstance(w, str)]
    a, b = members.withColumnRenamed("node", "src"), members.withColumnRenamed("node", "dst")
    inside = checkpointed(edges.select("src", "dst", *carried).join(a, "src").join(b, ["disease", "dst"]))
    kept = inside.join(keys_with_component_above(inside, ("disease",), least), "disease", "left_semi")
    weights = [
        kept.select("disease", F.col(name).alias("value")) if isinstance(w, str)
        else kept.select("disease", "src", "dst").join(w.select("src", "dst", "weight"), ["src", "dst"]).select("disease", F.col("weight").alias("value"))
        for name, w in sides.items()
    ]
    return statistics.signed_emd(*weights, keys=("disease",))


def hop_decay(edges: DataFrame, weights: DataFrame, module: DataFrame, hops: int = 4) -> DataFrame:
    """(hop, nodes, q1, median, q3, iqr): weights between a module and each hop around it."""
    layers = checkpointed(network.hop_bins(edges, module, hops))
    cells = mirror(weights.select("src", "dst", "weight")).where("src != dst")
    met = cells.join(module.withColumnRenamed("node", "src").distinct(), "src", "left_semi").join(layers.withColumnRenamed("node", "dst"), "dst")
    sizes = layers.groupBy("hop").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(statistics.quartiles(met, ["hop"], "weight"), "hop", "left")


def fused_modules(detected: DataFrame, one: str, other: str, top: int = 100) -> DataFrame:
    """(method, auroc, hits): fusions of the rankings that two networks give of the same held-out genes, mean over repeats.

    detected(network, rep, node, score, label) as from module_detection with keys=("network",)."""
    lists = [detected.where(F.col("network") == n).select("rep", F.col("node").alias("Name"), "score") for n in (one, other)]
    labels = detected.where(F.col("network") == one).select("rep", F.col("node").alias("Name"), "label")
    by = ranking.evaluate_fusions(ranking.combined_counts(*lists, keys=("rep",)), labels, top, ("rep",))
    return by.groupBy("method").agg(F.avg("auroc").alias("auroc"), F.avg("hits").alias("hits"))


def fused_edges(a: DataFrame, b: DataFrame, edges: DataFrame, top: int = 100) -> DataFrame:
    """(method, auroc, hits): fusions of two weight tables in ranking the cells that are edges."""
    named = lambda w: w.select(F.concat_ws("|", "src", "dst").alias("Name"), F.col("weight").alias("score"))
    labels = ranking.rank_edges(a, edges).select(F.concat_ws("|", "src", "dst").alias("Name"), "label")
    return ranking.evaluate_fusions(ranking.combined_counts(named(a), named(b)), labels, top)


def shift_report(shifts: DataFrame, classes: DataFrame, lo: float, hi: float, bins: int = 19) -> tuple[DataFrame, DataFrame]:
    """(histogram, quartiles) of emd by class; shifts(disease, emd), classes(disease, in_class)."""
    known = checkpointed(shifts.join(classes.select("disease", "in_class").distinct(), "disease"))
    return statistics.histogram(known, "in_class", "emd", lo, hi, bins), statistics.quartiles(known, ["in_class"], "emd")


def module_separability(edges: DataFrame, weights: DataFrame, module: DataFrame) -> DataFrame:
    """(auroc, edges, others): weights of a module's edges against those of its pairs that are no edges."""
    inside = network.module_weights(edges, module, weights)
    # each unordered pair once: the cells hold both orders
    outside = network.module_non_edges(edges, module, weights).where("src < dst")
    both = inside.select("weight", F.lit(1).alias("label")).unionByName(outside.select("weight", F.lit(0).alias("label")))
    sizes = both.agg(F.sum("label").alias("edges"), F.sum(1 - F.col("label")).alias("others"))
    return ranking.auc_tied(both, "weight").select(F.col("area").alias("auroc")).crossJoin(F.broadcast(sizes))
