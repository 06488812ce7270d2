"""Queries on the readers and writers, and on plans that are composed of several operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, shared_folder
from weftgraph.operators import distances, encoding, network, pairs, ranking, screening, selection, statistics, walks
from weftgraph.plans import pipelines
from weftgraph.registry import (
    ATTN, BOTH, DRUGS, ENCODED, EXPR, FUSED, G1, GDA, MOD, R1, VOCAB, W1, _brand, _drug_tasks, _module, _r, _t, associations, attention, drugs, encoded, expr, g1, query,
    ranking1, vocab, weights1,
)
from weftgraph.sources import tables


def _path(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _csv(df: DataFrame) -> str:
    path = _path(df.sparkSession)
    df.write.csv(path, header=True)
    return path

# Files -----------------------------------------------------------------------------------------------------------

@query("""SELECT DISTINCT least('n' || c_nationkey, 'n' || s_nationkey) AS src, greatest('n' || c_nationkey, 'n' || s_nationkey) AS dst
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def edge_csv(spark, d):
    """Nations that trade with each other, written and read as an edge list with repeats in both directions."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return tables.read_edges(spark, _csv(rows.select(F.concat(F.lit("n"), "c_nationkey").alias("ens1"), F.concat(F.lit("n"), "s_nationkey").alias("ens2"))))


@query("""SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, max(l_discount) AS weight FROM lineitem WHERE l_discount <> 0 GROUP BY 1, 2""")
def weighted_edge_csv(spark, d):
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("hgnc1"), F.concat(F.lit("p"), "l_partkey").alias("hgnc2"), F.col("l_discount").alias("weight"))
    return tables.read_weighted_edges(spark, _csv(rows))


@query(f"""WITH {GDA} SELECT "NewName", CAST("HGNC_Symbol" AS VARCHAR) AS "HGNC_Symbol", CAST("Strong" AS INTEGER) AS "Strong", CAST("Weak" AS INTEGER) AS "Weak", "DescriptorName" FROM gda""")
def association_csv(spark, d):
    return tables.read_csv(spark, _csv(associations(spark, d)), "associations")


def _scored(spark, d):
    part = _t(spark, d, "part").select(F.col("p_brand").alias("Disease name"), F.concat(F.lit("p"), "p_partkey").alias("Gene Symbol"), (F.col("p_size") / 50).alias("Disease gene score"))
    return tables.read_scored_associations(spark, _csv(part), 0.3)


_SC = """sc AS (SELECT p_brand AS "Disease name", 'p' || p_partkey AS "Gene Symbol", p_size / 50 AS "Disease gene score" FROM part WHERE p_size / 50 >= 0.3)"""


@query(f"WITH {_SC} SELECT * FROM sc")
def scored_association_csv(spark, d):
    return _scored(spark, d)


@query(f"""WITH {G1}, {_SC} SELECT DISTINCT "Gene Symbol" AS node FROM sc WHERE "Disease name" = 'Brand#11' AND "Gene Symbol" IN (SELECT src FROM g1 UNION SELECT dst FROM g1)""")
def disease_genes_in_network(spark, d):
    return selection.genes_in_network(_scored(spark, d), "Brand#11", network.nodes_of(g1(spark, d)))


@query(f"""WITH {DRUGS} SELECT 'DB' || "Name" AS "DB_id", CAST("Name" AS VARCHAR) AS "Name", "Status", 'Humans' AS organism, "Indication", CAST("Gene_Target" AS VARCHAR) AS "Gene_Target" FROM drugs""")
def drug_target_csv(spark, d):
    rows = drugs(spark, d).select(F.concat(F.lit("DB"), "Name").alias("DB_id"), "Name", "Status", "organism", "Indication", "Gene_Target")
    return tables.read_csv(spark, _csv(rows), "drug_targets")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS sample_id, o_orderpriority AS gene_id, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def wide_expression_csv(spark, d):
    """Orders by nation and priority as a wide table; cells without a value are left out."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tables.read_expression(spark, _csv(rows.groupBy("c_nationkey").pivot("o_orderpriority").agg(F.count(F.lit(1)))))


@query("""SELECT o_orderpriority AS sample_id, CAST(c_nationkey AS VARCHAR) AS gene_id, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def wide_expression_csv_transposed(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tables.read_expression(spark, _csv(rows.groupBy("c_nationkey").pivot("o_orderpriority").agg(F.count(F.lit(1)))), "genes")


@query(f"WITH {ENCODED} SELECT sample_id, array_to_string(input_ids, ',') AS ids, CAST(length AS INTEGER) AS length FROM encoded")
def tokenized_files(spark, d):
    path = _path(spark)
    tables.write_tokenized(encoded(spark, d), path)
    return tables.read_tokenized(spark, path).select("sample_id", F.array_join("input_ids", ",").alias("ids"), "length")


@query("""SELECT l_linenumber AS layer, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, round(avg(l_discount), 6) AS weight, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def pair_weight_files(spark, d):
    """Pair weights by layer through partitioned files; a layer is a line number."""
    path = _path(spark)
    tables.write_pair_weights(_layers(spark, d).withColumns({"model": F.lit("m"), "method": F.lit("avg")}), path)
    return tables.read_pair_weights(spark, path).where("model = 'm' and method = 'avg'").select("layer", "src", "dst", "weight", "n")


@query(f"WITH {G1}, {W1} SELECT g1.src, g1.dst, weight FROM g1 JOIN w1 USING (src, dst)")
def bucketed_weights_network(spark, d):
    """A network's weights from a store bucketed by pair, under a name of its own in the catalogue."""
    name = f"weights_{uuid.uuid4().hex}"
    store = tables.store_pair_weights(weights1(spark, d), name, _path(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return network.weighted(g1(spark, d), store)


def _layers(spark, d):
    li = _t(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("layer"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return li.agg(F.round(F.avg("l_discount"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_linenumber AS layer, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, round(avg(l_discount), 6) AS weight FROM lineitem GROUP BY 1, 2, 3)
  SELECT * FROM l WHERE layer = (SELECT max(layer) FROM l) - 1""")
def selected_layer(spark, d):
    return pairs.select_layer(_layers(spark, d), -2).select("layer", "src", "dst", "weight")


@query(f"WITH {W1} SELECT src, dst, weight, n FROM w1")
def cached_table_rows(spark, d):
    """The second call reads what the first has written."""
    path = _path(spark)
    tables.cached_table(spark, path, lambda: weights1(spark, d))
    return tables.cached_table(spark, path, lambda: weights1(spark, d).limit(0))


@query("""SELECT CAST(run_id AS INTEGER) AS run_id, name, score FROM (SELECT quality AS run_id, doc_id AS name, n_chars AS score FROM labels JOIN documents USING (doc_id))""")
def run_folders(spark, d):
    path = _path(spark)
    r = ranking1(spark, d).select(F.col("label").cast("int").alias("run_id"), F.col("Name").alias("name"), F.col("score").cast("long").alias("score"))
    tables.write_runs(r, path)
    return tables.read_runs(spark, path)


@query("""SELECT r.k AS run_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN (SELECT unnest(['A', 'N', 'R']) AS k) r ON l_returnflag = r.k GROUP BY ALL""")
def input_catalogue(spark, d):
    """Edge lists of the three return flags, read as one table with the name of each."""
    li = _t(spark, d, "lineitem")
    paths = {k: _csv(li.where(F.col("l_returnflag") == k).select(F.concat(F.lit("p"), "l_partkey").alias("ens1"), F.concat(F.lit("s"), "l_suppkey").alias("ens2"))) for k in "ANR"}
    return tables.read_catalogue(spark, paths, tables.read_edges).select("run_id", "src", "dst")

# Encoding and weights --------------------------------------------------------------------------------------------

@query(f"""WITH {ENCODED} SELECT r AS position, sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS r FROM encoded) WHERE r IN (SELECT p_size * 7 FROM part)""")
def listed_samples(spark, d):
    return encoding.samples_at(encoded(spark, d), _t(spark, d, "part").select((F.col("p_size") * 7).alias("position")))


@query(f"""WITH {ENCODED}, m AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS symbol FROM part WHERE p_size <= 25)
  SELECT sample_id, string_agg(coalesce(symbol, gene_id), ',' ORDER BY r) AS genes FROM ranked LEFT JOIN m USING (gene_id) WHERE r <= 2048 GROUP BY 1""")
def decoded_symbols(spark, d):
    m = _t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_name").alias("symbol"))
    return encoding.decode(encoded(spark, d), vocab(spark, d), m).select("sample_id", F.array_join("genes", ",").alias("genes"))


@query(f"""WITH {ENCODED} SELECT token, min(sample_id) AS sample_id FROM ranked WHERE r <= 2048 GROUP BY 1""")
def first_seen_tokens(spark, d):
    return encoding.distinct_tokens(encoded(spark, d)).select("token", F.col("first.sample_id").alias("sample_id"))


@query(f"""WITH {ATTN} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(weight - 0.5), 9) AS weight, count(DISTINCT sample_id) AS n FROM attn WHERE pos_i <= pos_j GROUP BY 1, 2""")
def attention_upper_without_floor(spark, d):
    a = attention(spark, d).withColumn("weight", F.col("weight") - 0.5)
    return pairs.attention_max(a, "upper", None).select("src", "dst", F.round("weight", 9).alias("weight"), "n")


@query(f"""WITH {EXPR}, {VOCAB}, ranked AS (SELECT sample_id, token, row_number() OVER (PARTITION BY sample_id ORDER BY expr.value / median DESC, gene_id) - 1 AS i FROM expr JOIN vocab USING (gene_id)),
  len AS (SELECT sample_id, count(*) AS length FROM ranked GROUP BY 1),
  a AS (SELECT sample_id, x.token AS src, y.token AS dst, 1.0 / (1 + x.i + 2 * y.i) AS w FROM ranked x JOIN ranked y USING (sample_id))
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(w * length / 2048), 9) AS weight, count(DISTINCT sample_id) AS n FROM a JOIN len USING (sample_id) GROUP BY 1, 2""")
def expression_pair_weights(spark, d):
    """Expression to pair weights, with a batch function in place of the model's forward pass."""
    def score(frames):
        for f in frames:
            n = f["input_ids"].map(len).to_numpy(np.int64)
            ids, start = np.concatenate([np.zeros(0, np.int32), *f["input_ids"]]), np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n * n)  # a cell for each ordered pair of positions
            i, j = np.divmod(np.arange(len(row)) - (np.cumsum(n * n) - n * n)[row], n[row])
            names = pd.arrays.ArrowExtensionArray(pa.array(f["sample_id"], pa.string()).take(pa.array(row)))
            cells = {"sample_id": names, "src": ids[start[row] + i], "dst": ids[start[row] + j]}
            yield pd.DataFrame({**cells, "pos_i": i, "pos_j": j, "weight": 1.0 / (1 + i + 2 * j)})

    schema = "sample_id string, src int, dst int, pos_i int, pos_j int, weight double"
    return pipelines.expression_to_weights(expr(spark, d), vocab(spark, d), score, schema).select("src", "dst", F.round("weight", 9).alias("weight"), "n")

# Networks --------------------------------------------------------------------------------------------------------

@query(f"WITH {G1}, {W1}, {MOD} SELECT src, dst, weight FROM g1 JOIN w1 USING (src, dst) WHERE src IN (SELECT node FROM mod) AND dst IN (SELECT node FROM mod)")
def module_edge_weights(spark, d):
    return network.module_weights(g1(spark, d), _module(spark, d), weights1(spark, d))


@query(f"""WITH {G1}, {MOD}, inside AS (SELECT * FROM g1 WHERE src IN (SELECT node FROM mod) AND dst IN (SELECT node FROM mod)),
  deg AS (SELECT node, count(*) AS k FROM (SELECT unnest([src, dst]) AS node FROM inside) GROUP BY 1)
  SELECT node, coalesce(k, 0) AS degree FROM mod LEFT JOIN deg USING (node) WHERE node IN (SELECT src FROM g1 UNION SELECT dst FROM g1)""")
def module_subgraph_degrees(spark, d):
    return network.module_subgraph(g1(spark, d), _module(spark, d))[1]


@query(f"""WITH RECURSIVE {G1}, deg AS (SELECT node, count(*) AS value FROM (SELECT unnest([src, dst]) AS node FROM g1) GROUP BY 1),
  c AS (SELECT p, count(*) AS c, row_number() OVER (ORDER BY p) AS i FROM (SELECT CAST(floor(ln(value) / ln(2) + 1e-9) AS BIGINT) AS p FROM deg) GROUP BY 1),
  g AS (SELECT i, p, 0 AS bin, c AS held FROM c WHERE i = 1 UNION ALL
    SELECT c.i, c.p, CASE WHEN held >= 50 THEN bin + 1 ELSE bin END, CASE WHEN held >= 50 THEN c.c ELSE held + c.c END FROM g JOIN c ON c.i = g.i + 1),
  l AS (SELECT bin, held FROM g ORDER BY i DESC LIMIT 1)
  SELECT node, CAST(least(bin, (SELECT CASE WHEN held < 50 AND bin > 0 THEN bin - 1 ELSE bin END FROM l)) AS INTEGER) AS bin FROM deg JOIN g ON p = CAST(floor(ln(value) / ln(2) + 1e-9) AS BIGINT)""")
def log_degree_bin_of_node(spark, d):
    return screening.log_bins(network.degree(g1(spark, d)).withColumnRenamed("degree", "value"), 50).select("node", "bin")

# Selection and metrics -------------------------------------------------------------------------------------------

@query(f"""WITH {DRUGS}, net AS (SELECT p_partkey AS node FROM part WHERE p_size <= 40), inside AS (SELECT * FROM drugs WHERE "Status" LIKE '%approved%' AND "Gene_Target" IN (SELECT node FROM net)),
  pos AS (SELECT DISTINCT "Name" FROM inside WHERE regexp_matches("Indication", '(?i)urgent')),
  near AS (SELECT DISTINCT "Name" FROM inside WHERE "Gene_Target" IN (SELECT "Gene_Target" FROM inside WHERE "Name" IN (SELECT "Name" FROM pos))),
  lab AS (SELECT "Name", 1 AS "Positive" FROM pos UNION ALL SELECT DISTINCT "Name", 0 FROM inside WHERE "Name" NOT IN (SELECT "Name" FROM near) AND "Name" NOT IN (SELECT "Name" FROM pos))
  SELECT DISTINCT "Name", "Gene_Target", "Positive" FROM inside JOIN lab USING ("Name")""")
def screen_input_rows(spark, d):
    nodes = _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    genes = _t(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("node"))
    return selection.screen_input(selection.approved_human(drugs(spark, d)), genes, nodes, ["urgent"], _drug_tasks(spark, d))[0].select("Name", "Gene_Target", "Positive")


@query(f"""WITH {DRUGS}, lab AS (SELECT DISTINCT "Name", CASE WHEN "Status" = 'approved' THEN 1 ELSE 0 END AS "Positive" FROM drugs)
  SELECT DISTINCT "Name", 'G' || "Gene_Target" AS gene_id, "Positive" FROM drugs JOIN part ON p_partkey = "Gene_Target" JOIN lab USING ("Name") WHERE p_size <= 25""")
def targets_with_gene_ids(spark, d):
    dr = drugs(spark, d)
    labels = dr.select("Name", F.when(F.col("Status") == "approved", 1).otherwise(0).alias("Positive")).distinct()
    m = _t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("symbol"), F.concat(F.lit("G"), "p_partkey").alias("gene_id"))
    return selection.targets_mapped(dr, labels, m, _drug_tasks(spark, d))


@query("""WITH h AS (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '|' || node), node) <= (count(*) OVER (PARTITION BY rep)) // 5 AS tossed
    FROM (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#11'), (SELECT range AS rep FROM range(1, 4)))
  SELECT rep, p_partkey AS node, CASE WHEN tossed THEN 1 ELSE 0 END AS label FROM part CROSS JOIN (SELECT range AS rep FROM range(1, 4)) r LEFT JOIN h USING (rep, node)""".replace("p_partkey AS node, CASE", "x.node, CASE").replace("FROM part CROSS", "FROM (SELECT p_partkey AS node FROM part) x CROSS").replace("LEFT JOIN h USING (rep, node)", "LEFT JOIN h ON h.rep = r.rep AND h.node = x.node").replace("SELECT rep, x.node", "SELECT r.rep, x.node"))
def held_out_ranking_labels(spark, d):
    reps = spark.range(1, 4).select(F.col("id").alias("rep"))
    genes = _t(spark, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("node"))
    ranked = _t(spark, d, "part").select(F.col("p_partkey").alias("node")).crossJoin(F.broadcast(reps))
    return selection.held_out_labels(ranked, selection.hold_out(genes, reps).where("tossed"), ["rep", "node"]).select("rep", "node", "label")


_AREA = """by_score AS (SELECT score2 AS t, sum(label) AS p, count(*) - sum(label) AS q FROM r1 GROUP BY 1),
pts AS (SELECT t, sum(p) OVER w / sum(p) OVER () AS re, sum(q) OVER w / sum(q) OVER () AS fpr, sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w) AS pr FROM by_score WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT t, re, pr FROM pts UNION ALL SELECT 'infinity'::DOUBLE, 0, 1), prc AS (SELECT -sum(a) AS pr_area FROM (SELECT (re - lag(re) OVER w) * (pr + lag(pr) OVER w) / 2 AS a FROM ends WINDOW w AS (ORDER BY t))),
roc AS (SELECT t, re, fpr FROM pts UNION ALL SELECT 'infinity'::DOUBLE, 0, 0), auc AS (SELECT sum(a) AS auroc FROM (SELECT (fpr - lag(fpr) OVER w) * (re + lag(re) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY t DESC)))"""


@query(f"WITH {R1}, {_AREA} SELECT round(pr_area, 6) AS area FROM prc")
def pr_area_with_ties(spark, d):
    return ranking.pr_area_tied(ranking1(spark, d), "score2").select(*_r("area"))


@query(f"""WITH {R1}, {_AREA}, top AS (SELECT sum(label) AS hits FROM (SELECT label FROM r1 ORDER BY score2 DESC, "Name" LIMIT 100)),
  s AS (SELECT count(*) AS n, round(sum(score2), 6) AS total FROM r1)
  SELECT round(auroc, 6) AS auroc, round(pr_area, 6) AS pr_area, CAST(hits AS BIGINT) AS hits, n, total FROM auc, prc, top, s""")
def evaluation_bundle(spark, d):
    """Scores come in as text and inverted; the bundle turns them for the metrics and returns them as they came."""
    r = ranking1(spark, d)
    got = ranking.evaluate(r.select("Name", (-F.col("score2")).cast("string").alias("Score")), r.select("Name", F.col("label").alias("Positive")), 100, invert=True)
    total = got["scores"].agg(F.count(F.lit(1)).alias("n"), F.round(-F.sum("Score"), 6).alias("total"))
    one = got["auc"].select(F.round("area", 6).alias("auroc")).crossJoin(got["pr_area"].select(F.round("area", 6).alias("pr_area")))
    return one.crossJoin(got["hits"].agg(F.max("hits").alias("hits"))).crossJoin(total)


@query(f"""WITH {R1}, {_AREA.replace("score2", "score")}
  SELECT rank AS top, round(m / rank, 6) AS precision, round(m / p, 6) AS recall, round(p / n, 6) AS base_precision, round(p * rank / (n * n), 6) AS base_recall,
    (SELECT round(auroc, 6) FROM auc) AS auroc, (SELECT count(*) FROM roc) AS roc_points, (SELECT round(sum(re + fpr), 6) FROM roc) AS roc_sum FROM cum""")
def metric_bundle(spark, d):
    """Precision and recall at every N, beside the area, the number of points and the sum of the rates of the ROC."""
    got = ranking.ml_metrics(ranking1(spark, d))
    roc = got["roc"].agg(F.count(F.lit(1)).alias("roc_points"), F.round(F.sum(F.col("tpr") + F.col("fpr")), 6).alias("roc_sum"))
    one = got["auc"].select(F.round("area", 6).alias("auroc")).crossJoin(roc)  # one row
    return got["at"].select("top", *_r("precision", "recall", "base_precision", "base_recall")).crossJoin(F.broadcast(one))


@query(f"""WITH {R1}, c AS (SELECT toxic, row_number() OVER w AS rank, sum(label) OVER w / sum(label) OVER (PARTITION BY toxic) AS tpr FROM r1 WINDOW w AS (PARTITION BY toxic ORDER BY score DESC, "Name" ROWS UNBOUNDED PRECEDING))
  SELECT rank, round(avg(tpr), 6) AS tpr_mean, round(stddev_pop(tpr) / sqrt(count(tpr)), 6) AS tpr_se FROM c GROUP BY 1""")
def mean_curve_over_runs(spark, d):
    c = ranking.roc_points(ranking.cumulative(ranking1(spark, d), [F.desc("score"), "Name"], "label", ("toxic",)))
    return ranking.mean_curve(c, ["rank"], ["tpr"]).select("rank", *_r("tpr_mean", "tpr_se"))


@query("""WITH v AS (SELECT event_type, log10(value) AS v FROM events WHERE value > 0), w AS (SELECT event_type, stddev_samp(v) * pow(count(*), -0.2) AS h, count(*) AS n FROM v GROUP BY 1),
  g AS (SELECT lo + (hi - lo) * i / 29 AS x FROM (SELECT min(v) AS lo, max(v) AS hi FROM v), (SELECT range AS i FROM range(30)))
  SELECT event_type, round(x, 6) AS x, round(sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) / (max(n) * max(h) * 2.5066282746310002), 6) AS density FROM v JOIN w USING (event_type), g GROUP BY 1, x""")
def value_density_log(spark, d):
    return statistics.density(_t(spark, d, "events"), "event_type", "value", 30, log=True).select("event_type", *_r("x", "density"))

# Plans -----------------------------------------------------------------------------------------------------------

@query(f"""WITH {G1}, {W1}, deg AS (SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM g1) GROUP BY 1),
  tot AS (SELECT node, sum(weight) AS total, degree FROM (SELECT unnest([src, dst]) AS node, weight FROM w1) JOIN deg USING (node) GROUP BY 1, 3)
  SELECT round(regr_slope(total, ln(degree)), 6) AS slope, round(regr_intercept(total, ln(degree)), 6) AS intercept, count(DISTINCT degree) AS degrees FROM tot""")
def degree_dependence(spark, d):
    fit, by = pipelines.degree_dependence(g1(spark, d), weights1(spark, d))
    return fit.select(*_r("slope", "intercept")).crossJoin(by.agg(F.count(F.lit(1)).alias("degrees")))


@query(f"""WITH {G1}, {W1}, lab AS (SELECT w1.src || '|' || w1.dst AS "Name", CASE WHEN g1.src IS NULL THEN 0 ELSE 1 END AS label FROM w1 LEFT JOIN g1 ON g1.src = w1.src AND g1.dst = w1.dst),
  x2 AS (SELECT 'p' || l_partkey || '|s' || l_suppkey AS "Name", round(avg(l_quantity), 6) AS score FROM lineitem GROUP BY 1),
  a AS (SELECT "Name", row_number() OVER (ORDER BY weight DESC, "Name") AS r1, count(*) OVER () AS n1 FROM (SELECT src || '|' || dst AS "Name", weight FROM w1)),
  b AS (SELECT "Name", row_number() OVER (ORDER BY score DESC, "Name") AS r2, count(*) OVER () AS n2 FROM x2), {FUSED} SELECT method, auroc, hits FROM fe""")
def fused_edge_ranking(spark, d):
    other = _t(spark, d, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.round(F.avg("l_quantity"), 6).alias("weight"))
    return pipelines.fused_edges(weights1(spark, d).select("src", "dst", "weight"), other, g1(spark, d)).select("method", *_r("auroc"), "hits")


@query(f"""WITH {G1}, {W1}, mod AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size <= 5 UNION ALL SELECT 's' || s_suppkey FROM supplier),
  two AS (SELECT weight, CASE WHEN g1.src IS NULL THEN 0 ELSE 1 END AS label FROM w1 LEFT JOIN g1 ON g1.src = w1.src AND g1.dst = w1.dst WHERE w1.src IN (SELECT node FROM mod) AND w1.dst IN (SELECT node FROM mod)),
  t AS (SELECT weight, sum(label) AS p, count(*) - sum(label) AS q FROM two GROUP BY 1)
  SELECT round(sum(q * (up - p / 2)) / (sum(q) * sum(p)), 6) AS auroc, CAST(sum(p) AS BIGINT) AS edges, CAST(sum(q) AS BIGINT) AS others FROM (SELECT p, q, sum(p) OVER (ORDER BY weight DESC ROWS UNBOUNDED PRECEDING) AS up FROM t)""")
def module_separability(spark, d):
    module = _t(spark, d, "part").where("p_size <= 5").select(F.concat(F.lit("p"), "p_partkey").alias("node")).unionByName(_t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    return pipelines.module_separability(g1(spark, d), weights1(spark, d), module).select(*_r("auroc"), "edges", "others")


_SHIFT = """pr AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, avg(l_discount) AS w0, avg(l_tax) AS w1 FROM lineitem GROUP BY 1, 2),
cls AS (SELECT 's' || s_suppkey AS dst, 'n' || s_nationkey AS disease, s_nationkey % 2 = 0 AS in_class FROM supplier),
v AS (SELECT disease, in_class, w0, w1 FROM pr JOIN cls USING (dst))"""


_EMD = """x AS (SELECT disease, in_class, round(w0, 6) AS value, 1 AS a, 0 AS b FROM v UNION ALL SELECT disease, in_class, round(w1, 6), 0, 1 FROM v),
  t AS (SELECT disease, in_class, value, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2, 3),
  c AS (SELECT disease, in_class, abs(sum(a) OVER w / sum(a) OVER k - sum(b) OVER w / sum(b) OVER k) * (lead(value) OVER (PARTITION BY disease ORDER BY value) - value) AS part
    FROM t WINDOW k AS (PARTITION BY disease), w AS (PARTITION BY disease ORDER BY value ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT disease, median(value) FILTER (a = 1) AS ma, median(value) FILTER (b = 1) AS mb FROM x GROUP BY 1),
  e AS (SELECT disease, in_class, sum(part) * sign(mb - ma) AS emd FROM c JOIN m USING (disease) GROUP BY disease, in_class, ma, mb)"""


@query(f"WITH {_SHIFT}, {_EMD}" + """ SELECT in_class, round(quantile_cont(emd, 0.25), 6) AS q1, round(quantile_cont(emd, 0.5), 6) AS median, round(quantile_cont(emd, 0.75), 6) AS q3, round(quantile_cont(emd, 0.75) - quantile_cont(emd, 0.25), 6) AS iqr FROM e GROUP BY 1""")
def shift_quartiles_by_class(spark, d):
    """Discounts against taxes of each nation's suppliers, by whether the nation's number is even."""
    return _shift_report(spark, d)[1].select("in_class", *_r("q1", "median", "q3", "iqr"))


@query(f"WITH {_SHIFT}, {_EMD}" + """, placed AS (SELECT in_class, least(CAST(floor((emd + 0.1) / (0.2 / 19)) AS INTEGER) + 1, 19) AS bin FROM e WHERE emd BETWEEN -0.1 AND 0.1),
  size AS (SELECT in_class, count(*) AS n FROM placed GROUP BY 1), found AS (SELECT in_class, bin, count(*) AS k FROM placed GROUP BY 1, 2)
  SELECT size.in_class, CAST(range AS INTEGER) AS bin, round(coalesce(k, 0) / (n * (0.2 / 19)), 6) AS density FROM size CROSS JOIN range(1, 20) LEFT JOIN found ON found.in_class = size.in_class AND found.bin = range""")
def shift_histogram_by_class(spark, d):
    return _shift_report(spark, d)[0].select("in_class", "bin", *_r("density"))


def _shift_report(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("w0"), F.round(F.avg("l_tax"), 6).alias("w1"))
    v = rows.join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").withColumn("disease", F.concat(F.lit("n"), "s_nationkey"))
    shifts = statistics.signed_emd(v.select("disease", F.col("w0").alias("value")), v.select("disease", F.col("w1").alias("value")), ("disease",))
    classes = v.select("disease", (F.col("s_nationkey") % 2 == 0).alias("in_class")).distinct()
    return pipelines.shift_report(shifts, classes, -0.1, 0.1)


@query(f"""WITH RECURSIVE {G1}, {W1}, net AS (SELECT 'plain' AS network, src, dst, CAST(1 AS DOUBLE) AS w FROM g1 UNION ALL SELECT 'weighted', src, dst, weight FROM g1 JOIN w1 USING (src, dst) WHERE weight > 0),
  cells AS (SELECT network, src, dst, w FROM net UNION ALL SELECT network, dst, src, w FROM net), steps AS (SELECT network, src, dst, w / sum(w) OVER (PARTITION BY network, src) AS share FROM cells),
  nodes AS (SELECT DISTINCT network, src AS node FROM cells), h AS (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '|' || node), node) <= (count(*) OVER (PARTITION BY rep)) // 5 AS tossed
    FROM (SELECT 'p' || p_partkey AS node FROM part WHERE p_brand = 'Brand#11'), (SELECT range AS rep FROM range(1, 4))),
  live AS (SELECT network, rep, node, 1.0 / count(*) OVER (PARTITION BY network, rep) AS p FROM h JOIN nodes USING (node) WHERE NOT tossed),
  base AS (SELECT n.network, r.rep, n.node, coalesce(p, 0) AS p FROM nodes n CROSS JOIN (SELECT range AS rep FROM range(1, 4)) r LEFT JOIN live l ON l.network = n.network AND l.rep = r.rep AND l.node = n.node),
  walk AS (SELECT 0 AS k, network, rep, node, CAST(1.0 AS DOUBLE) / count(*) OVER (PARTITION BY network, rep) AS score FROM base
    UNION ALL SELECT w.k + 1, w.network, w.rep, s.dst, 0.6 * sum(w.score * s.share) + 0.4 * max(b.p) FROM walk w JOIN steps s ON s.network = w.network AND s.src = w.node
      JOIN base b ON b.network = w.network AND b.rep = w.rep AND b.node = s.dst WHERE w.k < 70 GROUP BY w.k, w.network, w.rep, s.dst),
  seeds AS (SELECT rep, node FROM h WHERE NOT tossed),
  f AS (SELECT network, w.rep, w.node, round(score, 6) AS s, CASE WHEN t.node IS NULL THEN 0 ELSE 1 END AS label FROM walk w LEFT JOIN (SELECT rep, node FROM h WHERE tossed) t ON t.rep = w.rep AND t.node = w.node
    WHERE k = 70 AND (w.rep, w.node) NOT IN (SELECT (rep, node) FROM seeds)),
  rk AS (SELECT network, rep, label, row_number() OVER w AS rank, sum(label) OVER w AS m, sum(label) OVER (PARTITION BY network, rep) AS p, count(*) OVER (PARTITION BY network, rep) AS n
    FROM f WINDOW w AS (PARTITION BY network, rep ORDER BY s DESC, node ROWS UNBOUNDED PRECEDING)),
  st AS (SELECT network, rep, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM (SELECT network, rep, rank, m / p AS y, (rank - m) / (n - p) AS x FROM rk) WINDOW w AS (PARTITION BY network, rep ORDER BY rank))
  SELECT network, round(avg(a), 4) AS auroc FROM (SELECT network, rep, sum(a) AS a FROM st GROUP BY 1, 2) GROUP BY 1""")
def module_detection_by_network(spark, d):
    """Held-out genes of one brand found again by walks on the plain and on the weighted graph."""
    nets = _networks(spark, d)
    found = _detected(nets, spark, d)
    return pipelines.module_areas(found, ("network",)).select("network", F.round("auroc", 4).alias("auroc"))


def _networks(spark, d):
    plain = g1(spark, d).withColumns({"weight": F.lit(1.0), "network": F.lit("plain")})
    w = network.weighted(g1(spark, d), weights1(spark, d)).where("weight > 0").withColumn("network", F.lit("weighted"))
    return checkpointed(plain.unionByName(w))


def _detected(nets, spark, d):
    genes = _brand(spark, d)
    return checkpointed(pipelines.module_detection(checkpointed(nets), genes, spark.range(1, 4).select(F.col("id").alias("rep")), keys=("network",), digits=6, tol=1e-14))


@query()
def fused_module_ranking(spark, d):
    return pipelines.fused_modules(_detected(_networks(spark, d), spark, d), "plain", "weighted").select("method", F.round("auroc", 4).alias("auroc"), "hits")
