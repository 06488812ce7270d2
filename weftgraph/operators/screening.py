"""Proximity of drugs to diseases on a network, against random sets of nodes of the same bins.

The draws of one disease form batches; a task draws a batch's node numbers by a hash of (seed, set, node, iteration),
looks up the rows of a packed table of distances, takes their minimum over each drawn disease set and its mean over each
drawn target set, and folds the results to moments. No draw is a row of a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, running
from weftgraph.operators.distances import distances, packed_table

DRAWS = 250  # iterations of a batch
TILE_BYTES = 256 << 20  # of the packed table that are broadcast at a time; a larger one is looked up in column tiles
CELLS = 1 << 20  # draws (iterations times nodes) that are looked up at a time
BLOCK_TARGETS = 50_000  # targets of drugs that a task looks up together, about
_MOMENTS = "disease string, drug string, d double, n long, mean double, m2 double, below long"
_SUMS = "disease string, drug string, batch int, sums binary, counts binary"


def proximity(edges: DataFrame, targets: DataFrame, diseases: DataFrame) -> DataFrame:
    """(drug, disease, d): mean over a drug's targets of the distance to the nearest disease gene.

    targets(drug, node), diseases(disease, node)."""
    to = distances(edges, diseases.select(F.col("disease").alias("source"), "node"))
    return targets.distinct().join(to, "node").groupBy("drug", F.col("source").alias("disease")).agg(F.avg("dist").alias("d"))


def degree_bins(measure: DataFrame, bin_size: int) -> DataFrame:
    """(node, bin, slot): nodes by ordered measure in bins of bin_size; what is left over joins the last bin.

    measure(node, value). Places go by range partitions of (value, node): no value, however common, is one task."""
    total = measure.agg(F.count(F.lit(1)).alias("n"))
    placed = running(measure.select("node", "value"), [F.col("value"), F.col("node")], {}).withColumn("pos", F.col("rank") - 1)
    last = F.greatest(F.floor(F.col("n") / bin_size) - 1, F.lit(0))
    binned = placed.crossJoin(F.broadcast(total)).withColumn("bin", F.least(F.floor(F.col("pos") / bin_size), last).cast("int"))
    return binned.select("node", "bin", (F.col("pos") - F.col("bin") * bin_size).cast("int").alias("slot"))


def log_bins(measure: DataFrame, bin_size: int, base: float = 2.0) -> DataFrame:
    """(node, bin, slot): nodes in classes of floor(log_base value); neighbouring classes merge until a bin has
    bin_size nodes, what is left over joins the last bin. measure(node, value >= 0); value 0 is a class of its own."""
    power = F.when(F.col("value") > 0, F.floor(F.log(F.col("value").cast("double")) / float(np.log(base)) + 1e-9)).otherwise(F.lit(-(1 << 20)))
    classed = measure.select("node", "value", power.cast("long").alias("power"))
    counts = classed.groupBy("power").agg(F.count(F.lit(1)).alias("c")).orderBy("power").collect()  # a row for each power of the base
    bin_of, now, held = {}, 0, 0
    for r in counts:
        if held >= bin_size:
            now, held = now + 1, 0
        bin_of[r["power"]] = now
        held += r["c"]
    if held < bin_size and now:
        bin_of = {p: min(b, now - 1) for p, b in bin_of.items()}
    start, before = {}, 0
    for r in counts:
        start.setdefault(bin_of[r["power"]], before)
        before += r["c"]
    rows = [(p, b, start[b]) for p, b in sorted(bin_of.items())]
    table = measure.sparkSession.createDataFrame(rows, "power long, bin int, start long")
    # classes follow one another in the order of values, so a slot is a place less its bin's first place
    placed = running(classed, [F.col("value"), F.col("node")], {}).join(F.broadcast(table), "power")
    return placed.select("node", "bin", (F.col("rank") - 1 - F.col("start")).cast("int").alias("slot"))


def draw_key(seed: int, *columns):
    """32 bits of a set's node; with an iteration's number they give a draw (``drawn``)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *columns)), 1, 8), 16, 10).cast("long")


def drawn(key: np.ndarray, iteration: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slots below size: a mixing hash of 32 bits of key + iteration * 2654435769, modulo size."""
    low = np.uint64(0xFFFFFFFF)
    x = (key.astype(np.uint64)[None, :] + iteration.astype(np.uint64)[:, None] * np.uint64(2654435769)) & low
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(73244475) & low
    return (((x >> np.uint64(16)) ^ x) % size.astype(np.uint64)[None, :]).astype(np.int64)


def random_sets(bins: DataFrame, sets: DataFrame, n_iter: int, seed: int) -> DataFrame:
    """(set, iter, node): for each set(set, node) random nodes of the same bins, the draws of ``screening`` as rows."""
    size = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    wanted = sets.join(bins, "node").join(size, "bin").select("set", "node", "bin", "size", draw_key(seed, "set", "node").alias("key"))
    rows = wanted.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    x = (F.col("key") + F.col("iter").cast("long") * 2654435769) % (1 << 32)
    for _ in range(2):
        x = F.shiftright(x, 16).bitwiseXOR(x) * 73244475 % (1 << 32)
    rows = rows.withColumn("slot", (F.shiftright(x, 16).bitwiseXOR(x) % F.col("size")).cast("int"))
    return rows.drop("node").join(bins, ["bin", "slot"]).select("set", "iter", "node")


def _merged(parts: DataFrame) -> DataFrame:
    """Moments of batches as moments of all their iterations: equal batches leave no rounding behind."""
    state = "cast(0 AS bigint) AS n, cast(0 AS double) AS mean, cast(0 AS double) AS m2, cast(0 AS bigint) AS below"
    step = """named_struct('n', s.n + x.n, 'mean', s.mean + (x.mean - s.mean) * x.n / (s.n + x.n),
      'm2', s.m2 + x.m2 + (x.mean - s.mean) * (x.mean - s.mean) * s.n * x.n / (s.n + x.n), 'below', s.below + x.below)"""
    listed = parts.groupBy("drug", "disease").agg(F.max("d").alias("d"), F.array_sort(F.collect_list(F.struct("n", "mean", "m2", "below"))).alias("x"))  # a row for each batch
    empty = "named_struct(" + ", ".join(f"'{c.split(' AS ')[-1]}', {c.rsplit(' AS ', 1)[0]}" for c in state.split(", ")) + ")"
    whole = listed.select("drug", "disease", "d", F.expr(f"aggregate(x, {empty}, (s, x) -> {step})").alias("m"))
    std = F.sqrt(F.col("m.m2") / F.col("m.n"))
    out = whole.select("drug", "disease", "d", F.col("m.mean").alias("mean"), std.alias("std"), (F.col("m.below") / F.col("m.n")).alias("p"))
    return out.withColumn("z", F.try_divide(F.col("d") - F.col("mean"), F.col("std")))


def _fold(sums: np.ndarray, counts: np.ndarray, d: float):
    """(n, mean, M2, how many are at most d) of sums / counts, without the iterations that reach nothing."""
    x = sums[counts > 0] / counts[counts > 0]
    if not len(x):
        return 0, 0.0, 0.0, 0
    # taken from the first value, so that equal values have exactly no spread
    off = x - x[0]
    mean = off.mean()
    return len(x), float(x[0] + mean), float(((off - mean) ** 2).sum()), int((x <= d).sum())


def _look_up(table: np.ndarray, far, genes, targets, starts, iterations, real: bool):
    """(sums, counts) over each drug's targets of the distance to the nearest gene: a row for each iteration.

    genes and targets: (key, first, size, own) of each; with ``real`` the sets themselves are looked up. Draws of more
    than CELLS are made and looked up one stretch of nodes after another."""
    rounds = 1 if real else len(iterations)
    step = max(1, CELLS // max(1, rounds))

    def numbers(rows, a):
        key, first, size, own = (x[a : a + step] for x in rows)
        return own[None, :] if real else first[None, :] + drawn(key, iterations, size)

    near = None
    for a in range(0, len(genes[0]), step):
        at = numbers(genes, a)
        for g in range(at.shape[1]):
            near = table[at[:, g]] if near is None else np.minimum(near, table[at[:, g]], out=near)
    sums, counts = np.zeros((rounds, len(starts))), np.zeros((rounds, len(starts)), np.int64)
    for a in range(0, len(targets[0][0]), step):
        # targets whose numbers lie in this tile
        column = numbers(targets[0], a) - targets[1]
        inside = (column >= 0) & (column < table.shape[1])
        found = near[np.arange(len(near))[:, None], np.where(inside, column, 0)]
        known = inside & (found != far)
        # the drugs that this stretch has a part of
        k, end = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, a + column.shape[1])
        own = np.maximum(np.asarray(starts[k:end]) - a, 0)
        sums[:, k:end] += np.add.reduceat(np.where(known, found, 0).astype(np.float64), own, axis=1)
        counts[:, k:end] += np.add.reduceat(known.astype(np.int64), own, axis=1)
    return sums, counts


def _lists(sets: DataFrame, name: str, numbered: DataFrame, seed: int, *groups: str) -> DataFrame:
    """Rows of sets(name, node) with their draw's key, bin and number, as arrays of a group."""
    rows = sets.select(name, "node").distinct().join(numbered, "node")
    fields = F.struct(F.col(name).alias("set"), "node", draw_key(seed, name, "node").alias("key"), "first", "size", "number")
    # names of nodes give the order only; tasks get the numbers
    return rows.groupBy(*groups or (name,)).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x.dropFields("node")).alias("rows"))


def screening(edges: DataFrame, targets: DataFrame, diseases: DataFrame, bins: DataFrame, n_iter: int = 10_000, seed: int = 1) -> DataFrame:
    """(drug, disease, d, mean, std, p, z): proximity, and its place among random targets and disease genes of the same bins.

    edges(src, dst[, weight > 0]); targets(drug, node), diseases(disease, node): nodes without edges or bin are left out,
    repeats count once; bins(node, bin, slot from 0). Iteration i draws anew for every node of both sets, a node of its
    bin each (repeats are possible). Targets that reach no gene are left out of a mean, iterations without any out of the
    moments. One disease's genes are in one task at a time, and the table of distances between all nodes is broadcast in
    tiles of TILE_BYTES.
    """
    spark = edges.sparkSession
    size = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    first = running(size, [F.col("bin")], {"upto": "size"}).select("bin", "size", (F.col("upto") - F.col("size")).alias("first"))
    numbered = checkpointed(bins.join(first, "bin").select("node", "first", "size", (F.col("first") + F.col("slot")).alias("number")))
    n = numbered.count()
    if not n:
        return _merged(spark.createDataFrame([], _MOMENTS))  # no network, nothing to look up
    cells, kind = packed_table(edges, numbered, n)
    far = np.inf if kind.kind == "f" else np.iinfo(kind).max
    wide = max(1, min(n, TILE_BYTES // max(1, n * kind.itemsize)))
    tiles = -(-n // wide)
    # drugs in blocks of about BLOCK_TARGETS, diseases in batches of iterations
    blocks = max(1, -(-targets.count() // BLOCK_TARGETS))
    drugs = _lists(targets, "drug", numbered, seed, F.pmod(F.xxhash64("drug"), F.lit(blocks)).alias("block")).withColumnRenamed("rows", "targets")
    genes = _lists(diseases, "disease", numbered, seed + 1).withColumnRenamed("rows", "genes")
    batch = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n_iter // DRAWS) - 1))))
    units = checkpointed(genes.select("disease", "genes", batch.alias("batch")).repartition(spark.sparkContext.defaultParallelism * 4, "disease", "batch").crossJoin(drugs))

    def arrays(rows):
        get = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        return get("key"), get("first"), get("size"), get("number")

    def scan(sent, begin):
        def look(batches):
            table = np.frombuffer(sent.value, kind).reshape(n, -1)
            for batch in batches:
                for i in range(batch.num_rows):
                    disease, b = str(batch.column(0)[i]), batch.column(2)[i].as_py()
                    g, t = batch.column(1)[i].values, batch.column(4)[i].values
                    names = t.field("set").to_pylist()
                    starts = np.flatnonzero([a != b for a, b in zip(names, [None, *names])])
                    drugs = [str(names[s]) for s in starts]
                    iterations = np.arange(b * DRAWS, min(n_iter, (b + 1) * DRAWS))
                    args = arrays(g), (arrays(t), begin), starts, iterations
                    real = _look_up(table, far, *args, True)
                    sums, counts = _look_up(table, far, *args, False)
                    out = []
                    for k, drug in enumerate(drugs):
                        if tiles > 1:
                            # the sets' own sums come first
                            both = [np.concatenate((r[:, k], x[:, k])).tobytes() for r, x in zip(real, (sums, counts))]
                            out.append((disease, drug, b, *both))
                        elif real[1][0, k]:
                            d = real[0][0, k] / real[1][0, k]
                            out.append((disease, drug, float(d), *_fold(sums[:, k], counts[:, k], d)))
                    yield pa.RecordBatch.from_pylist([dict(zip(fields, r)) for r in out], schema)

        return look

    text = _SUMS if tiles > 1 else _MOMENTS
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")])
    fields, found = schema.names, None
    for tile in range(tiles):
        a = tile * wide
        part = cells.select("number", F.expr(f"substring(cells, {a * kind.itemsize + 1}, {wide * kind.itemsize})").alias("c"))
        rows = part.toArrow().sort_by("number").column("c")  # at most TILE_BYTES
        sent = spark.sparkContext.broadcast(b"".join(c.as_py() for c in rows))
        one = checkpointed(units.mapInArrow(scan(sent, a), text))
        found = one if found is None else found.unionByName(one)
    if tiles > 1:
        def add(frame):
            s, c = (np.sum([np.frombuffer(x, t) for x in frame[f]], axis=0) for f, t in (("sums", np.float64), ("counts", np.int64)))
            d = s[0] / c[0] if c[0] else np.nan
            return frame[["disease", "drug"]].head(1 if c[0] else 0).assign(d=d, **dict(zip(("n", "mean", "m2", "below"), _fold(s[1:], c[1:], d))))

        found = found.groupBy("disease", "drug", "batch").applyInPandas(add, _MOMENTS)
    return _merged(found.where("n > 0"))
