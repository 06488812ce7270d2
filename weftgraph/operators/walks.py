"""Random walks; many runs at once by key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.iterate import checkpointed, mirror, running

WIDTH = 32  # runs whose scores are columns of one matrix
LOOK = 4  # rounds between two looks at a walk's change; a walk may go on for as many rounds too long
PACK = 2_000_000  # edges of a pack, about
HELD = 1_000_000  # edges that a task holds before it packs them
NAMED = 1_500_000  # nodes whose places are broadcast; with more of them edges are shuffled to find the places
CELLS = 1 << 20  # scores of a part of the nodes at most

_AT = "_net int, _block int, _part int"
_STATE = f"{_AT}, parts int, n long, y binary, cur binary, off array<double>"
_NOW, _BEFORE, _FIXED = 1, 2, 3
_BASE = ["_net", "_block", "_part"]


def random_walk(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), restart: float = 0.4, tol: float = 1e-10, max_iter: int = 500) -> DataFrame:
    """(keys, node, score): walk with restart by edge weight, one loop for all keys.

    edges(keys?, src, dst[, weight]); seeds(keys, node). Starts from 1/N; mass of nodes without edges goes to the seeds;
    stops when every key's change is below N * tol. A key whose seeds have no edges has no rows.

    Nodes are dealt to parts by hash. The edges between two parts are packed once into arrays of places in them; they stay
    where they are, and a round sends to a pack the scores of its two parts as matrices (a row for each of up to WIDTH runs)
    and what the pack moves back to the parts. Blocks of runs that have settled leave the loop. ``edges`` is read three
    times and not stored: what is shuffled are the packs, 2 or 4 bytes a place and 8 a weight, none where all are equal.

    Edges go both ways, so a step is like a symmetric matrix with eigenvalues within 1 - restart; where no weight is
    negative, rounds are combined by Chebyshev's recurrence, which reaches the same scores in about half the rounds.
    """
    spark, k = edges.sparkSession, list(keys)
    own = [c for c in k if c in edges.columns]
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in edges.columns else F.lit(1.0)
    once = edges.where("src is not null and dst is not null").select(*own, "src", "dst", w.alias("weight"))
    total = mirror(once).groupBy(*own, F.col("src").alias("node")).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("ways"), F.min("weight").alias("least"))
    total = checkpointed(total)
    live = checkpointed(seeds.select(*k, "node").distinct().join(total, [*own, "node"], "left_semi"))
    counts = live.groupBy(*k).agg(F.count(F.lit(1)).alias("seeds")).where("seeds > 0").orderBy(*k or ["seeds"]).collect()  # a row for each run
    if not counts:
        return live.select(*k, "node", F.lit(0.0).alias("score"))
    net, runs, width = {}, [], 1
    for r in counts:
        at = net.setdefault(tuple(r[c] for c in own), [len(net), 0])
        runs.append((*(r[c] for c in k), at[0], at[1] // WIDTH, at[1] % WIDTH, r["seeds"]))
        width, at[1] = max(width, at[1] % WIDTH + 1), at[1] + 1
    sizes = total.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum("ways").alias("ways"), F.min("least").alias("least")).collect()  # a row for each network
    nets, packs_in_all, signed = [], 0, False
    for r in sizes:
        name = tuple(r[c] for c in own)
        if name in net:
            parts = max(1, math.ceil(math.sqrt(r["ways"] / PACK)), math.ceil(r["n"] * width / CELLS))
            nets.append((*name, net[name][0], parts, r["n"]))
            packs_in_all, signed = packs_in_all + parts * (parts + 1) // 2, signed or r["least"] < 0
    kinds = {c: t for c, t in live.dtypes}
    typed = lambda cs: "".join(f"{c} {kinds[c]}, " for c in cs)
    runs = spark.createDataFrame(runs, typed(k) + "_net int, _block int, _slot int, _seeds long")
    nets = F.broadcast(spark.createDataFrame(nets, typed(own) + "_net int, parts int, n long"))
    in_part = Window.partitionBy("_net", "_part").orderBy("node")
    nodes = total.join(nets, own) if own else total.crossJoin(nets)
    nodes = nodes.withColumn("_part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    nodes = checkpointed(nodes.select("_net", "_part", "parts", "n", "node", "total", (F.row_number().over(in_part) - 1).alias("pos")))
    packs = _packs(once.join(nets, own) if own else once.crossJoin(nets), nodes, packs_in_all, sum(r["n"] for r in sizes))
    fixed = checkpointed(_fixed(nodes, live, runs, k, width, restart))
    state = last = checkpointed(_started(fixed))
    done, keep, omega = None, 1 - restart, 1.0
    rate = 0.0 if signed else keep * keep
    for turn in range(1, max_iter + 1):
        omega = 1.0 if turn == 1 else 1 / (1 - rate / 2) if turn == 2 else 1 / (1 - rate * omega / 4)
        state, last = checkpointed(_round(packs, fixed, state, last, width, keep, omega)), state  # a round reads the state twice
        if turn % LOOK:
            continue
        off = state.select("_net", "_block", "n", F.posexplode("off")).groupBy("_net", "_block", "n", "pos").agg(F.sum("col").alias("off"))
        left = off.groupBy("_net", "_block").agg(F.max(F.col("off") / F.col("n")).alias("off")).collect()  # a row for each block of runs
        settled = [(r["_net"], r["_block"]) for r in left if r["off"] < tol]
        if len(settled) == len(left):
            break
        if settled:
            is_done = F.struct("_net", "_block").isin([F.struct(F.lit(a), F.lit(b)) for a, b in settled])
            over, state, last, fixed = state.where(is_done), state.where(~is_done), last.where(~is_done), fixed.where(~is_done)
            done = over if done is None else done.unionByName(over)
    packs.unpersist()
    state = state if done is None else state.unionByName(done)
    each = _scores(state, width).join(F.broadcast(runs), ["_net", "_block", "_slot"])  # a row for each run
    return each.join(nodes, ["_net", "_part", "pos"]).select(*k, "node", "score")


def _packs(once: DataFrame, nodes: DataFrame, count: int, named: int) -> DataFrame:
    """(_net, _a, _b, m, i, j, weight): m edges between two parts as arrays of places, each edge once; several rows a pack.

    A task packs the edges that it reads, so no edge is shuffled as a row unless the nodes are too many to be broadcast."""
    at = nodes.select("_net", "node", "_part", "pos")
    for end, part, pos in (("src", "_a", "_i"), ("dst", "_b", "_j")):
        places = at.select("_net", F.col("node").alias(end), F.col("_part").alias(part), F.col("pos").alias(pos))
        once = once.join(F.broadcast(places) if named <= NAMED else places, ["_net", end])

    def packed(held):
        net, a, b, i, j, weight = (np.concatenate(c) for c in zip(*held))
        swap = a > b
        a, b, i, j = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, j, i), np.where(swap, i, j)
        key = (net.astype(np.int64) * (a.max() + 1) + a) * (b.max() + 1) + b
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        for rows in np.split(order, starts[1:]):
            short = np.uint16 if max(i[rows].max(), j[rows].max()) < 1 << 16 else np.int32
            w = weight[rows]
            w = w[:1] if (w == w[0]).all() else w
            values = (net[rows[0]], a[rows[0]], b[rows[0]], len(rows), i[rows].astype(short).tobytes(), j[rows].astype(short).tobytes(), w.tobytes())
            types = [pa.int32()] * 4 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["_net", "_a", "_b", "m", "i", "j", "weight"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                size += batch.num_rows
            if size >= HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    rows = once.select("_net", "_a", "_b", "_i", "_j", "weight").mapInArrow(pack, "_net int, _a int, _b int, m int, i binary, j binary, weight binary")
    return rows.repartition(min(count, 1000), "_net", "_a", "_b").persist(StorageLevel.MEMORY_AND_DISK)  # dealt once, not in each round


def _edges_of(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight) of all rows of one pack; one weight if all are equal."""
    i, j = (np.concatenate([np.frombuffer(x, np.uint16 if len(x) == 2 * m else np.int32) for x, m in zip(p[c], p["m"])], dtype=np.intp) for c in "ij")
    weights = [np.frombuffer(x) for x in p["weight"]]
    if all(len(w) == 1 and w[0] == weights[0][0] for w in weights):
        return i, j, weights[0]
    return i, j, np.concatenate([np.broadcast_to(w, m) for w, m in zip(weights, p["m"])])


def _fixed(nodes: DataFrame, live: DataFrame, runs: DataFrame, k: list[str], width: int, restart: float) -> DataFrame:
    """What doesn't change, for each part and block of runs: what restarts (back), and one over the nodes' weights (inv)."""
    placed = live.join(F.broadcast(runs), k) if k else live.crossJoin(F.broadcast(runs))
    placed = placed.join(nodes, ["_net", "node"]).select(*_BASE, "parts", "n", "pos", F.lit(0.0).alias("total"), "_slot", (restart / F.col("_seeds")).alias("back"))
    rows = nodes.join(F.broadcast(runs.select("_net", "_block").distinct()), "_net")
    rows = rows.select(*_BASE, "parts", "n", "pos", "total", F.lit(-1).alias("_slot"), F.lit(0.0).alias("back"))

    def fix(f):
        slot, pos, total = (f[c].to_numpy() for c in ("_slot", "pos", "total"))
        seed = slot >= 0
        inv = np.zeros(len(f) - seed.sum())
        inv[pos[~seed]] = np.divide(1.0, total[~seed], out=np.zeros(len(inv)), where=total[~seed] != 0)
        back = np.zeros((width, len(inv)))
        back[slot[seed], pos[seed]] = f["back"].to_numpy()[seed]
        return pd.DataFrame({**{c: f[c].iloc[:1].to_numpy() for c in (*_BASE, "parts", "n")}, "back": [back.tobytes()], "inv": [inv.tobytes()]})

    return rows.unionByName(placed).groupBy(*_BASE).applyInPandas(fix, f"{_AT}, parts int, n long, back binary, inv binary")


def _started(fixed: DataFrame) -> DataFrame:
    def start(frames):
        for f in frames:
            cur = [np.full(len(b) // 8, 1 / n) for b, n in zip(f["back"], f["n"])]
            y = [(c.reshape(-1, len(i) // 8) * np.frombuffer(i)).tobytes() for c, i in zip(cur, f["inv"])]
            yield f.drop(columns=["back", "inv"]).assign(y=y, cur=[c.tobytes() for c in cur], off=[np.zeros(1)] * len(f))

    return fixed.mapInPandas(start, _STATE)


def _round(packs: DataFrame, fixed: DataFrame, state: DataFrame, last: DataFrame, width: int, keep: float, omega: float) -> DataFrame:
    """The state after one more step; ``last`` is the state before this one."""
    def move(p, s):
        y = {(n, b, t): np.frombuffer(v).reshape(width, -1) for n, b, t, v in zip(s["_net"], s["_block"], s["_part"], s["y"])}
        out = []
        if len(p) and y:
            (i, j, weight), a, b = _edges_of(p), p["_a"].iloc[0], p["_b"].iloc[0]
            back = np.where(i == j, 0, weight) if a == b else weight  # a loop is one way
            for (net, block, part), rows in y.items():
                other, at, to = (b, i, j) if part == a else (a, j, i)
                size = y[net, block, other].shape[1]
                moved = np.stack([np.bincount(to, row[at] * weight, size) for row in rows])
                if a == b:
                    moved += [np.bincount(at, row[to] * back, size) for row in rows]
                out.append((net, block, other, moved.tobytes()))
        return pd.DataFrame(out, columns=[*_BASE, "y"])

    def settle(f):
        kind, v = f["kind"].to_numpy(), f["v"].to_numpy()
        cur, prev = (np.frombuffer(v[kind == x][0]).reshape(width, -1) for x in (_NOW, _BEFORE))
        one = f[kind == _FIXED].iloc[0]
        new = np.zeros(cur.size)
        for y in v[kind == 0]:
            new += np.frombuffer(y)
        new = omega * (keep * new.reshape(cur.shape) + np.frombuffer(one["v"]).reshape(cur.shape) - prev) + prev
        return pd.DataFrame({**{c: [one[c]] for c in (*_BASE, "parts", "n")}, "y": [(new * np.frombuffer(one["inv"])).tobytes()], "cur": [new.tobytes()], "off": [np.abs(new - cur).sum(1)]})

    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other")
    sent = state.select(*_BASE, "y", other).select(*_BASE, "y", F.least("_part", "_other").alias("_a"), F.greatest("_part", "_other").alias("_b"))
    at = ["_net", "_a", "_b"]
    rows = packs.groupBy(*at).cogroup(sent.groupBy(*at)).applyInPandas(move, f"{_AT}, y binary").select(*_BASE, F.lit(0).alias("kind"), F.col("y").alias("v"))
    for kind, df in ((_NOW, state), (_BEFORE, last)):
        rows = rows.unionByName(df.select(*_BASE, F.lit(kind).alias("kind"), F.col("cur").alias("v")))
    rows = rows.unionByName(fixed.select(*_BASE, "parts", "n", F.lit(_FIXED).alias("kind"), F.col("back").alias("v"), "inv"), allowMissingColumns=True)
    return rows.groupBy(*_BASE).applyInPandas(settle, _STATE)


def _scores(state: DataFrame, width: int) -> DataFrame:
    def rows(frames):
        for f in frames:
            for net, block, part, cur in zip(f["_net"], f["_block"], f["_part"], f["cur"]):
                cur = np.frombuffer(cur)
                size = len(cur) // width
                yield pd.DataFrame({"_net": net, "_block": block, "_part": part, "pos": np.tile(np.arange(size, dtype=np.int32), width),
                                    "_slot": np.repeat(np.arange(width, dtype=np.int32), size), "score": cur})

    return state.select(*_BASE, "cur").mapInPandas(rows, f"{_AT}, pos int, _slot int, score double")


def ranked_without_seeds(scores: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores without the seeds, ranked from 1 by falling score, ties by node."""
    k = list(keys)
    left = scores.join(seeds, [*k, "node"], "left_anti")
    if not k:
        return running(left, [F.desc("score"), F.col("node")], {})
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("score"), "node")).cast("long"))
