"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension.

Law: ``bytes`` (shard sizes nearly equal). A node that is to become m shards is cut where floor(m/2)/m of its bytes lie
on the left. The widest dimension of a node is the one with the largest weighted variance there, numbers being scaled
by the logarithm and strings by their hash, so that a node is cut along another dimension once one has been used up.
Medians are found by refining histograms over the key bits, a few sums a round; only histogram rows and the tree (two
numbers a split) reach the driver. Equal texts share all coordinates, those of their first document, and so a leaf,
unless their group would leave a shard too heavy: then the cut goes through the group by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, table

SHARDS = 24
MAX_SHARDS = 4096
_VALUE, _CLASS, _HASH, _DOC = 16, 6, 26, 14  # bits of a key: its value, its group's lightness, the text's hash, the document's
_GROUP = _CLASS + _HASH  # heavy groups come first among equal values, so that cuts fall among light ones
_SLACK = 0.002  # of the bytes on a side of a cut: a cut as near as this to its place keeps groups whole
_NEAR = 0.0002  # the same for cuts between groups
DIMS = ("n_chars", "lang", "source")


@dataclass
class _Node:
    shards: int
    first: int  # its first shard
    dim: str | None = None
    cut: int = 0
    left: "_Node | None" = None
    right: "_Node | None" = None


def _values(docs: DataFrame, dims) -> dict:
    """Each dimension scaled to [0, 1): numbers by the logarithm of their range, strings by their hash; null is 0."""
    kinds = dict(docs.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    span = docs.agg(F.count(F.lit(1)), *[f(F.col(d).cast("double")).alias(f"{n}_{d}") for d in numbers for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for d in dims:
        if d in numbers:
            lo, hi = span[f"lo_{d}"] or 0.0, span[f"hi_{d}"] or 0.0
            value = F.log1p(F.col(d).cast("double") - lo) / max(float(np.log1p(hi - lo)), 1e-9)
        else:
            value = F.pmod(F.xxhash64(d), F.lit(1 << _VALUE)) / (1 << _VALUE)
        value = F.when(F.col(d).isNotNull() & ~F.isnan(value), value).otherwise(0.0)
        out[d] = F.least(F.floor(value * (1 << _VALUE)), F.lit((1 << _VALUE) - 1)).cast("long")
    return out


def _place(node: _Node, leaf):
    if node.dim is None:
        return leaf(node)
    return F.when(F.col(node.dim) < node.cut, _place(node.left, leaf)).otherwise(_place(node.right, leaf))


def _leaves(node: _Node) -> list[_Node]:
    return [node] if node.dim is None else _leaves(node.left) + _leaves(node.right)


def _split_level(points: DataFrame, root: _Node, open_: list[_Node], dims: list[str], target: float) -> None:
    """Split every open node once: choose dimensions by one pass, then cuts by histogram rounds for all nodes."""
    number = {id(n): i for i, n in enumerate(open_)}
    node = _place(root, lambda n: F.lit(number.get(id(n), -1)))
    here = points.withColumn("node", node).where("node >= 0")
    value = lambda d: F.shiftright(d, _GROUP + _DOC) / (1 << _VALUE)
    stats = here.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[F.sum(F.col("size") * value(d)).alias(f"s_{d}") for d in dims], *[F.sum(F.col("size") * value(d) * value(d)).alias(f"q_{d}") for d in dims]
    ).collect()
    stats = {r["node"]: r for r in stats}
    state = {}
    for i, n in enumerate(open_):
        r = stats.get(i)
        dim = max(dims, key=lambda d: r[f"q_{d}"] / r["bytes"] - (r[f"s_{d}"] / r["bytes"]) ** 2) if r else dims[0]
        goal = (r["bytes"] if r else 0) * (n.shards // 2) / n.shards
        state[i] = {"dim": dim, "lo": 0, "goal": goal, "before": 0, "cut": None if r else 0}
    left = _VALUE + _GROUP + _DOC
    for bits in (8, 8, 10, 10, 12, 7, 7):  # down to the value, the group and the document
        left -= bits
        todo = [i for i in state if state[i]["cut"] is None]
        if not todo:
            break
        key = F.lit(None).cast("long")
        for i in todo:
            s = state[i]
            inside = (F.col("node") == i) & (F.shiftright(s["dim"], left + bits) == s["lo"] >> (left + bits))
            key = F.when(inside, F.shiftright(s["dim"], left)).otherwise(key)
        sums = here.select("node", key.alias("b"), "size").where("b is not null").groupBy("node", "b").agg(F.sum("size").alias("w")).collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r["node"], []).append((r["b"], r["w"]))
        for i in todo:
            s, total = state[i], state[i]["before"]
            for b, w in sorted(by[i]):
                if total + w >= s["goal"] or b == max(x for x, _ in by[i]):
                    break
                total += w
            low, high = s["goal"] - total, total + w - s["goal"]
            # what a cut is off by is shared by the shards on the smaller side of it
            enough = (_SLACK if left == _DOC else _NEAR) * target * (open_[i].shards // 2)
            if min(low, high) <= enough and left >= _DOC or left == 0:
                s["cut"] = b << left if low <= high else (b + 1) << left
            else:
                s["lo"], s["before"] = b << left, total
    for i, n in enumerate(open_):
        n.dim, n.cut = state[i]["dim"], state[i]["cut"]
        m = n.shards // 2
        n.left, n.right = _Node(m, n.first), _Node(n.shards - m, n.first + m)


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dims=DIMS) -> DataFrame:
    """Per document: size (UTF-8 bytes + 8), crc32 of the text, law, shard, slot in the shard from 0.

    The number of shards is given, or follows from ``target_bytes`` a leaf. Null texts have no bytes, null metadata
    count as the least value; rows with a null doc_id are left out; repeated rows are rows of their own. Without rows
    the result is empty (a dimension with a clashing name is the table's own column); with fewer rows than shards some shards stay empty. Extra columns are ignored.
    """
    docs = docs.where("doc_id is not null")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    text = F.coalesce("text", F.lit(""))
    values = _values(docs, dims)
    doc = F.xxhash64(F.col("doc_id").cast("long"), F.lit(9)).bitwiseAND((1 << _DOC) - 1)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), doc.alias("doc"),
        *[values[d].alias(f"v_{d}") for d in dims],
    )
    names = [f"k_{d}" for d in dims]
    rows = materialize(rows, "rows")
    # equal texts stand where the first of them stands; single texts, most of all, need no look-up
    groups = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("size").alias("weight"), F.min(F.struct("doc_id", *[f"v_{d}" for d in dims])).alias("of")
    ).where("copies > 1").select("group", "weight", *[F.col(f"of.v_{d}").alias(f"g_{d}") for d in dims])
    light = F.lit((1 << _CLASS) - 1) - F.least(F.floor(F.log2(F.coalesce("weight", "size").cast("double"))), F.lit((1 << _CLASS) - 1))
    tie = F.shiftleft(light.cast("long"), _HASH) + F.col("group").bitwiseAND((1 << _HASH) - 1)
    points = rows.join(groups, "group", "left").select(
        "doc_id", "size", "text_crc32",
        *[(F.shiftleft(F.coalesce(f"g_{d}", f"v_{d}"), _GROUP + _DOC) + F.shiftleft(tie, _DOC) + F.col("doc")).alias(f"k_{d}") for d in dims],
    )
    points = materialize(points, "points")
    total, n = points.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards; at most {MAX_SHARDS}")
    root = _Node(shards, 0)
    while open_ := [x for x in _leaves(root) if x.shards > 1]:
        _split_level(points, root, open_, names, total / shards)
    placed = points.withColumn("shard", _place(root, lambda x: F.lit(x.first))).drop(*names)
    # slots: numbers inside (shard, bucket of documents), moved by the rows of the shard's earlier buckets
    buckets = max(1, min(4096, n // 50_000))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("moved"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("k", F.row_number().over(inside) - 1)
        .join(F.broadcast(moved), ["shard", "bucket"])  # at most shards * 4096 rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
            (F.col("k") + F.col("moved")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_kd_shards(spark, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))
