"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The file format is a Parquet table of blocks, in ascending doc_id order within each part and part by part: ``docs``
and ``lengths`` (one 64-bit id and one 32-bit count a document), ``control`` (two bits an id: bytes of its rank, less
one) and ``data`` (the ranks' bytes, little-endian). Rank r stands for the r-th most frequent id; the ranking is a
table beside the blocks. Blocks are written by Spark's committed writer, so lost executors leave nothing half-done.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, partitions, shared_dir, slices, table
from weftgraph.llm.spans_cache import ONE, Encoded

BLOCK_IDS = 1 << 17
DOCS_PER_PART = 20_000
_workers: dict = {}


def _encoder(path: str, dtype: str):
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        code, token_of = ("H" if dtype == "<u2" else "I"), tokenizer.model.tokenize
        # the vocabulary's characters for the 256 bytes: printable ones stand for themselves, the rest follow 255 in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        chars = [chr(b) for b in range(256)]
        for i, b in enumerate(hidden):
            chars[b] = chr(256 + i)
        space = chars[32]

        def match(x: str) -> bytes:
            # the model's ids of one match of the pre-tokeniser
            name = x.replace(" ", space) if x.isascii() else "".join([chars[b] for b in x.encode()])
            return array(code, [t.id for t in token_of(name)]).tobytes()

        def whole_ids(texts: list[str]) -> list[bytes]:
            return [array(code, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def ids_of(texts: list[str]) -> list[bytes]:
            return [match(t) if ONE.fullmatch(t) else whole_ids([t])[0] for t in texts]

        def after(words: list[str]) -> list[bytes]:
            # a space and letters are one match of the pre-tokeniser
            return [match(" " + w) for w in words]

        encoded = Encoded(after, ids_of)

        def encode(texts: list[str]) -> list[bytes]:
            # a text that holds an added token, such as <|endoftext|>, is the library's alone: it gets that token's id
            whole = [i for i, t in enumerate(texts) if any(x in t for x in added)]
            out = encoded([t for t in texts if not any(x in t for x in added)] if whole else texts)
            for i in whole:
                out.insert(i, whole_ids([texts[i]])[0])
            return out

        _workers[path] = encode, encoded.clear
    return _workers[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """(doc_id, ids, counts): each text's ids and the end id, as little-endian unsigned integers of the type returned.

    Each task adds a row without doc_id that has the number of times it has met each id."""
    with open(tokenizer_path) as f:
        spec = json.load(f)
    size = max(end_id, *spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]) + 1
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        encode, clear = _encoder(tokenizer_path, dtype)
        total = np.zeros(size, np.int64)
        for part in slices(batches, 1000):
            ids = [x + end for x in encode([t or "" for t in part.column(1).to_pylist()])]
            total += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=size)
            none = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), none], ["doc_id", "ids", "counts"])
        clear()
        if total.any():
            last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])]
            yield pa.RecordBatch.from_arrays(last, ["doc_id", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts binary"), dtype


def id_ranks(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents (ties: smaller id); as many numbers as ids that occur."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                got = np.frombuffer(counts, np.int64)
                total = got if len(total) == 1 else total + got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    each = encoded.where("counts is not null").select("counts").mapInArrow(count, "id long, n long")
    counts = each.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two bits for the length of each rank, and the ranks' bytes."""
    whole = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    whole[: len(ranks)] = ranks
    code = (whole > 0xFF).astype(np.uint8) + (whole > 0xFFFF) + (whole > 0xFFFFFF)
    by4 = code.reshape(-1, 4)
    control = by4[:, 0] | by4[:, 1] << 2 | by4[:, 2] << 4 | by4[:, 3] << 6
    code, raw = code[: len(ranks)], whole.view(np.uint8).reshape(-1, 4)
    ends = np.cumsum(code + np.uint8(1), dtype=np.int64)
    at, data = ends - code - 1, np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[at] = raw[: len(ranks), 0]
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        if not len(more):
            break
        data[at[more] + k] = raw[more, k]
    return control.astype(np.uint8).tobytes(), data.tobytes()


_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four numbers that a control byte describes
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block, by table look-up of the control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if not more.any():
            break
        words[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return words & _MASKS[size]


def write_blocks(encoded: DataFrame, dtype: str, ranks: np.ndarray, path: str, n_docs: int) -> None:
    """Write the blocks of all documents under ``path``, and the ranking beside them."""
    spark = encoded.sparkSession
    parts = max(1, min(4096, -(-n_docs // DOCS_PER_PART)))
    cuts = sorted(set(encoded.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    rank_of = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def part_of(batches):
        for batch in batches:
            part = np.searchsorted(cuts, batch.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", "doc_id", "ids"])

    def blocks(batches):
        now, seq, docs, ids, held = None, 0, [], [], 0

        def block():
            control, data = pack(rank_of[np.concatenate(ids)])
            row = {"part": now, "seq": seq, "n_ids": held, "docs": np.array(docs, "<i8").tobytes(), "lengths": np.array([len(x) for x in ids], "<u4").tobytes(), "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for part, doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if docs and (part != now or held >= BLOCK_IDS):
                    yield block()
                    seq, docs, ids, held = seq + 1, [], [], 0
                if part != now:
                    now, seq = part, 0
                docs.append(doc), ids.append(np.frombuffer(raw, dtype))
                held += len(ids[-1])
        if docs:
            yield block()

    (
        encoded.mapInArrow(part_of, "part int, doc_id long, ids binary")
        .repartition(max(partitions(spark), len(cuts) + 1), "part")
        .sortWithinPartitions("part", "doc_id")
        .mapInArrow(blocks, "part int, seq int, n_ids long, docs binary, lengths binary, control binary, data binary")
        .write.option("compression", "none").parquet(f"{path}/blocks")
    )
    spark.createDataFrame([(ranks.astype("<u4").tobytes(),)], "ranks binary").write.parquet(f"{path}/ranking")


_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), *[(n, pa.binary()) for n in ("docs", "lengths", "control", "data")]])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; ids as little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(f"{path}/blocks")
    row = spark.read.parquet(f"{path}/ranking").first()
    ranks = np.frombuffer(row[0], "<u4")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 parts
    offsets = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("part_start"))
    by_block = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", "n_ids").withColumn("block_start", F.coalesce(F.sum("n_ids").over(by_block), F.lit(0)))
    starts = starts.join(offsets, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("start"))

    def run(batches):
        for batch in batches:
            for start, docs, lengths, control, data in zip(*(batch.column(c).to_pylist() for c in ("start", "docs", "lengths", "control", "data"))):
                docs, lengths = np.frombuffer(docs, "<i8"), np.frombuffer(lengths, "<u4").astype(np.int64)
                ids = ranks[unpack(control, data, int(lengths.sum()))]
                ends = np.cumsum(lengths)
                raw = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(start + ends - lengths), pa.array(lengths), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.join(starts, ["part", "seq"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_blocks(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> DataFrame:
    """Encode all texts, write them under ``path`` and return what read_blocks finds there.

    Null and empty texts are the end id alone. Added tokens of the vocabulary that stand in a text, such as
    <|endoftext|>, get their own ids, as is the library's default. Rows with a null doc_id have no place in the order and are left out;
    rows that repeat a doc_id follow each other. Without rows an empty table is written. Other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    encoded, dtype = encode_documents(docs, tokenizer_path, end_id)
    encoded = materialize(encoded, "ids")
    ranks, encoded = id_ranks(encoded), encoded.where("doc_id is not null").select("doc_id", "ids")
    write_blocks(encoded, dtype, ranks, path, encoded.count())
    return read_blocks(docs.sparkSession, path)


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    back = token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
