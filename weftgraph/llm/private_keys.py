"""How many of a row's 64-bit keys no other row has, found without shipping rows to a key.

Rows are read in chunks. For each bucket of the key space a chunk sends one block: its distinct keys there (32 bits
beyond the bucket's own) and, for keys that only one of its rows has, that row's place in the chunk. A bucket answers
each chunk with the places whose keys nobody else has sent. So a hot key counts once a chunk, and neither a bucket nor
a chunk grows with it. Half of the keys take part (those with a leading 0 bit), which makes the counts lower bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftgraph.llm.shared_keys import bucket_bits

CHUNK_ROWS = 8192
_NAMES = ["route", "chunk", "ids", "keys", "at"]

SetsFn = Callable[[list[str]], list[np.ndarray]]


def _blocks(chunk: int, ids: list[bytes], sets: list[np.ndarray], bits: int) -> Iterator[tuple]:
    width = len(ids[0])
    sizes = np.array([len(s) for s in sets], np.int64)
    # the chunk's own row: no bucket has a negative number
    yield -1 - chunk, chunk, b"".join(ids), sizes.tobytes(), width.to_bytes(2, "little")
    half = [s[: np.searchsorted(s, np.uint64(1 << 63))] for s in sets]
    keys = np.concatenate(half) >> np.uint64(31 - bits)
    owner = np.repeat(np.arange(len(half), dtype=np.uint16), [len(s) for s in half])
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(head)
    several = np.diff(np.append(start, len(keys))) > 1
    keys, owner = keys[start], owner[start]
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    routes, first = np.unique(bucket, return_index=True)
    for route, a, b in zip(routes.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
        one = ~several[a:b]
        yield route, chunk, b"", np.concatenate((low[a:b][one], low[a:b][~one])).tobytes(), owner[a:b][one].tobytes()


def private_counts(rows: DataFrame, sets_fn: SetsFn, n_rows: int) -> DataFrame:
    """(id, n, private): for each row its number of keys and a lower bound of those that no other row has.

    rows(id binary, text): ids of one length; sets_fn gives the sorted distinct keys of texts. n_rows is an estimate,
    which fixes the number of buckets. A task that runs again must see its rows in the same order: pass a table that is
    read from files, not what a shuffle has dealt.
    """
    bits = min(30, bucket_bits(n_rows))
    schema = pa.schema([("route", pa.int64()), ("chunk", pa.int64()), *((n, pa.binary()) for n in _NAMES[2:])])

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(a, CHUNK_ROWS).columns)
                out = list(zip(*_blocks(number, ids, sets_fn(texts), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                number += 1

    def meet(group: pa.Table) -> pa.Table:
        if group.column("route")[0].as_py() < 0:
            return group.drop_columns("route")
        places = [np.frombuffer(x, np.uint16) for x in group.column("at").to_pylist()]
        blocks = [np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]
        keys = np.concatenate(blocks)
        order = np.argsort(keys)
        ranked = keys[order]
        alone = np.ones(len(keys), bool)
        alone[1:] &= ranked[1:] != ranked[:-1]
        alone[:-1] &= ranked[1:] != ranked[:-1]
        private = np.empty(len(keys), bool)
        private[order] = alone
        ends = np.cumsum([len(b) for b in blocks]).tolist()
        found = [np.sort(p[private[e - len(b) : e - len(b) + len(p)]]).tobytes() for p, b, e in zip(places, blocks, ends)]
        none = pa.array([b""] * len(found), pa.binary())
        return pa.table([group.column("chunk"), none, none, pa.array(found, pa.binary())], names=_NAMES[1:])

    def total(group: pa.Table) -> pa.Table:
        ids = sizes = None
        found = []
        for i, n, at in zip(*(group.column(c).to_pylist() for c in _NAMES[2:])):
            if i:
                ids, sizes, width = i, np.frombuffer(n, np.int64), int.from_bytes(at, "little")
            else:
                found.append(np.frombuffer(at, np.uint16))
        count = np.bincount(np.concatenate([np.zeros(0, np.uint16), *found]), minlength=len(sizes))
        ids = [ids[a : a + width] for a in range(0, len(ids), width)]
        return pa.table({"id": pa.array(ids, pa.binary()), "n": sizes, "private": count.astype(np.int64)})

    sent = rows.mapInArrow(send, "route long, chunk long, ids binary, keys binary, at binary")
    met = sent.groupBy("route").applyInArrow(meet, "chunk long, ids binary, keys binary, at binary")
    return met.groupBy("chunk").applyInArrow(total, "id binary, n long, private long")
