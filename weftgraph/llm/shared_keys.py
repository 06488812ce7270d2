"""Which 64-bit keys occur in two or more rows, found without shipping rows to a key.

Every batch of rows sends, for each bucket of the key space, one block with its distinct keys (32 bits beyond the
bucket's own). A key that is frequent inside a batch is sent once for the batch, so no bucket grows with a hot key;
its rows are passed on beside the buckets. Buckets get more numerous with the rows, so that a block fits in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_PER_BUCKET = 1024  # rows of the table for each bucket
_LOCAL = 64  # groups, beside the buckets, for what a batch knows by itself

KeyFn = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def bucket_bits(rows: int) -> int:
    return max(8, min(30, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET + 1))))


def effective(keys: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of keys that are compared; the result of shared_keys holds keys in this form."""
    return (keys >> np.uint64(32 - bits)).astype(np.int64)


def _blocks(batch: pa.RecordBatch, key_fn: KeyFn, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, keys = key_fn(batch)
    keys = effective(keys, bits)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    if not len(keys):
        return
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(head)
    several = np.diff(np.append(start, len(keys))) > 1
    multi = np.repeat(several, np.diff(np.append(start, len(keys))))
    if multi.any():
        yield (1 << bits) + int(keys[multi][0] % _LOCAL), ids[owner[multi]].tobytes(), keys[multi].tobytes(), b""
    keys, owner = keys[start], owner[start]
    where = np.searchsorted(keys >> 32, np.arange((1 << bits) + 1))
    low = (keys & 0xFFFFFFFF).astype(np.uint32)
    for b in np.flatnonzero(np.diff(where)).tolist():
        part = slice(where[b], where[b + 1])
        rows, at = np.unique(owner[part], return_inverse=True)
        if len(rows) * 8 + len(at) * 2 < len(at) * 8:
            yield b, ids[rows].tobytes(), low[part].tobytes(), at.astype(np.uint16).tobytes() + np.packbits(several[part]).tobytes()
        else:
            yield b, ids[owner[part]].tobytes(), low[part].tobytes(), np.packbits(several[part]).tobytes()


def shared_keys(rows: DataFrame, key_fn: KeyFn, n_rows: int) -> DataFrame:
    """(id, key) for each row's distinct keys that another row has too.

    rows: first column the row's id; key_fn takes an Arrow batch of it and returns (index in the batch, key) arrays.
    n_rows: an estimate, which fixes the number of buckets. Keys are compared by their leading 40 bits or more.
    """
    bits = bucket_bits(n_rows)
    spark = rows.sparkSession

    def send(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 60_000):
                out = list(_blocks(batch.slice(a, 60_000), key_fn, bits))
                if out:
                    route, ids, keys, more = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route, pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, keys, more))],
                        ["route", "ids", "keys", "more"],
                    )

    def meet(group: pa.Table) -> pa.Table:
        route = group.column("route")[0].as_py()
        ids, keys, single = [], [], []
        for i, k, m in zip(*(group.column(c).to_pylist() for c in ("ids", "keys", "more"))):
            i = np.frombuffer(i, np.int64)
            if route >= 1 << bits:
                ids.append(i), keys.append(np.frombuffer(k, np.int64))
                continue
            k = np.frombuffer(k, np.uint32)
            flags = (len(k) + 7) // 8
            if len(m) > flags:
                i = i[np.frombuffer(m[: 2 * len(k)], np.uint16)]
            ids.append(i), keys.append(k)
            single.append(np.unpackbits(np.frombuffer(m[-flags:], np.uint8), count=len(k)) == 0)
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        if route < 1 << bits:
            order = np.argsort(keys, kind="stable")
            keys, ids, one = keys[order], ids[order], np.concatenate(single)[order]
            same = keys[1:] == keys[:-1]
            known = np.zeros(len(keys), bool)
            known[1:] |= same
            known[:-1] |= same
            known &= one  # the others' rows are passed on by their batches
            ids, keys = ids[known], keys[known].astype(np.int64) | (route << 32)
        return pa.table({"id": ids, "key": keys})

    sent = rows.mapInArrow(send, "route long, ids binary, keys binary, more binary")
    return sent.groupBy("route").applyInArrow(meet, "id long, key long")
