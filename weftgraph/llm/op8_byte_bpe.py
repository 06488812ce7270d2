"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton holds the vocabulary. A piece is covered
from the left with the longest vocabulary entries that fit; an entry is taken if it may stand after the one before it,
that is, if merging would keep the two apart. This is remembered by pair. A dead end is marked and stepped back from,
so every position is left at most once for good and the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import table
from weftgraph.llm.spans_cache import Encoded

PAIRS_KEPT = 200_000
WORDS_KEPT = 200_000  # in each of two generations: a worker has 250 MB, beside what earlier stages of a pipeline left in it
_workers: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.together: dict[tuple[int, int], bool] = {}
        self.encoded = Encoded(self._after, self._alone, WORDS_KEPT)
        sizes = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), np.uint8)

    def merged(self, piece: bytes, below: int) -> list[int]:
        """Plain BPE with the merges of a rank under ``below``: gives the halves of a vocabulary entry."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two entries that merge into this one; None for a single byte, or an entry that no merge makes."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], token)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two entries apart when they stand side by side.

        They are taken apart again, the one made last first; they stay apart unless two parts that meet at the border
        have a merge that comes before the merges which put them into their own side.
        """
        key = (left, right)
        if key not in self.together:
            if len(self.together) > PAIRS_KEPT:
                self.together = {}
            ok, a, b = True, left, right
            in_a = in_b = 1 << 40  # rank of the merge that takes the part at the border into its own side
            while True:
                joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                # on equal ranks the leftmost pair merges first: the left side's own merge, but not the right side's
                if joint is not None and joint < in_a and joint <= in_b:
                    ok = False
                    break
                pa_, pb_ = self.split(a), self.split(b)
                if pa_ is None and pb_ is None:
                    break
                if pb_ is None or (pa_ is not None and a >= b):
                    in_a, a = a, pa_[1]
                else:
                    in_b, b = b, pb_[0]
            self.together[key] = ok
        return self.together[key]

    def next_shorter(self, token: int) -> int | None:
        """The longest entry that is a proper prefix of this one."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, size = len(raw), self.size
        longest = [self.single[b] for b in raw]
        reach = [1] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            start = end - size[token] + 1
            if size[token] > reach[start]:
                reach[start], longest[start] = size[token], token
        out: list[int] = []
        together, shorter = self.together, self.shorter
        open_ = bytearray(b"\1") * (n + 1)
        at, token, last = 0, longest[0], -1
        while at < n:
            while True:
                end = at + size[token]
                if open_[end]:
                    ok = last < 0 or together.get((last, token))
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        out.append(token)
                        at, last = end, token
                        if at < n:
                            token = longest[at]
                        break
                token = shorter[token] if token in shorter else self.next_shorter(token)
                while token is None:  # nothing fits here: step back to a shorter entry before
                    open_[at] = 0
                    last = out.pop()
                    at -= size[last]
                    token = self.next_shorter(last)
                    last = out[-1] if out else -1
        return out

    def _after(self, words: list[str]) -> list[bytes]:
        return [array("I", self.piece(b" " + w.encode())).tobytes() for w in words]

    def _alone(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids: list[int] = []
            for p in self.pattern.findall(text):
                ids += self.piece(p.encode("utf-8"))
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.encoded(texts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, gathered from the vocabulary's bytes laid end to end."""
        token = np.frombuffer(ids, "<u4")
        start = self.starts[token]
        size = self.starts[token + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)].tobytes()


def load(ranks_path: str, pattern: str) -> ByteBpe:
    """The coder of this worker for a ranks file (base64 bytes and rank a line)."""
    if (ranks_path, pattern) not in _workers:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _workers[ranks_path, pattern] = ByteBpe(ranks, pattern)
    return _workers[ranks_path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """All columns of docs and ids (array<int>) of each text; null texts are empty. Rows are independent of each other."""

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])
        bpe.encoded.clear()

    name = "ids"
    while name in docs.columns:
        name += "_"
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, ArrayType(IntegerType(), False)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_too: bool = False) -> DataFrame:
    """Per document: tokens, digests of the ids and of the bytes they decode to; with text_too the decoded text.

    Null texts are empty. Null and repeated doc_ids stay, each row for itself. Other columns are ignored.
    """

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                back = [bpe.decode(x) for x in ids]
                cols = [
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if text_too:
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in back]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)
        bpe.encoded.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * text_too
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
