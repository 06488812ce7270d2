"""Personal data: rules with checks, and boosted trees over high-recall candidates.

The rules give the base spans. Loose generators propose overlapping candidates; boosted trees judge them by format and
context, and thresholds calibrated by kind on held-out candidates decide which are added. The trees don't learn from
the rules: items of known kinds, written in ways that the rules don't cover, and harmless look-alikes (pii_items.py)
are put into stretches of a bounded sample of documents. A candidate that covers such an item of personal data is
positive; one in a look-alike is negative. What the document itself holds and the rules don't confirm is negative
where neither its form nor the words before it speak for personal data, and left out where they do.
Secrets (keys, tokens, passwords) are found in the same way; they are a fifth kind after the four base kinds.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import pii_items
from weftgraph.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
SAMPLE_DOCS = 4000  # documents at most, about, whose candidates the trees are fitted to
ITEMS = 3  # items put into each of them
AROUND = 160  # characters of the document on either side of an item
PRECISION = 0.98  # that a kind's threshold must reach on held-out candidates
LEAST = 0.9  # no candidate below this probability is added
CONTEXT = 24  # characters before a candidate
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these ends a whole run of digits, so starting inside a run can only repeat a failure.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_MAIL = re.compile(r"[^\s@\[(]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[^\s@]{1,64}")
_SPOKEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{2,24}){1,4}")
_LOOSE_DIGITS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}")
_BROKEN_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}")
_IP6_SIGN = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])")
_SECRET = re.compile(r"[=:]\x20{0,2}[\"']?([A-Za-z0-9+/_=\-]{16,200})")
_HINTS = tuple(re.compile(p) for p in (
    r"(?i)mail|contact", r"(?i)phone|tel|call|fax|mobile", r"(?i)card|visa|pay", r"(?i)\bip\b|host|addr", r"(?i)token|secret|key|passw|auth",
    r"(?i)\bno\b|order|isbn|date|version|total|sum|ratio",
))

def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data or secrets; each distinct one once."""
    out = []
    if "@" in text or "[at]" in text or "(at)" in text:
        out += [("email", *m.span()) for m in _LOOSE_MAIL.finditer(text)]
    if " dot " in text:
        out += [("email", *m.span()) for m in _SPOKEN_MAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _LOOSE_DIGITS.finditer(text):
            s = m[0]
            kind = "phone" if s[0] in "+(" or "(" in s else "ip" if s.count(".") == 3 and len(s) < 16 else "card" if sum(c.isdigit() for c in s) > 15 else "phone"
            out.append((kind, *m.span()))
        if "[." in text or "(." in text:
            out += [("ip", *m.span()) for m in _BROKEN_IP.finditer(text)]
    if _IP6_SIGN.search(text):
        out += [("ip", *m.span()) for m in _IP6.finditer(text)]
    out += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    return out


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = "".join(c for c in s if "0" <= c <= "9")
    runs = re.findall(r"[0-9]+", s)
    tail = s.rpartition(".")[2]
    mixed = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    return [
        float(x)
        for x in (
            ALL.index(kind), len(s), len(digits), sum(c.isalpha() for c in s), s.count("@"), s.count("."), s.count(" "), s.count("-"),
            s.count("("), s[0] == "+", bool(digits) and _luhn(digits), len(runs), max(map(len, runs), default=0), min(map(len, runs), default=0),
            max((int(r[:9]) for r in runs), default=0) <= 255, len(tail), tail.isalpha(), s[-1].isalnum(), s.count(":"), s.count("["), s.count("/"),
            mixed, len(set(s)), before[-1:].isalnum(), text[b : b + 1].isalnum(), *(bool(h.search(before)) for h in _HINTS),
        )
    ]


@dataclass
class Booster:
    """Boosted regression trees as nested tuples (feature, threshold, left, right) or leaf values."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)  # by kind; a kind without one gets no spans
    held_out: dict[str, tuple[int, float, float]] = field(default_factory=dict)  # kind: items, precision, recall; documents of no other use
    unseen: dict[str, tuple[int, float]] = field(default_factory=dict)  # kind: items in forms that no example has, recall

    def probability(self, x: list[float]) -> float:
        margin = 0.0
        for tree, w in zip(self.trees, self.weights):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            margin += w * tree
        return float(1 / (1 + np.exp(-2 * margin)))

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates over their kind's threshold that touch neither a base span nor a better candidate."""
        if not self.trees:
            return []
        taken, out = [(a, b) for _, a, b in base], []
        scored = [(self.probability(features(text, c)), c) for c in candidates(text) if all(c[2] <= a or b <= c[1] for a, b in taken)]
        for p, c in sorted(scored, key=lambda x: (-x[0], x[1][1], x[1])):
            if p >= self.thresholds.get(c[0], 2.0) and all(c[2] <= a or b <= c[1] for a, b in taken):
                out.append(c)
                taken.append(c[1:])
        return out


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _doubtful(text: str, span: tuple[str, int, int]) -> bool:
    """Whether a document's own candidate may well be what it looks like, so that it's no example of either class."""
    kind, a, b = span
    s = text[a:b]
    if kind in ("email", "secret") or kind == "ip" and not s.replace(".", "").isdigit():
        return True
    return kind == "card" and _luhn("".join(c for c in s if "0" <= c <= "9")) or any(h.search(text[max(0, a - CONTEXT) : a]) for h in _HINTS[:5])


def _examples(text: str, rng: random.Random, unseen: bool) -> list[tuple[list[float], float, int, str]]:
    """(features, label, item, kind) of the candidates in and around items that are put into the text.

    Item -1 is the document's own. An item that neither the rules nor a candidate covers has a row without features.
    """
    out = []
    for n in range(ITEMS):
        at = text.find(" ", rng.randrange(len(text) + 1)) if text else -1
        at = len(text) if at < 0 else at
        kind, lead, item = pii_items.item(rng, unseen)
        left = f"{text[max(0, at - AROUND) : at]} {lead}"
        place = (len(left), len(left) + len(item))
        around = f"{left}{item} {text[at + 1 : at + AROUND]}"
        sure = [(a, b) for _, a, b in base_spans(around)]
        covered = kind is None or any(a < place[1] and place[0] < b for a, b in sure)
        for c in candidates(around):
            if any(c[1] < b and a < c[2] for a, b in sure):
                continue  # the rules have it already
            over = min(c[2], place[1]) - max(c[1], place[0])
            if over > 0:
                whole = kind == c[0] and over * 10 >= 8 * max(place[1] - place[0], c[2] - c[1])
                covered |= whole
                out.append((features(around, c), float(whole), n, c[0]))
            elif not _doubtful(around, c):
                out.append((features(around, c), 0.0, -1, c[0]))
        if not covered:
            out.append(([], 1.0, n, kind))
    return out


def fit(docs: DataFrame) -> Booster:
    """Fit to examples in about SAMPLE_DOCS documents(doc_id, text), chosen by a hash of doc_id.

    A fifth of them calibrates the thresholds. Another fifth is for the reported figures alone; half of its items have
    forms that no other example has. Null texts are empty ones; rows that repeat a doc_id count each time. Without
    documents there are no trees and nothing is added.
    """
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    key = F.xxhash64("doc_id", F.lit(2))
    chosen = docs.where(F.pmod(key, F.lit(1 << 20)) / (1 << 20) < share).select("text", key.alias("key"))
    names = ["x", "label", "item", "kind", "key", "unseen"]

    def run(batches):
        for part in slices(batches):
            rows = []
            for text, key in zip(*(c.to_pylist() for c in part.columns)):
                for unseen in (False, True)[: 1 + (_fold(key) == 1)]:
                    rows += [(*e, key, unseen) for e in _examples(text or "", random.Random(key + unseen), unseen)]
            types = (pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "x array<double>, label double, item int, kind string, key long, unseen boolean"
    sample = chosen.mapInArrow(run, schema).toPandas()  # a few for each item
    if sample["label"].nunique() < 2:
        return Booster()
    sample["x"] = sample["x"].map(tuple)
    sample = sample.sort_values(["key", "unseen", "item", "label", "x"], ignore_index=True)  # however rows were dealt
    fold, seen = sample["key"].map(_fold).to_numpy(), sample["x"].map(len).to_numpy() > 0
    train = sample[(fold > 1) & seen][["x", "label"]].assign(x=lambda d: d["x"].map(list))
    if train["label"].nunique() < 2:
        return Booster()
    train = docs.sparkSession.createDataFrame(train, "x array<double>, label double").coalesce(2)
    model = GBTClassifier(maxIter=20, maxDepth=5, seed=1).fit(train.select(array_to_vector("x").alias("features"), "label"))
    booster = Booster([_tree(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))
    sample["p"] = [booster.probability(x) if x and f < 2 else 0.0 for x, f in zip(sample["x"], fold)]
    for k in ALL:
        mine = sample[(fold == 0) & seen & (sample["kind"] == k)]
        fine = [t for t in np.unique(mine["p"]) if t >= LEAST and mine["label"][mine["p"] >= t].mean() >= PRECISION]
        if fine:
            booster.thresholds[k] = t = float(min(fine))
            test = sample[(fold == 1) & (sample["kind"] == k)]
            for unseen in (False, True):
                one = test[test["unseen"] == unseen]
                best = one[one["label"] == 1].groupby(["key", "item"])["p"].max()
                recall = float((best >= t).mean()) if len(best) else 0.0
                if unseen:
                    booster.unseen[k] = (len(best), recall)
                else:
                    hit = one["p"] >= t
                    booster.held_out[k] = (len(best), float(one["label"][hit].mean()) if hit.any() else 0.0, recall)
    return booster


def _fold(key: int) -> int:
    """0 calibrates, 1 is for the reported figures, 2 to 4 are trained on; whole documents."""
    return key // 7 % 5


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, booster: Booster) -> DataFrame:
    """Per document: base counts by kind, digest of the base spans, all spans (base ones and what the trees have added,
    secrets after the four base kinds), and how many were added. Null texts have none; every row counts."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in slices(batches):
            counts, digests, written = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                added = booster.added(text or "", base)
                counts.append([*(sum(k == s[0] for s in base) for k in KINDS), len(added)])
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(base + added))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS) + 1)]
            texts = [pa.array(x, pa.string()) for x in (digests, written)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:-1], *texts, columns[-1]], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, booster: Booster) -> DataFrame:
    """The documents with each found span replaced by its kind in brackets; overlapping spans become one, named by the
    first. ``text`` changes and nothing else does; null texts stay null."""

    def clean(text):
        if text is None:
            return None
        base = base_spans(text)
        out, at = [], 0
        for k, a, b in sorted(base + booster.added(text, base), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array([clean(t) for t in part.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs.select("doc_id", "text")))
