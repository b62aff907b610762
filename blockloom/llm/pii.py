"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

The field's nodes are a document's addresses (tokens with an at sign) and numbers: runs of digit groups with no more
than a few brackets, dots, dashes, slashes or single spaces between two digits, of ``LEAST_DIGITS`` digits or more. A
node has a unary potential from its shape and what stands before it, a chain edge to the next node if no more than two
words lie between, and a skip edge to the next node, however far, that repeats it: the same characters apart from case
and punctuation, or the same last seven digits. Loopy sum-product messages let all mentions of one item agree; a node
that no base span covers and that most probably carries a kind becomes a span, whether or not the document has a base
span or a repeat. Skip edges join a mention to the next one only, so their number is linear.

Base spans are certain. Potentials are trained here: on a bounded sample of documents, with the base spans as labels,
the unary ones by logistic regression and the edges' by how much oftener than by chance two joined nodes have each
pair of labels. As base spans all bear the mark their pattern asks for (a phone's plus, the dot of an address), each
also counts ``HIDDEN`` times without it, so that the field learns the shape behind the mark, against all the nodes of
that shape that are nothing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import sample_ids, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Training documents; rounds of messages; probability a node needs; weight of a base span's label.
SAMPLE_DOCS, ROUNDS, SURE, CERTAIN = 3000, 8, 0.5, 12.0
#: Digits that make a number a node; weight in training of a base span without its mark.
LEAST_DIGITS, HIDDEN = 3, 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# An address begins where a token does, so every token is read once; numbers are looked for between addresses.
_ADDRESS = re.compile(r"(?<![^\s@])[^\s@]*+@[^\s@]*+")
_NUMBER = re.compile(r"[+(]?[0-9](?:[().\-/]{0,2}[\x20]?[().\-/+]{0,2}[0-9])*+")
_EDGE = "()[]{}<>.,;:!?\"'*#$%&|"
_BETWEEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: around each at sign, back over local characters and on over a domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The contract's spans of each kind, in code points; a match that fails its condition is dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if "@" in text:
        out["email"] = _emails(text)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    for m in _IP.finditer(text):
        if all(len(bare := p.lstrip("0")) <= 3 and int(bare or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    return out


# Unary features of a node, each a yes or no.
FEATURES = ("constant", "at", "plus", "dot", "bracket", "dash", "slash", "space", "three dots only", "digits>=7", "digits>=9", "digits>=13", "digits>=16", "digits>19", "digits only", "two groups", "three groups", "more groups", "four digits last", "luhn", "letters around", "parts to 255", "digits 10 or 11")
_MARK = {k: sum(1 << FEATURES.index(f) for f in marks) for k, marks in ((LABELS.index("phone"), ["plus"]), (LABELS.index("email"), ["dot"]))}


def _features(token: str, around: bool) -> int:
    groups = re.findall("[0-9]+", token)
    digits = "".join(groups)
    n, at = len(digits), "@" in token
    number, domain = not at, token.rpartition("@")[2]
    dots = number and len(groups) == 4 and token.count(".") == 3 == len(token) - n
    bits = (
        True, at, token.startswith("+"), "." in (domain if at else token), "(" in token, number and "-" in token, "/" in token, " " in token, dots, number and n >= 7, number and n >= 9,
        number and n >= 13, number and n >= 16, number and n > 19, n == len(token), number and len(groups) == 2, number and len(groups) == 3, number and len(groups) > 3,
        number and len(groups[-1]) == 4, number and 13 <= n <= 19 and luhn(digits), around, dots and all(len(g) <= 3 and int(g) <= 255 for g in groups), number and 10 <= n <= 11,
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


def _nodes(text: str) -> Iterator[tuple[int, int]]:
    """Addresses and numbers in order, each as it stands, in time linear in the text."""
    free = 0
    addresses = _ADDRESS.finditer(text) if "@" in text else iter(())
    for start, end in itertools.chain((m.span() for m in addresses), [(len(text), len(text))]):
        yield from (m.span() for m in _NUMBER.finditer(text, free, start))
        if start < end:
            yield start, end
        free = end


class Graph:
    """The nodes of a document with their features, base labels, places, and edges of both sorts."""

    def __init__(self, text: str, base: dict[str, list[tuple[int, int]]]):
        self.spans, self.features, self.labels = [], [], []
        covered = sorted((s, e, k) for k, kind in enumerate(KINDS, 1) for s, e in base[kind])
        keys: dict[str, int] = {}
        self.chain, self.skip = [], []
        at, last = 0, None
        for start, end in _nodes(text):
            token = text[start:end]
            if "@" in token:
                bare = token.strip(_EDGE)
                if len(bare) < 2 or bare.endswith("@"):
                    continue
                start += token.index(bare)
                token = bare
                end = start + len(token)
            elif sum("0" <= c <= "9" for c in token) < LEAST_DIGITS:
                continue
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            label = covered[at][2] if at < len(covered) and covered[at][0] < end else 0
            node = len(self.spans)
            self.spans.append((start, end))
            self.features.append(_features(token, text[max(0, start - 1) : start].isalpha() or text[end : end + 1].isalpha()))
            self.labels.append(label)
            if last is not None and start - last <= 40 and len(_BETWEEN.findall(text, last, start)) <= 2:
                self.chain.append((node - 1, node))
            last = end
            digits = "".join(c for c in token if "0" <= c <= "9")
            for key in {"=" + "".join(c for c in token.casefold() if c.isalnum()), "~" + digits[-7:] if len(digits) >= 7 else ""} - {""}:
                if key in keys:
                    self.skip.append((keys[key], node))
                keys[key] = node


class Field:
    """Unary weights (features by labels) and log potentials of chain and skip edges (labels by labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of each node after ``ROUNDS`` of parallel, damped sum-product messages."""
        bits = (np.array(graph.features)[:, None] >> np.arange(len(FEATURES))) & 1
        score = bits @ self.unary
        labels = np.array(graph.labels)
        known = labels > 0
        score[known] = 0
        score[known, labels[known]] = CERTAIN
        edges = np.array([*graph.chain, *graph.skip], np.int64).reshape(-1, 2)
        n, c = len(edges), len(graph.chain)
        a, b = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        # Chain edges, then skip edges; forwards, then back.
        sorts = [(slice(0, c), self.chain), (slice(c, n), self.skip), (slice(n, n + c), self.chain.T), (slice(n + c, 2 * n), self.skip.T)]
        sorts = [(part, np.exp(log)) for part, log in sorts]
        order = np.argsort(b, kind="stable")
        heads = np.flatnonzero(np.diff(b[order], prepend=-1))
        there = b[order][heads]
        message = np.zeros((2 * n, len(LABELS)))
        back = np.concatenate((np.arange(n) + n, np.arange(n)))

        def belief() -> np.ndarray:
            out = score.copy()
            if n:
                out[there] += np.add.reduceat(message[order], heads)
            return out

        for _ in range(ROUNDS if n else 0):
            out = belief()[a] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.concatenate([out[part] @ pair for part, pair in sorts]))
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        score = belief()
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
        """Spans of nodes that most probably carry a kind and that no base span covers."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        graph = Graph(text, base)
        if not graph.spans:
            return out
        p = self.marginals(graph)
        for node in np.flatnonzero((p[:, 1:].max(1) >= SURE) & (np.array(graph.labels) == 0)).tolist():
            out[KINDS[int(p[node, 1:].argmax())]].append(graph.spans[node])
        return out


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE_DOCS) -> Field:
    """Potentials from at most ``most`` documents that have digits in a row or an at sign, by smallest hashed keys."""
    rows = docs.where(F.col(text).rlike("[0-9]{4}|@"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        for batch in texts_of(batches):
            for t in batch.column(0).to_pylist():
                graph = Graph(t, base_spans(t))
                pairs = list(zip(graph.features, graph.labels, strict=True))
                seen = [("node", f, y) for f, y in pairs] + [("hidden", f & ~_MARK[y], y) for f, y in pairs if y in _MARK]
                seen += [(sort, graph.labels[a], graph.labels[b]) for sort in ("chain", "skip") for a, b in getattr(graph, sort)]
                for x in seen:
                    counts[x] = counts.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array([k[2] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["sort", "a", "b", "n"])

    sample = sample_ids(rows, F.col(key), most).select(F.col(text).alias("t"))
    found = sample.mapInArrow(run, "sort string, a long, b int, n long").groupBy("sort", "a", "b").agg(F.sum("n").alias("n")).orderBy("sort", "a", "b").collect()
    nodes = [r for r in found if r.sort in ("node", "hidden")]
    size = len(LABELS)
    weights = np.zeros((len(FEATURES), size))
    if nodes:
        x = np.array([[(r.a >> i) & 1 for i in range(len(FEATURES))] for r in nodes], float)
        y = np.eye(size)[[r.b for r in nodes]]
        n = np.array([r.n * (HIDDEN if r.sort == "hidden" else 1) for r in nodes], float)
        for _ in range(2000):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights += 2.0 * (x.T @ (n[:, None] * (y - p)) / n.sum() - 1e-4 * weights)
    else:
        weights[0, 0] = 3.0
    potentials = []
    for sort in ("chain", "skip"):
        joint = np.full((size, size), 0.5)
        for r in found:
            if r.sort == sort:
                joint[r.a, r.b] += r.n / 2
                joint[r.b, r.a] += r.n / 2
        joint += np.eye(size)
        joint /= joint.sum()
        side = joint.sum(0)
        potentials.append(np.clip(np.log(joint / (side[:, None] * side)), -3, 3))
    return Field(weights, *potentials)


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def personal_data(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` for every row of ``docs``: lists of ``kind:start:end``, by kind and start, comma-joined.

    ``base`` holds what the patterns find, ``spans`` that and what the field adds. A null text is an empty one and has
    neither. Whole texts are searched, in time linear in their length; repeated rows agree; other columns are not read.
    An empty table gives an empty one; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in texts_of(batches):
            base, spans = [], []
            for t in batch.column(1).to_pylist():
                found = base_spans(t)
                more = field.added(t or "", found)
                base.append(listed(found))
                spans.append(listed({k: found[k] + more[k] for k in KINDS}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["key", "base", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, base string, spans string")
