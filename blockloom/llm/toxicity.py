"""Toxicity by the nearest labelled examples under TF-IDF cosine, from a block-max inverted index.

Examples are a bounded sample of the labelled documents outside the held-out fold. Terms are the words of that sample
that go with the label beyond chance (the chi-squared of their presence, at a level that one word in twenty samples
would reach by luck). A document's vector is plain TF-IDF over them: one plus the logarithm of the count, times the
inverse document frequency over all documents. A text that holds no term is told by itself alone: its own words as a
whole are its one term, so that it is near to its exact copies and to nothing else.

Examples with equal vectors are one entry of the index. Entries stand in blocks; the index keeps sparse postings and
each term's largest weight in each block that has it, which bounds the cosine of all its entries. (The postings of the
most frequent terms, which most entries have, are full rows; what they add is worked out for a batch of documents at
once and enters the bounds as it is.) Blocks are opened in order of their bounds until no bound reaches the k-th nearest
example found, so the neighbours are exact.

The neighbours' votes for the label, weighted by distance, each class counted at its frequency among all labelled
documents, are a share. What a share means is learnt from the examples themselves, each voted on by those of other
folds: a logistic curve of the share's log odds, so scores are probabilities. Texts without neighbours get the rate of
the label among such examples.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import cut, texts_of
from blockloom.llm.decontaminate import words_of

#: Examples of each class; words chosen as terms at most; folds of the labelled documents, one of which is held out.
EXAMPLES, TERMS, FOLDS = 4096, 1 << 16, 5
#: Neighbours, entries of a block, distance at which a vote halves, chance of a term by luck alone.
K, BLOCK, NEAR, LUCK = 15, 64, 0.05, 0.05
#: Frequent terms whose postings are full rows, and documents whose products with them are taken at once.
FULL, BATCH = 512, 64
#: Examples named as evidence of a score.
NAMED = 3


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one range after the other."""
    n = last - first
    return np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())


def _places(terms: dict[bytes, int], words: Collection[bytes]) -> np.ndarray:
    """The place of each word, -1 for those that are no term."""
    return np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))


class Index:
    """Entries (distinct unit vectors) in blocks, with block-max weights by term.

    ``votes`` counts an entry's examples by fold and class. ``entry`` and ``weight`` are the postings by term and entry;
    a run is a term's postings within one block. Terms with a ``row`` have theirs in ``full`` instead.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], places: int, votes: np.ndarray, names: list[list]):
        # Entries with the same weightiest term stand together.
        top = np.array([(t[np.argmax(w)], w.max()) for t, w in vectors])
        order = np.lexsort((-top[:, 1], top[:, 0]))
        self.size, self.block, self.n_blocks, self.places = len(order), BLOCK, -(-len(order) // BLOCK), places
        self.votes, self.names = votes[order], [names[i] for i in order]
        entry = np.repeat(np.argsort(order), [len(t) for t, _ in vectors])
        term, weight = (np.concatenate(x) for x in zip(*vectors, strict=True))
        by_term = np.lexsort((entry, term))
        term, entry, weight = term[by_term], entry[by_term].astype(np.int32), weight[by_term]
        number = np.bincount(term, minlength=places)
        frequent = np.argsort(-number, kind="stable")[:FULL]
        frequent = frequent[number[frequent] > self.n_blocks]
        self.row = np.full(places, -1)
        self.row[frequent] = np.arange(len(frequent))
        row = self.row[term]
        self.full = np.zeros((len(frequent), self.size))
        self.full[row[row >= 0], entry[row >= 0]] = weight[row >= 0]
        term, self.entry, self.weight = term[row < 0], entry[row < 0], weight[row < 0]
        run = term * self.n_blocks + self.entry // self.block
        self.start = np.flatnonzero(np.diff(run, prepend=-1))
        self.end = np.append(self.start[1:], len(run))
        self.run_block = run[self.start] % self.n_blocks
        self.run_max = np.maximum.reduceat(self.weight, self.start) if len(run) else np.empty(0)
        self.runs = np.searchsorted(term[self.start], np.arange(places + 1))

    @property
    def vectors(self) -> np.ndarray:
        """All entries as rows of a dense matrix (for small indexes)."""
        out = np.zeros((self.size, self.places))
        postings = self.end - self.start
        out[self.entry, np.repeat(np.repeat(np.arange(self.places), np.diff(self.runs)), postings)] = self.weight
        out[:, self.row >= 0] = self.full[self.row[self.row >= 0]].T
        return out

    def products(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to each entry's cosine with each query."""
        share = np.zeros((len(queries), len(self.full)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            share[i, row[row >= 0]] = weights[row >= 0]
        return share @ self.full

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries that hold the k nearest examples, and all as near as the k-th, with their cosines, which are
        above 0; ``number`` says how many examples of each entry count.

        ``known`` is the query's row of ``products``. Blocks are opened in order of their bounds: first a few, which
        give a k-th nearest, then those whose bound reaches it.
        """
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        first, last = self.runs[terms], self.runs[terms + 1]
        runs, share = _ranges(first, last), np.repeat(weights, last - first)
        block = self.run_block[runs]
        bound = np.bincount(block, share * self.run_max[runs], self.n_blocks) + np.maximum.reduceat(known, np.arange(0, self.size, self.block))
        order, at, reached, wave = np.argsort(-bound, kind="stable"), 0, 2e-9, 8
        where, cosines = np.empty(0, np.int64), np.empty(0)
        while at < len(order) and bound[order[at]] >= reached - 1e-9:
            blocks = order[at : at + wave]
            at, wave = at + wave, wave * 2
            blocks = blocks[bound[blocks] >= reached - 1e-9]
            opened = np.zeros(self.n_blocks, bool)
            opened[blocks] = True
            opened = opened[block]
            start, end = self.start[runs[opened]], self.end[runs[opened]]
            posting = _ranges(start, end)
            value = known + np.bincount(self.entry[posting], self.weight[posting] * np.repeat(share[opened], end - start), self.size)
            fresh = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
            fresh = fresh[fresh < self.size]
            fresh = fresh[(value[fresh] >= reached - 1e-9) & (number[fresh] > 0)]
            where, cosines = np.concatenate((where, fresh)), np.concatenate((cosines, value[fresh]))
            near = np.argsort(-cosines, kind="stable")
            total = np.cumsum(number[where[near]])
            if len(total) and total[-1] >= k:
                reached = max(reached, cosines[near[np.searchsorted(total, k)]])
        chosen = cosines >= reached - 1e-9
        return where[chosen], cosines[chosen]


@dataclass
class Model:
    """Terms (words, then digests of whole texts) with their inverse document frequencies, the index, and the curve."""

    terms: dict[bytes, int]
    weights: np.ndarray
    index: Index | None
    rates: np.ndarray
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)
    alone: float = 0.0

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's terms, in order, and how often each stands there."""
        number = Counter(words)
        place = _places(self.terms, number)
        n = np.fromiter(number.values(), np.int64, len(number))[place >= 0]
        place = place[place >= 0]
        if not len(place) and words:
            whole = self.terms.get(digest(words), -1)
            return (np.array([whole]), np.ones(1, np.int64)) if whole >= 0 else (place, n)
        order = np.argsort(place)
        return place[order], n[order]

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        terms, n = counts
        weights = (1 + np.log(n)) * self.weights[terms]
        norm = np.linalg.norm(weights)
        return terms, weights / norm if norm else weights

    def shares(self, counts: list[tuple[np.ndarray, np.ndarray]], folds: list[int] | None = None) -> list[tuple[float | None, list]]:
        """Of each document with these terms, the share of votes (null without neighbours) and its nearest examples.

        Examples of a document's own fold in ``folds`` do not vote.
        """
        told = [i for i, (terms, _) in enumerate(counts) if len(terms)] if self.index else []
        found: list[tuple[float | None, list]] = [(None, [])] * len(counts)
        votes = {}
        for own in {folds[i] for i in told} if folds else {None}:
            if self.index:
                of = self.index.votes.sum(1) if own is None else self.index.votes.sum(1) - self.index.votes[:, own]
                votes[own] = of, of.sum(1)
        for at in range(0, len(told), BATCH):
            batch = told[at : at + BATCH]
            queries = [self.vector(counts[i]) for i in batch]
            for i, query, known in zip(batch, queries, self.index.products(queries), strict=True):
                found[i] = self._share(query, known, *votes[folds[i] if folds else None])
        return found

    def _share(self, query: tuple[np.ndarray, np.ndarray], known: np.ndarray, votes: np.ndarray, number: np.ndarray) -> tuple[float | None, list]:
        at, cosine = self.index.nearest(*query, K, known, number)
        if not len(at):
            return None, []
        weight = (votes[at] * self.rates) * (NEAR / (np.maximum(0.0, 1 - cosine)[:, None] + NEAR))
        share = weight.sum(0)
        order = np.argsort(-cosine, kind="stable")
        named = [(*x, float(cosine[i])) for i in order for x in self.index.names[at[i]]][:NAMED]
        return float((share[1] + self.prior) / (share.sum() + 1)), named

    def score(self, share: float | None) -> float:
        if share is None:
            return self.alone
        slope, shift = self.curve
        odds = math.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * odds + shift))))


def digest(words: list[bytes]) -> bytes:
    """A term that no word is: a text's words as a whole."""
    return b" " + md5(b" ".join(words), usedforsecurity=False).digest()


def fitted(share: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift of the logistic curve of the log odds of ``share`` that fits the labels best.

    The labels are drawn in by one case of each class, and the slope is held lightly at 1, so that few examples or such
    that are told apart wholly give no step.
    """
    odds = np.log(share / (1 - share))
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((odds, np.ones(len(odds))), 1)
    at, hold = np.array([1.0, 0.0]), np.diag([0.1, 1e-3])
    loss = lambda v: float((weight * (np.logaddexp(0, x @ v) - goal * (x @ v))).sum() + 0.5 * (v - [1, 0]) @ hold @ (v - [1, 0]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (weight * (p - goal)) + hold @ (at - [1, 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, slope)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` labelled keys with the smallest hashes: a bounded, reproducible sample."""
    return rows.orderBy(F.xxhash64("key", F.lit(20260101)), "key").limit(most)


def _chosen_words(texts: DataFrame) -> list[bytes]:
    """Words of the examples whose presence goes with the label beyond chance, in order. Copies of a text count once."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_of(batches):
            got = [(w, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()), pa.array([y for _, y in got], pa.int32())], ["word", "y"])

    distinct = texts.groupBy(F.md5("t"), "y").agg(F.first("t").alias("t"))
    n = {r.y: r.n for r in distinct.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m1, m0 = n.get(1, 0), n.get(0, 0)
    if not (m1 and m0):
        return []
    words = distinct.select("t", F.col("y").cast("int").alias("y")).mapInArrow(present, "word binary, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b, size = F.col("a"), F.col("b"), F.lit(float(m1 + m0))
    chi2 = size * F.pow(a * m0 - b * m1, 2) / (F.lit(float(m1 * m0)) * (a + b) * F.greatest(size - a - b, F.lit(1.0)))
    words = cut(words.select("word", chi2.alias("chi2")))
    least = 2 * math.log(max(1, words.count()) / LUCK)
    return sorted(bytes(r.word) for r in words.where(F.col("chi2") > least).orderBy(F.desc("chi2"), "word").limit(TERMS).collect())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """A model from at most ``examples`` documents of each class, none of them of the held-out fold.

    To the driver come at most ``TERMS`` words and the examples' counts of them.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("y"))
    known = cut(known)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.broadcast(cut(_sample(known.where("y = 1"), examples).unionByName(_sample(known.where("y = 0"), examples))))
    texts = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("t")).join(chosen, "key").withColumn("y", F.col("y").cast("int")))
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(totals.values())
    prior = totals.get(1, 0) / total if total else 0.0
    rates = np.array([totals.get(y, 0) / n[y] if n.get(y) else 0.0 for y in (0, 1)])
    model = Model({w: i for i, w in enumerate(_chosen_words(texts))}, np.empty(0), None, rates / (rates.max() or 1.0), prior, alone=prior)
    if not n.get(1) or not n.get(0):
        return model

    # The terms of each example; one without any has its whole text as a term.
    words_only = spark.sparkContext.broadcast(model.terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = words_only.value
        for batch in texts_of(batches):
            keys, ts, ys, folds = (c.to_pylist() for c in batch.columns)
            found = []
            for t in ts:
                words = words_of(t)
                number = Counter(w for w in words if w in terms)
                found.append(sorted(number.items()) or ([(digest(words), 1)] if words else []))
            columns = [pa.array([str(k) for k in keys], pa.string()), pa.array(ys, pa.int32()), pa.array(folds, pa.int32()), pa.array([[w for w, _ in x] for x in found], pa.list_(pa.binary())), pa.array([[c for _, c in x] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "y", "fold", "terms", "counts"])

    kinds = "key string, y int, fold int, terms array<binary>, counts array<int>"
    rows = texts.select("key", "t", "y", fold(F.col("key")).cast("int").alias("fold")).mapInArrow(counted, kinds).collect()
    rows.sort(key=lambda r: (r.key, r.y, r.terms, r.counts))
    for r in rows:
        for w in r.terms:
            model.terms.setdefault(bytes(w), len(model.terms))
    shared_terms = spark.sparkContext.broadcast(model.terms)
    n_words = len(words_only.value)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows = shared_terms.value, 0
        df = np.zeros(len(terms), np.int64)
        for batch in texts_of(batches):
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                place = _places(terms, set(words))
                place = place[place >= 0]
                if not len(place) and len(terms) > n_words:
                    place = _places(terms, [digest(words)])
                    place = place[place >= 0]
                df[place] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, seen), pa.int32()), pa.array(np.append(rows, df[seen]), pa.int64())], ["term", "n"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(model.terms) + 1)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    model.weights = 1 + np.log((1 + df[-1]) / (1 + df[:-1]))
    counts = [(np.array([model.terms[bytes(w)] for w in r.terms], np.int64), np.array(r.counts, np.int64)) for r in rows]
    counts = [(t[np.argsort(t)], m[np.argsort(t)]) for t, m in counts]
    entries: dict[bytes, tuple[np.ndarray, list, tuple]] = {}
    for r, c in zip(rows, counts, strict=True):
        if len(c[0]):
            votes, names, _ = entries.setdefault(c[0].tobytes() + c[1].tobytes(), (np.zeros((FOLDS, 2)), [], c))
            votes[r.fold, r.y] += 1
            if len(names) < NAMED:
                names.append((r.key, r.y))
    if entries:
        model.index = Index([model.vector(c) for _, _, c in entries.values()], len(model.terms), np.array([v for v, *_ in entries.values()]), [names for _, names, _ in entries.values()])
    shared = spark.sparkContext.broadcast(model)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_of(batches):
            ts, ys, folds = (c.to_pylist() for c in batch.columns)
            found = shared.value.shares([shared.value.counts(words_of(t)) for t in ts], folds)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array(ys, pa.int32())], ["share", "y"])

    voted_on = texts.select("t", "y", fold(F.col("key")).cast("int").alias("fold")).mapInArrow(voted, "share double, y int").collect()
    voted_on.sort(key=lambda r: (r.share is not None, r.share, r.y))
    weight = lambda r: rates[r.y]
    lone = [r for r in voted_on if r.share is None]
    told = [r for r in voted_on if r.share is not None]
    model.alone = float((sum(weight(r) for r in lone if r.y) + prior) / (sum(map(weight, lone)) + 1))
    if told:
        model.curve = fitted(np.array([r.share for r in told]), np.array([r.y for r in told]), np.array([weight(r) for r in told]) / rates.max())
    return model


EVIDENCE = "array<struct<key:string,label:int,cosine:double>>"


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, evidence`` for every row of ``docs``; ``evidence`` are the examples nearest to it: key, label, cosine.

    Whole texts are scored, by nothing but their words. A null or empty text, like any without neighbours, has the rate
    of the label among such examples and no evidence; repeated rows agree; without labelled examples every score is the
    rate of the label (0 without any). Other columns are not read. An empty table gives an empty one; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    named = pa.list_(pa.struct([("key", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, OrderedDict()
        for batch in texts_of(batches):
            texts = batch.column(1).to_pylist()
            names = [md5((t or "").encode(), usedforsecurity=False).digest() for t in texts]
            fresh = {}
            for same, t in zip(names, texts, strict=True):
                if same not in seen and same not in fresh:
                    fresh[same] = model.counts(words_of(t))
            seen.update(zip(fresh, [(model.score(s), e) for s, e in model.shares(list(fresh.values()))], strict=True))
            found = [seen[same] for same in names]
            evidence = [[{"key": k, "label": y, "cosine": round(c, 6)} for k, y, c in e] for _, e in found]
            while len(seen) > 20_000:
                seen.popitem(last=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, named)], ["key", "score", "evidence"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, score double, evidence {EVIDENCE}")
