import math
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import toxicity as T
from pyspark.sql import functions as F

BAD = ["rotter", "cad", "bounder"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(900):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(1, 120))], int(rng.random() < 0.15)
        for _ in range(rng.randint(2, 5) if toxic else rng.random() < 0.1):
            text.insert(rng.randrange(len(text) + 1), rng.choice(BAD))
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    # Few full rows, so that some terms have sparse postings, and small blocks, so that some are skipped.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "FULL", 2)
        patch.setattr(T, "BLOCK", 8)
        return rows, docs, T.fit(docs, labels)


def test_held_out_accuracy(data):
    rows, docs, model = data
    got = {r.key: r.score for r in T.toxicity(docs, model).where(T.fold(F.col("key")) == 0).collect()}
    truth = {i: y for i, _, y in rows if i in got}
    right = [truth[i] == (s >= 0.5) for i, s in got.items()]
    assert len(got) > 100 and all(0 <= s <= 1 for s in got.values()) and np.mean(right) > 0.97
    assert {w.encode() for w in BAD} <= set(model.terms)


def test_neighbours_are_exact(data):
    rows, _, model = data
    votes, full = model.index.votes, model.index.vectors
    for own in (None, 2):
        number = (votes.sum(1) if own is None else votes.sum(1) - votes[:, own]).sum(1)
        for _, text, _ in rows[:200]:
            terms, weights = model.vector(model.counts(T.words_of(text)))
            at, cosine = model.index.nearest(terms, weights, T.K, model.index.products([(terms, weights)])[0], number)
            query = np.zeros(full.shape[1])
            query[terms] = weights
            every = full @ query
            order = np.argsort(-every, kind="stable")
            order = order[(every[order] > 1e-9) & (number[order] > 0)]
            if number[order].sum() < T.K:
                assert set(at.tolist()) == set(order.tolist())
                continue
            kth = every[order[np.searchsorted(np.cumsum(number[order]), T.K)]]
            assert set(at.tolist()) == set(np.flatnonzero((every >= kth - 1e-9) & (number > 0)).tolist())


def test_shares_equal_a_brute_force(data):
    """Term choice, TF-IDF vectors, cosines and votes again, over every word of the examples, in plain loops."""
    rows, docs, model = data
    examples = [(r.key, r.f) for r in docs.select(F.col("doc_id").alias("key"), T.fold(F.col("doc_id")).alias("f")).collect() if r.f]
    text, truth = {i: t for i, t, _ in rows}, {i: y for i, _, y in rows}
    sets = {i: set(T.words_of(text[i])) for i, _ in examples}
    m1, m = sum(truth[i] for i in sets), len(sets)
    every, chosen = set().union(*sets.values()), set()
    for w in every:
        a, n = sum(truth[i] for i in sets if w in sets[i]), sum(w in s for s in sets.values())
        chi2 = m * (a * (m - m1) - (n - a) * m1) ** 2 / (m1 * (m - m1) * n * max(1, m - n))
        if chi2 > 2 * math.log(len(every) / T.LUCK):
            chosen.add(w)
    assert chosen == {t for t in model.terms if t[:1] != b" "} and {w.encode() for w in BAD} <= chosen

    def terms_of(t):
        words = T.words_of(t)
        return Counter(w for w in words if w in chosen) or Counter({T.digest(words)} if words else {})

    df = Counter(w for _, t, _ in rows for w in terms_of(t))

    def vector(t):
        v = {w: (1 + math.log(n)) * (1 + math.log((1 + len(rows)) / (1 + df[w]))) for w, n in terms_of(t).items() if w in model.terms}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    known = [(vector(text[i]), truth[i], f) for i, f in examples]
    for own in (None, 3):
        queries = [t for _, t, _ in rows[:80]]
        for t, (share, named) in zip(queries, model.shares([model.counts(T.words_of(t)) for t in queries], [own] * 80 if own else None)):
            q = vector(t)
            near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), y) for v, y, f in known if f != own), reverse=True)
            near = [x for x in near if x[0] > 1e-9]
            if not near:
                assert share is None and not named
                continue
            least = near[min(T.K, len(near)) - 1][0] - 1e-9
            votes = [0.0, 0.0]
            for c, y in near:
                if c >= least:
                    votes[y] += model.rates[y] * T.NEAR / (max(0.0, 1 - c) + T.NEAR)
            assert share == pytest.approx((votes[1] + model.prior) / (sum(votes) + 1), abs=1e-9)
            assert named and named[0][2] == pytest.approx(near[0][0])


def test_scores_are_calibrated(data):
    """Brier score and reliability on the held-out fold."""
    rows, docs, model = data
    truth = {i: y for i, _, y in rows}
    got = [(r.score, truth[r.key]) for r in T.toxicity(docs, model).where(T.fold(F.col("key")) == 0).collect()]
    rate = np.mean([y for _, y in got])
    assert np.mean([(s - y) ** 2 for s, y in got]) < 0.3 * rate * (1 - rate)
    for low, high in ((0, 0.5), (0.5, 1.01)):
        part = [(s, y) for s, y in got if low <= s < high]
        assert abs(np.mean([s for s, _ in part]) - np.mean([y for _, y in part])) < 0.1


def test_the_curve_finds_its_slope():
    rng = np.random.default_rng(3)
    odds = rng.normal(size=20_000) * 2
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * odds - 0.6)))).astype(int)
    share = 1 / (1 + np.exp(-odds))
    assert np.allclose(T.fitted(share, label, np.ones(20_000)), (1.7, -0.6), atol=0.1)
    for label in (np.zeros(5), np.ones(5), np.array([0, 0, 0, 1, 1])):
        slope, _ = T.fitted(np.array([0.1, 0.2, 0.2, 0.9, 0.95]), label, np.ones(5))
        assert 0 <= slope < 10


def test_copies_are_near_where_no_term_is(spark):
    rows = [(i, f"plain words of text {i % 40} only", i % 40 == 3) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.key: r for r in T.toxicity(docs, model).collect()}
    assert all((got[i].score > 0.5) == y for i, _, y in rows)
    assert all(e.label == 1 and e.cosine == 1 for e in got[3].evidence) and len(got[3].evidence) == T.NAMED


def test_few_toxic_labels(spark):
    rng = random.Random(7)
    words, bad = [f"w{i}" for i in range(3000)], [f"insult{i}" for i in range(4)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join([*text, *rng.sample(bad, 2)] if i % 10 == 0 else text), int(i % 10 == 0)))
    keys = {r[0] for r in spark.range(400).where(T.fold(F.col("id")) != 0).select("id").collect()}
    toxic = [i for i, _, y in rows if y and i in keys][:8]  # each insult stands in about four of them
    clean = [i for i, _, y in rows if not y and i in keys][:60]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in clean], "doc_id long, toxic int"))
    got = {r.key: r.score for r in T.toxicity(docs, model).collect() if r.key not in toxic + clean}
    scores = {y: [got[i] for i, _, x in rows if x == y and i in got] for y in (0, 1)}
    above = np.mean([a > b for a in scores[1] for b in scores[0]])
    assert above > 0.9


def test_few_toxic_labels_of_the_small_table(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    rows = T.toxicity(docs, model).join(labels.where("toxic IS NOT NULL"), F.col("key") == F.col("doc_id")).where(T.fold(F.col("key")) == 0).collect()
    clean = [r.score for r in rows if r.toxic == 0]
    assert clean and all(r.score >= np.median(clean) for r in rows if r.toxic == 1)


def test_odd_rows(spark, docs_of, data):
    model = data[2]
    got = T.toxicity(docs_of(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got)
    assert T.toxicity(docs_of([]), model).collect() == []
    none = T.fit(docs_of(ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in T.toxicity(docs_of(ODD), none).collect()} == {0.0}
