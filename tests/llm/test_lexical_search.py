import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import lexical_search as L
from blockloom.llm import queries
from blockloom.llm.decontaminate import words_of


def brute(docs, items, k=10):
    """Ranks of every item by scoring every document."""
    terms = [Counter(words_of(t)) for _, t in docs]
    n, words = sum(bool(t) for t in terms), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    out = []
    for name, text in items:
        found = []
        for (doc, _), held in zip(docs, terms, strict=True):
            m = 100 - 75 + (75 * sum(held.values()) * n) // max(1, words)
            score = 0
            for w in words_of(text):
                if held[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * held[w]) // (1000 * held[w] + 8 * m))
            if score > 0:
                found.append((-score, -math.inf if doc is None else doc, doc))
        out += [(name, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda f: f[:2])[:k], 1)]
    return out


def least_cost(values, longest, price):
    best = [0.0]
    for i in range(1, len(values) + 1):
        best.append(min(best[j] + price + (i - j) * max(values[j:i]) - sum(values[j:i]) for j in range(max(0, i - longest), i)))
    return best[-1]


@pytest.mark.parametrize("seed", range(10))
def test_blocks_have_the_least_bound_error(seed, monkeypatch):
    monkeypatch.setattr(L, "LONGEST", random.Random(seed).choice([4, 16, 64]))
    rng = np.random.default_rng(seed)
    lists = [rng.integers(1, 1000, rng.integers(1, 150)) for _ in range(8)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    ends = L.cut_blocks(np.concatenate(lists), starts)
    for x, a, b in zip(lists, starts, starts[1:], strict=False):
        price = max(1, L.PRICE * (x.max() - x.mean()))
        cuts = [0, *(np.flatnonzero(ends[a:b]) + 1)]
        assert cuts[-1] == len(x) and max(np.diff(cuts)) <= L.LONGEST
        cost = sum(price + (q - p) * x[p:q].max() - x[p:q].sum() for p, q in zip(cuts, cuts[1:], strict=False))
        assert cost <= least_cost(x.tolist(), L.LONGEST, price) * 1.0001


def test_bounds_hold_and_skip():
    rng = random.Random(4)
    vocabulary = {f"w{i}".encode(): i + 1 for i in range(30)}
    texts = [" ".join(f"w{min(int(rng.expovariate(0.2)), 29)}" for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    sizes, *lists = L.postings(texts, vocabulary)
    shard = L.Shard(sizes, *lists, 3000, int(sizes.sum()), np.arange(31) * 100)
    rows, times = np.array([2, 9, 20]), np.array([1, 2, 1])
    scores, bounds = shard.scores(rows, times, np.arange(3000)), shard.bounds(rows, times)
    assert (bounds >= scores).all() and (bounds < np.sort(scores)[-10]).sum() > 300


@pytest.mark.parametrize("seed", range(4))
def test_frame_equals_brute_force(spark, docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(L, "SHARD_WORDS", 500)
    monkeypatch.setattr(L, "FIRST", 4)
    words = ["the", "The", "Été", "été", "x1", "of", *[f"w{i}" for i in range(30)]]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice([4, 36])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 50))) for i in range(300)]
    docs += [*docs[:40], *[(1000 + i, docs[5][1]) for i in range(30)], *[(d, t) for d, t, _ in ODD]]
    items = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(3, docs[5][1]), (None, "of x1"), (77, None), (78, ""), (79, "nowhere")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    for block in (10**6, 60):
        got = [tuple(r) for r in L.top_documents(docs_of([(d, t, "s") for d, t in docs]), frame, block_chars=block).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.top_documents(docs_of([]), items).collect() == []
    assert L.top_documents(docs_of(ODD), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in L.top_documents(docs_of([(7, "A", "s"), (None, "a", "s"), (3, "c", "s")]), items).collect()] == [(1, 1, None), (1, 2, 7)]


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op12_lexical_search"]).fetchall())
    assert want and sorted(tuple(r) for r in queries.op12_lexical_search(spark, sf).collect()) == want
