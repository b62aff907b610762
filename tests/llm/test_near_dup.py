import random

import pytest
from tests.llm.conftest import ODD

from blockloom.llm import common
from blockloom.llm import near_dup as N
from blockloom.llm.common import components


def classes(rows, weights):
    store = N.Words()
    sets = [N.shingles(store.hash(N.words_of(t)), weights) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or N.similarity(sets[i], sets[j]) >= N.THRESHOLD):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    return {d: min(ids[top(i)]) for i, (d, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            copy[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(160, 230)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(60)) + " " + " ".join(base[:60])) for i in range(230, 280)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(200)) + " one line again" * 150) for i in range(280, 300)]
    return rows + [(300, None), (301, None), (302, ""), (303, ""), (304, "a b"), (305, "a b"), (306, "a b c")]


def test_classes_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    got = {r.doc: (r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    want = classes(corpus, N.word_weights(df))
    assert got == {d: (c, c == d) for d, c in want.items()}
    # A line repeated in many documents and a shared passage make no near duplicates.
    assert all(want[i] == i for i in range(230, 302))


@pytest.mark.parametrize("small", [{"FIRST_PIVOTS": 1, "PARTNERS": 1}, {"PIVOT_PAIRS": 5, "BLOCK": 20, "TASK_ROWS": 40}, {"BLOCK_BYTES": 40_000, "TASK_BYTES": 50_000}])
def test_bounds_of_tasks_change_nothing(spark, corpus, monkeypatch, small):
    """Pivots dealt to several tasks, small blocks, hot keys that are joined apart and components joined by shuffles."""
    for name, value in small.items():
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "BROADCAST_EDGES", 10)
    df = spark.createDataFrame([*corpus, *[(1000 + i, corpus[0][1]) for i in range(60)]], "doc_id long, text string").repartition(6)
    got = {r.doc: r.component_id for r in N.near_duplicates(df).collect()}
    weights = N.word_weights(df)
    want = classes([*corpus, (1000, corpus[0][1])], weights)
    assert got == want | {1000 + i: want[0] for i in range(60)}


def test_odd_rows(spark, docs_of):
    got = sorted(((r.doc, r.component_id, r.kept) for r in N.near_duplicates(docs_of(ODD)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (None, 4, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True)], key=str)
    assert N.near_duplicates(docs_of([])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.comp) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
