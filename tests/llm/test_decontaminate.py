import random

import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import decontaminate as D


def brute(texts, items):
    windows = {}
    for name, text in items:
        words = D.words_of(text)
        for k in range(max(0, len(words) - D.WINDOW) + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + D.WINDOW]), set()).add(name)
    lengths, out = {len(w) for w in windows}, []
    for text in texts:
        words, hit, names = D.words_of(text), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= owners
        out.append((len(words), sorted(names), len(hit)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(D, "INDEX_SYMBOLS", rng.choice([40, 100, 1 << 20]))
    letters = rng.choice(["ab", "abc", "abcdefghij"])
    items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for k in range(8)]
    texts = [" ".join(rng.choice(letters + "Z") for _ in range(rng.randint(0, 200))) + " " + rng.choice(items)[1] for _ in range(20)] + [None, ""] + [items[1][1]] * 3
    got = D.scan(texts, D.Windows(items))
    assert [(n, names, sum(e - s for s, e in spans)) for n, names, spans in got] == brute(texts, items)


def test_index_finds_and_locates_every_place():
    rng = np.random.default_rng(2)
    symbols = np.concatenate(([0], rng.integers(0, 4, 500), [0])).astype(np.int32)
    index = D.FMIndex(symbols, 3)
    for _ in range(50):
        pattern = rng.integers(1, 4, rng.integers(1, 5))
        want = [i for i in range(len(symbols) - len(pattern) + 1) if (symbols[i : i + len(pattern)] == pattern).all()]
        who, low, high = index.search(pattern[None, :])
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(who) else []
        assert got == want


def test_frame_spans_and_blocks(spark, docs_of):
    passage = " ".join(f"Word{i}," for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "short item"), (2, passage.upper()), (3, None), (None, "lost words"), (4, "!!")], "item_id long, text string")
    rows = [*ODD, (9, f"É start; {passage} end short item.", "s"), (10, "some lost words", "s")]
    for block in (10**6, 30):
        got = {r.doc_id: r for r in D.find_benchmark(docs_of(rows), items, block_chars=block).collect()}
        r = got[9]
        assert (r.n_words, r.n_hit, r["items"]) == (25, 22, ["1", "2"])
        assert [rows[-2][1][s.start : s.end] for s in r.spans] == [passage.rstrip(","), "short item"]
        assert len(got) == 8 and (got[10].n_hit, got[10]["items"]) == (2, []) and got[1].n_words == got[2].n_words == 0 and got[5].n_words == 30_000
    assert D.find_benchmark(docs_of([]), items).collect() == []
    unnamed = items.where("item_id IS NULL")
    assert {r.doc_id for r in D.find_benchmark(docs_of(rows), unnamed).where("n_hit > 0").collect()} == {10}
    assert all(r.n_hit == 0 for r in D.find_benchmark(docs_of(rows), items.limit(0)).collect())
