import hashlib
import random

import duckdb
import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import queries
from blockloom.llm import substring_dup as S


def brute(rows, window=S.WINDOW):
    """``doc_id, n_words, n_removed, kept_sha256`` of each row; rows of equal ids and texts are one document."""
    key = {(d, t): (d is not None, d or 0) for d, t in rows}
    order = sorted(set(rows), key=lambda r: key[r])
    seen, gone = set(), {}
    for row in order:
        words = (row[1] or "").encode().split()
        out = set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                out.update(range(k, k + window))
            seen.add(run)
        gone[row] = out
    made = []
    for row in rows:
        words = (row[1] or "").encode().split()
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone[row])
        made.append((row[0], len(words), len(gone[row]), hashlib.sha256(kept).hexdigest()))
    return made


def test_word_hashes_tell_words_and_nothing_else(monkeypatch):
    texts = ["a b  a", "", "\n ba\x0bé\x1c é ", "x" * 3000 + " x", "b", " ", "x" * 3000]
    for size in (1 << 20, 64):
        monkeypatch.setattr(S, "SLICE", size)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        hashes, counts = S.word_hashes(data, bounds)
        words = [w for t in texts for w in t.encode().replace(b"\x1c", b"?").split()]
        assert counts.tolist() == [len(t.encode().split()) for t in texts]
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("seed", range(20))
def test_factors_cover_what_starts_earlier(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 50, 400)
    pieces = []
    for _ in range(60):
        at, length = rng.integers(0, 360), rng.integers(20, 32)
        piece = passage[at : at + length].copy() if rng.random() < 0.8 else rng.integers(0, rng.choice([1, 2, 50]), length)
        if rng.random() < 0.4:
            piece[rng.integers(0, len(piece))] = 99
        pieces.append(piece.astype(np.uint64))
    piece, low, high = S.factors(np.concatenate(pieces), np.array([len(p) for p in pieces]))
    got = {(p, i) for p, a, b in zip(piece.tolist(), low.tolist(), high.tolist(), strict=True) for i in range(a, b)}
    seen, want = set(), set()
    for p, words in enumerate(pieces):
        for k in range(len(words) - S.WINDOW + 1):
            run = tuple(words[k : k + S.WINDOW].tolist())
            if run in seen:
                want.update((p, i) for i in range(k, k + S.WINDOW))
            seen.add(run)
    assert got == want


def corpus(rng):
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [fresh(rng.randint(15, 90)) for _ in range(8)]
    rows = []
    for i in range(250):
        parts = [rng.choice([fresh(rng.randint(0, 40)), rng.choice(passages), " ".join(rng.choice(passages).split()[rng.randint(0, 9) : rng.randint(12, 80)])]) for _ in range(rng.randint(0, 4))]
        rows.append((rng.randint(0, 10**6) * 1000 + i, rng.choice([" ", "\n", " \t "]).join(parts)))
    for i in range(60):
        rows.append((10**12 + i, rows[i % 5 + 100][1]))
        rows.append((2 * 10**12 + i, f"start {i} " + passages[0] + f" end {i} " + passages[1]))
    rows += [rows[7], rows[7], rows[101], (5, "a " * 500), (6, "a b c " * 300), (7, "x " + "a b c " * 30)]
    rows += [(d, t) for d, t, _ in ODD]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_frame_equals_brute_force(spark, docs_of, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(S, "HOT_PLACES", rng.choice([1, 20, 8192]))
    monkeypatch.setattr(S, "BLOCK", 500)
    monkeypatch.setattr(S, "BUCKET", 300)
    rows = corpus(rng)
    found = S.without_repeats(docs_of([(d, t, "s") for d, t in rows]).repartition(5), texts=True).collect()
    order = lambda r: (r[0] is not None, *[x or 0 for x in r[:3]], r[3])
    assert sorted([tuple(r)[:4] for r in found], key=order) == sorted(brute(rows), key=order)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_empty_table(spark, docs_of):
    assert S.without_repeats(docs_of([])).collect() == []
    assert [tuple(r)[:3] for r in S.without_repeats(docs_of([(1, None, "s")])).collect()] == [(1, 0, 0)]


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op13_substring_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op13_substring_dedup(spark, sf).collect())
    assert got == want and sum(r[2] for r in got) > 0
