import html
import math
import random
import re
import time

import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import common
from blockloom.llm import language as L

TEXTS = {"en": "the house is where they were with that thing and this other", "de": "das haus ist nicht wo sie mit dem und der anderen waren", "fr": "la maison est dans laquelle vous avez avec les autres choses"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i * 10 + j, " ".join([t] * 60 * (j + 1)), lang) for i, (lang, t) in enumerate(TEXTS.items()) for j in range(8)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def page(text, lang=None):
    return f'<html{f" lang={chr(34)}{lang}{chr(34)}" if lang else ""}><head><script>var x = "das";</script></head><body><p>{text}</p></body></html>'


ROWS = [(1, "http://a.site.de/x", page(TEXTS["de"], "de-AT")), (2, "http://a.site.de/y", page(TEXTS["de"], "de")), (3, "https://b.site.com", page("the thing", "en")), (4, "http://a.site.de/z", page("is", "de")), (5, "http://c.site.fr", page(TEXTS["fr"])), (6, None, page("1234")), (7, "q.org", None), (8, "q.org", page("zzqx kjvv wwqq xxzz qqkk"))]


def brute(model):
    """The same posterior in plain loops."""
    names, logs = model
    n, classes = len(names) + 1, [*names, L.UNKNOWN]
    prior = np.log([(1 - L.PRIOR_UNKNOWN) / (n - 1)] * (n - 1) + [L.PRIOR_UNKNOWN])
    norm = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    rows = []
    for i, url, source in ROWS:
        grams, said = L.trigrams(L.visible(source)), L.declared_in(source)
        rows.append([i, logs[grams].sum(0) * L.TEMPER, len(grams), *L._host(url), said if said in names else "other" if said else "none"])
    seen = [r for r in rows if r[2]]
    p = [norm(r[1] + prior) for r in seen]
    total = sum(p)
    like = lambda at: {v: np.log((sum(x for x, r in zip(p, seen) if r[at] == v) + 1) / (total + 10)) for v in {r[at] for r in seen}}
    said, suffix = like(6), like(5)
    base = {r[0]: r[1] + said.get(r[6], 0) + suffix.get(r[5], 0) for r in rows}
    own = {k: norm(v + prior) for k, v in base.items()}
    sums = lambda at: {v: sum(own[r[0]] for r in seen if r[at] == v) for v in {r[at] for r in seen}}
    host, domain = sums(3), sums(4)
    whole = sum(own[r[0]] for r in seen)
    overall = (whole + 1) / (whole.sum() + n)
    out = {}
    for r in rows:
        if not r[2]:
            out[r[0]] = (L.UNKNOWN, 0.0)
            continue
        d, h = np.maximum(0, domain[r[4]] - own[r[0]]), np.maximum(0, host[r[3]] - own[r[0]])
        dp = (d + L.SMOOTH * overall) / (d.sum() + L.SMOOTH)
        final = norm(base[r[0]] + np.log((h + L.SMOOTH * dp) / (h.sum() + L.SMOOTH)))
        out[r[0]] = (classes[int(final.argmax())], float(final.max()))
    return out


def test_posteriors_equal_brute_force(spark, model):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, language string")
    got = {r.page_id: (r.language, r.confidence) for r in L.identify(df, model, text="html", address="url", markup=True).collect()}
    want = brute(model)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in want)
    assert got[1][0] == "de" and got[8][0] == got[6][0] == L.UNKNOWN


@pytest.mark.parametrize("hot", [1000, 2])
def test_many_hosts_give_the_same(spark, model, monkeypatch, hot):
    df = spark.createDataFrame([(*r, "x") for r in ROWS * 3], "page_id long, url string, html string, language string")
    rows = lambda: sorted(map(str, L.identify(df, model, text="html", address="url", markup=True).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(common, "HOT", hot)
    assert rows() == want


def test_every_declared_language_is_a_class(spark):
    """Ninety languages, one of them with most of the documents; words of the rarest are told from the others."""
    word = lambda k: "".join(chr(97 + (k * 7 + j * (3 + k % 5)) % 26) for j in range(6))
    text = lambda k: " ".join([word(k), word(k + 90), word(k + 180)] * 20)
    rows = [(i, text(0), "L00") for i in range(3000)] + [(10_000 + k, text(k), f"L{k:02}") for k in range(1, 90)]
    names, logs = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=50)
    assert names == [f"l{k:02}" for k in range(90)] and logs.shape[1] == 91
    pages = spark.createDataFrame([(k, text(k), "") for k in (0, 17, 65, 89)], "doc_id long, text string, source string")
    assert {r.doc_id: r.language for r in L.identify(pages, (names, logs)).collect()} == {k: f"l{k:02}" for k in (0, 17, 65, 89)}


OLD_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
OLD_LANG = re.compile(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)")


def test_one_pass_reads_pages_as_plain_patterns_do():
    rng = random.Random(1)
    parts = ["<script>", "</script>", "</SCRIPT >", "<style", "</style>", "<!--", "-->", "<p>", "<", ">", "a b", "<html lang='en'>", "<html x", "lang=de", " lang = fr>", "\n", "<scripts>"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        said = OLD_LANG.search(text)
        assert L.visible(text) == html.unescape(OLD_DROP.sub(" ", text))
        assert L.declared_in(text) == (said[1].lower() if said else None)


@pytest.mark.parametrize("run", ["<", "<!--", "<script ", "<html ", "<html lang ", "</script ", "<style>", "<html a> ", "&", "中", "a", "0", "<a>"])
def test_a_megabyte_of_anything_takes_linear_time(run):
    text = run * (1_000_000 // len(run))
    began = time.process_time()
    L.trigrams(L.visible(text))
    assert L.declared_in(text) is None and time.process_time() - began < 10


def test_odd_rows(spark, docs_of, model):
    got = L.identify(docs_of(ODD), model).collect()
    assert len(got) == len(ODD) and [r.language for r in got if r.doc_id in (1, 2)] == [L.UNKNOWN] * 2
    assert L.identify(docs_of([]), model).collect() == []
    assert L.train(docs_of([]))[0] == []
