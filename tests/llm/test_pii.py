import itertools
import random
import re
import time

import numpy as np
import pytest
from tests.llm.conftest import ODD

from blockloom.llm import pii as P


def plain(text):
    out = {k: [] for k in P.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    parts = ["0123456789", ". -+()", "@ab.", "1.2", "+1 (2", "25", "٣é\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 40)))
        assert P.base_spans(text) == plain(text)


LONG = ["a", "1", "0", "中", "@", "a@", "1 ", "12345 ", "+1(", "1.", "((", "1-", "+ ", "4111 1111 1111 1111 "]


@pytest.mark.parametrize("run", LONG)
def test_a_megabyte_of_anything_takes_linear_time(run):
    """Spans, graph and messages; none of these texts took a minute in its square, all take seconds."""
    text = (run * 1_000_000)[: 1_000_000 if "@" not in run else 200_000]
    began = time.process_time()
    f = field()
    f.added(text, P.base_spans(text))
    assert time.process_time() - began < 20


def test_parts_of_many_zeros_are_numbers():
    zeros = "0" * 5000
    assert P.base_spans(f"{zeros}1.2.3.{zeros}")["ip"] == [(0, 10_006)]
    assert P.base_spans(f"{zeros}1.2.3.4 and {zeros}256.1.1.1")["ip"] == [(0, 5007)]


def test_nodes_are_addresses_and_the_numbers_between():
    text = "a@b@c, 12 34@x 555-1234 (@) 2 77 mail:x1@y2.org"
    assert [text[s:e] for s, e in P._nodes(text)] == ["a@b", "12", "34@x", "555-1234", "(@)", "2 77", "mail:x1@y2.org"]


def field():
    unary = np.zeros((len(P.FEATURES), len(P.LABELS)))
    unary[0, 0] = 1.0
    return P.Field(unary, np.zeros((5, 5)), np.where(np.eye(5), 2.5, -2.5))


def test_repeated_mentions_agree():
    text = "call +1 (217) 555-0143 today. Later words, more words. or (217) 555-0143 at night; order 2024 stays."
    base = P.base_spans(text)
    added = field().added(text, base)
    assert [text[s:e] for s, e in added["phone"]] == ["(217) 555-0143"] and not added["card"]


def trained(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(600):
        item = rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"a{digits(2)}@b{digits(1)}.cd", f"order {digits(8)}", f"in {digits(4)}", f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}"])
        rows.append((i, f"some words {item} and more words {digits(rng.choice([3, 4, 7, 16]))} at the end"))
    return P.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_field_decides_without_base_spans_or_repeats(spark):
    f = trained(spark)
    mark = lambda t: [t[s:e] for k in P.KINDS for s, e in f.added(t, P.base_spans(t))[k]]
    assert mark("ring (217) 555-0143 today") == ["(217) 555-0143"]
    assert mark("ring (217) 555-0143 today, and many words later ring again (217) 555-0143") == ["(217) 555-0143"] * 2
    assert mark("order 20240113 of 2024 and 1234567890123456") == [] and mark("no number at all") == []
    stub = P.Field(np.zeros_like(f.unary), np.zeros((5, 5)), np.zeros((5, 5)))
    stub.unary[0, 0] = 1.0
    assert not any(stub.added("ring (217) 555-0143 today", P.base_spans("")).values())


def test_numbers_in_small_groups_are_one_node():
    graph = P.Graph("tel 06 12 34 56 78, room 12 of 2024-01-12", P.base_spans(""))
    assert [e - s for s, e in graph.spans] == [14, 10]


def test_no_mark_adds_nothing_to_an_empty_field():
    assert not any(field().added("mail a@b.cd and 123456 or 999", P.base_spans("mail a@b.cd and 123456 or 999")).values())


def test_messages_equal_enumeration_on_a_tree():
    text = "a 1234567 b 1234567"
    graph = P.Graph(text, P.base_spans(text))
    graph.chain = []
    rng = np.random.default_rng(1)
    pair = rng.normal(size=(5, 5))
    f = P.Field(rng.normal(size=(len(P.FEATURES), 5)), np.zeros((5, 5)), pair)
    graph.skip = graph.skip[:1]
    bits = (np.array(graph.features)[:, None] >> np.arange(len(P.FEATURES))) & 1
    s = bits @ f.unary
    joint = np.exp(s[0][:, None] + s[1][None, :] + pair)
    joint /= joint.sum()
    assert np.allclose(f.marginals(graph), np.stack((joint.sum(1), joint.sum(0))), atol=0.02)


def test_messages_come_near_enumeration_on_a_cycle():
    """Chain and skip edges close a ring; weak potentials leave loopy messages close to the exact marginals."""
    text = "1234567 8888888 1234567 8888888 1234567"
    graph = P.Graph(text.replace(" ", "; "), P.base_spans(""))
    assert len(graph.spans) == 5 and len(graph.chain) == 4 and len(graph.skip) >= 3
    rng = np.random.default_rng(3)
    chain, skip = 0.3 * rng.normal(size=(5, 5)), 0.3 * rng.normal(size=(5, 5))
    f = P.Field(0.5 * rng.normal(size=(len(P.FEATURES), 5)), chain, skip)
    bits = (np.array(graph.features)[:, None] >> np.arange(len(P.FEATURES))) & 1
    unary = bits @ f.unary
    exact = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        e = sum(unary[i, y[i]] for i in range(5)) + sum(chain[y[i], y[j]] for i, j in graph.chain) + sum(skip[y[i], y[j]] for i, j in graph.skip)
        for i in range(5):
            exact[i, y[i]] += np.exp(e)
    exact /= exact.sum(1, keepdims=True)
    assert np.abs(f.marginals(graph) - exact).max() < 0.03
    assert np.abs(P.Field(f.unary, 0 * chain, 0 * skip).marginals(graph) - exact).max() > 0.06


def test_odd_rows(spark, docs_of):
    trained = P.train(docs_of([*ODD, (9, "mail a@b.cd twice a@b.cd", "s")]))
    got = P.personal_data(docs_of([*ODD, (9, "mail a@b.cd twice a@b.cd", "s")]), trained).collect()
    assert sorted(r.base for r in got)[-1] == "email:5:11,email:18:24" and sum(bool(r.base) for r in got) == 1
    assert P.personal_data(docs_of([]), P.train(docs_of([]))).collect() == []
