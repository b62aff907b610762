import random
from collections import Counter, defaultdict
from math import comb

import pytest
from tests.llm.conftest import ODD
from pyspark.sql import functions as F

from blockloom.llm import mixing as M
from blockloom.llm.mixing import hypergeometric, mix, mixed, source_targets, split_quotas


def fill(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets(spark):
    rng = random.Random(2)
    sizes = {f"s{i:02}": rng.choice([0, 3, 50, 1000, 40_000]) for i in range(30)} | {None: 77, "É": 10}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_rows long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mix(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(1500)]
    out = mix(docs_of(rows), shards=6)
    got = out.collect()
    assert len(got) == len(rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        words = sum(c.words for c in r.copies)
        assert words <= 2 * r["size"] and len({c["pass"] for c in r.copies}) == len(r.copies)
        taken[r.source] += words
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert target == pytest.approx(fill(dict(size)))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs_of(rows[::-1]), shards=6).collect()))
    shards = mixed(out, 6)
    assert shards.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("(w)"))))).first()[0] == sum(taken.values())
    per = Counter(r["shard"] for r in shards.select("shard").collect())
    assert set(per) == set(range(6)) and max(per.values()) < 2 * min(per.values())


def quantile(population, marked, drawn, u):
    """The hypergeometric quantile in exact integers."""
    low, high = max(0, drawn - (population - marked)), min(drawn, marked)
    weights = [comb(marked, k) * comb(population - marked, drawn - k) for k in range(low, high + 1)]
    total, run = sum(weights), 0
    for k, w in enumerate(weights, low):
        run += w
        if run >= u * total:
            return k
    return high


def plain_tree(spark, quotas, shards, seed, group):
    """Quotas by shard and source, by the tree in plain Python; only the uniform numbers are looked up."""

    def uniforms(salt, lo, hi, names):
        rows = spark.createDataFrame([(lo, hi, n) for n in names], "lo int, hi int, nr long")
        return {r.nr: r.u for r in rows.select("nr", M._uniform(F.lit(salt), F.col("lo"), F.col("hi"), F.col("nr")).alias("u")).collect()}

    def draw(items, want, salt, lo, hi):
        u, left, population = uniforms(salt, lo, hi, items), {}, sum(items.values())
        for name in sorted(items):
            left[name] = quantile(population, items[name], want, u[name])
            population, want = population - items[name], want - left[name]
        return left

    def split(items, lo, hi):
        if hi - lo == 1:
            return {lo: items}
        mid, groups = (lo + hi) // 2, defaultdict(dict)
        for nr, q in items.items():
            groups[nr // group][nr] = q
        total = sum(items.values())
        want = int(total * (mid - lo) / (hi - lo) + 0.5)
        wants = draw({g: sum(i.values()) for g, i in groups.items()}, want, seed + 1, lo, hi) if len(groups) > 1 else dict.fromkeys(groups, want)
        left = {nr: q for g, i in groups.items() for nr, q in draw(i, wants[g], seed, lo, hi).items()}
        return split(left, lo, mid) | split({nr: q - left[nr] for nr, q in items.items()}, mid, hi)

    return split(quotas, 0, shards)


@pytest.mark.parametrize("group", [1024, 3])
def test_quotas_equal_a_tree_in_plain_python(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP_SOURCES", group)
    quotas = {nr: q for nr, q in enumerate([40, 0, 7, 123, 1, 60, 2, 33])}
    got = split_quotas(spark.createDataFrame(list(quotas.items()), "nr long, quota long"), 5, 9).collect()
    want = plain_tree(spark, quotas, 5, 9, group)
    ends = {nr: [sum(want[s][nr] for s in range(k + 1)) for k in range(5)] for nr in quotas}
    assert {r.nr: r.bounds for r in got} == ends
    per = [sum(want[s].values()) for s in want]
    assert max(per) - min(per) <= 3


def test_shards_take_their_quotas(spark, docs_of, monkeypatch):
    """Each shard's copies of whole blocks are what the tree gives it, and partitions hold the shards in order."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 1)
    seen = {}
    real = M.split_quotas

    def spy(quotas, shards, seed):
        seen["quota"] = {r.nr: r.quota for r in quotas.collect()}
        out = real(quotas, shards, seed)
        seen["bounds"] = {r.nr: r.bounds for r in out.collect()}
        return out

    monkeypatch.setattr(M, "split_quotas", spy)
    rows = [(i, "w " * (1 + i % 3), "abc"[i % 3]) for i in range(400)]
    out = mix(docs_of(rows), shards=4)
    per = Counter()
    blocks = defaultdict(set)
    for r in out.select("source", "copies", "doc_id").collect():
        for c in r.copies:
            per[r.source, c.shard] += 1
            blocks[r.source].add((r.doc_id, c["pass"]))
    for nr, source in enumerate("abc"):
        ends = seen["bounds"][nr]
        assert ends[-1] == seen["quota"][nr] and ends == sorted(ends)
        shares = [b - a for a, b in zip([0, *ends], ends)]
        assert all((per[source, s] > 0) == (n > 0) for s, n in enumerate(shares))
    places = mixed(out, 4).withColumn("p", F.spark_partition_id()).select("p", "shard", "place").collect()
    assert places == sorted(places, key=lambda r: (r.p, r.place)) and [r["shard"] for r in places] == sorted(r["shard"] for r in places)
    assert [(r["shard"], r.place) for r in places] == sorted((r["shard"], r.place) for r in places)


def test_a_key_of_many_rows_is_spread(docs_of):
    got = mix(docs_of([(None, f"word {i}", "a") for i in range(2000)] + [(1, "w " * 4000, "b")])).collect()
    assert len(got) == 2001 and {c["shard"] for r in got for c in r.copies} == set(range(16))


def test_hypergeometric_draws(spark):
    n = 4000
    u = (F.col("id") + 0.5) / n
    drawn = spark.range(n).select(hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), u).alias("k")).groupBy("k").count().collect()
    for r in drawn:
        assert abs(r["count"] / n - comb(20, r.k) * comb(30, 10 - r.k) / comb(50, 10)) < 0.001


def test_odd_rows(spark, docs_of):
    rows = mix(docs_of(ODD))
    assert rows.count() == len(ODD) and rows.columns.count("size") == 1
    total = rows.agg(F.sum(F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))).first()[0]
    assert abs(total - 1.5 * (2 * 3 + 30_000 + 1 + 1)) <= 4
    assert mix(docs_of([])).collect() == []
