from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from blockloom.llm.sharding import ROUNDS, grid, original, permuted, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 97, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, 3).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 24 or got != sorted(got))


@pytest.mark.parametrize("n", [1, 2, 24, 97, 1000, 12_345])
def test_inverse_and_network_in_plain_python(spark, n):
    """The permutation again, in integers, with the hashes it draws on looked up."""
    got = {r.id: (r.p, r.b) for r in spark.range(n).select("id", permuted(F.col("id"), n, 3).alias("p")).select("id", "p", original(F.col("p"), n, 3).alias("b")).collect()}
    assert all(b == i for i, (_, b) in got.items())
    wide, high = grid(n)
    rounds = [(i, r) for i in [*range(ROUNDS), *range(100, 100 + ROUNDS)] for r in range(max(wide, high) + 1)]
    table = spark.createDataFrame(rounds, "i int, r long").select("i", "r", F.xxhash64(F.lit(3), "i", "r").alias("h"))
    h = {(r.i, r.r): r.h for r in table.collect()}

    def through(x):
        left, right = divmod(x, high)
        for i in range(ROUNDS):
            left = (left + h[i, right] % wide) % wide
            right = (right + h[i + 100, left] % high) % high
        return left * high + right

    for i in range(0, n, max(1, n // 500)):
        x = through(i)
        while x >= n:
            x = through(x)
        assert got[i][0] == x


@pytest.mark.parametrize("n", [10**6 + 3, 10**9, 10**12 + 39, 10**14 + 31])
def test_walks_are_short_at_any_size(n):
    wide, high = grid(n)
    assert 0 <= wide * high - n <= 64 and wide < 1.2 * high + 2


def test_shard_and_slot_follow_from_the_row_number(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("v"))
    got = shard_rows(rows, 24, seed=7).select("v", (F.col("slot") * 24 + F.col("shard")).alias("place"))
    numbers = sorted(r.n for r in got.select(original(F.col("place"), 5000, 7).alias("n")).collect())
    assert numbers == list(range(5000))


def test_a_key_of_many_rows_is_spread(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("v"))
    got = shard_rows(rows, 24)
    assert got.count() == 60_000 and got.select("shard", "slot").distinct().count() == 60_000


def test_shards(spark):
    rows = spark.range(2000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") % 3).alias("v"))
    got = shard_rows(rows, 24).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard_rows(rows.repartition(7).orderBy(F.rand(1)), 24).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_odd_rows(spark, docs_of):
    rows = docs_of(ODD)
    got = shard_rows(rows, 3)
    assert got.columns == [c for c in rows.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert Counter((r["shard"], r.slot) for r in got.collect()) == Counter({(s, i): 1 for s in range(3) for i in range(3)} | {}) - Counter({(1, 2): 1, (2, 2): 1})
    assert shard_rows(docs_of([]), 3).collect() == []
