"""Reproducible shuffle into equal shards: a Feistel permutation with cycle walking over global row numbers.

Every row gets a number from 0 to N-1, the permutation moves the number, and shard and slot are its remainder and
quotient by the number of shards: counts differ by at most one, slots have no gaps, and where a row number goes
(``permuted``) or which number stands in a place (``original``) can be computed without the table.

The row number is the row's place by (hash bucket, key, hash of all columns). A bucket is chosen by all columns, so a
key that many rows share is spread; buckets hold some hundred rows however large the table is. Their offsets are sums
of sums, so no task numbers more than one bucket or one thousand bucket sizes. Only rows that are equal in every column
share a bucket whatever their number; they are sorted, which spills, and numbered as they stream by.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a bucket on average, and buckets in a group of buckets.
BUCKET_ROWS, GROUP_BUCKETS = 256, 1024
ROUNDS = 4


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def grid(n: int) -> tuple[int, int]:
    """Sides of the network's grid, both near sqrt(n), with as few cells past the ``n``-th as can be found.

    Among widths up to an eighth above the square root, the cells past the end are spread like remainders, so some
    width leaves about ten whatever ``n`` is.
    """
    root = max(1, math.isqrt(max(0, n - 1)) + 1)
    wide = np.arange(root, root + max(1, min(root // 8, 1 << 22)), dtype=np.int64)
    width = int(wide[np.argmin((-n) % wide)])
    return width, max(1, -(-n // width))


def _halves(x: Column, wide: int, high: int, seed: int, back: bool) -> Column:
    """One pass through the network, forwards or backwards."""
    width, height = F.lit(wide).cast("long"), F.lit(high).cast("long")
    right = F.pmod(x, height)
    sign = -1 if back else 1

    def mixed(salt: Column, of: Column, size: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), salt, of), size)

    def half(acc: Column, i: Column) -> Column:
        if back:
            r = F.pmod(acc["r"] + sign * mixed(i + 100, acc["l"], height), height)
            return F.struct(F.pmod(acc["l"] + sign * mixed(i, r, width), width).alias("l"), r.alias("r"))
        left = F.pmod(acc["l"] + sign * mixed(i, acc["r"], width), width)
        return F.struct(left.alias("l"), F.pmod(acc["r"] + sign * mixed(i + 100, left, height), height).alias("r"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(
        F.array(*[F.lit(i) for i in order]),
        F.struct(_div(x - right, high).alias("l"), right.alias("r")),
        half,
        lambda acc: acc["l"] * height + acc["r"],
    )


def _walked(number: Column, n: int, seed: int, back: bool) -> Column:
    wide, high = grid(n)
    # A number that meets cells past the end meets each at most once, so as many more passes always suffice.
    more = wide * high - n
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(more)),
        number,
        lambda acc, i: F.when((i > 0) & (acc < n), acc).otherwise(_halves(acc, wide, high, seed, back)),
    )


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` (0 to n-1) in a pseudo-random permutation of 0 to n-1.

    The Feistel network works on a grid of about sqrt(n) by sqrt(n) cells; a number that lands past the end is sent
    through again until it comes back.
    """
    return _walked(number, n, seed, back=False)


def original(place: Column, n: int, seed: int) -> Column:
    """The row number that ``permuted`` sends to ``place``: the network backwards."""
    return _walked(place, n, seed, back=True)


def shard_rows(rows: DataFrame, shards: int = 24, key: tuple[str, ...] = ("doc_id",), seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (from 0, without gaps in a shard).

    Law: row counts of shards differ by at most one. The same rows, in whatever order or files, get the same places;
    rows with equal keys are told apart by their other columns, and wholly equal rows are interchangeable. Nulls are
    values like others. An empty table gives an empty one. Columns named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    n = rows.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    names = [F.col(f"`{c}`") for c in rows.columns]
    keyed = rows.select(*names, F.xxhash64(*names).alias("_tie"))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key], "_tie"), F.lit(buckets)))
    group = _div(F.col("_bucket"), GROUP_BUCKETS)
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", group)
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_gn")).select("_group", F.coalesce(F.sum("_gn").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(groups, "_group").select("_bucket", (F.col("_at") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset"))
    place = Window.partitionBy("_bucket").orderBy(*[F.col(k) for k in key], "_tie")
    numbered = keyed.withColumn("_place", F.row_number().over(place) - 1).join(offsets, "_bucket")
    moved = permuted((F.col("_offset") + F.col("_place")).cast("long"), n, seed)
    out = numbered.withColumn("_moved", moved)
    return out.select(*names, F.pmod("_moved", F.lit(shards)).cast("int").alias("shard"), _div(F.col("_moved"), shards).alias("slot"))

