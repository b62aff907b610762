"""Mixing sources to target weights, by a splitting tree of multivariate hypergeometric draws.

Each source is cut into blocks of documents. Its target, in words, fixes exactly how many block copies the mix takes
from it: whole passes over the source, then as many blocks in permuted order as the rest needs, the last one in part.
A binary tree over the output shards then splits these counts: at every node the left half's share of each source is
drawn from the multivariate hypergeometric law (one univariate draw after the other, by its inverse distribution
function), so every shard gets an exact quota from every source and the shards together take every copy once. A
shard draws its quota as the next disjoint range of the source's permuted block copies, and orders its documents by a
hash of its own.

Everything is hashes and counts, so reruns agree. Tables of blocks hold at most ``MOST_BLOCKS`` rows besides one for
each source, whatever the input: with more documents the blocks grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import cut, let

#: What counts as a word of a text.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_ROWS, MOST_BLOCKS = 96, 1 << 20
#: Sources up to this many are joined by broadcast (some 100 bytes each); more by a shuffle that splits hot keys.
BROADCAST_SOURCES = 50_000
#: Sources that a row of the splitting tree holds.
GROUP_SOURCES = 1024


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` over the whole table: ranges are sorted each by itself and begin
    where the sizes of those before end, so no task holds more than a range."""
    ranged = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(order)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_range", "_start")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, source_rows, target, nr`` from ``source, source_size, source_rows`` (one row a source).

    Targets share ``share`` times all words by weight, in code point order of the sources (null last), and stop at
    ``most`` times the source's words; what is cut off goes to the others by weight until none is above. The level
    (words a unit of weight) rises with every source found full, in sums over the table, until none is found any more.
    """
    ordered = numbered(sizes, F.col("source").asc_nulls_last(), "nr")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nr"), F.lit(len(weights))).cast("int") + 1)
    capped = cut(ordered.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    level, full = 0.0, -1
    while True:
        filled = F.col("_cap") <= F.col("_w") * F.lit(level)
        total, caps, left, n = capped.agg(F.sum("source_size"), F.sum(F.when(filled, F.col("_cap")).otherwise(0.0)), F.sum(F.when(filled, 0.0).otherwise(F.col("_w"))), F.count_if(filled)).first()
        if n == full or not left:
            break
        level, full = max(level, (total * share - caps) / left), n
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level)) if left else F.col("_cap")
    return capped.select("source", "source_size", "source_rows", target.alias("target"), "nr")


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` items, out of ``population`` with ``marked`` ones, are marked: the quantile of ``uniform``.

    Values further than 12 standard deviations from the mean have less weight than a double can tell and are left out.
    """
    number = lambda c: c.cast("double")
    share = number(marked) / F.greatest(number(population), F.lit(1.0))
    spread = F.sqrt(F.greatest(number(drawn) * share * (1 - share) * (number(population) - drawn) / F.greatest(number(population) - 1, F.lit(1.0)), F.lit(0.0)))
    mean = number(drawn) * share
    low = F.greatest(F.lit(0).cast("long"), drawn - (population - marked), F.floor(mean - 12 * spread - 2).cast("long"))
    high = F.least(drawn, marked, F.ceil(mean + 12 * spread + 2).cast("long"))

    def found(s: Column) -> Column:
        m, d, p = s["m"], s["d"], s["p"]

        def step(k: Column) -> Column:  # log of the weight of k over that of k - 1
            return F.log(number((m - k + 1) * (d - k + 1))) - F.log(number(k * (p - m - d + k)))

        after = F.when(s["hi"] > s["lo"], F.sequence(s["lo"] + 1, s["hi"])).otherwise(F.expr("array()").cast("array<bigint>"))
        peak = F.aggregate(after, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("top")), lambda a, k: let(a["x"] + step(k), lambda x: F.struct(x.alias("x"), F.greatest(a["top"], x).alias("top"))), lambda a: a["top"])

        def pick(top: Column) -> Column:
            total = F.aggregate(after, F.struct(F.lit(0.0).alias("x"), F.exp(-top).alias("sum")), lambda a, k: let(a["x"] + step(k), lambda x: F.struct(x.alias("x"), (a["sum"] + F.exp(x - top)).alias("sum"))), lambda a: a["sum"])

            def search(limit: Column) -> Column:
                start = F.struct(F.lit(0.0).alias("x"), F.exp(-top).alias("sum"), s["lo"].alias("k"))
                return F.aggregate(
                    after,
                    start,
                    lambda a, k: F.when(a["sum"] >= limit, a).otherwise(let(a["x"] + step(k), lambda x: F.struct(x.alias("x"), (a["sum"] + F.exp(x - top)).alias("sum"), k.alias("k")))),
                    lambda a: a["k"],
                )

            return let(total * uniform, search)

        return let(peak, pick)

    return let(F.struct(population.alias("p"), marked.alias("m"), drawn.alias("d"), low.alias("lo"), F.greatest(low, high).alias("hi")), found)


def _uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))


ITEM = "struct<nr:bigint,q:bigint>"


def _sum(items: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["q"])


def _left_share(seed: int) -> Column:
    """What the left half of a node takes of each of its items ``qs``: ``_want`` in all, drawn without replacement."""

    def draw(acc: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["nr"])
        return let(
            hypergeometric(acc["pop"], x["q"], acc["want"], u),
            lambda k: F.struct((acc["pop"] - x["q"]).alias("pop"), (acc["want"] - k).alias("want"), F.concat(acc["out"], F.array(F.struct(x["nr"].alias("nr"), k.alias("q")).cast(ITEM))).alias("out")),
        )

    start = F.struct(_sum("qs").alias("pop"), F.col("_want").alias("want"), F.expr("array()").cast(f"array<{ITEM}>").alias("out"))
    return F.aggregate("qs", start, draw, lambda a: a["out"])


def _halved(node: DataFrame, keep: list[str]) -> DataFrame:
    """The two halves of each node with ``_left`` (a node of one shard stays as it is)."""
    rest = F.zip_with("qs", "_left", lambda a, b: F.struct(a["nr"].alias("nr"), (a["q"] - b["q"]).alias("q")).cast(ITEM))
    halves = F.array(F.struct("lo", F.col("_mid").alias("hi"), F.col("_left").alias("qs")), F.struct(F.col("_mid").alias("lo"), "hi", rest.alias("qs")))
    pair = F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(F.array(F.struct("lo", "hi", "qs")))
    return node.select(*keep, F.explode(pair).alias("n")).select(*keep, "n.lo", "n.hi", "n.qs")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``nr, bounds``: for each source, where each shard's range of its ``quota`` block copies ends.

    ``quotas`` has ``nr, quota``. The tree halves the range of shards until each node is one shard. Sources stand in
    groups of ``GROUP_SOURCES``: at every node the left half's share is first drawn for each group, then within each
    group for its sources, which is the same law as one draw after the other, and keeps rows of bounded length.
    """
    item = F.struct(F.col("nr").cast("long").alias("nr"), F.col("quota").cast("long").alias("q"))
    listed = F.array_sort(F.collect_list(item)).cast(f"array<{ITEM}>")
    grouped = quotas.groupBy(F.call_function("div", F.col("nr"), F.lit(GROUP_SOURCES)).alias("g")).agg(listed.alias("qs"))
    node = cut(grouped.select("g", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "qs"))
    several = node.count() > 1
    top = node.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("nr"), _sum("qs").alias("q")))).cast(f"array<{ITEM}>").alias("qs")) if several else None
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    even = F.round(_sum("qs") * (F.col("_mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
    while shards > 1:
        node = node.withColumn("_mid", middle)
        if several:
            top = cut(top.withColumn("_mid", middle).withColumn("_want", even).withColumn("_left", _left_share(seed + 1)))
            wants = top.select("lo", "hi", F.explode("_left").alias("x")).select("lo", "hi", F.col("x.nr").alias("g"), F.col("x.q").alias("_want"))
            node, top = node.join(wants, ["lo", "hi", "g"]), _halved(top, [])
        else:
            node = node.withColumn("_want", even)
        node = cut(_halved(node.withColumn("_left", _left_share(seed)), ["g"]))
        shards = -(-shards // 2)
    flat = node.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select("shard", "x.nr", "x.q")
    by_shard = flat.groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("s"))
    running = F.aggregate("s", F.expr("array()").cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x["q"])))
    return by_shard.select("nr", running.alias("bounds"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = 11, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size, source_size, target`` and ``copies``, what the mix takes of each row.

    ``copies`` is an array of ``pass, shard, words, place``: in each pass over the source the row is taken at most
    once, with its first ``words`` words (all of them but for one row of a source in its last pass); ``place`` orders
    the rows of a shard. The words taken of a source are its target rounded. A null text has no words and a null source
    is a source; rows without words may be taken, with 0 words. Equal rows are taken each for itself. Columns of the
    four names are replaced. An empty table gives an empty one. Hot sources and keys are cut into blocks, so no task
    holds one; only rows equal in every column share a block.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # A row's block and place go by all its columns, so a key that many rows share is spread.
    tie = F.xxhash64(*names)
    sized = docs.select(*names, words_in(F.col(text)).alias("size"), tie.alias("_tie"))
    rows = docs.select(F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = cut(source_targets(cut(stats), share, most, weights))
    total, n_sources = targets.agg(F.sum("source_rows"), F.count(F.lit(1))).first()
    block_rows = max(BLOCK_ROWS, -(-(total or 0) // MOST_BLOCKS))
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda d: d)

    quota = F.least(F.round("target").cast("long"), (F.col("source_size") * F.lit(most)).cast("long"))
    plan = targets.withColumn("_quota", quota).withColumn("_passes", F.when(F.col("source_size") > 0, F.call_function("div", F.col("_quota"), F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("_quota") - F.col("_passes") * F.col("source_size")).withColumn("_blocks", F.ceil(F.col("source_rows") / F.lit(block_rows)))
    side = small(plan.select(F.col("source").alias("_source"), "nr", "source_size", "target", "_blocks"))
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("nr"), F.col("_tie")), F.col("_blocks"))
    placed = sized.join(side, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_block", block)

    # The words of each block need no texts; then the copies that the mix takes, by block.
    light = docs.select(F.col(source).alias("source"), tie.alias("_tie"), words_in(F.col(text)).alias("size"))
    light = light.join(side, F.col("source").eqNullSafe(F.col("_source"))).select("nr", "size", block.alias("_block"))
    blocks = cut(light.groupBy("nr", "_block").agg(F.sum("size").alias("_words")))
    first = Window.partitionBy("nr").orderBy(F.xxhash64(F.lit(seed + 1), "nr", "_block"), "_block")
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_words").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drawn = blocks.join(small(plan.select("nr", "_passes", "_rest")), "nr")
    passes = F.concat(
        F.transform(F.when(F.col("_passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)).otherwise(F.expr("array()").cast("array<bigint>")), lambda p: F.struct(p.cast("int").alias("pass"), F.col("_words").alias("words"))),
        F.when(F.col("_before") < F.col("_rest"), F.array(F.struct(F.col("_passes").cast("int").alias("pass"), F.least(F.col("_words"), F.col("_rest") - F.col("_before")).alias("words")))).otherwise(F.expr("array()").cast("array<struct<pass:int,words:bigint>>")),
    )
    drawn = drawn.select("nr", "_block", "_words", F.explode(passes).alias("p")).select("nr", "_block", "_words", "p.pass", "p.words")
    again = Window.partitionBy("nr").orderBy(F.xxhash64(F.lit(seed + 2), "nr", "_block", "pass"), "_block", "pass")
    drawn = cut(drawn.withColumn("_place", F.row_number().over(again) - 1))
    bounds = split_quotas(drawn.groupBy("nr").agg(F.count(F.lit(1)).alias("quota")), shards, seed + 3)
    shard = F.size(F.filter("bounds", lambda b: b <= F.col("_place")))
    dealt = drawn.join(small(bounds), "nr").select("nr", "_block", F.struct("pass", shard.alias("shard"), "words", F.col("_words").alias("of")).alias("t"))
    dealt = dealt.groupBy("nr", "_block").agg(F.array_sort(F.collect_list("t")).alias("_taken"))

    inside = Window.partitionBy("nr", "_block").orderBy(F.xxhash64(F.lit(seed + 4), "_tie"), "_tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(dealt, ["nr", "_block"], "left").withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def copy(t: Column) -> Column:
        taken = F.when(t["words"] >= t["of"], F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), t["words"] - F.col("_before"))))
        return F.struct(t["pass"].alias("pass"), t["shard"].alias("shard"), taken.alias("words"), F.xxhash64(F.lit(seed + 5), t["shard"], t["pass"], F.col("_tie")).alias("place"))

    copies = F.filter(F.transform(F.coalesce("_taken", F.expr("array()").cast("array<struct<pass:int,shard:int,words:bigint,of:bigint>>")), copy), lambda c: (c["words"] > 0) | (F.col("size") == 0))
    return joined.select(*names, "size", "source_size", "target", copies.alias("copies"))


def mixed(rows: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """The documents of the mix from ``mix``'s rows: one row a copy, with ``pass, shard, place`` (columns of
    these names are replaced) and its words only.

    Partitions follow the shards and, within a shard, the places, in order: each shard is a run of partitions that
    cover equal ranges of its hashed places, so writing the rows writes the mix shard by shard, shuffled.
    """
    each = rows.withColumn("_c", F.explode("copies"))
    shortened = F.when(F.col("_c.words") >= F.col("size"), F.col(text)).otherwise(first_words(F.col(text), F.col("_c.words")))
    names = [c for c in rows.columns if c not in ("copies", "size", "source_size", "target", "pass", "shard", "place")]
    each = each.withColumn("_short", shortened)
    each = each.select(*[F.col("_short").alias(c) if c == text else F.col(f"`{c}`") for c in names], "_c.pass", "_c.shard", "_c.place")
    parts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    # The place's upper 32 bits, from 0, tell its range.
    part = F.call_function("div", (F.shiftright("place", 32) + F.lit(1 << 31)) * F.lit(parts).cast("long"), F.lit(1 << 32))
    return each.repartitionById(shards * parts, (F.col("shard") * parts + part).cast("int")).sortWithinPartitions("place")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.when(n > 0, F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1)).cast("int")), "")).otherwise(F.lit(""))
