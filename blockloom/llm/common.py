"""What several operators share: tables, checkpoints, hashing in numpy, bounded samples, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary folder and a cluster is
    refused, as its machines would not share one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that a lost executor costs no recomputation."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder. Unlike a checkpoint it forgets the size Spark expected of ``df``,
    which in a loop of joins is a product that grows by a power in every round."""
    path = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def texts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same batches in pieces of at most ``rows`` rows, so that long texts do not pile up in Python.

    Spark bounds the batches themselves by their bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def level_of(hash_: Column) -> Column:
    """How small a 64-bit hash is: eight levels for each halving, so few levels tell small samples from large ones."""
    part = (F.shiftrightunsigned(hash_, 11).cast("double") + 0.5) / F.lit(2.0**53)
    return F.floor(-8 * F.log2(part)).cast("int")


def sample_ids(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows of ``df`` whose hashed key is among the smallest: a reproducible sample of nearly ``most`` keys at most.

    Only counts by level of the hash are put together, some hundred rows whatever the table is. Rows of equal keys
    stand or fall together, so hashes are made distinct first.
    """
    rank = F.xxhash64(key, F.lit(20260101))
    counts = df.select(rank.alias("h")).distinct().groupBy(level_of(F.col("h")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, low = 0, 1 << 20
    for level, n in sorted(((r.level, r.n) for r in counts), reverse=True):
        total += n
        if total > most:
            break
        low = level
    return df.where(level_of(rank) >= low)


#: Rows of a table with one row a key up to which it is broadcast, and the share of all rows that makes a key hot.
BROADCAST_KEYS, HOT = 100_000, 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each of ``keys`` and says in ``weight`` how many rows have it.

    A short table is broadcast. Of a long one, keys that more than one in ``HOT`` rows have (fewer than ``HOT`` keys)
    are broadcast and their rows are spread by ``salt``, so no task of the shuffle gets more of one key. ``how`` is
    ``inner`` or ``left``; ``weight`` is dropped. The table is read three times, so it should be a written one.
    """
    n, total = table.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table.drop(weight)), keys, how)
    names = [c for c in table.columns if c not in (*keys, weight)]
    is_hot = F.col(weight) * HOT > F.lit(total)
    hot = table.where(is_hot).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    rest = table.where(~is_hot).select(*keys, F.lit(-1).cast("long").alias("_salt"), F.lit(True).alias("_cold"), *names)
    marked = rows.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt, F.lit(100_003))).otherwise(F.lit(-1)).cast("long"))
    joined = marked.join(rest, [*keys, "_salt"], "left")
    if how == "inner":
        joined = joined.where(F.col("_hot") | F.col("_cold"))
    for c in names:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_hot_{c}"), F.col(c))).drop(f"_hot_{c}")
    return joined.drop("_salt", "_hot", "_cold")


#: Edges up to which a table of minima is broadcast (some 50 bytes each), and edges in a partition of such a graph.
BROADCAST_EDGES, PART_EDGES = 300_000, 50_000


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the undirected ``edges (a, b)``; ``comp`` is the smallest node of its component.

    Alternating large-star and small-star steps: every step is two aggregations and two joins on the node, whose
    partial minima are taken before the shuffle; the links of a node that has very many are spread over tasks. The
    steps halve path lengths, so few are needed; each is written. While the edges are few (they are counted in
    every round), the minima are broadcast and the edges kept in few partitions; more are joined by shuffles.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(state)
    while True:
        n = seen[0]
        few = n <= BROADCAST_EDGES

        def beside_minima(rows: DataFrame, of: DataFrame, few: bool = few) -> DataFrame:
            """``rows`` with ``m``, the smallest ``b`` that their ``a`` has in ``of``."""
            low = of.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
            return rows.join(F.broadcast(low.drop("n")), "a") if few else spread_join(rows, written(low), ["a"], "n", F.xxhash64("b"))

        if few:
            state = state.coalesce(-(-max(n, 1) // PART_EDGES))
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = beside_minima(both.where(F.col("b") > F.col("a")), both)
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where(F.col("a") > F.col("b"))
        small = beside_minima(large, large).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = small.unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        state = written(state.coalesce(-(-max(n, 1) // PART_EDGES)) if few else state)
        now = _mark(state)
        if now == seen:
            break
        seen = now
    member = state.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return member.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
