"""From ``documents`` to shards of a training mix: five stages, each one operator of ``blockloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last adds each row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import cut, table
from blockloom.llm.decontaminate import find_benchmark
from blockloom.llm.language import UNKNOWN, identify
from blockloom.llm.language import train as train_language
from blockloom.llm.mixing import mix, mixed
from blockloom.llm.near_dup import BROADCAST_NODES, near_duplicates
from blockloom.llm.sharding import shard_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIX_SHARDS, SHARDS = 16, 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those the corpus declares; ``lang`` becomes the language found.

    Rejected: documents without letters (null and empty texts among them) and such whose most probable class is none
    of the languages, or no class reaches one half. Repeated rows agree; equal classes go to the first by name. An
    empty table, and one that declares no language, gives an empty one; further columns are left out.
    """
    docs = docs.select(*COLUMNS)
    rows = identify(docs, train_language(docs), declared="lang")
    kept = rows.where((F.col("language") != UNKNOWN) & (F.col("confidence") >= 0.5))
    return kept.select("doc_id", "text", F.col("language").alias("lang"), "source", "n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Of wholly repeated rows one stays.

    The texts do not move unless the rows to drop are too many to broadcast. A null text is no copy of anything. An
    empty table gives an empty one; further columns are left out.
    """
    docs = docs.select(*COLUMNS)
    found = cut(near_duplicates(docs).select("doc", "node", "kept"))
    node = F.unhex(F.md5("text"))
    doubled = cut(found.where("kept").groupBy("doc", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "node"))
    gone = found.where(~F.col("kept")).select("doc", "node").distinct().unionByName(doubled)
    gone = cut(gone.select(F.col("doc").alias("_doc"), F.col("node").alias("_node")))
    small = F.broadcast if gone.count() <= BROADCAST_NODES else (lambda d: d)
    match = docs["doc_id"].eqNullSafe(F.col("_doc")) & node.eqNullSafe(F.col("_node"))
    kept = docs.join(small(gone), match, "left_anti")
    if doubled.take(1):
        again = doubled.select(F.col("doc").alias("_doc"), F.col("node").alias("_node"))
        kept = kept.unionByName(docs.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of the benchmark.

    Null and empty texts have no words and stay; repeated rows are judged each for itself. An empty table gives an
    empty one, an empty benchmark all rows; further columns are left out.
    """
    rows = find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return rows.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(*COLUMNS)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, shard by shard in shuffled order: a row for each time one is taken.

    Where the mix takes only a document's first words, it is cut short. Documents without words (null and empty texts)
    may be taken with none. Wholly equal rows are taken each for itself; ties do not arise. An empty table gives an
    empty one; further columns are left out.
    """
    rows = mixed(mix(docs.select(*COLUMNS), shards=MIX_SHARDS), MIX_SHARDS)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` (row counts at most one apart) and ``slot`` (without gaps).

    Nulls are values like others; rows with equal ids are told apart by their other columns, and wholly equal ones are
    interchangeable. An empty table gives an empty one; further columns are left out.
    """
    return shard_rows(docs.select(*COLUMNS), SHARDS)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mix", target_mix),
    ("shards", into_shards),
]
#: The samples of near-duplicate search, the FM-index and the hashes of mix and permutation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
