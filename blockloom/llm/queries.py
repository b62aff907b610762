"""The driver's ``opN_`` queries: each reads its whole table, calls its operator and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import table
from blockloom.llm.conversations import repair
from blockloom.llm.decontaminate import find_benchmark
from blockloom.llm.embedding_dup import near_vectors
from blockloom.llm.language import identify, train
from blockloom.llm.lexical_search import search_sql, top_documents
from blockloom.llm.licences import licence_sql, licences
from blockloom.llm.mixing import mix
from blockloom.llm.near_dup import near_duplicates
from blockloom.llm.pii import KINDS, personal_data
from blockloom.llm.pii import train as train_pii
from blockloom.llm.sharding import shard_rows
from blockloom.llm.substring_dup import repeats_sql, without_repeats
from blockloom.llm.token_count import token_counts
from blockloom.llm.toxicity import fit, fold, toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "component_id", "kept")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each shard's draws; ``shards`` lists them as shard:words, in order."""
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    drawn = F.array_sort(F.transform("copies", lambda c: F.struct(c["shard"].alias("shard"), c["words"].alias("words"))))
    taken = F.aggregate(drawn, F.lit(0).cast("long"), lambda a, c: a + c["words"])
    listed = F.array_join(F.transform(drawn, lambda c: F.concat_ws(":", c["shard"], c["words"])), ",")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), listed.alias("shards"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["key"], e["label"], F.format_number(e["cosine"], 3))), ",")
    return rows.select(F.col("key").alias("doc_id"), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), evidence.alias("evidence"))


def op7_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = personal_data(docs, train_pii(docs))
    counts = [F.coalesce(F.regexp_count("base", F.lit(f"{k}:")), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(F.col("key").alias("doc_id"), *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    rows = identify(table(spark, sf_dir, "pages"), model, text="html", address="url", markup=True)
    return rows.select("page_id", "host", "language", "confidence")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's damage; ``times`` is 0 for a row that it drops, 2 for one that it repeats."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *known)) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    role = F.when(kind == 4, "user").otherwise(role)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), times=F.col("times"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_toxicity_neighbours": op6_toxicity_neighbours,
    "op7_licence_rules": op7_licence_rules,
    "op8_personal_data": op8_personal_data,
    "op9_language_fusion": op9_language_fusion,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {"op7_licence_rules": licence_sql(), "op12_lexical_search": search_sql(), "op13_substring_dedup": repeats_sql()}
