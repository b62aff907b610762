"""Ranked lexical search: the best documents of each query by saturated, length-normalised term weights.

A shard is some million words of whole documents; its index holds the postings of every term that a query has. Shards
are written as a table once; the counts over all documents (documents, words, documents of each term) are sums over it.
With those, each posting's share of a score is known. Dynamic programming cuts each posting list into blocks of varying
length so that the blocks' maxima overshoot the shares by as little as possible at a price for each block. A document's
bound is the sum of the maxima of the blocks that cover it. Documents are scored exactly in falling order of bounds;
those whose bound lies below the tenth best score are skipped, block by block, so the ranking is exact.

All scores are 64-bit integers, so shards agree to the last digit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from blockloom.llm.common import texts_of, written
from blockloom.llm.decontaminate import ids_of, words_of

#: Words of documents in a shard, and characters of queries that one pass over the documents serves.
SHARD_WORDS, BLOCK_CHARS = 2_000_000, 4_000_000
#: Postings in the longest block, and what a block costs, in mean overshoots of a posting under the list's maximum.
LONGEST, PRICE = 64, 4.0
#: Documents scored before the first threshold is known.
FIRST = 64

_SHARD = StructType(
    [StructField("doc_ids", ArrayType(LongType())), StructField("n_docs", LongType()), StructField("n_words", LongType())]
    + [StructField(c, ArrayType(IntegerType())) for c in ("terms", "df")]
    + [StructField(c, BinaryType()) for c in ("sizes", "docs", "tf")]
)


def postings(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Words of each text; then terms in order, how many postings each has, and the postings' documents and counts."""
    ids = [ids_of(t, vocabulary) for t in texts]
    sizes = np.array([len(i) for i in ids], np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    term = np.concatenate(ids) if ids else np.empty(0, np.int32)
    key = term.astype(np.int64)[term > 0] * len(ids) + doc[term > 0]
    key, tf = np.unique(key, return_counts=True)
    terms, df = np.unique(key // max(1, len(ids)), return_counts=True)
    return sizes, terms.astype(np.int32), df.astype(np.int32), (key % max(1, len(ids))).astype(np.int32), tf.astype(np.int32)


def cut_blocks(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For all lists at once, whether a block ends behind each value; ``starts`` bounds the lists, of which none is empty.

    A block costs its price and, for each value, what its maximum lies above it; the sum is smallest among all cuts
    into blocks of at most ``LONGEST``. Step i of the dynamic programme looks at value i of all lists that have one,
    and at the ``LONGEST`` places where its block may begin.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[:-1][order], lengths[order]
    values = values.astype(np.float32)
    n = len(order)
    price = np.ones(n, np.float32)
    if n:
        sums, tops = np.add.reduceat(values, starts[:-1]), np.maximum.reduceat(values, starts[:-1])
        price = np.maximum(1, PRICE * (tops - sums / lengths))[order].astype(np.float32)
    best = np.zeros(n, np.float32)
    base, top, over = np.full((n, LONGEST), np.inf, np.float32), np.zeros((n, LONGEST), np.float32), np.zeros((n, LONGEST), np.float32)
    back = np.zeros(len(values), np.int32)
    count = np.zeros(LONGEST, np.float32)
    active = n
    for i in range(int(length[0]) if n else 0):
        while length[active - 1] <= i:
            active -= 1
        slot, a = i % LONGEST, slice(0, active)
        base[a, slot], top[a, slot], over[a, slot], count[slot] = best[a], 0, 0, 0
        x = values[begin[a] + i][:, None]
        new = np.maximum(top[a], x)
        over[a] += (new - top[a]) * count + (new - x)
        top[a] = new
        count += 1
        total = base[a] + over[a]
        pick = total.argmin(axis=1)
        best[a] = total[np.arange(active), pick] + price[a]
        # Sums of one list only grow; taking off what all its open blocks share keeps them small enough for float32.
        low = best[a].copy()
        base[a] -= low[:, None]
        best[a] -= low
        back[begin[a] + i] = count[pick]
    ends = np.zeros(len(values), bool)
    at, left = begin + length - 1, np.ones(n, bool)
    while left.any():
        ends[at[left]] = True
        at = at - np.where(left, back[np.maximum(at, 0)], 0)
        left = left & (at >= begin)
    return ends


class Shard:
    """A shard's postings with their shares of scores and its blocks' maxima."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, tf: np.ndarray, n: int, words: int, weight: np.ndarray):
        self.size, self.terms = len(sizes), terms.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(df)))
        norm = 25 + (75 * sizes * n) // max(1, words)
        row = np.repeat(np.arange(len(terms)), df)
        tf = tf.astype(np.int64)
        self.share = weight[self.terms][row] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[docs]))
        self.key = np.concatenate((row * self.size + docs, [-1]))
        ends = cut_blocks(self.share, self.starts)
        last = np.flatnonzero(ends)
        first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
        most = np.maximum.reduceat(self.share, first) if len(last) else last
        opens = np.isin(first, self.starts[:-1])
        # The bound of a list steps to a block's maximum behind the block before it, and to 0 behind its last posting.
        where = np.where(opens, 0, np.concatenate(([0], docs[last[:-1]] + 1)) if len(last) else 0)
        step = most - np.where(opens, 0, np.concatenate(([0], most[:-1])) if len(last) else 0)
        block_row = row[last]
        close = np.searchsorted(block_row, np.arange(len(terms)), side="right") - 1
        every = np.concatenate((block_row, np.arange(len(terms))))
        sort = np.argsort(every, kind="stable")
        self.where = np.concatenate((where, docs[last[close]] + 1 if len(last) else close))[sort]
        self.step = np.concatenate((step, -most[close] if len(last) else close))[sort].astype(np.float64)
        self.steps = np.searchsorted(every[sort], np.arange(len(terms) + 1))

    def bounds(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """No document's score is above its bound: the maxima of the blocks that cover it. Whole numbers below 2^53."""
        parts = [slice(self.steps[r], self.steps[r + 1]) for r in rows]
        where = np.concatenate([self.where[p] for p in parts])
        step = np.concatenate([self.step[p] * t for p, t in zip(parts, times, strict=True)])
        return np.cumsum(np.bincount(where, step, self.size + 1))[: self.size]

    def scores(self, rows: np.ndarray, times: np.ndarray, docs: np.ndarray) -> np.ndarray:
        key = (rows[:, None] * self.size + docs[None, :]).ravel()
        at = np.searchsorted(self.key[:-1], key)
        found = np.where(self.key[at] == key, self.share[np.minimum(at, len(self.share) - 1)], 0)
        return times @ found.reshape(len(rows), len(docs))

    def best(self, query: list[tuple[int, int]], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Document and score of the ``k`` best, equal scores by ``ids``."""
        at = np.searchsorted(self.terms, [t for t, _ in query])
        held = [i for i, (t, _) in zip(at.tolist(), query, strict=True) if i < len(self.terms) and self.terms[i] == t]
        if not held:
            return []
        times = np.array([c for i, (t, c) in zip(at.tolist(), query, strict=True) if i < len(self.terms) and self.terms[i] == t], np.int64)
        rows = np.array(held, np.int64)
        bound = self.bounds(rows, times)
        docs = np.empty(0, np.int64)
        score = np.empty(0, np.int64)
        threshold, todo = 1, np.flatnonzero(bound >= 1)
        todo, take = todo[np.argsort(-bound[todo], kind="stable")], FIRST
        while len(todo):
            now, todo = todo[:take], todo[take:]
            docs, score = np.concatenate((docs, now)), np.concatenate((score, self.scores(rows, times, now)))
            chosen = np.lexsort((ids[docs], -score))[:k]
            docs, score = docs[chosen], score[chosen]
            if len(score) == k:
                threshold = max(1, int(score[-1]))
            todo = todo[: np.searchsorted(-bound[todo], -threshold, side="right")]
            take *= 2
        return [(d, s) for d, s in zip(docs.tolist(), score.tolist(), strict=True) if s > 0]


def _index(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs``, one row each, written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str | None] = []
        volume = 0

        def shard() -> pa.RecordBatch:
            sizes, terms, df, at, tf = postings(texts, shared.value)
            row = [ids, int((sizes > 0).sum()), int(sizes.sum()), terms, df, sizes.tobytes(), at.tobytes(), tf.tobytes()]
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], _SHARD.names)

        for b in texts_of(batches):
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            volume += b.column(1).nbytes // 6
            if volume >= SHARD_WORDS:
                yield shard()
                ids, texts, volume = [], [], 0
        if ids:
            yield shard()

    return written(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, _SHARD))


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search(shards: DataFrame, queries: list[list[tuple[int, int]]], n: int, words: int, weight: np.ndarray, k: int) -> DataFrame:
    shared = shards.sparkSession.sparkContext.broadcast((queries, weight))
    schema = StructType([StructField("query", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries_, weight_ = shared.value
        for b in texts_of(batches, 1):
            column = {name: b.column(name)[0] for name in b.schema.names}
            ids = column["doc_ids"].as_py()
            plain = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
            terms, df = (column[c].values.to_numpy() for c in ("terms", "df"))
            sizes, docs, tf = (np.frombuffer(column[c].as_py(), t) for c, t in (("sizes", np.int64), ("docs", np.int32), ("tf", np.int32)))
            if not len(terms):
                continue
            shard = Shard(sizes, terms, df, docs, tf, n, words, weight_)
            found = [(q, ids[d], s) for q, query in enumerate(queries_) for d, s in shard.best(query, plain, k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], schema.names)

    return shards.select("doc_ids", "terms", "df", "sizes", "docs", "tf").mapInArrow(run, schema)


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id", doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 for each row of ``queries``.

    Terms, weights and scores are those of the contract: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its
    share of a document's score the weight times (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, times its
    occurrences in the query. Equal scores go to the smaller document id, nulls first. Every row of ``docs`` is a
    document, repeated ones too; every row of ``queries`` is a query, whose ranks count from 1. Null and empty texts
    have no terms: such a document is never found, such a query finds nothing, as in an empty table. Texts of any length
    are read whole, and other columns are not read. Document ids are whole numbers.

    Past ``block_chars`` characters, queries are answered block by block, with a pass over the documents each. What is
    broadcast is a block of queries with its vocabulary.
    """
    spark = docs.sparkSession
    rows = queries.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    parts = []
    for block in range(blocks):
        held = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)).collect()
        vocabulary: dict[bytes, int] = {}
        asked = [sorted(Counter(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(r.text)).items()) for r in held]
        shards = _index(docs, doc_id, text, vocabulary)
        n, words = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
        weight = np.zeros(len(vocabulary) + 1, np.int64)
        for r in shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():
            weight[r.terms] = weight_of(n, r.df)
        found = _search(shards, asked, n or 0, words or 0, weight, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(held)], StructType([StructField("query", IntegerType()), StructField(item, queries.schema[item].dataType)]))
        parts.append(found.join(F.broadcast(names), "query").select(F.col(f"`{item}`"), "rank", F.col("doc_id").alias(doc_id), "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_sql(k: int = 10) -> str:
    """The ranking in DuckDB's SQL over ``documents`` and ``benchmark``, term by term and without an index."""
    upper = "".join(map(chr, range(65, 91)))

    def terms(table: str) -> str:
        found = r"regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
        return f"SELECT r, id, translate(w, '{upper}', '{upper.lower()}') AS w, count(*) AS tf FROM (SELECT r, id, unnest({found}) AS w FROM {table}) GROUP BY ALL"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, text FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id AS id, text FROM benchmark),
p AS ({terms("d")}), q AS ({terms("b")}),
l AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT q.r AS query, q.id AS item_id, p.r AS r, p.id AS doc_id,
  CAST(sum(q.tf * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN p USING (w) JOIN f USING (w) JOIN l ON l.r = p.r CROSS JOIN a GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
