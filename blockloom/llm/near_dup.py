"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a weighted set of its five-word shingles; a shingle weighs (1 + log of its count) times the mean inverse
document frequency of its words. (Plain counts would let one line repeated hundreds of times make documents alike, and
frequencies of the shingles themselves would make a large group of near copies lower its own weights and so hide the
shared part behind the few changed shingles.) Word frequencies are counted over all documents in a fixed number of
hash buckets, so the table of weights has one size whatever the corpus.

Each of ``ROWS * BANDS`` consistent weighted samples of two sets agrees with the probability of their weighted
Jaccard similarity. Documents that agree in all samples of a band share a bucket. A bucket is not expanded into pairs:

1. every member is held against the bucket's pivot, the member that has most company in all its buckets and so
   stands in the middle of its near copies (of its pivots in all bands, the two likeliest); pairs at the threshold
   are links;
2. links are joined into components, and only members of a bucket that ended in different components are left;
3. of those, members that do not match the pivot are compared by their samples, block against block, with the rest of
   the bucket, unless the triangle inequality of the Jaccard distance rules a link out. The few likeliest partners of
   each go on to verification; of buckets that are still in several components after that, all partners do, within
   the tasks that compare blocks.

Every pair that is held against each other first passes a comparison of samples (a pair at the threshold fails it with
a chance of about one in ten thousand) and is then verified by the exact weighted Jaccard similarity of whole texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import U64, components, cut, mix64, spread_join, texts_of
from blockloom.llm.decontaminate import words_of

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 16
SAMPLES = ROWS * BANDS
BUCKETS_BITS = 16
#: Sample agreement from which a pair is verified, and below which it is taken to be far from the pivot. A pair at the
#: threshold is four deviations above the first, and the farthest a linked pair's third text can be (a similarity of
#: 0.6, by the triangle inequality) more than four above the second: either errs with a chance of 0.00003 at most.
VERIFY_FROM, NEAR_FROM = 0.6, 0.34
#: Pivots of a member verified at first, partners tried next; members and bytes of shingles in a block; rows and bytes in
#: a task of small buckets; pairs of one pivot in a task.
FIRST_PIVOTS, PARTNERS, BLOCK, BLOCK_BYTES, TASK_ROWS, TASK_BYTES, PIVOT_PAIRS = 2, 4, 2048, 64 << 20, 1500, 32 << 20, 1000
#: Bytes of a shingle with its weight.
SHINGLE_BYTES = 12
#: Nodes up to which their ids are broadcast (16 bytes each).
BROADCAST_NODES = 400_000
LEVELS = 2048


def _gamma_levels() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``LEVELS`` equal parts, by bisection."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    low, high = np.zeros(LEVELS), np.full(LEVELS, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_R = _gamma_levels().astype(np.float32)
_INV_R, _LN_C = (1 / _R).astype(np.float32), np.log(_R).astype(np.float32)
_SEEDS = (mix64(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
_PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=U64) * U64(0xA0761D6478BD642F))


class Words:
    """Hashes of words, kept for the words met so far; the store starts anew past a bound."""

    def __init__(self, most: int = 500_000):
        self.most, self.number, self.hashes = most, {}, np.empty(1 << 12, U64)

    def hash(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        if len(number) > self.most:
            number.clear()
        for w in {w for w in words if w not in number}:
            if len(number) == len(self.hashes):
                self.hashes = np.concatenate((self.hashes, np.empty(len(self.hashes), U64)))
            self.hashes[len(number)] = xxhash.xxh3_64_intdigest(w)
            number[w] = len(number)
        return self.hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]


def shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted) of a text's word hashes, with their weights. Fewer words than five are one shingle."""
    n = len(hashes)
    if not n:
        return np.empty(0, U64), np.empty(0)
    weight = idf[(hashes >> U64(64 - BUCKETS_BITS)).astype(np.int64)]
    width = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        key = np.zeros(n - width + 1, U64)
        for j in range(width):
            key += hashes[j : n - width + 1 + j] * _PLACES[j]
    total = np.concatenate(([0.0], np.cumsum(weight)))
    mean = (total[width:] - total[:-width]) / width
    found, first, count = np.unique(mix64(key), return_index=True, return_counts=True)
    # The weight depends on the shingle's words only; rounding makes it the same wherever the shingle stands.
    return found, (1 + np.log(count)) * np.round(mean[first], 6)


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent weighted samples, each a 64-bit fingerprint of a shingle and its level.

    A shingle's draws for a seed are the parts of one 32-bit hash: eleven bits each choose the two Gamma(2, 1)
    variables among their quantiles, ten are the uniform one.
    """
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, U64)
    columns = np.arange(SAMPLES)
    key, log_w = (found >> U64(20)).astype(np.uint32), np.log(weights).astype(np.float32)
    for at in range(0, len(found), 2048):
        part = slice(at, at + 2048)
        with np.errstate(over="ignore"):
            x = (key[part, None] ^ _SEEDS[None, :]) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
        level = x & np.uint32(LEVELS - 1)
        r = _R[level]
        beta = (x >> np.uint32(22)).astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(2.0**-10)
        t = log_w[part, None] * _INV_R[level]
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        beta += _LN_C[(x >> np.uint32(11)) & np.uint32(LEVELS - 1)]
        low = beta.argmin(0)
        value, t = beta[low, columns], t[low, columns]
        better = value < best
        best[better] = value[better]
        with np.errstate(over="ignore"):
            out[better] = mix64(found[part][low[better]] ^ (t[better].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return out


def bands(fingerprints: np.ndarray) -> np.ndarray:
    grid = fingerprints.reshape(BANDS, ROWS)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix64(key ^ grid[:, j])
    return key.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole > 0 else 0.0


def _node(text: Column) -> Column:
    """A text's identity: 16 bytes, equal for exact copies only (up to the collisions of MD5)."""
    return F.unhex(F.md5(text))


def word_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Smoothed inverse document frequency of each hash bucket of words, counted over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts, n = Words(), np.zeros(1 << BUCKETS_BITS, np.int64), 0
        for batch in texts_of(batches):
            for t in batch.column(0).to_pylist():
                n += 1
                if words := words_of(t):
                    counts[np.unique(store.hash(list(set(words))) >> U64(64 - BUCKETS_BITS)).astype(np.int64)] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(counts[there], n), pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n, df = 0, np.zeros(1 << BUCKETS_BITS)
    for bucket, count in counted:
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return 1 + np.log((1 + n) / (1 + df))


def _signatures(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, weights = Words(), idf.value
        lately: OrderedDict[bytes, tuple] = OrderedDict()
        for batch in texts_of(batches):
            sigs, keys, sizes = [], [], []
            for node, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node not in lately:
                    found, w = shingles(store.hash(words_of(t)), weights)
                    prints = samples(found, w) if len(found) else None
                    lately[node] = (prints.astype(np.uint16).tobytes(), bands(prints), len(found)) if prints is not None else (None, None, 0)
                    if len(lately) > 512:
                        lately.popitem(last=False)
                sig, band, size = lately[node]
                sigs.append(sig)
                keys.append(band)
                sizes.append(size * SHINGLE_BYTES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc", "node", "sig", "bands", "size"])

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("doc"), _node(F.col(text)).alias("node"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc {kind}, node binary, sig binary, bands array<long>, size long")


def _beside(pairs: DataFrame, table: DataFrame, column: str, **names: str) -> DataFrame:
    """``pairs (a, b)`` with columns of ``table`` for the node in ``column``, under the names given.

    A node of more than ``PIVOT_PAIRS`` pairs (or of one in 50,000 of all, if that is more) stands in the table several
    times, and its pairs are dealt to these, so no task gets all pairs of a pivot. ``pairs`` should be a written table.
    """
    most = max(PIVOT_PAIRS, pairs.count() // 50_000)
    heavy = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    # At most 50,000 nodes, of 16 bytes.
    heavy = F.broadcast(cut(heavy.select(column, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(heavy, column, "left").withColumn("_part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("_parts")
    wanted = table.select(F.col("node").alias(column), *[F.col(c).alias(n) for c, n in names.items()])
    copies = wanted.join(heavy, column, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [column, "_part"]).drop("_part")


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with ``est``, the share of samples in which they agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SAMPLES) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(1), pa.float64())], ["a", "b", "est"])

    both = _beside(pairs, sigs, "b", sig="_sb").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("_sa")), "a")
    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a binary, b binary, est double")


def _texts(needed: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``node, t``: the texts of the nodes in ``needed``. Only they leave the scan while the list is short."""
    needed = cut(needed.distinct())
    few = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed
    whole = docs.select(_node(F.col(text)).alias("node"), F.col(text).alias("t")).join(few, "node", "left_semi")
    return cut(whole.groupBy("node").agg(F.first("t").alias("t")))


def _vectors(nodes: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """``node, keys, weights`` (raw arrays): the shingle sets of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, weights = Words(), idf.value
        for batch in texts_of(batches):
            sets = [shingles(store.hash(words_of(t)), weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.tobytes() for k, _ in sets], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in sets], pa.binary())], ["node", "keys", "weights"])

    return texts.join(nodes, "node", "left_semi").select("node", "t").mapInArrow(run, "node binary, keys binary, weights binary")


def _links(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, weights = Words(), idf.value
        lately: OrderedDict[bytes, tuple] = OrderedDict()

        def vector(node: bytes, t: str) -> tuple:
            if node not in lately:
                lately[node] = shingles(store.hash(words_of(t)), weights)
                if len(lately) > 64:
                    lately.popitem(last=False)
            lately.move_to_end(node)
            return lately[node]

        for batch in texts_of(batches):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            near = [similarity(vector(b[i], tb[i]), vector(a[i], ta[i])) >= threshold for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = _beside(pairs, texts, "b", t="_tb")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("t").alias("_ta")), "a")
    return both.select("a", "b", "_ta", "_tb").mapInArrow(run, "a binary, b binary")


LINKED, NEAR, FAR = 0, 1, 2


def _open(stated: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that may still hold an unseen link, and their blocks.

    These are buckets of several components with two members or more that do not match the pivot, with one such
    member near it beside others that match, or with a likely pair of member and pivot that was not verified.
    """
    label = cut(stated.join(found.withColumnRenamed("comp", "c"), "node", "left").withColumn("c", F.coalesce("c", "node")))
    count = lambda of: F.sum(of.cast("long"))
    other = F.col("state") != LINKED
    sizes = label.groupBy("band", "bucket").agg(
        F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("n"), count(other).alias("m"), count(F.col("state") == NEAR).alias("near"),
        count(F.col("untried")).alias("untried"), F.sum("size").alias("bytes"), F.sum(F.when(other, F.col("size")).otherwise(0)).alias("other_bytes"),
    )
    sizes = sizes.where((F.col("_lo") != F.col("_hi")) & ((F.col("m") > 1) | ((F.col("near") > 0) & (F.col("n") - F.col("m") > 1)) | (F.col("untried") > 0)))
    blocks = lambda rows, size: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    sizes = cut(sizes.select("band", "bucket", "n", blocks("m", "other_bytes").alias("mb"), blocks("n", "bytes").alias("nb")))
    open_ = spread_join(label, sizes, ["band", "bucket"], "n", F.xxhash64("node"))
    return cut(open_.select("band", "bucket", "node", "c", "state", "size", "mb", "nb"))


def _dealt(open_: DataFrame, more: DataFrame, cols: list[str]) -> DataFrame:
    """Open members dealt to tasks: block ``i`` of those that do not match the pivot (side 0) meets block ``j`` of all
    (side 1); where there is one block of each, a member is sent once (side 2).

    ``more`` has further columns by node. Small tasks share a ``slot`` of about TASK_ROWS rows and TASK_BYTES bytes.
    """
    every = open_.join(more, "node")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("mb"))
    theirs = F.pmod(F.xxhash64("node", F.lit(2)), F.col("nb"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", "bucket", "node", "c", "state", *cols]
    big = F.col("nb") > 1
    one = every.where(big & (F.col("state") != LINKED)).select(*cols, mine.cast("int").alias("i"), upto("nb").alias("j"), F.lit(0).alias("side"))
    two = every.select(*cols, upto("mb").alias("i"), theirs.cast("int").alias("j"), F.when(big, 1).otherwise(2).alias("side"))
    n, size = open_.agg(F.count(F.lit(1)), F.sum("size")).first()
    slots = max(1, -(-n // TASK_ROWS), -(-(size or 0) // TASK_BYTES))
    task = F.xxhash64("band", "bucket", "i", "j")
    return one.unionByName(two).withColumn("task", task).withColumn("slot", F.pmod("task", F.lit(slots))).drop("bucket", "i", "j")


def _questions(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each member that does not match its pivot, with the members it may link to and the agreement of their samples.

    A far member cannot match one that matches the pivot. Of two that do not match, the one with the smaller name asks.
    """
    tasks, side, states = (table.column(c).to_numpy() for c in ("task", "side", "state"))
    names = np.array(table.column("node").to_pylist(), object)
    comps = np.array(table.column("c").to_pylist(), object)
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SAMPLES)
    order = np.lexsort((side, tasks))
    for rows in np.split(order, np.flatnonzero(np.diff(tasks[order])) + 1):
        ones, twos = rows[(side[rows] != 1) & (states[rows] != LINKED)], rows[side[rows] != 0]
        for k in ones:
            may = np.where(states[twos] == LINKED, states[k] == NEAR, (names[twos] > names[k]).astype(bool)) & (comps[twos] != comps[k]).astype(bool)
            if may.any():
                agree = (sigs[twos[may]] == sigs[k]).mean(1)
                yield k, twos[may][agree >= VERIFY_FROM], agree[agree >= VERIFY_FROM]


def _likeliest(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each open member, its ``PARTNERS`` likeliest partners in each task."""

    def compare(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        a, b = [], []
        for k, may, agree in _questions(table):
            for other in may[np.argsort(-agree, kind="stable")[:PARTNERS]]:
                a.append(names[k])
                b.append(names[other])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    dealt = _dealt(open_, nodes.select("node", "sig"), ["sig"])
    return cut(dealt.groupBy("slot").applyInArrow(compare, "a binary, b binary").distinct())


def _settled(open_: DataFrame, nodes: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components of all open members: every pair that may be one is verified within its task.

    A pair that shares several buckets is looked at in the first; pairs that links of the task have joined already are
    left out. So rows are as many as links that join something, not as pairs.
    """

    def compare(table: pa.Table) -> pa.Table:
        names, comps = table.column("node").to_pylist(), table.column("c").to_pylist()
        keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
        weights = [np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("weights").to_pylist()]
        bands_ = np.array(table.column("bands").to_pylist(), np.int64)
        band = table.column("band").to_numpy()
        above: dict[bytes, bytes] = {}

        def top(c: bytes) -> bytes:
            while c in above:
                c = above[c]
            return c

        a, b = [], []
        for k, may, agree in _questions(table):
            first = (bands_[may] == bands_[k]).argmax(1) == band[k]
            for other in may[first][np.argsort(-agree[first], kind="stable")]:
                x, y = top(comps[k]), top(comps[other])
                if x != y and similarity((keys[k], weights[k]), (keys[other], weights[other])) >= threshold:
                    above[max(x, y)] = min(x, y)
                    a.append(names[k])
                    b.append(names[other])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    dealt = _dealt(open_, nodes.select("node", "sig", "bands").join(vectors, "node"), ["sig", "bands", "keys", "weights"])
    return cut(dealt.groupBy("slot").applyInArrow(compare, "a binary, b binary").distinct())


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components that ``found (node, comp)`` and further links make together."""
    known = found.where(F.col("node") != F.col("comp")).select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return cut(components(known.unionByName(links)))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, node, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``key`` of all documents reachable by links (similarity of ``threshold`` or more)
    or exact copies, ``kept`` whether it is the row's own. A null text is no copy of anything, nor is a null key ever
    the smallest beside another; texts without words (the empty text among them) link with their exact copies only.
    Rows with equal keys and texts all carry the same result. Other columns are not read. An empty table gives an
    empty one.
    """
    idf = docs.sparkSession.sparkContext.broadcast(word_weights(docs, text))
    signed = cut(_signatures(docs, idf, key, text))
    nodes = cut(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    placed = nodes.where(F.col("bands").isNotNull()).select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = cut(placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    members = cut(spread_join(placed, shared.withColumn("others", F.col("n")), ["band", "bucket"], "n", F.xxhash64("node")))
    company = members.groupBy("node").agg(F.sum("others").alias("company"))
    central = members.join(company, "node").groupBy("band", "bucket").agg(F.max(F.struct("company", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("n"))
    members = cut(spread_join(members.drop("others"), cut(central), ["band", "bucket"], "n", F.xxhash64("node")))
    to_pivot = cut(members.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    tried = cut(_agreement(to_pivot, nodes))
    near = tried.where(F.col("est") >= NEAR_FROM)
    texts = _texts(near.select(F.explode(F.array("a", "b")).alias("node")), docs, text)
    # The likeliest pivots of each member go first; a likely one that is left out keeps its bucket open.
    likely = Window.partitionBy("a").orderBy(F.desc("est"), "b")
    ranked = tried.where(F.col("est") >= VERIFY_FROM).withColumn("_rank", F.row_number().over(likely))
    best = cut(ranked.select("a", "b", (F.col("_rank") <= FIRST_PIVOTS).alias("first")))
    links = cut(_links(cut(best.where("first").select("a", "b")), texts, idf, threshold))
    found = cut(components(links))

    linked = links.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("linked"))
    left_out = best.where(~F.col("first")).select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("untried"))
    verdict = tried.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "est").join(linked, ["node", "pivot"], "left").join(left_out, ["node", "pivot"], "left")
    state = F.when((F.col("node") == F.col("pivot")) | F.coalesce("linked", F.lit(False)), LINKED).when(F.col("est") >= NEAR_FROM, NEAR).otherwise(FAR)
    stated = cut(members.join(verdict, ["node", "pivot"], "left").select("band", "bucket", "node", "size", state.alias("state"), F.coalesce("untried", F.lit(False)).alias("untried")))

    def known(wanted: DataFrame) -> DataFrame:
        """``texts`` and those of the nodes in ``wanted`` that it lacks."""
        missing = wanted.join(texts, "node", "left_anti")
        return texts.unionByName(_texts(missing, docs, text)) if missing.take(1) else texts

    # A few partners each, which joins most of what belongs together; then all that is still open.
    open_ = _open(stated, found)
    if open_.take(1):
        pairs = _likeliest(open_, nodes)
        texts = known(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        new = cut(_links(pairs, texts, idf, threshold))
        found = _joined(found, new)
        open_ = _open(stated, found)
    if open_.take(1):
        still = open_.select("node").distinct()
        late = _settled(open_, nodes, _vectors(still, known(still), idf), threshold)
        if late.take(1):
            found = _joined(found, late)

    linked = nodes.select("node", "first_doc").join(found, "node")
    least = cut(linked.groupBy("comp").agg(F.min("first_doc").alias("least"), F.count(F.lit(1)).alias("n")))
    classes = spread_join(linked, least, ["comp"], "n", F.xxhash64("node")).select("node", "least")
    table = cut(nodes.select("node", "first_doc", "copies").join(classes, "node", "left"))
    rows = spread_join(signed.select("doc", "node"), table, ["node"], "copies", F.xxhash64("doc"), "left")
    result = F.coalesce("least", "first_doc", "doc")
    return rows.select("doc", "node", result.alias("component_id"), result.eqNullSafe(F.col("doc")).alias("kept"))
