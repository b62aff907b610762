"""Benchmark decontamination with an FM-index per training shard.

A shard (some million words of whole documents) becomes a string over the benchmark's words. Words that no benchmark
item has are separators, and a stretch between separators that is shorter than every window is not indexed: no
occurrence can lie there. The suffix array of the string gives its Burrows-Wheeler transform, a wavelet matrix over
that answers rank queries, and all windows of the benchmark are searched backwards at once. Occurrences are located
by walking to the next sampled suffix position; their spans are merged into removal spans.

Separators are distinct symbols in order of their position, so suffixes are compared no further than their stretch.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from blockloom.llm.common import texts_of

WINDOW = 13
#: Words of documents in a shard, symbols in one index, distance of the sampled suffix positions.
SHARD_WORDS, INDEX_SYMBOLS, SAMPLED = 2_000_000, 1 << 20, 16
#: Characters of benchmark text that one search holds; more are searched for block by block, in one pass each.
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def words_of(text: str | None) -> list[bytes]:
    """Words as ``WORD`` takes them from the text with A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def ids_of(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers, 0 for those not in ``vocabulary``; long texts go piece by piece."""
    if not text:
        return np.empty(0, np.int32)
    raw, at, out = text.encode().translate(_FOLD), 0, []
    while at < len(raw):
        end = raw.find(b" ", at + (1 << 20))
        words = raw[at : end if end >= 0 else len(raw)].split()
        out.append(np.fromiter(map(vocabulary.get, words, itertools.repeat(0)), np.int32, len(words)))
        at = end if end >= 0 else len(raw)
    return np.concatenate(out)


class Windows:
    """The distinct windows of benchmark items, by number: the numbers of their words, and which items have them.

    All windows of one length are the rows of one array. An item without a name has windows but is not listed.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        item_of: dict[int, list[np.ndarray]] = {}
        self.names = [name for name, _ in items]
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            if len(ids):
                length = min(len(ids), window)
                rows.setdefault(length, []).append(np.lib.stride_tricks.sliding_window_view(ids, length))
                item_of.setdefault(length, []).append(np.full(len(ids) - length + 1, number, np.int32))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths, owner, start = [], [], 0
        for length in sorted(rows):
            distinct, which = np.unique(np.concatenate(rows[length]), axis=0, return_inverse=True)
            self.by_length[length] = (np.arange(start, start + len(distinct)), distinct)
            owner.append(np.unique(np.stack((which.ravel() + start, np.concatenate(item_of[length])), 1), axis=0))
            lengths.append(np.full(len(distinct), length, np.int64))
            start += len(distinct)
        self.lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        self.shortest, self.longest = (min(rows), max(rows)) if rows else (0, 0)
        pairs = np.concatenate(owner) if owner else np.empty((0, 2), np.int64)
        self._items, self._starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(start + 1))

    def owners(self, window: int) -> list[str]:
        """The names of the items that have this window."""
        return [self.names[i] for i in self._items[self._starts[window] : self._starts[window + 1]] if self.names[i] is not None]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; a 0 is smaller than all else, and an earlier 0 smaller than a later one."""
    n, zero = len(symbols), symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + int(zero.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1 if step < n else 0
        after[zero] = 0
        key = rank * (int(rank.max()) + int(symbols.max(initial=0)) + n + 2) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search and location over a string of numbers whose zeros are separators; it must begin with a 0."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_array(symbols)
        bwt = symbols[order - 1].astype(np.int64)
        self.n, self.bwt = len(symbols), bwt
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))
        marked = (order % SAMPLED == 0) | (bwt == 0)
        self.marked, self.mark_rank, self.sample = marked, np.cumsum(marked) - 1, order[marked]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = bwt
        for bit in range(max(1, largest.bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            count = np.concatenate(([0], np.cumsum(ones)))
            self.levels.append((bit, count, self.n - int(count[-1])))
            row = np.concatenate((row[ones == 0], row[ones == 1]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        at, start = row, np.zeros(len(row), np.int64)
        for bit, count, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            at = np.where(one, zeros + count[at], at - count[at])
            start = np.where(one, zeros + count[start], start - count[start])
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which patterns (rows of equal length) occur, with the first row and the row past the last of each."""
        who = np.arange(len(patterns))
        low, high = self.before[patterns[:, -1]], self.before[patterns[:, -1] + 1]
        for at in range(patterns.shape[1] - 2, -1, -1):
            alive = low < high
            who, low, high = who[alive], low[alive], high[alive]
            symbol = patterns[who, at]
            low, high = self.before[symbol] + self.rank(symbol, low), self.before[symbol] + self.rank(symbol, high)
        alive = low < high
        return who[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the string where the suffixes of these rows begin."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            there = self.marked[rows]
            out[todo[there]] = self.sample[self.mark_rank[rows[there]]] + steps
            todo, rows, steps = todo[~there], rows[~there], steps + 1
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.rank(symbol, rows)
        return out


def stretches(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Start and end of each run of known words that has at least ``shortest`` of them."""
    edge = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def occurrences(docs: list[np.ndarray], windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, word and window of every occurrence in ``docs`` (arrays of word numbers), by index."""
    most, overlap = INDEX_SYMBOLS, windows.longest - 1
    pending: list[tuple[int, int, int]] = []
    size = 1

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, owner, shift, place = [np.zeros(1, np.int32)], [-1], [0], [0]
        at = 1
        for doc, start, end in pending:
            parts += [docs[doc][start:end], np.zeros(1, np.int32)]
            owner.append(doc)
            shift.append(start - at)
            place.append(at)
            at += end - start + 1
        index = FMIndex(np.concatenate(parts), len(windows.vocabulary))
        which, where = [], []
        for numbers, patterns in windows.by_length.values():
            who, low, high = index.search(patterns)
            counts = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            where.append(index.locate(rows))
            which.append(np.repeat(numbers[who], counts))
        where_, which_ = np.concatenate(where), np.concatenate(which)
        piece = np.searchsorted(np.array(place), where_, side="right") - 1
        return np.array(owner)[piece], where_ + np.array(shift)[piece], which_

    for doc, ids in enumerate(docs):
        for start, end in stretches(ids, windows.shortest):
            while start < end:
                stop = min(end, start + most)
                if pending and size + stop - start + 1 > most:
                    yield run()
                    pending, size = [], 1
                pending.append((doc, start, stop))
                size += stop - start + 1
                start = end if stop == end else stop - overlap
    if pending:
        yield run()


def scan(texts: list[str | None], windows: Windows) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """Number of words, items and merged spans (of words, end exclusive) of each text of a shard."""
    docs = [ids_of(t, windows.vocabulary) for t in texts]
    if not len(windows.lengths):
        return [(len(d), [], []) for d in docs]
    base = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    change = np.zeros(int(base[-1]) + 1, np.int64)
    found: list[set[str]] = [set() for _ in docs]
    for doc, word, window in occurrences(docs, windows):
        np.add.at(change, base[doc] + word, 1)
        np.add.at(change, base[doc] + word + windows.lengths[window], -1)
        for d, w in np.unique(np.stack((doc, window), 1), axis=0).tolist():
            found[d].update(windows.owners(w))
    hit = np.cumsum(change[:-1]) > 0
    out = []
    for d in range(len(texts)):
        mine = hit[base[d] : base[d + 1]]
        edge = np.diff(np.concatenate(([0], mine.view(np.int8), [0]))) if mine.any() else np.empty(0)
        out.append((len(mine), sorted(found[d]), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))))
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def in_text(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` and ``n_words, n_hit, items, spans`` for every row of ``docs``.

    An item's windows are its runs of ``window`` words, or all its words if they are fewer (one without words, or with a
    null text, has none). An item with a null id is searched for like any other, but ``items`` cannot name it.
    ``n_hit`` counts the words of the text that lie in an occurrence of a window, ``items`` are the ids (as strings, in
    order) that have an occurring window, ``spans`` the merged stretches to remove, from the first character of a word
    to the end of one. A null or empty text has no words. Repeated rows are judged each for
    itself; equal items are all named. Names in ``docs`` that clash with the four are refused; no shuffle takes place.

    Past ``block_chars`` characters of benchmark, items are searched for in several passes, each with its own block.
    """
    if clash := {"n_words", "n_hit", "items", "spans"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    fields = [docs.schema[k] for k in keep]
    result = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(SPAN))]
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    plain = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).alias("_text"))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        items = [(r.item, r.text) for r in part.collect()]
        final = k + 1 == blocks
        plain = plain.mapInArrow(_searcher(docs, items, window, len(fields), k > 0, final), StructType([*fields, *([] if final else [StructField("_text", StringType())]), *result]))
    return plain


def _merge(hit: list[tuple[int, int]], earlier: list[dict] | None) -> list[tuple[int, int]]:
    """Spans of words joined with those an earlier block of the benchmark gave."""
    out: list[list[int]] = []
    for start, end in sorted([*hit, *((s["start"], s["end"]) for s in earlier or [])]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _searcher(docs: DataFrame, items: list[tuple[str, str]], window: int, n_keep: int, later: bool, final: bool):
    """One pass over the documents with one block of the benchmark. Between passes, spans are of words."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = ["n_words", "n_hit", "items", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, window)
        held: list[pa.RecordBatch] = []
        volume = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = iter(scan([t for b in held for t in b.column(n_keep).to_pylist()], windows))
            for b in held:
                texts = b.column(n_keep).to_pylist()
                was = list(zip(b.column(n_keep + 3).to_pylist(), b.column(n_keep + 4).to_pylist(), strict=True)) if later else [([], [])] * b.num_rows
                out = []
                for text, (names_, spans_), (n, items_, spans) in zip(texts, was, rows):
                    spans = _merge(spans, spans_)
                    hits = sum(e - s for s, e in spans)
                    out.append((n, hits, sorted({*items_, *names_}), in_text(text, spans) if final else spans))
                made = [pa.array([r[i] if i < 3 else [{"start": s, "end": e} for s, e in r[3]] for r in out], kind) for i, kind in enumerate(kinds)]
                kept = n_keep + (not final)
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *made], [*b.schema.names[:kept], *names])

        for b in texts_of(batches):
            held.append(b)
            volume += b.column(n_keep).nbytes // 6
            if volume >= SHARD_WORDS:
                yield from flush()
                held, volume = [], 0
        if held:
            yield from flush()

    return run
