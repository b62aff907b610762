"""Substring dedup by relative Lempel-Ziv parsing: words inside a run of 20 words that stands earlier too are removed.

1. Every window of 20 words has an anchor: the leftmost of its runs of 10 words whose hash is smallest. Equal windows
   have equal anchors, and neighbouring windows mostly share theirs. Tasks put the distinct anchors of their chunk of
   documents (some million words) into buckets, and buckets tell which anchors stand in more than one place.
2. Stretches of windows around such anchors, at most 30 words each, go to the reference block of their anchor. A chunk
   sends each text of a stretch once; its later copies are factors of their whole length, known on the spot. Stretches
   of an anchor that very many places have go by window instead, so that no block gets more than its share.
3. A block orders its stretches by document and place and indexes them: ranks of runs of 1, 2, 4 to 32 words, which give
   the suffix array and the common prefix of any two places, and with it the nearest suffixes that start earlier. Every
   stretch is parsed greedily into the longest factors that start earlier in the block. Factors of 20 words and more are
   duplicate spans. A duplicate window that is in no single factor lies over one boundary of two factors, the second of
   which reaches its end; such windows are looked up one by one.
4. Spans join their documents, and the words that none covers stay.

A document meets the blocks of its own anchors only: in no other block does any of its windows occur.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from blockloom.llm.common import U64, mix64, texts_of, written

WINDOW, GRAM = 20, 10
#: Bytes of text in a chunk, bytes hashed at once, anchors in a bucket and stretches in a block.
CHUNK_BYTES, SLICE, BUCKET, BLOCK = 12_000_000, 1 << 20, 1 << 22, 100_000
#: Places of an anchor past which its stretches go by window; documents with repeats whose spans are put together.
HOT_PLACES, PART = 8192, 20_000
#: The bits of a word's hash by which stretches are compared, word by word.
WORD_BITS = U64((1 << 48) - 1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_BYTE = np.where(_SEPARATOR, U64(0), mix64(np.arange(256, dtype=np.uint64) + U64(0x51ED270B)) | U64(1))
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, SLICE), _powers(_BACK, SLICE)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in ``data``, and how many words each text has.

    A word's hash is a polynomial of its bytes, for which separators count 0.
    """
    apart = _SEPARATOR[data]
    first = ~apart
    first[1:] &= apart[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] = ~apart[heads]
    starts = np.flatnonzero(first)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + SLICE, side="right")) - 1)
        if to >= len(starts) - 1 and len(data) - low <= SLICE:
            to = len(starts)
        high = int(starts[to]) if to < len(starts) else len(data)
        if high - low <= SLICE:
            out[at:to] = np.add.reduceat(_BYTE[data[low:high]] * _UP[: high - low], starts[at:to] - low) * _DOWN[starts[at:to] - low]
        else:
            total = 0
            for k in range(low, high, SLICE):
                part = _BYTE[data[k : min(high, k + SLICE)]]
                total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_STEP, k - low, 1 << 64)
            out[at] = total % (1 << 64)
        at = to
    return mix64(out), np.diff(np.searchsorted(starts, bounds))


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def _doubled(x: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of twice ``length`` words from those of ``length``."""
    return x + _shifted(x, length) * U64(pow(_STEP, 7 * length, 1 << 64))


class Windows:
    """The windows of some texts, given their words' hashes, in runs of neighbours that have one anchor.

    ``owner, start, count, value`` of each run: its text, the place of its first window in it, how many windows it has
    and its anchor's hash. ``content`` hashes any stretch of 20 to 32 words.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        n = len(words)
        self.words, self.counts, self.base = words, counts, np.concatenate(([0], np.cumsum(counts)))
        self.two = _doubled(words, 1)
        self.eight = _doubled(_doubled(self.two, 2), 4)
        low = mix64(self.eight + _shifted(self.two, 8) * U64(pow(_STEP, 56, 1 << 64)))
        where, width, most = np.arange(n, dtype=np.int64), 1, WINDOW - GRAM + 1
        while width < most:
            by = min(width, most - width)
            right, there = _shifted(low, by), _shifted(where, by)
            less = right < low
            low, where = np.where(less, right, low), np.where(less, there, where)
            width += by
        owner = np.repeat(np.arange(len(counts)), counts)
        valid = np.arange(n) + WINDOW <= self.base[owner + 1] if n else np.zeros(0, bool)
        places = np.flatnonzero(valid)
        where = where[places]
        new = np.ones(len(places), bool)
        new[1:] = (where[1:] != where[:-1]) | (owner[places][1:] != owner[places][:-1])
        head = np.flatnonzero(new)
        self.at = places[head]
        self.owner, self.start = owner[self.at], self.at - self.base[owner[self.at]]
        self.count = np.diff(np.concatenate((head, [len(places)])))
        self.value = low[self.at]

    def content(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        sixteen = _doubled(self.eight, 8)
        return mix64(sixteen[at] + mix64(sixteen[at + length - 16] + length.astype(np.uint64)))


def factors(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Duplicate spans of stretches that lie one after the other in ``words``: stretch, first word, word past the last.

    Of two places the one in an earlier stretch, or earlier in the same one, is the earlier. Stretches have 31 words
    at most.
    """
    n_pieces = len(lengths)
    _, symbol = np.unique(words, return_inverse=True)
    begin = np.cumsum(lengths + 1) - lengths - 1
    n = int(len(words) + n_pieces)
    rank = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[begin + lengths] = False
    rank[inside] = symbol
    rank[~inside] = len(words) + np.arange(n_pieces)
    ranks = [rank.astype(np.int32)]
    for k in range(5):
        key = ranks[-1] * np.int64(int(ranks[-1].max()) + 2) + _shifted(ranks[-1].astype(np.int64) + 1, 1 << k)
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
    suffix = np.empty(n, np.int32)
    suffix[ranks[5]] = np.arange(n, dtype=np.int32)
    before, after = _nearest_smaller(suffix), n - 1 - _nearest_smaller(suffix[::-1])[::-1]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        there, out = b >= 0, np.zeros(len(a), np.int64)
        b = np.maximum(b, 0)
        for k in range(4, -1, -1):
            out += (ranks[k][np.minimum(a + out, n - 1)] == ranks[k][np.minimum(b + out, n - 1)]).astype(np.int64) << k
        return np.where(there, out, 0)

    def longest(at: np.ndarray) -> np.ndarray:
        """Length of the longest match that starts earlier: one of the two nearest suffixes that do has it."""
        row = ranks[5][at]
        low, high = before[row], after[row]
        left = np.where(low >= 0, suffix[np.maximum(low, 0)], -1)
        right = np.where(high < n, suffix[np.minimum(high, n - 1)], -1)
        return np.maximum(common(at, left), common(at, right))

    at, piece, found = begin.copy(), np.arange(n_pieces), []
    while len(at):
        match = longest(at)
        found.append((at, match, piece))
        at = at + np.maximum(1, match)
        more = at < begin[piece] + lengths[piece]
        at, piece = at[more], piece[more]
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, match, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(start)
    start, match, piece = start[order], match[order], piece[order]
    whole = match >= WINDOW
    beside = np.flatnonzero((piece[1:] == piece[:-1]) & (match[1:] > 0) & (match[:-1] > 0))
    boundary = start[beside + 1]
    low = np.maximum(start[beside], boundary - WINDOW + 1)
    high = np.minimum(boundary - 1, boundary + match[beside + 1] - WINDOW)
    many = np.maximum(0, high - low + 1)
    tried = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner = np.repeat(piece[beside], many)
    hit = longest(tried) >= WINDOW
    where = np.concatenate((start[whole], tried[hit]))
    owner = np.concatenate((piece[whole], owner[hit]))
    end = np.concatenate((start[whole] + match[whole], tried[hit] + WINDOW))
    return owner, where - begin[owner], end - begin[owner]


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the nearest place before it that holds a smaller one, or -1, by chains that are halved."""
    out = np.arange(len(values), dtype=np.int64) - 1
    todo = np.arange(1, len(values))
    while len(todo):
        todo = todo[out[todo] >= 0]
        todo = todo[values[out[todo]] > values[todo]]
        out[todo] = out[out[todo]]
    return out


def _packed(x: np.ndarray) -> bytes:
    """An array compressed byte by byte of its elements: first all lowest bytes, then the next."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    if not x:
        return np.empty(0, kind)
    raw = pa.decompress(x[8:], struct.unpack("<q", x[:8])[0], codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list of ``values`` (in the order of their owners) for each of ``n`` owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind or pa.int32()))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The elements of all lists of a column, in order."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class _Chunk:
    """Rows of documents: the keys, and the words' hashes of their texts."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.doc, self.hash = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in (0, 1))
        words, counts = [], []
        for b in batches:
            column = b.column(2).cast(pa.large_binary()).fill_null(b"")
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            values = column.buffers()[2]
            data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.empty(0, np.uint8)
            found = word_hashes(data, bounds - bounds[0])
            words.append(found[0])
            counts.append(found[1])
        self.windows = Windows(np.concatenate(words), np.concatenate(counts))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, volume = [], 0
    for b in texts_of(batches):
        held.append(b)
        volume += b.column(2).nbytes
        if volume >= CHUNK_BYTES:
            yield held
            held, volume = [], 0
    if held:
        yield held


_ANCHORS = StructType([StructField("chunk", LongType()), StructField("bucket", IntegerType()), *[StructField(c, BinaryType()) for c in ("value", "place", "docs", "hashes", "runs")]])


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            chunk, name = _Chunk(held), uuid.uuid4().int >> 65
            w = chunk.windows
            value, first, which, times = np.unique(w.value, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[which] > 1)
            place = np.where(times > 1, -times, first).astype(np.int32)
            bucket = ((value >> U64(32)) % U64(buckets)).astype(np.int64)
            code = (bucket.astype(np.uint64) << U64(32)) | (value & U64(0xFFFFFFFF))
            per_doc = np.bincount(w.owner, minlength=len(chunk.doc)).astype(np.int32)
            rows = [(name, -1, _packed(code[which[again]]), _packed(again.astype(np.int32)), _packed(chunk.doc), _packed(chunk.hash), _packed(per_doc))]
            order = np.lexsort((place, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                mine = order[ends[b] : ends[b + 1]]
                rows.append((name, int(b), _packed((value[mine] & U64(0xFFFFFFFF)).astype(np.uint32)), _packed(np.diff(place[mine], prepend=np.int32(0))), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], _ANCHORS.names)

    return run


def _repeated(hot_places: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Which of the anchors of a bucket stand in several places, chunk by chunk, and which of these in very many."""
        bucket = key[0].as_py()
        values = [_unpacked(v, np.uint32) for v in rows.column("value").to_pylist()]
        places = [np.cumsum(_unpacked(p, np.int32), dtype=np.int32) for p in rows.column("place").to_pylist()]
        value, place = np.concatenate(values), np.concatenate(places)
        distinct, which = np.unique(value, return_inverse=True)
        chunks = np.bincount(which)
        times = np.bincount(which, np.where(place < 0, -place, 1))
        hot = times[which] > hot_places
        back = (chunks[which] > 1) | hot
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        single, many = back & (place >= 0), hot & (place < 0)
        code = (np.int64(bucket) << np.int64(32)) | value.astype(np.int64)
        made = [_lists(x[of], owner[of], len(values), kind) for x, of, kind in ((place, single & ~hot, pa.int32()), (place, single & hot, pa.int32()), (code, many, pa.int64()))]
        return pa.table([rows.column("chunk"), *made], ["chunk", "places", "hot_places", "hot_codes"])

    return run


_REPEATED = "chunk bigint, places array<int>, hot_places array<int>, hot_codes array<bigint>"
_FLAGS = "doc bigint, hash bigint, runs array<int>, hot array<int>"


def _flags(rows: pa.Table) -> pa.Table:
    """The runs of each document of a chunk whose anchors stand in several places, and those whose anchors are hot."""
    made = {c: _flat(rows.column(c)) for c in ("places", "hot_places", "hot_codes")}
    listed = next(r for r in rows.select(["docs", "hashes", "runs", "place", "value"]).to_pylist() if r["docs"] is not None)
    doc, hash_, per_doc = (_unpacked(listed[c], t) for c, t in (("docs", np.int64), ("hashes", np.int64), ("runs", np.int32)))
    local, code = _unpacked(listed["place"], np.int32).astype(np.int64), _unpacked(listed["value"], np.uint64).astype(np.int64)
    is_hot = np.isin(code, made["hot_codes"])
    base = np.concatenate(([0], np.cumsum(per_doc)))
    columns, some = [], np.zeros(len(doc), bool)
    for place in (np.concatenate((local[~is_hot], made["places"])), np.concatenate((local[is_hot], made["hot_places"]))):
        place = np.sort(place)
        owner = np.searchsorted(base, place, side="right") - 1
        some[owner] = True
        columns.append(_lists(place - base[owner], owner, len(doc)))
    return pa.table([pa.array(doc), pa.array(hash_), *columns], ["doc", "hash", "runs", "hot"]).filter(pa.array(some))


_SPANS = StructType([StructField("part", IntegerType()), *[StructField(c, BinaryType()) for c in ("docs", "hashes", "starts", "ends")]])
_PIECES = StructType([StructField("block", IntegerType()), *[StructField(c, BinaryType()) for c in ("start", "length", "words", "which")], *_SPANS.fields])
_MERGED = "doc bigint, hash bigint, starts array<int>, ends array<int>"


def _spans(doc: np.ndarray, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> pa.RecordBatch:
    """Spans packed by the part of their document, a row for each part that has some."""
    part = (mix64(doc.view(np.uint64) + U64(1)) % U64(parts)).astype(np.int64)
    order = np.lexsort((start, hash_, doc, part))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for k in np.flatnonzero(np.diff(ends)):
        mine = order[ends[k] : ends[k + 1]]
        rows.append((int(k), *map(_packed, (doc[mine], hash_[mine], start[mine].astype(np.int32), end[mine].astype(np.int32)))))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], _SPANS.names)


def _merged(rows: pa.Table) -> pa.Table:
    """Each document of a part with its spans, joined where they touch."""
    kinds = (np.int64, np.int64, np.int32, np.int32)
    doc, hash_, start, end = (np.concatenate([_unpacked(x, t) for x in rows.column(c).to_pylist()]).astype(np.int64) for c, t in zip(("docs", "hashes", "starts", "ends"), kinds, strict=True))
    return pa.table(_span_rows(doc, hash_, start, end), ["doc", "hash", "starts", "ends"])


def _span_rows(doc: np.ndarray, hash_: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Spans merged where they touch, and a row of them for each document; they come in the order of their documents."""
    order = np.lexsort((start, hash_, doc))
    doc, hash_, start, end = doc[order], hash_[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
    owner = np.cumsum(new) - 1
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(end + owner * wide) - owner * wide
    apart = new.copy()
    apart[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(apart)
    last = np.concatenate((head[1:], [len(doc)])) - 1 if len(head) else head
    n = int(new.sum())
    return [pa.array(doc[new], pa.int64()), pa.array(hash_[new], pa.int64()), _lists(start[head], owner[head], n), _lists(reach[last], owner[head], n)]


def _pieces(blocks: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            chunk = _Chunk(held)
            w = chunk.windows
            first_run = np.searchsorted(w.owner, np.arange(len(chunk.doc)))
            flagged = []
            for i in (3, 4):
                lists = [b.column(i) for b in held]
                rows = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists])
                flagged.append(np.concatenate([_flat(x) for x in lists]) + np.repeat(first_run, rows))
            plain, hot = flagged
            each = np.repeat(hot, w.count[hot])
            step = np.arange(len(each)) - np.repeat(np.cumsum(w.count[hot]) - w.count[hot], w.count[hot])
            at = np.concatenate((w.at[plain], w.at[each] + step))
            length = np.concatenate((w.count[plain] + WINDOW - 1, np.full(len(each), WINDOW)))
            owner = np.concatenate((w.owner[plain], w.owner[each]))
            content = w.content(at, length)
            value = np.concatenate((w.value[plain], content[len(plain) :]))
            doc, hash_, start = chunk.doc[owner], chunk.hash[owner], at - w.base[owner]
            order = np.lexsort((start, hash_, doc))
            _, first, which = np.unique(content[order], return_index=True, return_inverse=True)
            head = order[first]
            source = head[which]
            same = (doc[order] == doc[source]) & (hash_[order] == hash_[source]) & (start[order] == start[source])
            copies = order[~same]
            if len(copies):
                made = _spans(doc[copies], hash_[copies], start[copies], start[copies] + length[copies], parts)
                nothing = [pa.nulls(made.num_rows, t) for t in (pa.int32(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([*nothing, *made.columns], _PIECES.names)
            block = (mix64(value[head]) % U64(blocks)).astype(np.int64)
            head = head[np.argsort(block, kind="stable")]
            ends = np.searchsorted(np.sort(block), np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(ends)):
                mine = head[ends[b] : ends[b + 1]]
                size = length[mine]
                words = w.words[np.repeat(at[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())] & WORD_BITS
                distinct, which = np.unique(words, return_inverse=True)
                which = which.astype(np.uint16 if len(distinct) <= 65536 else np.int32)
                row = [int(b), *map(_packed, (start[mine].astype(np.int32), size.astype(np.uint8), np.diff(distinct, prepend=U64(0)), which)), None, _packed(doc[mine]), _packed(hash_[mine]), None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 4), strict=True)], _PIECES.names)

    return run


def _factored(parts: int):
    def run(rows: pa.Table) -> pa.Table:
        """Duplicate spans of the stretches of a block."""
        made: dict[str, list[np.ndarray]] = {c: [] for c in ("docs", "hashes", "start", "length", "words")}
        for r in rows.to_pylist():
            distinct = np.cumsum(_unpacked(r["words"], np.uint64), dtype=np.uint64)
            made["words"].append(distinct[_unpacked(r["which"], np.uint16 if len(distinct) <= 65536 else np.int32)])
            for c, t in (("docs", np.int64), ("hashes", np.int64), ("start", np.int32), ("length", np.uint8)):
                made[c].append(_unpacked(r[c], t).astype(np.int64))
        doc, hash_, start, length, words = (np.concatenate(x) for x in made.values())
        base = np.cumsum(length) - length
        order = np.lexsort((start, hash_, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (hash_[order][1:] != hash_[order][:-1]) | (start[order][1:] != start[order][:-1])
        order = order[new]
        size = length[order]
        words = words[np.repeat(base[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        piece, low, high = factors(words, size)
        piece_at = order[piece]
        return pa.Table.from_batches([_spans(doc[piece_at], hash_[piece_at], start[piece_at] + low, start[piece_at] + high, parts)])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, hash, starts, ends``: the stretches of words of a document that windows cover which also start earlier.

    One row for each document that has some; ``doc`` is the id (the smallest long for null), ``hash`` that of the text.
    """
    rows = _keyed(docs, doc_id, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // (36 * BUCKET)
    anchors = written(rows.mapInArrow(_anchors(buckets), _ANCHORS))
    repeated = anchors.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeated(HOT_PLACES), _REPEATED)
    repeated = repeated.where((F.size("places") > 0) | (F.size("hot_places") > 0) | (F.size("hot_codes") > 0))
    listed = anchors.where("bucket < 0").select("chunk", "value", "place", "docs", "hashes", "runs")
    flags = written(listed.unionByName(repeated, allowMissingColumns=True).groupBy("chunk").applyInArrow(_flags, _FLAGS).dropDuplicates(["doc", "hash"]))
    stretches, repeating = flags.agg(F.sum(F.size("runs") + 8 * F.size("hot")), F.count(F.lit(1))).first()
    blocks, parts = 1 + (stretches or 0) // BLOCK, 1 + repeating // PART
    pieces = written(rows.join(flags, ["doc", "hash"]).select("doc", "hash", "text", "runs", "hot").mapInArrow(_pieces(blocks, parts), _PIECES))
    copies = pieces.where("block IS NULL").select(*_SPANS.names)
    found = pieces.where("block IS NOT NULL").select("block", "start", "length", "words", "which", "docs", "hashes").groupBy("block").applyInArrow(_factored(parts), _SPANS)
    return copies.unionByName(found).groupBy("part").applyInArrow(_merged, _MERGED)


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(words).alias("hash"), words.alias("text"), *more)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` for every row, and ``kept`` if ``texts``.

    A word is removed if a window of 20 words covers it whose words also start earlier: in a document of a smaller id
    (null is the smallest), in the same document before it, or, of documents of one id with different texts, in the one
    whose text has the smaller hash. Rows of one id and one text are one document and agree. Windows are judged on the
    input. ``spans`` are the stretches of words removed, end exclusive; ``kept`` is what stays, joined by spaces. A null
    or empty text has no words. Texts are read whole, other columns not at all; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, doc_id, text)
    rows = _keyed(docs, doc_id, text, F.col(f"`{doc_id}`").alias("id")).join(spans, ["doc", "hash"], "left").select("id", "text", "starts", "ends")
    fields = [StructField(doc_id, docs.schema[doc_id].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*fields, StructField("spans", ArrayType(span)), *([StructField("kept", StringType())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_of(batches):
            out = []
            for value, starts, ends in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                words = value.encode().split()
                n, gone = len(words), list(zip(starts or (), ends or (), strict=True))
                for start, end in reversed(gone):
                    del words[start:end]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in gone], kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds) if texts or i < 4]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], schema.names)

    return rows.mapInArrow(run, schema)


def repeats_sql() -> str:
    """The same in DuckDB's SQL over ``documents``: every window by its words. It takes each document once by its id."""
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM d),
r AS (SELECT doc_id, pos, word, (count(*) OVER s) = 20 AS whole, md5(string_agg(word, ' ') OVER s) AS h
  FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, h ORDER BY doc_id, pos) > 1 AS again FROM r),
g AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
