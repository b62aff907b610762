"""Token counts of a BPE piece vocabulary by rank-synchronous array merging.

Texts become ragged numpy arrays of symbols, one sequence per distinct pre-token. In each round every sequence finds
the lowest rank among its adjacent pairs and merges that pair wherever it stands, all sequences at once; a sequence
whose pairs are in no piece is finished. The surviving symbols are the tokens, characters outside the vocabulary
counting their UTF-8 bytes.

The sequential rule merges one occurrence at a time, lowest rank first, leftmost on ties. Merging all occurrences at
once gives the same result unless a merge makes a new pair of no higher rank; the pieces of which some longer piece of
no higher rank begins or ends with them are found when the vocabulary is loaded, and only their leftmost occurrence is
merged in a round.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from blockloom.llm.common import texts_of

SPACE = "▁"
NEVER = np.iinfo(np.int64).max
#: Pre-tokens kept with their counts by one Python worker; past it the store starts anew. Longer ones are not kept.
STORE, STORE_CHARS = 400_000, 64


class Pieces:
    """Merge rules of a sentence-piece BPE model with byte fallback, white space kept and a space put before the text."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        scores: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                scores[model.id_to_piece(i)] = model.get_score(i)
        ids = {piece: i for i, piece in enumerate(scores)}
        for char in sorted({c for piece in scores for c in piece} - ids.keys()):
            ids[char] = len(ids)
        order = {s: rank for rank, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {piece: order[s] for piece, s in scores.items()}
        self.ids, self.known, self.width = ids, set(scores), len(ids) + 1
        keys, made = [], []
        risky = np.zeros(self.width, bool)
        for piece in scores:
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if left in ids and right in ids:
                    keys.append(ids[left] * self.width + ids[right])
                    made.append(ids[piece])
                    for part in (left, right):
                        if len(part) > 1 and rank.get(part, -1) >= rank[piece]:
                            risky[ids[part]] = True
        by = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[by], np.array(made, np.int64)[by]
        ranks = np.full(self.width, NEVER, np.int64)
        for piece, r in rank.items():
            ranks[ids[piece]] = r
        self.ranks, self.risky = ranks, risky
        self.pairs = {piece[i : i + 2] for piece in scores for i in range(len(piece) - 1)}
        inner = {b for a, b in self.pairs if a != SPACE}
        alone = all("\n" not in pair for pair in self.pairs)
        #: No piece has a space after another character, so texts part there; a new line parts them if in no piece.
        parts = SPACE not in inner
        self.split = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if parts and alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if parts else r"(?s).+")
        self.run = 0
        longest = max((len(p) for p in scores if set(p) == {SPACE}), default=0)
        if longest > 1:
            # A long run of spaces gives one longest piece after another; the last ones are left to the rounds.
            n = [int(x) for x in self.merge([SPACE * (longest * k + d) for k in (3, 4, 5) for d in range(longest)])]
            if all(n[d] + 2 == n[longest + d] + 1 == n[2 * longest + d] for d in range(longest)):
                self.run = longest

    def merge(self, words: list[str]) -> np.ndarray:
        """The token counts of ``words``."""
        flat: list[int] = []
        extra = np.zeros(len(words), np.int64)
        owner: list[int] = []
        lengths: list[int] = []
        ids, known, pairs = self.ids, self.known, self.pairs
        for w, word in enumerate(words):
            last, n = "", 0
            for char in word:
                if n and last + char not in pairs:  # no piece holds these two side by side
                    lengths.append(n)
                    owner.append(w)
                    n = 0
                flat.append(ids.get(char, self.width - 1))
                if char not in known:
                    extra[w] += len(char.encode()) - 1
                last, n = char, n + 1
            if n:
                lengths.append(n)
                owner.append(w)
        symbols, sizes, own = np.array(flat, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)
        counts = extra
        while len(sizes):
            one = sizes == 1
            if one.any():
                counts = counts + np.bincount(own[one], minlength=len(words))
                symbols, sizes, own = symbols[np.repeat(~one, sizes)], sizes[~one], own[~one]
                if not len(sizes):
                    break
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            key = np.empty(len(symbols), np.int64)
            key[:-1] = symbols[:-1] * self.width + symbols[1:]
            key[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            made = np.where(hit, self.made[at], 0)
            rank = np.where(hit, self.ranks[made], NEVER)
            low = np.minimum.reduceat(rank, starts)
            chosen = hit & (rank == np.repeat(low, sizes))
            place = np.flatnonzero(chosen)
            seq = np.repeat(np.arange(len(sizes)), sizes)[place]
            first = np.ones(len(place), bool)
            first[1:] = seq[1:] != seq[:-1]
            # Overlapping pairs: in a run of neighbouring places every second one counts, from the left.
            begins = np.ones(len(place), bool)
            begins[1:] = (place[1:] != place[:-1] + 1) | first[1:]
            since = np.arange(len(place)) - np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))
            lowest = self.risky[made[place[first]]]
            wary = np.zeros(len(sizes), bool)
            wary[seq[first]] = lowest
            place = place[np.where(wary[seq], first, since % 2 == 0)]
            symbols[place] = made[place]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            gone = np.add.reduceat((~keep).astype(np.int64), starts)
            done = low == NEVER
            if done.any():
                counts = counts + np.bincount(own[done], weights=sizes[done], minlength=len(words)).astype(np.int64)
                keep &= np.repeat(~done, sizes)
            symbols, sizes, own = symbols[keep], (sizes - gone)[~done], own[~done]
        return counts

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of ``text``, and the tokens of the long runs of spaces taken out of them."""
        text, out = SPACE + text.replace(" ", SPACE), 0
        if self.run and SPACE * (6 * self.run) in text:
            def shorter(match: re.Match) -> str:
                nonlocal out
                n = len(match[0]) // self.run - 4
                out += n
                return match[0][n * self.run :]

            text = re.sub(f"{SPACE}{{{6 * self.run},}}", shorter, text)
        return self.split.findall(text), out


@functools.lru_cache(maxsize=4)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def count_texts(texts: list[str | None], model_file: str, store: dict[str, int]) -> list[int]:
    rules = pieces(model_file)
    lists = [rules.words(t) if t else ([], 0) for t in texts]
    new = list({w for words, _ in lists for w in words if w not in store})
    mine = dict(zip(new, rules.merge(new).tolist(), strict=True)) if new else {}
    store |= {w: n for w, n in mine.items() if len(w) <= STORE_CHARS}
    long = {w: n for w, n in mine.items() if len(w) > STORE_CHARS}
    get = store.__getitem__ if not long else lambda w: long[w] if w in long else store[w]
    out = [sum(map(get, words)) + more for words, more in lists]
    if len(store) > STORE:
        store.clear()
    return out


def token_counts(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``n_bytes, n_tokens`` for every row of ``docs``; a null text counts as an empty one.

    ``model_file`` is a path that every executor can read (the vocabulary is never copied into this package). Repeated
    rows are counted each; an empty text has no tokens, one of any length is counted whole; other columns of ``docs``,
    whatever their names, are not read. No shuffle: each task keeps only its own batch and a bounded store of words.
    """
    plain = docs.select(*[F.col(k) for k in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f for f in plain.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: dict[str, int] = {}
        for batch in texts_of(batches):
            column = batch.column(batch.num_columns - 1)
            n = count_texts(column.to_pylist(), model_file, store)
            sizes = pc.binary_length(column.cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes.cast(pa.int64()), pa.array(n, pa.int64())], [*[f.name for f in fields], "n_bytes", "n_tokens"])

    return plain.mapInArrow(run, StructType([*fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]))
