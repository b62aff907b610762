"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

The grammar is an automaton of four states: START, SYSTEM (an opening system row stands), USER (a user row waits for
its answer), DONE. Deleting, keeping, changing and inserting rows make it a weighted, ambiguous automaton over the rows
of a conversation. It is made deterministic lazily: the cheapest costs from each state to the end, less the smallest of
them, are one state of the new automaton, and its transitions are worked out the first time a row asks for them and kept
in a table. Few such vectors exist, as no state is more than two insertions away from another.

Rows are scanned from the last to the first, one table look-up each. The trace runs back over the scan, from the first
row on, along tight arcs (those whose costs add up), the ASCII-least letter first; so it gives the least of all cheapest
audits. A conversation's rows stream through its task in order, twice: as codes of one byte, then with their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from blockloom.llm.common import texts_of

INF = 1 << 40
DELETE, INSERT, KEEP, REROLE = 2, 5, 0, 1
TRUNCATED_COST = 5
#: Faults of a row, in the order in which they count, and initials of roles: a code is ``4 * fault + initial``.
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
SYSTEM_ROW, USER_ROW, ASSISTANT_ROW, OTHER_ROW = range(4)
#: ``NEXT[state][initial]``: the state after a row of this initial, or -1; START, SYSTEM, USER, DONE are 0 to 3.
NEXT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The row that each state waits for, which is what is inserted or a role is changed to.
WANTED = (USER_ROW, USER_ROW, ASSISTANT_ROW, USER_ROW)
LEGAL = {(SYSTEM_ROW, USER_ROW), (USER_ROW, ASSISTANT_ROW), (ASSISTANT_ROW, USER_ROW)}
ROLE = {USER_ROW: "user", ASSISTANT_ROW: "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def arcs(state: int, code: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that use up a row, in the order of their letters."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (CLEAN, TRUNCATED):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if NEXT[state][initial] >= 0:
            out.append(("K", KEEP + more, NEXT[state][initial]))
        out.append(("R", REROLE + more, NEXT[state][WANTED[state]]))
    return out


class Table:
    """The deterministic automaton as far as it was needed: vectors of costs, transitions, and the trace's steps."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.steps: dict[int, tuple[str, int]] = {}
        self.end, _ = self._state([0, INF, INF, 0])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """Number of the normalised vector, insertions included, and what was taken off."""
        for _ in range(len(costs)):
            costs = [min(c, INSERT + costs[NEXT[q][WANTED[q]]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def before(self, after: int, code: int) -> tuple[int, int]:
        """The vector in front of a row, from the one behind it, and what was taken off."""
        key = after * 16 + code
        if key not in self.moves:
            costs = self.vectors[after]
            self.moves[key] = self._state([min(c + costs[to] for _, c, to in arcs(q, code)) for q in range(4)])
        return self.moves[key]

    def step(self, after: int, code: int, state: int) -> tuple[str, int]:
        """Letters of the least tight edits from ``state`` up to and with this row, and the state after it."""
        key = (after * 16 + code) * 4 + state
        if key not in self.steps:
            front, off = self.before(after, code)
            costs, left = self.vectors[after], self.vectors[front]
            letters = ""
            while True:
                tight = {a: to for a, c, to in arcs(state, code) if left[state] + off == c + costs[to]}
                to = NEXT[state][WANTED[state]]
                if "D" not in tight and left[state] == INSERT + left[to]:
                    letters, state = letters + "I", to
                    continue
                letter = min(tight)
                self.steps[key] = (letters + letter, tight[letter])
                break
        return self.steps[key]

    def repair(self, codes: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation of these rows."""
        states, at, total = bytearray(len(codes)), self.end, 0
        for i in range(len(codes) - 1, -1, -1):
            states[i] = at
            at, off = self.before(at, codes[i])
            total += off
        total += self.vectors[at][0]
        out, state = [], 0
        for i, code in enumerate(codes):
            letters, state = self.step(states[i], code, state)
            out.append(letters)
        while self.vectors[self.end][state]:
            out.append("I")
            state = NEXT[state][WANTED[state]]
        return total, "".join(out)


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def _coded(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, n, code, again``: rows put into their conversation's task, equal ones counted in ``n``.

    ``code`` is that of the first of the ``n`` rows, ``again`` that of the others. Times of 0 leave a row of ``n`` 0, so
    that its conversation is not lost. All steps use the one shuffle by conversation.
    """
    rows = rows.repartition("conv").withColumn("_there", F.col("times") > 0)
    shown = [F.when(F.col("_there"), F.col(c)).alias(c) for c in ("turn", "role", "text")]
    rows = rows.select("conv", *shown, "times").groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("n"))
    same = Window.partitionBy("conv", "role", F.md5("text"), F.col("n") > 0)
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    last = F.right(trimmed(F.col("text")), F.lit(1))
    fault = (
        F.when(last == "", BLANK).when(place != F.min(place).over(same), DUPLICATE)
        .when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    )
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", SYSTEM_ROW).when(first == "u", USER_ROW).when(first == "a", ASSISTANT_ROW).otherwise(OTHER_ROW)
    rows = rows.withColumn("_fault", fault).withColumn("_initial", initial)
    again = F.when(F.col("_fault") == BLANK, BLANK).otherwise(DUPLICATE)
    return rows.select("conv", "turn", "role", "text", "n", (F.col("_fault") * 4 + F.col("_initial")).alias("code"), (again * 4 + F.col("_initial")).alias("again"))


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Conversation:
    """What is kept of a conversation while its rows pass: codes, counts, later the audit and how far it was written."""

    def __init__(self, key: object):
        self.key, self.codes, self.low, self.high, self.distinct = key, bytearray(), None, None, 0
        self.audit: str | None = None
        self.cost = self.at = self.row = 0
        self.state, self.digest, self.empty = 0, hashlib.sha256(), True

    def add(self, turn: int | None, n: int, code: int, again: int) -> None:
        self.codes.append(code)
        self.codes.extend(bytes([again]) * (n - 1))
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def judged(self, table: Table) -> None:
        if self.audit is None:
            self.cost, self.audit = table.repair(self.codes)

    def put(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False
        self.at += 1
        return (self.key, self.at - 1, edit, role, text)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.row : self.row + 1] == "I":
            self.row += 1
            yield self.put("I", ROLE[WANTED[self.state]], "")
            self.state = NEXT[self.state][WANTED[self.state]]

    def use(self, n: int, code: int, again: int, role: str, text: str) -> Iterator[tuple]:
        """The messages that ``n`` equal rows leave, with those inserted before them."""
        for k in range(n):
            yield from self.inserted()
            edit, initial = self.audit[self.row], (again if k else code) % 4
            self.row += 1
            if edit == "R":
                initial, role_ = WANTED[self.state], ROLE[WANTED[self.state]]
            else:
                role_ = role
            if edit != "D":
                yield self.put(edit, role_, text)
                self.state = NEXT[self.state][initial]

    def summary(self) -> tuple:
        codes = self.codes
        faults = [sum(codes.count(4 * f + i) for i in range(4)) for f in range(4)]
        legal = sum(_pairs(codes, a, b) for a, b in LEGAL)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], max(0, len(codes) - 1) - legal, self.cost, self.audit, self.digest.hexdigest())


_INITIALS = bytes(c % 4 for c in range(256))


def _pairs(codes: bytes, a: int, b: int) -> int:
    """How often a row of initial ``b`` follows one of initial ``a``, which differ."""
    return codes.translate(_INITIALS).count(bytes([a, b]))


def _stream(rows: DataFrame, messages: bool) -> DataFrame:
    """Summaries (``messages`` false) or the messages of the repaired conversations."""
    kind = rows.schema["conv"].dataType
    passes = _coded(rows).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    passes = passes.sortWithinPartitions(F.col("conv").asc_nulls_first(), "pass", F.col("turn").asc_nulls_first(), "role", "text")
    second = F.col("pass") == 1
    passes = passes.select("conv", "pass", F.col("turn").cast("long"), "n", "code", "again", F.when(second, F.col("role")).alias("role"), F.when(second, F.col("text")).alias("text"))
    if messages:
        schema = StructType([StructField("conv", kind), StructField("position", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]])
    else:
        schema = StructType([StructField("conv", kind), *[StructField(c, LongType()) for c in SUMMARY[:6]], *[StructField(c, StringType()) for c in SUMMARY[6:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = Table(), None
        out: list[tuple] = []
        target = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target, strict=True)], schema.names)
            out.clear()
            return made

        def close() -> Iterator[tuple]:
            now.judged(table)
            for message in now.inserted():
                if messages:
                    yield message
            if not messages:
                yield (now.key, *now.summary())

        for b in texts_of(batches):
            rest = [pa.int64(), *[pa.string()] * 3] if messages else [*[pa.int64()] * 6, *[pa.string()] * 2]
            target = [b.schema.field(0).type, *rest]
            for key, again_pass, turn, n, code, again, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        out.extend(close())
                    now = _Conversation(key)
                if n and again_pass:
                    now.judged(table)
                    for message in now.use(n, code, again, role, text):
                        if messages:
                            out.append(message)
                elif n:
                    now.add(turn, n, code, again)
            if out:
                yield batch()
        if now is not None:
            out.extend(close())
            if out:
                yield batch()

    return passes.mapInArrow(run, schema)


def _plain(rows: DataFrame, conv: str, times: Column | None) -> DataFrame:
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col("turn").cast("long").alias("turn"), *columns, (F.lit(1) if times is None else times).cast("long").alias("times"))


def repair(rows: DataFrame, conv: str = "conv_id", times: Column | None = None) -> DataFrame:
    """One row for every ``conv`` of ``rows (conv, turn, role, text)``: ``gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``.

    ``times`` (of 0, 1 and more) says how often each row stands in its conversation, one after the other; a conversation
    whose rows have 0 all is empty: zeros, an empty audit and the hash of the empty text. Rows are taken by turn, nulls
    first, then role, then text, so rows of equal turns have a fixed order and repeated rows stand side by side. A null
    conversation is one like any other; a null role or text counts as one space. A role that is empty or has another
    initial than s, u and a cannot be kept. Other columns are not read. An empty table gives an empty one.

    A conversation streams through one task in order: the task keeps a byte for a row besides the audit that the result
    holds, no texts.
    """
    return _stream(_plain(rows, conv, times), False).withColumnRenamed("conv", conv)


def repaired(rows: DataFrame, conv: str = "conv_id", times: Column | None = None) -> DataFrame:
    """The messages of the repaired conversations: ``conv, position`` (from 0), ``edit`` (K, R or I), ``role, text``.

    Rows, ties and odd values are taken as in ``repair``; an empty conversation has no messages.
    """
    return _stream(_plain(rows, conv, times), True).withColumnRenamed("conv", conv)
