import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from blockloom.llm import conversations as C
from blockloom.llm import queries
from blockloom.llm.common import table

GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = BLANK.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and messages by trying edits cheapest first, then least audit; the grammar is the expression itself."""
    found, front, done = faults(rows), [(0, "", 0, ())], set()
    while front:
        cost, audit, at, made = heapq.heappop(front)
        shape = "".join(r[:1] for r, _ in made)
        if (at, shape[-1:]) in done:
            continue
        done.add((at, shape[-1:]))
        if at == len(rows) and GRAMMAR.fullmatch(shape):
            return cost, audit, made
        options = [(5, "I", at, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            options.append((2, "D", at + 1, None))
            if found[at] not in ("blank", "duplicate"):
                more = 5 * (found[at] == "truncated")
                options += [(more, "K", at + 1, (role, text))] if role else []
                options += [(1 + more, "R", at + 1, (r, text)) for r in ("user", "assistant")]
        for c, letter, to, message in options:
            new = made if message is None else (*made, message)
            shape = "".join(r[:1] for r, _ in new)
            if GRAMMAR.fullmatch(shape) or GRAMMAR.fullmatch(shape + "a") or shape == "s":
                heapq.heappush(front, (cost + c, audit + letter, to, new))


def summary(turns, rows):
    known = sorted({t for t in turns if t is not None})
    found = faults(rows)
    legal = sum((a[0][:1] + b[0][:1]) in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, made = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in made)
    gaps = known[-1] - known[0] + 1 - len(known) if known else 0
    return (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], max(0, len(rows) - 1) - legal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_costs_and_audits_equal_brute_force(seed):
    rng = random.Random(seed)
    automaton = C.Table()
    for _ in range(300):
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant", "tool", "", "User"]])
        rows = [(rng.choice(roles), rng.choice(["One.", "two", "", " \n", "Three! ", f"{rng.random()}."])) for _ in range(rng.randint(0, 9))]
        kind = {"": C.CLEAN, "truncated": C.TRUNCATED, "duplicate": C.DUPLICATE, "blank": C.BLANK}
        codes = bytes(4 * kind[f] + max(0, "sua".find(r[:1])) * (r[:1] in set("sua")) + 3 * (r[:1] not in set("sua")) for (r, _), f in zip(rows, faults(rows), strict=True))
        assert automaton.repair(codes) == cheapest(rows)[:2], rows
    assert len(automaton.vectors) < 256


def expected(rows):
    """The contract's result, row by row."""
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    out = {}
    for conv, mine in by.items():
        kept = []
        for r in mine:
            key = ":".join(" " if v is None else str(v) for v in (r.conv_id, r.turn))
            role, text, kind = r.role if r.role is not None else " ", r.text if r.text is not None else " ", zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(r.turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out[conv] = summary([r[0] for r in kept], [r[1:] for r in kept])
    return out


def test_query_equals_brute_force(spark, sf):
    rows = table(spark, sf, "conversations").collect()
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)


def test_odd_rows(spark):
    odd = [
        (None, None, None, None, 1), (None, 3, "user", "Hi.", 1), (None, 3, "user", "Hi.", 1), (1, 0, "", "x" * 300_000, 1), (1, 5, "assistant", "A.", 1),
        (2, 0, "tool", "T.", 1), (2, None, "sys", "S.", 1), (2, 9, "a", "Ok!", 1), *[(7, t, "user", f"{t % 3}.", 1) for t in range(40)],
    ]
    frame = spark.createDataFrame(odd, "conv_id long, turn int, role string, text string, n long")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(queries.damaged(frame), times=queries.F.col("times")).collect()}
    assert got == expected(frame.collect())
    messages = C.repaired(queries.damaged(frame), times=queries.F.col("times")).orderBy("conv_id", "position").collect()
    for conv, row in got.items():
        mine = [m for m in messages if m.conv_id == conv]
        assert [m.position for m in mine] == list(range(len(mine))) and "".join(m.edit for m in mine) == row[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in mine).encode()).hexdigest() == row[7]
    assert C.repair(frame.limit(0)).collect() == []
    empty = C.repair(frame.where("conv_id = 1"), times=queries.F.lit(0)).collect()
    assert [tuple(r) for r in empty] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_streams_by_in_parts(spark):
    rows = spark.range(30_000).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, if(id % 7 = 0, '', '.')) AS text")
    row = C.repair(rows).first()
    assert (row.gaps, row.duplicate, row.illegal, len(row.audit.replace("I", ""))) == (0, 0, 0, 30_000)
