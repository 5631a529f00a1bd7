import hashlib
import itertools
import random
import re
import zlib

import pytest

from turnwise.llm import repair
from turnwise.llm.repair import best, chart, damaged, joined, repair_report

RIGHT = re.compile("(s?(ua)+)?")
INSERTS = ("", "u", "a", "ua", "au")


def row_options(symbol):
    yield 2, "D", ""
    if symbol != "0":
        extra = 5 if symbol.isupper() else 0
        if symbol.lower() != "x":
            yield extra, "K", symbol.lower()
        yield 1 + extra, "R", "u"
        yield 1 + extra, "R", "a"


def by_search(symbols):
    """Least (cost, audit) over all edits, with up to two rows inserted in every gap."""
    found = []
    for gaps in itertools.product(INSERTS, repeat=len(symbols) + 1):
        for edits in itertools.product(*[list(row_options(s)) for s in symbols]):
            out, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for (c, letter, initial), more in zip(edits, gaps[1:]):
                out, audit, cost = out + initial + more, audit + letter + "I" * len(more), cost + c + 5 * len(more)
            if RIGHT.fullmatch(out):
                found.append((cost, audit))
    return min(found)


def by_states(symbols):
    """The same row by row, from states of the language instead of spans."""
    step = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}

    def close(held):
        for _ in range(2):
            for (p, i), q in step.items():
                if i != "s" and p in held:
                    held[q] = min(held.get(q, (10 ** 9, "")), (held[p][0] + 5, held[p][1] + "I"))
        return held

    held = close({0: (0, "")})
    for s in symbols:
        nxt = {}
        for p, (cost, audit) in held.items():
            for c, letter, initial in row_options(s):
                q = p if letter == "D" else step.get((p, initial))
                if q is not None:
                    nxt[q] = min(nxt.get(q, (10 ** 9, "")), (cost + c, audit + letter))
        held = close(nxt)
    return min(held[q] for q in (0, 2) if q in held)


def test_chart_finds_the_cheapest_repair():
    for n in range(3):
        for symbols in itertools.product("suaxSUAX0", repeat=n):
            assert best(chart("".join(symbols))) == by_search(symbols)
    rng = random.Random(2)
    for _ in range(6):
        symbols = "".join(rng.choices("suaxUA0", k=3))
        assert best(chart(symbols)) == by_search(symbols)
    for _ in range(150):
        symbols = "".join(rng.choices("suaxSUAX0", (2, 9, 9, 2, 1, 3, 3, 1, 3), k=rng.randrange(4, 14)))
        assert best(chart(symbols)) == by_states(symbols)


def test_every_split_gives_the_same_cells():
    rng = random.Random(3)
    for _ in range(20):
        symbols = "".join(rng.choices("suaxSUAX0", k=9))
        whole = chart(symbols)
        for cut in range(1, 9):
            assert joined(chart(symbols[:cut]), chart(symbols[cut:])) == whole


def plain_report(rows):
    """The report of (conv_id, turn, role, text) rows by loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = (" " if v is None else v for v in (role, text))
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else \
                "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "0" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = {t for t, *_ in own if t is not None}
        cost, audit = by_states(symbols) if own else (0, "")
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role = "assistant" if state == 3 else "user"
            text = ""
            if letter != "I":
                role, text = own[at][1] if letter == "K" else role, own[at][2]
                at += 1
            state = {"s": 1, "u": 3, "a": 2}[role[0]]
            lines.append(f"{role}:{text}")
        assert RIGHT.fullmatch("".join(line[0] for line in lines))
        initials = [r[1][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [4, 32])
def test_report_matches_loops(spark, block):
    rng = random.Random(8)
    texts = ["Fine.", "Fine.", "Why?", "cut off", "", " \t\r", None, "line\n.\n", "ends here!\x0b ", "é"]
    rows = [(c, t if rng.random() < .95 else None, rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None]),
             rng.choice(texts) if rng.random() < .3 else f"text {rng.random()}.")
            for c in [*range(40), None] for t in range(rng.choice([1, 2, 5, 9, 21]))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(150)]
    rows += [rows[3], rows[7], (77, 4, None, None)]
    rows += [(c, 0, "user", "hello.") for c in range(1000, 1040) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, position int, audit string")
    turns = turns.repartition(3)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                          r["repaired_sha256"]) for r in repair_report(turns, damaged(turns), block).collect()}
    assert got == plain_report(rows)
    none = turns.limit(0)
    assert repair_report(none, damaged(none), block).count() == 0


def test_equal_conversations_share_a_parse(spark):
    facts = spark.createDataFrame([(c, p, "ua"[p % 2]) for c in range(50) for p in range(6)],
                                  "conv_id long, position long, symbol string")
    assert {tuple(r)[1:] for r in repair.parsed(facts).collect()} == {(0, "KKKKKK")}
