"""Conversation repair against a plain dynamic program over all states."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import conversations as C
from quillspan.llm.conversations import damage, repair_report, repaired_turns

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault): for each state the least by cost, then audit."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for s, (cost, audit, said) in list(out.items()):
                new = (cost + 5, audit + "I", [*said, f"{names[follow[s]]}:"])
                out[follow[s]] = min(out.get(follow[s], new), new)
        return out

    states = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, said) in inserts(states).items():
            ways = [(s, (cost + 2, audit + "D", said))]
            if fault in (0, 3):
                late = 5 * (fault == 3)
                if role[:1] == follow[s] or role[:1] == "s" and s == "":
                    ways.append((role[:1], (cost + late, audit + "K", [*said, f"{role}:{text}"])))
                ways.append((follow[s], (cost + 1 + late, audit + "R", [*said, f"{names[follow[s]]}:{text}"])))
            for t, way in ways:
                new[t] = min(new.get(t, way), way)
        states = new
    return min(w for s, w in inserts(states).items() if s in ("", "a"))


def some_rows(rng, n, roles=("system", "user", "assistant", "tool", "")):
    return [(rng.choice(roles), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_auction_and_blocks_give_the_cheapest_and_least():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 5, 8, 13, 40]:
        for _ in range(60):
            rows = some_rows(rng, n)
            want = cheapest([(role, "x", fault) for role, fault in rows])[:2]
            own = [(role[:1] if role[:1] in C.KEEP else "", fault) for role, fault in rows]
            assert C.solve_whole(own) == want
            # The same in blocks of three.
            blocks = [C.solve_block(own[i : i + 3]) for i in range(0, n, 3)]
            togo = [[float(c) for c in C.END_COST]]
            for b in blocks[::-1]:
                togo.append(C.backward(b, togo[-1]))
            state, cost, audit = C.BEGUN, 0, ""
            for b, after in zip(blocks, togo[-2::-1], strict=True):
                state, more, labels = C.forward(b, state, after)
                cost, audit = cost + more, audit + labels
            assert (cost + C.END_COST[state], audit + C.ENDING[state]) == want


def test_prices_stay_feasible_and_tight_at_the_goal():
    rng = random.Random(6)
    for _ in range(50):
        rows = [(r[:1] if r[:1] in C.KEEP else "", f) for r, f in some_rows(rng, 12)]
        steps, prices = [C.ARCS[r] for r in rows] + [C.LAST], [*C._floor(rows), 0.0]
        cost = C.auction(steps, prices, 0, 4 * 12 + 4)
        arcs = [(i, c, i + by) for i in range(4 * 13) for _, c, by in steps[i >> 2][i & 3]]
        assert all(prices[i] <= c + prices[j] for i, c, j in arcs) and prices[0] == cost


def fault_rows(turns):
    seen, out = set(), []
    for role, text in turns:
        text_end = text.rstrip(SPACE)
        fault = 1 if not text_end else 2 if (role, text) in seen else 3 if text_end[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(table, damaged=True):
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort()
        faulty = fault_rows([r[2:] for r in rows])
        known = [r[1] for r in rows if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(faulty, faulty[1:]))
        cost, audit, said = cheapest(faulty)
        counts = [sum(f == k for _, _, f in faulty) for k in (1, 2, 3)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def awkward():
    rng = random.Random(1)
    texts = ["Yes.", "No!  \n", "Why?", "cut", "", " \t", None, "é😀.", "a:b\nc.", "long " * 3000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ux", "agent"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, rng.choice(roles[:5]), rng.choice(texts)) for t in range(20)] + [(500, None, "user", "A."), (500, None, "user", "A."), (500, 4, "assistant", "B."), (501, None, "user", None)]
    return rows + rows[:10] + [(600, 2**62, "user", "x."), (600, 0, "system", "x.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def as_dict(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_damaged_rows_of_every_kind(spark):
    table = awkward()
    df = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "kind", "piece", "same", "fault", "rows", "window", "n", "cost")}).repartition(3)
    got = repair_report(damage(df)).collect()
    want = expected(table)
    assert len(got) == len(want) and as_dict(got) == want


@pytest.mark.parametrize("roles", [("user", "assistant"), ("user",), ("system", "user", "assistant")])
def test_long_conversations_in_blocks(spark, roles):
    """A third of all rows in one conversation, over several windows and partitions."""
    rng = random.Random(2)
    table = [(7, t, rng.choice(roles), rng.choice(["Yes.", "cut", "", "No!"]) if t % 3 else f"{t}.") for t in range(3000)]
    table += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(100, 1100) for t in range(4)]
    df = spark.createDataFrame(table, SCHEMA)
    assert as_dict(repair_report(df).collect()) == expected(table, damaged=False)


def test_repaired_rows(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", ""), (2, 0, "assistant", "Hello."), (3, 0, "user", " ")]
    got = sorted(tuple(r) for r in repaired_turns(spark.createDataFrame(table, SCHEMA)).collect())
    assert got == [(1, 0, "user", "Hi.", "K", 0), (1, 1, "assistant", "Again.", "R", 1)]
    damaged = spark.createDataFrame(awkward(), SCHEMA)
    rows = repaired_turns(damage(damaged)).collect()
    told = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.place)):
        told.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashes = {r.conv_id: r.repaired_sha256 for r in repair_report(damage(damaged)).collect()}
    assert {c: hashlib.sha256("\n".join(told.get(c, [])).encode()).hexdigest() for c in hashes} == hashes


def test_all_lost_and_empty(spark):
    lost = [(c, t) for c in range(400) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    df = spark.createDataFrame([(c, t, "user", "x.") for c, t in lost], SCHEMA)
    got = as_dict(repair_report(damage(df)).collect())
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: nothing for c, _ in lost}
    assert repair_report(df.where("false")).collect() == []
