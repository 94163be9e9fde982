import hashlib
import itertools
import random

import pytest

from cohortspark.llm import repair
from cohortspark.llm.repair import ENDS, FAR, NEXT, crossings, forward, only, row_step

SCHEMA = "conv_id long, turn long, role string, text string, same string, at int"


def cheapest(codes):
    """(cost, audit) by trying every edit of every row and up to two inserted rows before each and at the end."""
    best = {0: (0, "")}
    for c in [codes[i : i + 2] for i in range(0, len(codes), 2)]:
        new = {}
        for state, (cost, audit) in best.items():
            for k in range(3):
                at = state
                for _ in range(k):
                    at = 3 if at == 2 else 2
                options = [("D", 3, at)]
                if c[1] != "x":
                    t = c[1] == "t"
                    options.append(("R", 2 + t, 3 if at == 2 else 2))
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c[0], at))
                    if to:
                        options.append(("K", t, to))
                for letter, more, to in options:
                    found = (cost + 2 * k + more, audit + "I" * k + letter)
                    new[to] = min(new.get(to, found), found)
        best = new
    return min((cost + [0, 4, 2, 0][s], audit + ["", "II", "I", ""][s]) for s, (cost, audit) in best.items())


def exhaustive(codes, depth=3):
    """The same over all strings of letters, which tells that no cheaper or lesser one was overlooked by keeping one a state."""
    found = []

    def walk(i, state, cost, audit, put):
        if i == len(codes) // 2 and state in (0, 3):
            found.append((cost, audit))
        if put < depth:
            walk(i, NEXT[state], cost + 2, audit + "I", put + 1)
        if i < len(codes) // 2:
            initial, fault = codes[2 * i : 2 * i + 2]
            walk(i + 1, state, cost + 3, audit + "D", put)
            if fault != "x":
                t = fault == "t"
                walk(i + 1, NEXT[state], cost + 2 + t, audit + "R", put)
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if to:
                    walk(i + 1, to, cost + t, audit + "K", put)

    walk(0, 0, 0, "", 0)
    return min(found)


def solved(codes):
    import pandas as pd

    (edits,) = repair.solved(pd.Series([codes]), pd.Series([0]), pd.Series([4]))
    steps = repair.coded(codes)
    states = [0, *crossings(steps, 0, ENDS)]
    cost = sum(step[a][b][0] for step, a, b in zip(steps, states, states[1:])) + ENDS[states[-1]]
    roles = "".join(e["role"] for e in edits if e["role"])
    rest = roles.removeprefix("s")
    assert not roles or (rest and rest == "ua" * (len(rest) // 2))
    return cost, "".join(e["edit"] for e in edits)


def test_all_short_sequences():
    for n in range(4):
        for rows in itertools.product([i + f for i in "suao" for f in "xt."], repeat=n):
            assert solved("".join(rows)) == (exhaustive if n < 3 else cheapest)("".join(rows))


def test_long_sequences():
    r = random.Random(3)
    for _ in range(300):
        codes = "".join(r.choice("suao") + r.choice("xt...") for _ in range(r.randint(3, 60)))
        assert solved(codes) == cheapest(codes)
        if len(codes) <= 10:
            assert solved(codes) == exhaustive(codes)


def test_chunks_are_steps():
    """Costs and ranks of a chunk lead to the same vectors as its rows."""
    r = random.Random(4)
    for _ in range(200):
        codes = [r.choice("suao") + r.choice("xt...") for _ in range(12)]
        steps = [row_step(c) for c in codes]
        chunks = [[forward(steps[i : i + 4], only(s)) for s in range(4)] for i in (0, 4, 8)]
        assert forward(chunks, only(0)) == forward(steps, only(0))
        assert all(c == FAR or c < 100 for c, _ in forward(steps, only(0)))


def in_memory(rows):
    """What repair and digested should give, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ", r[1]) for r in rows if r[0] == conv)
        seen, codes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text, _ in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            codes += (role[0] if role[:1] in ("s", "u", "a") and role else "o") + {"": ".", "truncated": "t"}.get(fault, "x")
        cost, audit = cheapest(codes)
        turns = [t for *_, t in own if t is not None]
        initials = codes[::2]
        lines, at, i = [], 0, 0
        for e in audit:
            if e == "D":
                i += 1
                continue
            new = {"u": "user", "a": "assistant"}["a" if at == 2 else "u"]
            at = 1 if e == "K" and codes[2 * i] == "s" else 3 if at == 2 else 2
            lines.append(f"{own[i][1] if e == 'K' else new}:{'' if e == 'I' else own[i][2]}")
            i += e != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    r = random.Random(5)
    texts = ["Yes.", "no", "", " \n", None, "Why?", "é!", "x ", "a. \t", "long " * 2000]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["user", "assistant", "system", "tool", "", None, "agent"]), r.choice(texts)) for c in (1, 2, None, 4) for _ in range(r.randint(1, 25))]
    rows += [(7, 0, "user", "same.")] * 40 + [(8, None, "user", "a")]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA)
    found, repaired = repair.repair(df)
    digests = {x.conv_id: x.repaired_sha256 for x in repair.digested(repaired).collect()}
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, digests.get(x.conv_id)) for x in found.collect()}
    assert got == in_memory(rows)
    assert all(x.role in ("user", "assistant") and x.text == "" for x in repaired.where("edit = 'I'").collect())


def test_empty(spark):
    found, repaired = repair.repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and repaired.count() == 0 and repair.digested(repaired).count() == 0


def test_a_hot_conversation_is_many_tasks(spark):
    df = spark.range(40_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id % 7, '.') as text")
    turns = repair.placed(df)
    sizes = [x["count"] for x in turns.groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 20_000
    found, _ = repair.repair(df)
    (row,) = found.collect()
    assert (row.duplicate, row.illegal, row.gaps) == (40_000 - 14, 0, 0) and len(row.audit.replace("I", "")) == 40_000
