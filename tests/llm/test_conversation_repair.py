"""Conversation repair against brute force."""
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tandem.llm import conversation_repair as cr

COLUMNS = "conv_id long, turn long, role string, text string, pos int, cells string, block long, copy string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "d") for r in rows], COLUMNS)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    digest = hashlib.sha256(f"{len(row[2])}:{row[2]}:{row[3]}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, digest)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerate_repairs(rows, kinds):
    """Every edit script with as few insertions as a cheapest one can have (deleting all costs 2 a row)."""
    best = None
    options = [[("D", None, 2)] if k in ("blank", "duplicate") else
               [("D", None, 2), ("K", r[2][:1], 5 * (k == "truncated")), ("R", "u", 1 + 5 * (k == "truncated")),
                ("R", "a", 1 + 5 * (k == "truncated"))] for r, k in zip(rows, kinds, strict=True)]
    for script in itertools.product(*options):
        for more in range(2 * len(rows) // 5 + 1):
            for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), more):
                for roles in itertools.product("ua", repeat=more):
                    steps = [(i, 1, k, s) for i, (k, *s) in enumerate(script)]
                    # insertions before row i; among equal places the least audit counts
                    full = sorted([(i, 0, n, "I", (c, 5)) for n, (i, c) in enumerate(zip(gaps, roles, strict=True))]
                                  + [(i, 1, 0, k, s) for i, _, k, s in steps], key=lambda x: x[:3])
                    if re.fullmatch("(s?(ua)+)?", "".join("" if s[0] is None else s[0] or "?" for *_, s in full)):
                        found = (sum(s[1] for *_, s in full), "".join(k for _, _, _, k, _ in full))
                        best = found if best is None else min(best, found)
    return best


def cheapest(rows, kinds):
    """The same by a row-by-row search over the states of the pattern."""
    next_state = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    def inserted(states):
        todo = list(states.items())
        while todo:
            p, (cost, audit) = todo.pop()
            for c in "ua":
                q = next_state.get((p, c))
                if q and (cost + 5, audit + "I") < states.get(q, (10 ** 9, "")):
                    states[q] = (cost + 5, audit + "I")
                    todo.append((q, states[q]))
        return states

    states = inserted({"0": (0, "")})
    for r, k in zip(rows, kinds, strict=True):
        after = {}
        for p, (cost, audit) in states.items():
            moves = [(p, 2, "D")]
            if k not in ("blank", "duplicate"):
                more = 5 * (k == "truncated")
                moves += [(next_state.get((p, r[2][:1])), more, "K")] + [(next_state.get((p, c)), 1 + more, "R") for c in "ua"]
            for q, price, edit in moves:
                if q and (cost + price, audit + edit) < after.get(q, (10 ** 9, "")):
                    after[q] = (cost + price, audit + edit)
        states = inserted(after)
    return min(states[q] for q in "03" if q in states)


def rebuild(rows, audit):
    out, at = [], 0
    first = sum(e != "D" for e in audit) % 2
    for e in audit:
        role = ("user", "assistant")[(len(out) - first) % 2]
        if e == "I":
            out.append(f"{role}:")
            continue
        if e != "D":
            out.append(f"{rows[at][2] if e == 'K' else role}:{rows[at][3]}")
        at += 1
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(data, exhaustive=True):
    convs = defaultdict(list)
    for r in data:
        convs[r[0]] += damaged([r])
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=order)
        kinds = faults(rows)
        turns = {r[1] for r in rows} - {None}
        cost, audit = cheapest(rows, kinds)
        if exhaustive and len(rows) <= 4:
            assert (cost, audit) == (enumerate_repairs(rows, kinds) if rows else (0, ""))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                    kinds.count("truncated"), sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
                    cost, audit, rebuild(rows, audit)))
    return sorted(out, key=str)


def made(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "USER", None, "u", "assistant\n"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "same.", "same.", "end ", "é…", "ok.\t\n"]
    data = []
    for conv in range(n):
        k = rng.randint(1, longest)
        for i in range(k):
            turn = rng.choice([i, i, i, i, i + 3, None, 1])
            good = ["system", "user", "assistant"][0 if i == 0 and conv % 4 == 0 else 1 + (i + conv // 2) % 2]
            data.append((conv, turn, good if rng.random() < 0.7 else rng.choice(roles),
                         f"line {rng.random()}." if rng.random() < 0.6 else rng.choice(texts)))
    return data


def got(rows):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


@pytest.mark.parametrize("block", [32, 2])
def test_repairs_are_cheapest(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    data = made(3, 150, 7) + made(4, 6, 90)[:300] + [(None, None, None, None), (None, 1, "user", "Hi."), (10 ** 6, None, "user", "x.")]
    assert got(cr.damage_and_repair(frame(spark, data)).collect()) == brute(data)


def test_long_conversation_and_empty_table(spark):
    data = [(7, i, ["user", "assistant"][i % 2 ^ (i % 97 == 0)], f"turn {i}." if i % 31 else "cut") for i in range(5000)]
    data += [(8, 0, "user", "word " * 400000), (8, 1, "assistant", "a.")]
    assert got(cr.damage_and_repair(frame(spark, data)).collect()) == brute(data)
    assert cr.damage_and_repair(frame(spark, [])).count() == 0


def test_repeated_rows_and_dropped_conversations(spark):
    gone = [i for i in range(3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    data = [(i, 0, "user", "All of it is dropped.") for i in gone] + [(1, 5, "user", "Same.")] * 4 + [(1, 6, "assistant", "Yes.")] * 2
    assert got(cr.damage_and_repair(frame(spark, data)).collect()) == brute(data)


def test_splits_do_not_matter():
    rng = random.Random(1)
    for _ in range(60):
        cells = [cr.leaf(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(2, 9))]
        whole = cr.combine_all(cells)
        for cut in range(1, len(cells)):
            assert cr.combine(cr.combine_all(cells[:cut]), cr.combine_all(cells[cut:])) == whole
