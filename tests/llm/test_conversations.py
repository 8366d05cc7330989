import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from ratewright.llm import conversations as C
from ratewright.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string, pos int, c string, chunk int"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def solve(rows):
    """Plain search: rows are (role, text, fault); the least (cost, audit, repaired lines) over all edits."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(k, state, inserted):
        options = []
        if k == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[k]
            more = 3 if fault == "truncated" else 0
            c, a, out = best(k + 1, state, 0)
            options.append((c + 4, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                if role[:1] in after[state]:
                    c, a, out = best(k + 1, role[:1], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                for x in "ua":
                    if x in after[state]:
                        c, a, out = best(k + 1, x, 0)
                        options.append((c + 3 + more, "R" + a, (f"{full[x]}:{text}", *out)))
        if inserted < 3:
            for x in "ua":
                if x in after[state]:
                    c, a, out = best(k, x, inserted + 1)
                    options.append((c + 3, "I" + a, (f"{full[x]}:", *out)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    found = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows):
        found[conv].append(rest)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            rest = text.rstrip(WHITE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = solve(tuple(judged))
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(map(tuple, C.structure(df, **how).collect()), key=str)


def test_table(spark, sf):
    df = read(spark, sf, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert got(df) == want and sum(r[6] for r in want) > 0


def odd(seed, conversations=40, most=14):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", "", None], ["Yes.", "No!", "open", "", " \t\x0b", None, "Who?  ", "a\nb", "Yes."]
    rows = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts), 0, "x", 1) for conv in [None, *range(conversations)] for _ in range(rng.randint(1, most))]
    return rows + rows[:20]


@pytest.mark.parametrize("bits", [1, 17])
def test_odd_rows(spark, bits):
    rows = odd(3)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), bits=bits) == brute(rows)


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "same.", "same."]), 0, "", 0) for k in range(300)]
    rows += [(2, k, "user", "again.", 0, "", 0) for k in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, bits=3) == brute(rows)
    assert C.structure(df.limit(0)).count() == 0
    e = C.Repair(C.damaged(df), bits=4).edits().orderBy("pos").collect()
    assert len(e) == len(damage(rows)) and {"K", "D", "R"} <= {r.edit for r in e}
    lines = [line for r in e if r.conversation == 1 for line in [*(f"{x}:" for x in r.inserted), *([f"{r.new_role}:{r.text}"] if r.edit != "D" else [])]]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    tail = hashlib.sha256("\n".join([*lines, "assistant:"]).encode()).hexdigest()
    assert {r[0]: r[-1] for r in brute(rows)}[1] in (digest, tail)


def test_fix_up_agrees_with_a_whole_run():
    rng = random.Random(2)
    again = 0
    for _ in range(300):
        letters = bytes(65 + rng.randrange(12) for _ in range(rng.randint(0, 60)))
        run, total = C._backward(letters, 1)
        for end in range(len(C.VECTORS)):
            other, cost = C._backward(letters, end)
            head, added, rows = C.fix_up(letters, run, total, end)
            assert (head, added) == (other[0], cost)
            again += rows
    assert again < 300 * 30 * 30 * 0.5  # most runs meet the speculative one early
    assert len(C.VECTORS) == 30
