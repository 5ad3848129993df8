"""Conversation repair against a plain search over grammar states, on the driver's table and on odd rows."""

import functools
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import conversations, queries

KIND = "conv_id long, turn long, role string, text string, audit string, present2 int"


def cheapest(rows):
    """rows (initial, forced, truncated): least (cost, audit) by search over what may come next."""
    after = {"start": ("u", "u"), "system": ("u", "u"), "a": ("u", "u"), "u": ("a", "a")}

    @functools.lru_cache(None)
    def go(i, state, inserts):
        wanted, then = after[state]
        options = [(0, "")] if i == len(rows) and state in ("start", "a") else []
        if inserts < 2:
            options.append((5, "I", i, then, inserts + 1))
        if i < len(rows):
            initial, forced, truncated = rows[i]
            options.append((2, "D", i + 1, state, 0))
            if not forced:
                more = 5 * truncated
                if initial == "s" and state == "start":
                    options.append((more, "K", i + 1, "system", 0))
                options.append((more, "K", i + 1, then, 0) if initial == wanted else (more + 1, "R", i + 1, then, 0))
        done = []
        for option in options:
            if len(option) == 2:
                done.append(option)
            else:
                rest = go(*option[2:])
                if rest:
                    done.append((option[0] + rest[0], option[1] + rest[1]))
        return min(done) if done else None

    return go(0, "start", 0)


def expected(rows):
    """The contract's rows from (conv_id, turn, role, text) rows, by plain Python."""
    out = {}
    held = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        held.setdefault(c, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        held[c] += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for c, body in held.items():
        body.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in body if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, facts, seen = [0, 0, 0], [], set()
        for _, role, text in body:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            facts.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit = cheapest(tuple(facts))
        lines, at, due = [], 0, "u"
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            role, text = {"u": "user", "a": "assistant"}[due], ""
            if edit in "KR":
                role, text = body[at][1] if edit == "K" else role, body[at][2]
                at += 1
            lines.append(f"{role}:{text}")
            due = "a" if role[0] == "u" else "u"
        out[c] = (c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.conv_id]


def test_alignment_equals_the_search():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("suuaa?"), rng.random() < 0.25, rng.random() < 0.25) for _ in range(rng.randint(0, 9))]
        rows = [(a, f, t and not f) for a, f, t in rows]
        got = conversations.align(np.array(["sua?".index(a) for a, _, _ in rows], np.uint8), np.array([f for _, f, _ in rows], bool), np.array([t for _, _, t in rows], bool))
        assert got == cheapest(tuple(rows))


def test_a_long_conversation_equals_the_search():
    rng = random.Random(6)
    rows = [("s", True, False)] * 20 + [("s", False, False)] + [(rng.choice("ua") if rng.random() < 0.3 else "ua"[i % 2], rng.random() < 0.1, False) for i in range(180)]
    rows = [(a, f, not f and rng.random() < 0.1) for a, f, _ in rows]
    got = conversations.align(np.array(["sua?".index(a) for a, _, _ in rows], np.uint8), np.array([f for _, f, _ in rows], bool), np.array([t for _, _, t in rows], bool))
    assert got == cheapest(tuple(rows))


def test_repair_of_damaged_rows_with_odd_ones(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No", "What?\n", "", " \n", None, "é!", "A b. c", "x" * 50_000 + "."]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "a."), (None, 3, None, None), (7, 2, "user", "Yes."), (7, 2, "user", "Yes."), (7, None, "user", "Yes."), (-5, 2**40, "assistant", "x"), (-5, -(2**40), "user", "y")]
    rows += [(1000, t, "user", f"t{t % 50}.") for t in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    same(conversations.repair(conversations.damage(df)).collect(), expected(rows))


def test_a_dropped_conversation_stays_and_an_empty_table_gives_nothing(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0)], KIND)
    row = conversations.repair(conversations.damage(df)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert not conversations.repair(conversations.damage(df.limit(0))).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect(), expected(rows))
