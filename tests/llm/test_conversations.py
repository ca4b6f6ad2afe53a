"""Conversation repair against a fold over all ways, with chunks of a few rows; the planted worst cases for guesses."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from verdictlab.llm import conversations as cv, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, edits string"
NAMES = {"u": "user", "a": "assistant"}


def plain(rows):
    """By conversation ``(blank, duplicate, truncated, illegal, cost, audit, digest)`` of ``(conv, turn, role, text)``."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r if r is not None else " ", x if x is not None else " "))
    out = {}
    for conv, own in by.items():
        own.sort()
        seen, n, illegal, before = set(), [0, 0, 0], 0, None
        ways = {0: (0, "", ())}
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if solid == "" else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            extra = 5 if fault == 2 else 0
            reach = {}
            for s, way in ways.items():
                for k in range(4):
                    cost, audit, lines = way
                    state = s
                    for _ in range(k):
                        new = "a" if state == 2 else "u"
                        state, cost, audit, lines = (3 if new == "a" else 2), cost + 5, audit + "I", (*lines, f"{NAMES[new]}:")
                    reach.setdefault(state, []).append((cost + 2, audit + "D", lines))
                    if fault in (0, 1):
                        continue
                    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state].get(role[:1])
                    if kept is not None:
                        reach.setdefault(kept, []).append((cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                    new = "a" if state == 2 else "u"
                    reach.setdefault(3 if new == "a" else 2, []).append((cost + extra + 1, audit + "R", (*lines, f"{NAMES[new]}:{text}")))
            ways = {s: min(w) for s, w in reach.items()}
        ends = {0: (0, "", ()), 1: (10, "II", ("user:", "assistant:")), 2: (5, "I", ("assistant:",)), 3: (0, "", ())}
        cost, audit, lines = min((c + ends[s][0], a + ends[s][1], t + ends[s][2]) for s, (c, a, t) in ways.items())
        out[conv] = (*n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    fixed = cv.repair(df, **how)
    report = {r["conv"]: r for r in fixed.report.collect()}
    digests = {r["conv"]: (r["audit"], r["repaired_sha256"]) for r in cv.audits(fixed.edits).collect()}
    return {c: (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], *digests[c]) for c, r in report.items()}


def some(seed, n, roles, texts, convs):
    r = random.Random(seed)
    return [(r.choice(convs), r.choice([None, *range(n)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "No!", "Why?", "open", " \n", "", None, *[f"Word {i}." for i in range(40)]]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_ways(spark, seed):
    rows = some(seed, 400, ROLES, TEXTS, [*range(60), None])
    assert repaired(spark, rows) == plain(rows)


@pytest.mark.parametrize("fixups", [0, 1, 3])
def test_one_hot_conversation_in_many_chunks(spark, fixups):
    rows = some(fixups, 260, ROLES[:5], [f"Text {i}." for i in range(900)] + ["open"] * 50, [7]) + some(9, 60, ROLES, TEXTS, [*range(20), None])
    assert repaired(spark, rows, chunk=8, fixups=fixups) == plain(rows)


@pytest.mark.parametrize("role", ["tool", "user"])
@pytest.mark.parametrize("end", [".", ""])
def test_what_never_converges_is_told_by_matrices(spark, role, end):
    rows = [(1, i, role if i else "system", f"row {i}{end}") for i in range(150)] + [(2, i, "tool", f"row {i}.") for i in range(61)]
    assert repaired(spark, rows, chunk=4, fixups=2) == plain(rows)


def test_all_roles_of_the_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "user", "b."), (1, 3, "assistant", "c."), (1, 4, "user", "d.")]
    edits = cv.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).edits.orderBy("id", "place").collect()
    kept = [e["role"] for e in edits if e["edit"] != "D"]
    assert kept == ["user", "assistant"] * (len(kept) // 2)
    assert [(e["turn"], e["fault"]) for e in edits if e["edit"] == "D"][0][1] in (None, "duplicate")


def test_empty_repeated_and_very_long(spark):
    assert repaired(spark, []) == {}
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 0, "user", "x" * 3_000_000 + "."), (1, None, None, None), (None, None, "assistant", "y" * 2_000_000)]
    rows += [(5, 3, "user", "Same.")] * 300
    got = repaired(spark, rows, chunk=16)
    assert got == plain(rows) and got[5][1] == 299


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF).collect()
    assert sorted(r["conv_id"] for r in got) == sorted({r[0] for r in rows})
    damaged = [tuple(r) for r in queries._damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    want = plain(damaged)
    none = (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for r in got:
        assert tuple(r[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want.get(r["conv_id"], none)
