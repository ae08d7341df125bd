"""Conversation repair: the integer minimum against a search over all edits; whole results against plain code."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import __spark_entry__ as E
from basketcast.llm import repair

SF = "/root/testdata/sf0.001"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def search(initials, faults):
    """Least (cost, letters) over all ways to delete, keep, rerole and insert up to two rows in each gap."""
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    choices = [[("D", 4, "")] if f in (1, 2) else
               [("D", 4, ""), ("K", 3 * (f == 3), x), ("R", 3 + 3 * (f == 3), "u"), ("R", 3 + 3 * (f == 3), "a")]
               for x, f in zip(initials, faults, strict=True)]
    for gaps in itertools.product(inserts, repeat=len(initials) + 1):
        for edits in itertools.product(*choices):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
            for (letter, price, role), gap in zip(edits, gaps[1:], strict=True):
                roles, audit, cost = roles + role + gap, audit + letter + "I" * len(gap), cost + price
            if SHAPE.match(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_integer_minimum_by_search():
    rng = random.Random(5)
    for n in range(4):
        for _ in range(60):
            initials = "".join(rng.choice("suax ") for _ in range(n))
            faults = bytes(rng.choice((0, 0, 1, 2, 3)) for _ in range(n))
            assert repair.least_edits(initials, faults) == search(initials, faults), (initials, faults)


def test_long_conversation():
    n = 4000
    cost, audit = repair.least_edits("s" + "ua" * n + "u", bytes(2 * n + 2))
    assert (cost, audit) == (3, "K" * (2 * n + 2) + "I")


def plain(rows):
    """The contract's columns from ``conv_id, turn, role, text``, one row after the other."""
    out = []
    for conv in {r[0] for r in rows}:
        hurt = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            hurt += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = {t for t, _, _ in hurt if t is not None}, set(), []
        for _, role, text in hurt:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append(1 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 3)
            seen.add((role, text))
        initials = [r[1][:1] for r in hurt]
        cost, audit = repair.least_edits("".join(x or " " for x in initials), bytes(faults))
        put, i = [], 0
        total = sum(x != "D" for x in audit)
        for letter in audit:
            own = hurt[i] if letter != "I" else None
            i += letter != "I"
            if letter == "D":
                continue
            made = ("user", "assistant")[(len(put) - total % 2) % 2]
            put.append(f"{own[1] if letter == 'K' else made}:{own[2] if own else ''}")
            assert letter != "K" or own[1][:1] == (made[0] if len(put) > total % 2 else "s")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials)), cost, audit,
                    hashlib.sha256("\n".join(put).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, E.queries()["op12_conversation_repair"](spark, SF).collect()), key=str) == plain(rows)


AWKWARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why"), (1, 2, "assistant", "So."), (1, 2, "assistant", "So."), (1, 9, "user", " \t\x0b"),
    (2, None, "user", "First."), (2, None, None, "x."), (2, 5, "assistant", None), (2, 5, "assistant", ""), (2, 7, "", "no role."),
    (None, 1, "user", "Nobody?"), (None, 2, "tool", "1" * 200_000 + "."), (None, None, "assistant", "Ends.\n \r"),
    *[(3, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(60)], (4, 3, None, None), (5, 1, "ünder", "é!")]


def test_awkward_rows(spark):
    rows = spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS conv", "3 AS audit")
    hurt, lost = repair.damage(rows.repartition(3))
    got = sorted(map(tuple, repair.repair_conversations(hurt, dropped=lost).collect()), key=str)
    assert got == plain(AWKWARD) and {r[0] for r in got} == {1, 2, 3, 4, 5, None}
    assert repair.repair_conversations(rows.limit(0)).count() == 0


def test_all_rows_lost(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"8:{k}".encode()) % 20 == 0)
    hurt, gone = repair.damage(spark.createDataFrame([(8, lost, "user", "x.")], "conv_id long, turn long, role string, text string"))
    got = repair.repair_conversations(hurt, dropped=gone).collect()
    assert [tuple(r) for r in got] == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("n", [1, 7])
def test_repaired_rows_have_the_shape(spark, n):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where(f"conv_id % {n} = 0")
    audits = repair.audit_conversations(rows).cache()
    by_key = {}
    for r in repair.repaired_rows(rows, audits).collect():
        by_key.setdefault(r.key, []).append((r.place, r.role))
    for turns in by_key.values():
        assert SHAPE.match("".join(role[0] for _, role in sorted(turns)))
        assert [p for p, _ in sorted(turns)] == list(range(len(turns)))
