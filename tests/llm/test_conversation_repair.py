"""Conversation repair against brute force: whole suffixes compared from the end, parts of any size, one long conversation, nulls."""

import functools
import hashlib
import random
import zlib

import pytest

from millrace.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def mended(rows):
    """Faults and cheapest edits of one conversation's (turn, role, text) in order; the best ends are known before what stands in front of them."""
    seen, faults = set(), []
    for _, role, text in rows:
        plain = text.strip(SPACE)
        faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "p") else []
        if inserts < 2:
            for made in "ua":
                if made in NEXT[state]:
                    cost, audit, lines = best(i, NEXT[state][made], inserts + 1)
                    ways.append((cost + 2, "I" + audit, ({"u": "user", "a": "assistant"}[made] + ":", lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                for name, edit, price in [(role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)]:
                    if name[:1] in NEXT[state]:
                        cost, audit, lines = best(i + 1, NEXT[state][name[:1]], 0)
                        ways.append((cost + price + (faults[i] == "truncated"), edit + audit, (f"{name}:{text}", lines)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    for i in range(len(rows), -1, -1):
        for state in NEXT:
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    told = []
    while lines:
        told.append(lines[0])
        lines = lines[1]
    return faults, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def brute(rows):
    convs = {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for conv, *row in damage(rows):
        convs[conv].append(tuple(row))
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, cost, audit, sha = mended(held)
        turns = [t for t, *_ in held if t is not None]
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, kind string, part int, same string")


def talk(pick, conv, n):
    says = ["Hello there.", "No end", "Really?", "", " \t", "Yes!", "Same words.", "Same words.", "ünïcode … ok."]
    roles = pick.choice([["user", "assistant"], ["user", "user", "assistant", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant", "user", "tool", "system", "", None]])
    rows, turn = [], 0
    for i in range(n):
        turn += pick.choice([1, 1, 1, 1, 0, 3])
        role = roles[i % len(roles)] if pick.random() < 0.9 else pick.choice(["user", "assistant", "system"])
        text = pick.choice(says) if pick.random() < 0.3 else f"Turn {i} of {conv}" + pick.choice([".", "", "!"])
        rows.append((conv, None if pick.random() < 0.05 else turn, role, None if pick.random() < 0.02 else text))
    return rows


@pytest.mark.parametrize("segment", [cr.SEGMENT, 3])
def test_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    pick = random.Random(13)
    rows = [r for c in range(150) for r in talk(pick, c, pick.randint(1, 14))] + talk(pick, 500, 400) + talk(pick, None, 20)
    rows += [(600, 1, "user", "Only this.")] * 5 + [(601, None, None, None)] * 3 + [(602, t, "user", "Again and again.") for t in range(40)]
    rows += [(603, t, ("user", "user", "assistant", "assistant")[t % 4], f"Ties {t}.") for t in range(200)]
    got = cr.repair_damaged(frame(spark, rows).repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_dropped_rows_leave_their_conversation(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert [tuple(r) for r in cr.repair_damaged(frame(spark, [(gone, 1, "user", "Hi.")])).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair_damaged(frame(spark, []).limit(0)).count() == 0


def test_only_what_is_undecided_is_held():
    ways, held, given = cr.Survivors(), 0, []
    for i in range(20_000):
        ways.advance((cr.OF_ROW if i else cr.OF_FIRST)[("u", "a")[i % 2], i % 97 == 0, i % 13 == 0])
        given += ways.decided()
        held = max(held, max(n.depth for _, n in ways.at.values()) - ways.root.depth)
    assert held < 60 and len(given) + len(ways.finish()[1]) == 20_000


def test_query_against_brute_force(spark, small):
    from millrace.llm.queries import op13_conversations

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13_conversations(spark, small).collect()), key=str) == brute(rows)
