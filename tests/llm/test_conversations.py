"""Repair of conversations against a dynamic programme over whole conversations that compares edits as texts."""

import hashlib
import random
import re
import zlib

import pytest

from flowlens.llm import conversations

SPACE = " \t\n\v\f\r"


def slow_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if part == 1:
            text = ""
        if part == 2:
            text = re.sub("[.!?]", "", text)
        for _ in range({0: 0, 3: 2}.get(part, 1)):
            yield conv, turn, "user" if part == 4 else role, text


def slow_repair(rows):
    """rows: (turn, role, text), damaged."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def closed(best):
        for _ in range(4):
            for at in after:
                for role in ("user", "assistant"):
                    if role[0] in after[at] and role[0] in best:
                        cost, audit, out = best[role[0]]
                        option = (cost + 2, "I" + audit, (f"{role}:", *out))
                        best[at] = min(best.get(at, option), option)
        return best

    best = closed(best)
    for (_, role, text), fault in list(zip(rows, faults))[::-1]:
        now = {}
        for at in after:
            options = []
            if at in best:
                options.append((best[at][0] + 3, "D" + best[at][1], best[at][2]))
            if fault in ("", "truncated"):
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new[:1] and new[0] in after[at] and new[0] in best:
                        cost, audit, out = best[new[0]]
                        options.append((cost + price + (fault == "truncated"), letter + audit, (f"{new}:{text}", *out)))
            if options:
                now[at] = min(options)
        best = closed(now)
    cost, audit, out = best[""]
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def slow(rows):
    left = {r[0]: [] for r in rows}
    for conv, *rest in slow_damage([r[:4] for r in rows]):
        left[conv].append(tuple(rest))
    return sorted(((conv, *slow_repair(own)) for conv, own in left.items()), key=repr)


def drawn(seed, convs=80, long=400):
    draw, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(long if conv == 3 else draw.choice([1, 2, 3, 5, 8, 12])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice([f"Said {draw.randrange(40)}.", "Same words!", "", " \n", None, "cut off", f"More {turn}? ", "two\nlines."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), role, text, 7))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, chunk int"


@pytest.mark.parametrize("chunk", [4096, 1, 3, 16])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = drawn(chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, conversations.repair_report(df).collect()), key=repr)
    assert got == slow(rows)


def test_repair_of_deletions(spark, monkeypatch):
    """Chunks in which every row must go hand on what they are given."""
    monkeypatch.setattr(conversations, "LONGEST", 5)
    rows = [(1, t, "user", " ", 0) for t in range(200)] + [(1, 300, "assistant", "Yes.", 0), (2, 1, "user", "No.", 0)]
    got = sorted(map(tuple, conversations.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == slow(rows)


def test_repaired_rows(spark):
    rows = [r for r in drawn(5) if r[0] is not None]
    damaged = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    out = conversations.repaired(damaged, keep_rows=True).collect()
    for got in map(tuple, conversations.repaired(damaged).collect()):
        own = sorted((r for r in out if r["conv_id"] == got[0]), key=lambda r: r["position"])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == got[-1]
        assert [r["edit"] for r in own] == [c for c in got[-2] if c != "D"]


def test_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, conversations.repair_report(df).collect()), key=repr) == slow(rows)


def test_fix_up_is_a_new_pass():
    draw = random.Random(4)
    for _ in range(500):
        codes = bytes(draw.choice([0, 1, 2, 2, 3, 3, 14, 15, 6, 7, 12]) for _ in range(draw.randrange(40)))
        ends = [conversations.TERMINAL]
        for _ in range(5):
            ends.append(conversations.step(ends[-1], draw.randrange(16))[0])
        vectors, base = conversations.backward(codes, ends[0])
        again = conversations.fix_up(codes, vectors, base, ends[-1]) if codes else None
        if codes:
            assert again[:2] == conversations.backward(codes, ends[-1])


def test_empty_table(spark):
    assert conversations.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
