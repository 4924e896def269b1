"""Conversation repair against all edit sequences, and long conversations in segments against short ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessella.llm import conversations

SF = "/root/testdata/sf0.001"
NONE = hashlib.sha256(b"").hexdigest()


def every(items, most_inserts):
    """All (cost, audit, roles) of edit sequences, by trying each."""
    def go(i, cost, audit, roles, inserts):
        if i == len(items):
            yield cost, audit, roles
        if inserts < most_inserts:
            for r in "ua":
                yield from go(i, cost + 3, audit + "I", roles + r, inserts + 1)
        if i < len(items):
            initial, fault = items[i]
            yield from go(i + 1, cost + 4, audit + "D", roles, inserts)
            if fault not in ("blank", "duplicate"):
                charge = 3 * (fault == "truncated")
                yield from go(i + 1, cost + charge, audit + "K", roles + (initial or "-"), inserts)
                for r in "ua":
                    yield from go(i + 1, cost + charge + 3, audit + "R", roles + r, inserts)

    return min((c, a) for c, a, roles in go(0, 0, "", "", 0) if re.fullmatch("(s?(ua)+)?", roles))


def as_items(faulty):
    return [1 if f in ("blank", "duplicate") else (x, f == "truncated") for x, f in faulty]


def test_search_against_every_edit_sequence():
    rng = random.Random(5)
    for _ in range(400):
        items = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(4))]
        assert min(conversations.search(as_items(items)).values()) == every(items, 3)


def layered(items):
    """(cost, audit) by a plain table of layers, for items that every() can't go through."""
    nxt = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    now = {0: (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a) in list(out.items()):
                t = nxt[s][1]
                out[t] = min(out.get(t, (10**9, "")), (c + 3, a + "I"))
        return out

    for x, fault in items:
        new = {}
        for s, (c, a) in inserted(now).items():
            ways = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                t = 3 * (fault == "truncated")
                ways.append((nxt[s][1], t + (0 if x == nxt[s][0] else 3), "K" if x == nxt[s][0] else "R"))
                ways += [(1, t, "K")] if s == 0 and x == "s" else []
            for to, more, e in ways:
                new[to] = min(new.get(to, (10**9, "")), (c + more, a + e))
        now = new
    now = inserted(now)
    return min(now[s] for s in (0, 3) if s in now)


def plain(rows):
    """conv_id -> report, from original rows (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        held[c] += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = {}
    for c, own in held.items():
        own.sort(key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
        seen, items, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            items.append((role[:1], fault))
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(items, items[1:], strict=False))
        turns = {t for known, t, *_ in own if known}
        cost, audit = layered(items)
        done, s, it = [], 0, iter(own)
        for k, e in enumerate(audit):
            row = next(it) if e != "I" else None
            if e == "D":
                continue
            if e == "K":
                s = s or (not done and row[2][:1] == "s")
                done.append(f"{row[2]}:{row[3]}")
            else:
                done.append(f"{('user', 'assistant')[(len(done) - s) % 2]}:{row[3] if row else ''}")
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def made(rng, convs, most):
    texts = ["Yes.", "No?", "cut", "", " \t", "Ünder 😀!", "a.b", "long " * 20 + ".", None, ".", "x\n"]
    return [(rng.choice([c, c, c]) if c else None, rng.choice([None, *range(most)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(most))]


def compare(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("x"), "pos": F.lit(1), "place": F.lit(2)}).repartition(3)
    got = conversations.repair(conversations.damaged(df))
    found = {r[0]: tuple(r[1:]) for r in got.report.collect()}
    expected = plain(rows)
    assert len(found) == got.report.count() == len(expected)
    for c in expected:
        assert found[c] == expected[c], c
    held = defaultdict(list)
    for r in got.rows().orderBy("place").collect():
        held[r.conv_id].append(f"{r.role}:{r.text}")
    for c in expected:
        assert hashlib.sha256("\n".join(held[c]).encode()).hexdigest() == expected[c][-1]


def test_damage_and_repair(spark):
    compare(spark, made(random.Random(2), 60, 9))
    compare(spark, [])


@pytest.mark.parametrize("rows, fan", [(4, 2), (32, 16)])
def test_long_conversations_in_segments(spark, monkeypatch, rows, fan):
    monkeypatch.setattr(conversations, "LONG_ROWS", rows)
    monkeypatch.setattr(conversations, "FAN", fan)
    rng = random.Random(3)
    few = made(rng, 12, 40)
    copies = [(7, 3, "user", "Same."), (7, 4, "user", " ")] * 90
    compare(spark, few + copies + [(None, t, rng.choice(["user", "assistant"]), "Turn %d." % t) for t in range(150)])


def test_long_by_bytes_and_dropped_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_BYTES", 500)
    dropped = next(t for t in range(1000) if zlib.crc32(b"5:%d" % t) % 20 == 0)
    compare(spark, [(5, dropped, "user", "gone.")] * 3 + [(6, 1, "user", "word " * 400_000 + "."), (6, 2, "assistant", "Yes.")])
    monkeypatch.setattr(conversations, "LONG_ROWS", 2)
    compare(spark, [(5, dropped, "user", "gone.")] * 3 + [(8, None, None, None)] * 4)


def test_replay_inserts_and_reroles():
    rows = [("system", "S."), ("assistant", "A."), ("tool", "T.")]
    assert list(conversations.replayed(rows, "KIKR")) == [("system", "S.", "K"), ("user", "", "I"), ("assistant", "A.", "K"), ("user", "T.", "R")]
    assert conversations.digest([]) == NONE


def test_suffix_sums_never_exceed_the_rest():
    rng = random.Random(6)

    @cache
    def rest(items):
        return layered(items)[0]

    for _ in range(200):
        faulty = tuple((rng.choice("sua"), rng.choice(["", "blank", "truncated"])) for _ in range(6))
        assert conversations.suffix_sums(as_items(faulty))[0] <= rest(faulty)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in conversations.query(spark, SF).collect()}
    assert got == plain(rows)
