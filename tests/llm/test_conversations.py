"""Conversation repair against a search over all edits, with pieces small enough that conversations are cut."""

import hashlib
import heapq
import random
import zlib

import pytest

from tunegrid.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\t\n\x0b\f\r "
MORE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def damage(rows):
    out, convs = [], set()
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        convs.add(conv)
        kind, role, text = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20, told(role), told(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, convs


def cheapest(rows):
    """(cost, audit, lines) by a search in order of (cost, audit): the first end met is the answer."""
    heap, met = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, lines
        if (at, state) in met:
            continue
        met.add((at, state))
        to, role = MORE[state]
        heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*lines, f"{role}:")))
        if at < len(rows):
            own, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                fits = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((own[:1], state))
                if fits is not None:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, fits, (*lines, f"{own}:{text}")))
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", at + 1, to, (*lines, f"{role}:{text}")))


def brute(rows):
    hurt, convs = damage(rows)
    out = []
    for conv in convs:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            judged.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""))
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        count = lambda f: sum(j[2] == f for j in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", " ", "Line.\n", "é."] + [f"text {k}." for k in range(40)]
    roles = ["user", "assistant", "system", "tool", "", None, "usurper", "User"]
    pick = lambda: (rng.choice(roles[:3] * 6 + roles), rng.choice([*texts, None]))
    found = [(conv, rng.choice([*range(30), None]), *pick()) for conv in range(60) for _ in range(rng.randrange(12))]
    found += [(900, t, *pick()) for t in range(400)] + [(None, k % 7, *pick()) for k in range(15)]
    found += [(901, 3, "user", "Again.")] * 120 + [(902, None, "assistant", None)] * 3
    found += [(k, t, "user" if t % 2 else "assistant", "Fine.") for k in range(1000, 1100) for t in range(1)]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("piece,per_task", [(20_000, 100_000), (7, 100), (1, 30)])
def test_equals_search(spark, rows, monkeypatch, piece, per_task):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    monkeypatch.setattr(conversations, "ROWS_PER_RANGE", per_task)
    turns = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", piece long, fault int, audit string").repartition(5)
    got = conversations.summaries(conversations.repair_conversations(conversations.damaged(turns)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_real_outputs_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "cut"), (1, 2, "system", "S."), (1, 3, "assistant", "Bye.")]
    turns = spark.createDataFrame([(*r, False) for r in rows], SCHEMA + ", gone boolean")
    (r,) = conversations.repair_conversations(turns).collect()
    assert (r.cost, r.audit, r.roles, r.texts) == (8, "KDDK", ["user", "assistant"], ["Hi.", "Bye."])
    assert conversations.summaries(conversations.repair_conversations(turns.limit(0))).collect() == []
