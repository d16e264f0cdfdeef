"""Conversation repair: alignments against a search over all edits, whole results against a plain model, odd inputs."""

import hashlib
import random
import re

import pytest

from spanqa.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string, key string, block string, _h string, conv string"


def cheapest(syms, faults, state, goal):
    """Best (cost, audit) by a walk over turns that keeps the best of every state of the grammar."""
    def close(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                x = "a" if s == "u" else "u"
                best[x] = min(best.get(x, (c + 5, a + "I")), (c + 5, a + "I"))
        return best

    cur = close({state: (0, "")})
    for s, f in zip(syms, faults):
        nxt = {}
        for st, (c, a) in cur.items():
            x = "a" if st == "u" else "u"
            ways = [(st, c + 2, "D")]
            if f not in "12":
                more = 5 if f == "3" else 0
                ways += [(x, c + 1 + more, "R")] + ([(x, c + more, "K")] if s == x else [])
                ways += [("s", c + more, "K")] if st == "" and s == "s" else []
            for to, cost, letter in ways:
                nxt[to] = min(nxt.get(to, (cost, a + letter)), (cost, a + letter))
        cur = close(nxt)
    return min((v for s, v in cur.items() if C.reaches(state, goal, s)), default=None)


def test_alignments():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.choice([0, 1, 2, 3, 5, 8, 13])
        syms = "".join(rnd.choices("suax", [1, 4, 4, 1], k=n))
        faults = "".join(rnd.choices("0123", [6, 1, 1, 1], k=n))
        state, goal = rnd.choice(C.STATES), rnd.choice([*C.STATES, C.END])
        assert C.align(syms, faults, state, goal) == cheapest(syms, faults, state, goal), (syms, faults, state, goal)


def model(conv, turns):
    """One conversation's (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), and its repaired turns."""
    def order(t):
        name = "" if conv is None else f"={conv}"
        key = f"{name}:{len(t[1].encode())}:{t[1]}:{t[2]}"
        return t[0] is not None, t[0] or 0, t[1], hashlib.sha256(key.encode()).hexdigest()

    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=order)
    faults, seen = "", set()
    for _, role, text in turns:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        faults += "1" if not chars else "2" if (role, text) in seen else "0" if chars[-1] in ".!?" else "3"
        seen.add((role, text))
    syms = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for _, r, _ in turns)
    cost, audit = cheapest(syms, faults, "", C.END)
    out, i = [], 0
    for letter in audit:
        nxt = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((nxt, "", letter))
            continue
        if letter != "D":
            out.append((turns[i][1] if letter == "K" else nxt, turns[i][2], letter))
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _, _ in out))
    nums = [t for t, _, _ in turns if t is not None]
    gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
    illegal = sum(p not in ("su", "ua", "au") for p in zip_pairs(syms))
    return (gaps, faults.count("1"), faults.count("2"), faults.count("3"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in out).encode()).hexdigest()), out


def zip_pairs(s):
    return [a + b for a, b in zip(s, s[1:])]


@pytest.fixture(scope="module")
def talks():
    """Conversations of up to 150 turns (many blocks), one of equal rows, odd ones."""
    rnd = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rnd.choice([1, 2, 4, 7, 7, 20, 150 if c % 20 == 0 else 9])):
            role = "system" if t == 0 and rnd.random() < .4 else ("user", "assistant")[(t + (rnd.random() < .1)) % 2]
            rows.append((c, t * (1 + (rnd.random() < .05)), role, rnd.choice(["a.", "b!", "c?", "d", " ", "é.", "f. \n"]) + str(t) * (t % 3 == 0) + "."))
    rows += [(70, 5, "user", "same.")] * 300
    rows += [(None, None, None, None), (None, 3, "user", "q."), (None, None, "assistant", "r."), (71, 1, "", "x."), (71, 2, "tool", "y."),
             (72, -2**62 - 9, "user", "z."), (72, 2**62, "assistant", ""), (73, 0, "user", "w " * 100_000 + "end.")]
    return rows


@pytest.mark.parametrize("block", [7, 64])
def test_whole_results(spark, talks, block):
    df = spark.createDataFrame([(*r, "k", "b", "h", "c") for r in talks], ROWS).repartition(5)
    convs = {}
    for c, *r in talks:
        convs.setdefault(c, []).append(r)
    got = {r.conv_id: tuple(r)[1:] for r in C.audits(df, block).collect()}
    lines = {}
    for r in C.repair(df, block).collect():
        lines.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.edit))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        facts, out = model(c, turns)
        if c == 72:
            facts = (2**63 - 1, *facts[1:]) if facts[0] < 2**63 else (None, *facts[1:])
        assert got[c] == facts, c
        assert sorted(lines.get(c, [])) == [(i, *t) for i, t in enumerate(out, 1)], c


def test_none_and_damage(spark):
    none = spark.createDataFrame([], ROWS)
    assert C.audits(none).collect() == [] and C.repair(none).collect() == [] and C.damage(none).collect() == []
    import zlib
    rows = [(c, t, "assistant", "a. b! c?") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    got = {}
    for r in C.damage(spark.createDataFrame([(*r, "", "", "", "") for r in rows], ROWS)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if h == 4 else role or " ", "" if h == 1 else "a b c" if h == 2 else text or " ")
        assert got.get((c, t), []) == [one] * (0 if h == 0 else 2 if h == 3 else 1)
