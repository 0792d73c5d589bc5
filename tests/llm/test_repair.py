"""Conversation repair against all ways of editing short conversations, and associativity of the matrices."""

import hashlib
import random
import re
from itertools import product

import pytest

from siteledger.llm import repair
from siteledger.llm.queries import op11_repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def judged(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in turns:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def brute(turns):
    """cost, audit, repaired lines: the least over all keeps, reroles, deletions and up to two inserts in each gap."""
    best = None
    gap = ["", "u", "a", "ua", "au"]
    for edits in product(*[["D"] if t[3] in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for t in turns]):
        for added in product(gap, repeat=len(turns) + 1):
            roles, audit, cost, lines = "", "", 0, []
            for k in range(len(turns) + 1):
                roles, audit, cost = roles + added[k], audit + "I" * len(added[k]), cost + 2 * len(added[k])
                lines += [f"{'user' if c == 'u' else 'assistant'}:" for c in added[k]]
                if k < len(turns):
                    _, role, text, fault = turns[k]
                    e = edits[k]
                    audit, cost = audit + e[0], cost + {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and fault == "truncated")
                    if e != "D":
                        role = {"Ru": "user", "Ra": "assistant"}.get(e, role)
                        roles, lines = roles + (role[:1] or "-"), [*lines, f"{role}:{text}"]
            if LEGAL.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def conversations():
    draw = random.Random(5)
    texts = ["Good.", "Cut off", "", " \n", "Why?  ", "Good.", "a\tb!", "x."]
    rows = [(c, t if draw.random() < 0.8 else draw.choice([None, t + 2]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User"]), draw.choice(texts)) for c in range(30) for t in range(draw.randint(1, 3))]
    return [*rows, (None, 0, "user", "Hi"), (None, 0, "user", "Hi"), (None, None, "assistant", "Yes.")]


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_brute(spark, chunk):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")
    report, turns = repair.repair(frame, chunk=chunk, fan=2)
    got = {r.key.conv_id: r for r in report.collect()}
    hashes = {r.key.conv_id: r.sha256 for r in repair.digests(turns).collect()}
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: r.place):
        lines.setdefault(r.key.conv_id, []).append(f"{r.role}:{r.text}")
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        mine = judged([x[1:] for x in rows if x[0] == c])
        cost, audit, repaired = brute(mine)
        assert (r.cost, r.audit) == (cost, audit) and lines.get(c, []) == repaired, c
        assert hashes.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [sum(m[3] == f for m in mine) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        known = [m[0] for m in mine if m[0] is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)


def test_associative():
    draw = random.Random(1)
    for _ in range(50):
        kinds = "".join(draw.choice("ABCDEFGHI") for _ in range(draw.randint(2, 30)))
        at = draw.randint(1, len(kinds) - 1)
        assert repair.times(repair.product(kinds[:at]), repair.product(kinds[at:])) == repair.product(kinds)


def test_long(spark):
    """One conversation of 5,000 turns over many tasks: all kept but a repeated one in the middle."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." if i != 3001 else "Turn 2999.") for i in range(5000)]
    report, turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), chunk=64, fan=4)
    (r,) = report.collect()
    assert (r.cost, r.duplicate, r.illegal, len(r.audit)) == (5, 1, 0, 5001) and r.audit[3000:3004] == "KDIK"
    assert turns.count() == 5000


def test_query_empty_and_dropped(spark, tmp_path):
    one = [(i, 0, "user", None) for i in range(60)]  # conversations of a turn each; some are dropped whole
    for name, rows in (("none", []), ("some", one)):
        (tmp_path / name).mkdir()
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = op11_repair(spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows)
        assert all(r.repaired_sha256 == hashlib.sha256().hexdigest() and r.audit in ("", "D", "DD") and r.cost == 3 * len(r.audit) == 3 * r.blank for r in got)
        assert not rows or {r.audit for r in got} == {"", "D", "DD"}
