"""Repaired conversations against an exhaustive search for the cheapest edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from usetrail.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, at long"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        z = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if z == 0:
            continue
        text = "" if z == 1 else re.sub("[.!?]", "", text) if z == 2 else text
        out += [(conv, turn, "user" if z == 4 else role, text)] * (2 if z == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit) over rows (initial, fault): up to two insertions tried at every place, every edit of every row."""
    found = (plain(rows, extra) for extra in itertools.product((0, 1, 2), repeat=len(rows) + 1))
    return min(x for x in found if x is not None)


def plain(rows, extra):
    """Least (cost, audit) with exactly so many insertions before each row and at the end."""
    states = {"": (0, "")}

    def push(into, told, cost, audit):
        if re.fullmatch("s?(ua)*u?", told) and (told not in into or (cost, audit) < into[told]):
            into[told] = (cost, audit)

    for i in range(len(rows) + 1):
        for _ in range(extra[i]):
            into = {}
            for told, (cost, audit) in states.items():
                for role in "ua":
                    push(into, told + role, cost + 2, audit + "I")
            states = into
        if i < len(rows):
            initial, fault = rows[i]
            into = {}
            for told, (cost, audit) in states.items():
                push(into, told, cost + 3, audit + "D")
                if fault not in ("blank", "duplicate"):
                    more = int(fault == "truncated")
                    if initial in ("s", "u", "a"):
                        push(into, told + initial, cost + more, audit + "K")
                    for role in "ua":
                        push(into, told + role, cost + 2 + more, audit + "R")
            states = into
    done = [v for told, v in states.items() if re.fullmatch("(s?(ua)+)?", told)]
    return min(done, default=None)


def brute(rows):
    out = Counter()
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        seen, codes = set(), []
        for _, role, text in mine:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append((role[:1], fault))
        faults = Counter(f for _, f in codes)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = cheapest(tuple(codes)) if codes else (0, "")
        shown, told, left = [], "", list(mine)
        for edit in audit:
            forced = "assistant" if told.endswith("u") else "user"
            role, text = (forced, "") if edit == "I" else (None, None)
            if edit != "I":
                _, own, text = left.pop(0)
                role = {"K": own, "R": forced, "D": None}[edit]
            if role is not None:
                shown.append(f"{role}:{text}")
                told += role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(shown).encode()).hexdigest()
        out[(conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)] += 1
    return out


def corpus():
    rng = random.Random(2)
    rows = []
    for conv in [None, *range(70)]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["One.", "Two!", "cut off", "", " \n", None, "Why?\t", "One.", "x" * 3000])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), role, text))
    rows.append((500, next(t for t in range(999) if zlib.crc32(f"500:{t}".encode()) % 20 == 0), "user", "Dropped."))
    return rows


@pytest.mark.parametrize("piece", [4096, 1, 2])
def test_repairs_equal_exhaustive_search(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = corpus()
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(3)
    found = repair.repaired(repair.damaged(table), table).collect()
    assert Counter(tuple(r) for r in found) == brute(rows)


def test_walk_equals_exhaustive_search_and_pieces():
    faults = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    rng = random.Random(8)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(1, 6)))
        want = cheapest(tuple(("suao"[c & 3], faults[c >> 2]) for c in codes))
        assert repair.audit_of(codes) == want
        cut = rng.randrange(len(codes) + 1)
        parts = [p for p in (codes[:cut], codes[cut:]) if p]
        pieces = [repair._run(1, [(n, None, c) for n, c in enumerate(p, 100 * k)], False) for k, p in enumerate(parts)]
        told = repair.joined(pieces)
        assert (told["cost"], told["audit"]) == want


def test_audits_are_ordered_like_their_texts(monkeypatch):
    rng = random.Random(5)
    for prime in (repair.PRIME, 3):  # with 3 nearly all hashes collide
        monkeypatch.setattr(repair, "PRIME", prime)
        nodes = [repair.Node()]
        for _ in range(400):
            nodes.append(repair.Node(rng.choice(nodes), rng.choice(["D", "I", "K", "R", "DK", "KKD"])))
        for _ in range(2000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert repair.before(a, b) == (a.text() < b.text())


def test_a_long_conversation_is_cut_into_pieces(spark):
    rows = [(1, n, "user" if n % 2 else "assistant", f"Text {n}.") for n in range(20000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in repair.repaired(table).collect()}
    assert (found[1].cost, found[1].audit) == (4, "I" + "K" * 20000 + "I")
    assert (found[2].cost, found[2].audit) == (2, "KI")


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(none), none).collect() == []
