"""Matching and multiset hashes against their definitions."""

import hashlib
import json

import numpy as np
import pytest

from pulsegrid.operators import matching
from pulsegrid.operators.matching import deferred_acceptance
from pulsegrid.sources import tables

DAY = 24 * 60


def greedy(wanted, free):
    """Pairs of one person, the nearest first."""
    pairs = sorted((min((a - w) % DAY, (w - a) % DAY), a // DAY == w // DAY, slot, turn) for turn, w in wanted for slot, a in free)
    turns, slots, out = set(), set(), set()
    for apart, _, slot, turn in pairs:
        if turn not in turns and slot not in slots:
            turns.add(turn)
            slots.add(slot)
            out.add((turn, slot, apart))
    return out


def test_deferred_acceptance(spark):
    rng = np.random.default_rng(4)
    people = {"many": (40, 60), "few": (30, 9), "even": (5, 5), "no slot": (3, 0), None: (5, 20), "no wish": (0, 4)}
    wanted, free, expected = [], [], {}
    for p, (w, f) in people.items():
        moments = [(k + 1, int(x)) for k, x in enumerate(rng.integers(300, 330, w) if p == "even" else rng.integers(-DAY, 5 * DAY, w))]
        stretches = [(k, int(x)) for k, x in enumerate(rng.integers(0, 5 * DAY, f))]
        wanted += [(p, t, x) for t, x in moments]
        free += [(p, s, x) for s, x in stretches]
        expected[p] = greedy(moments, stretches)
    a = spark.createDataFrame([r for r in wanted if r[0] is not None], "p string, turn int, like long")
    b = spark.createDataFrame([r for r in free if r[0] is not None], "p string, slot long, start long")
    got = {}
    for r in deferred_acceptance(a, b, ["p"], DAY).collect():
        got.setdefault(r.p, set()).add((r.turn, r.slot, r.apart))
    for p, pairs in expected.items():
        if p is not None:
            assert got.get(p, set()) == pairs and len(pairs) == min(people[p])
    assert deferred_acceptance(a.limit(0), b, ["p"], DAY).count() == 0 and deferred_acceptance(a, b.limit(0), ["p"], DAY).count() == 0


def plain_hash(rows):
    total = sum(int(hashlib.sha256(json.dumps(r, separators=(",", ":")).encode()).hexdigest()[:32], 16) for r in rows) % (1 << 128)
    return len(rows), f"{total:032x}"


def test_hash_counts_repeated_rows(spark):
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    of = lambda df: tuple(tables.content_hash(df).values())
    assert of(table(1, 1)) != of(table(2, 2)) and of(table(1, 2, 1)) == of(table(2, 1, 1).repartition(3)) != of(table(1, 2, 2))
    for values in ([], [None, 3, 3], list(range(1000)) * 3):
        assert of(table(*values)) == plain_hash([{"v": v} for v in values])


@pytest.mark.parametrize("parts", [["k"], ["k", "j"]])
def test_differing_partitions(spark, parts):
    rows = [(k % 5 if k % 7 else None, k % 2, f"v{k % 3}") for k in range(100)]
    a = spark.createDataFrame(rows, "k int, j int, v string")
    b = spark.createDataFrame([(0, 0, "new"), (9, 1, "new"), *[r for r in rows if r[:2] != (3, 1)]], "k int, j int, v string")
    assert tables.differing_partitions(a, a.repartition(7), parts).count() == 0
    got = {tuple(r[:len(parts)]): tuple(r[len(parts):]) for r in tables.differing_partitions(a, b, parts).collect()}
    count = lambda table, key: sum(r[: len(parts)] == key for r in table)
    keys = {(0, 0)[: len(parts)], (9, 1)[: len(parts)], (3, 1)[: len(parts)]}
    assert got == {key: (count(rows, key), count([tuple(r) for r in b.collect()], key)) for key in keys}


@pytest.mark.parametrize("held", [0, 300])
def test_rounds_and_held_keys_agree(spark, monkeypatch, held):
    """The same matching whether keys go in rounds, in one row each, or some so and some so."""
    rng = np.random.default_rng(6)
    people = {"a": (25, 40), "b": (12, 20), "c": (3, 1), "d": (1, 300)}
    moments = {p: [(k + 1, int(x)) for k, x in enumerate(rng.integers(-DAY, 5 * DAY, w))] for p, (w, _) in people.items()}
    stretches = {p: [(k, (k * 240) % (5 * DAY)) for k in range(f)] for p, (_, f) in people.items()}
    a = spark.createDataFrame([(p, *x) for p, v in moments.items() for x in v], "p string, turn int, like long")
    b = spark.createDataFrame([(p, *x) for p, v in stretches.items() for x in v], "p string, slot long, start long")
    expected = {(p, *x) for p in people for x in greedy(moments[p], stretches[p])}
    seen = []
    rounds = matching._in_rounds
    monkeypatch.setattr(matching, "_in_rounds", lambda w, *more: seen.extend(r.p for r in w.select("p").distinct().collect()) or rounds(w, *more))
    assert {(r.p, r.turn, r.slot, r.apart) for r in deferred_acceptance(a, b, ["p"], DAY).collect()} == expected and not seen
    monkeypatch.setattr(matching, "HELD_PAIRS", held)
    assert {(r.p, r.turn, r.slot, r.apart) for r in deferred_acceptance(a, b, ["p"], DAY).collect()} == expected
    assert set(seen) == ({"a", "b", "c", "d"} if held == 0 else {"a"})
