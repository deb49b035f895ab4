import datetime as dt
import random

import pytest

from loomsite.operators.snapshot_diff import _hash, _signed64, peel, snapshot_changes

DDL = "domain string, snapshot_id string, url string, title_hash string, paragraph_hash string, delivered_at timestamp, extra string, key bigint, val string"
T = dt.datetime(2024, 1, 1)


def row(d, s, u, t, p, at=T):
    return (d, s, u, t, p, at, "x", 1, "y")


def brute(rows):
    state = {}
    for d, s, u, t, p, at, *_ in sorted(rows, key=lambda r: (r[5] is not None, r[5] or T)):
        if d is None or s is None or u is None:
            continue
        norm = lambda x: None if x is None else x.strip().lower()
        state.setdefault(d, {}).setdefault(s, {})[u.rstrip("/")] = (norm(t), norm(p))
    out = set()
    for d, snaps in state.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            for u in snaps[a].keys() | snaps[b].keys():
                x, y = snaps[a].get(u), snaps[b].get(u)
                if x != y:
                    out.add((d, b, u, "added" if x is None else "removed" if y is None else "changed"))
    return out


def run(spark, rows, **kw):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, DDL), **kw).collect()}


def test_cases(spark):
    rows = [
        row("a", "1", "u/", "T", "P"), row("a", "1", "v", None, "P"), row("a", "1", "w", "T", "P"), row("a", "1", "w", "T", "P"),
        row("a", "2", "u", " t ", "p"), row("a", "2", "v", "x", "P"), row("a", "2", "n", "T", None), row("a", "2", "n", "Z", None, T - dt.timedelta(1)),
        row("b", "1", "u", "T", "P"), row(None, "1", "u", "T", "P"), row("a", None, "u", "T", "P"), row("a", "2", None, "T", "P"),
    ]
    assert run(spark, rows) == {("a", "2", "v", "changed"), ("a", "2", "w", "removed"), ("a", "2", "n", "added")} == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


@pytest.mark.parametrize("kw", [{}, {"cells": 2, "attempts": 2}, {"cells": 2, "attempts": 1}])
def test_random_against_brute_force(spark, kw):
    rnd = random.Random(5)
    rows = []
    for s in range(4):
        for u in range(900):
            if rnd.random() < 0.9:
                rows.append(row("hot" if u % 3 else "d", f"{s}", f"u{u}", f"t{rnd.randrange(4)}", rnd.choice([None, "p", "P "])))
    assert run(spark, rows, **kw) == brute(rows)


def test_hash_is_sparks(spark):
    got = spark.sql("select xxhash64(-5L, 77L) as h").first().h
    assert _signed64(_hash(-5, 77)) == got


def test_peel_refuses_what_it_cannot_empty():
    assert peel([(0, 2, 1, 1, 1), (-1, 2, 0, 0, 0)], 8) is None
    assert peel([], 8) == []
