from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from assayer.llm import minhash


def say(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "eps", "zeta", "eta"]) + str(rng.randint(0, 60)) for _ in range(n))


def sets_of(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_edits_follow_the_next_document(make):
    rng = random.Random(1)
    rows = [(i * 3, say(rng, rng.randint(0, 300))) for i in range(70)] + [(7, None), (8, ""), (10, "é"), (11, "word " * 30_000)]
    got = {r.doc_id: r for r in minhash.compare_with_edits(make(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    prints = {r.doc_id: r.fingerprint for r in got.values()}
    for k, (i, t) in enumerate(order):
        j, nxt = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        pair = [np.frombuffer(bytes.fromhex(x), ">u2") for x in (r.fingerprint, r.edited_fingerprint, prints[j])]
        assert r.near_edited == (pair[0] == pair[1]).mean() and r.near_next == (pair[0] == pair[2]).mean()
        a, b = sets_of(t), sets_of(edited)
        if a and b:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2


def test_edits_of_ties_nulls_and_few_rows(make):
    assert minhash.compare_with_edits(make([])).count() == 0
    r = minhash.compare_with_edits(make([(4, "abcdef")])).collect()
    assert [(x.doc_id, x.edited_sha256) for x in r] == [(4, hashlib.sha256(b"abcabc").hexdigest())] and r[0].near_next == 1.0
    rows = [(1, "aa bb"), (1, "aa bb"), (None, "cc dd"), (2, "aa bb")]
    out = minhash.compare_with_edits(make(rows)).collect()
    assert sorted(str(x.doc_id) for x in out) == ["1", "1", "2", "None"]
    assert len({x.fingerprint for x in out if x.doc_id is not None}) == 1


def test_many_ranges_with_gaps(make, spark):
    rows = [(10**12 + i * i, f"text number {i} of many") for i in range(300)] + [(-5, "low"), (0, "zero")]
    out = {r.doc_id: r.edited_sha256 for r in minhash.compare_with_edits(make(rows)).collect()}
    order = sorted(rows, reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        h = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()
    assert out == want


@pytest.mark.parametrize("tile", [4, 512])
def test_near_duplicates_are_verified(make, tile):
    rng = random.Random(2)
    base = [say(rng, 150) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:6]):
        w = t.split()
        for m in range(3):
            rows.append((100 + 10 * k + m, " ".join(w[: 20 + m] + ["new"] + w[21 + m :])))
    rows += [(900, base[0]), (901, None), (902, ""), (None, base[1])]
    got = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(make(rows, extra=True), tile=tile).collect()}
    sets = {i: sets_of(t or "") for i, t in rows if i is not None}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {(i, find(i)) for i in sets} | {(None, find(1))}
    assert got == want
    assert minhash.near_duplicates(make([])).count() == 0
