"""Periodic runs against brute force."""

from __future__ import annotations

import random

import pytest

from assayer.llm import periodic, queries


def brute(words, least_length=6, least_exponent=4):
    n, best = len(words), {}
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                best.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items() if n >= max(least_length, least_exponent * q)), key=lambda r: (r[0], r[2]))


def left_over(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def corpus(rng):
    for _ in range(rng.randint(1, 8)):
        k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 150])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 8:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield rng.choice([b" ", b"\n", b" \t\x0b", b"\x1c "]).join(w)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_match_brute_force(exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = list(corpus(rng))
        for (n, runs, rest), text in zip(periodic.collapse(texts, 6, exponent), texts, strict=True):
            words = text.split()
            want = brute(words, 6, exponent)
            assert (n, runs, rest) == (len(words), want, left_over(words, want))


def test_small_blocks_of_questions_give_the_same(monkeypatch):
    rng = random.Random(9)
    texts = [t for _ in range(20) for t in corpus(rng)]
    want = list(periodic.collapse(texts))
    monkeypatch.setattr(periodic, "QUESTIONS", 7)
    assert list(periodic.collapse(texts)) == want


def test_nested_runs_keep_their_smallest_period():
    words = b"a a a a a a b".split() * 5
    got = [r for _, r, _ in periodic.collapse([b" ".join(words)])][0]
    assert got == brute(words)
    assert (0, 35, 7) in got and (0, 6, 1) in got


def test_a_very_long_text():
    words = [b"w%d" % (k * 7919 % 5003) for k in range(5003)] * 40
    (n, runs, rest), (_, none, whole) = periodic.collapse([b" ".join(words), b" ".join(words[:5003] * 3)])
    assert n == 200_120 and runs == [(0, 200_120, 5003)] and rest == b" ".join(words[:5003])
    assert none == [] and whole.count(b" ") == 3 * 5003 - 1


def test_rows_nulls_repeats_and_clashing_names(make):
    six = "x x x x x x"
    rows = [(1, "a b " + six + " c"), (1, "a b " + six + " c"), (None, six), (2, None), (3, ""), (4, " \n\t"), (5, "é é é é é é é")]
    got = periodic.collapse_runs(make(rows, extra=True).selectExpr("*", "doc_id as runs"))
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    plain = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect()), key=str)
    once = (1, 9, [(2, 6, 1)], "a b x c")
    want = [once, once, (None, 6, [(0, 6, 1)], "x"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 7, [(0, 7, 1)], "é")]
    assert plain == sorted(want, key=str)
    assert periodic.collapse_runs(make([])).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(make([]), least_exponent=1)


def test_planted_repeats_follow_the_rule(make):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (1000, None)]
    got = {r.doc_id: r.text for r in queries.planted_repeats(make(rows)).collect()}
    altered = 0
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i] == " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
            altered += 1
        else:
            assert got[i] == text
    assert altered > 10
