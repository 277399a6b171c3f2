"""Substring, line and SimHash deduplication against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from assayer.llm import graph, lines, nearcopies, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["é", "x y", "DéJÀ"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, short = say(120), say(49)
    rows = [(i, say(rng.randint(1, 200))) for i in range(60)]
    rows += [(100 + i, say(rng.randint(0, 60)) + " " + passage + "\n" + say(rng.randint(0, 40))) for i in range(25)]
    rows += [(200 + i, say(30) + "\t" + short + " " + say(30)) for i in range(5)]
    rows += [(300 + i, rows[7][1]) for i in range(10)]
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, " ".join([passage] * 40)), (404, "z " * 300), (405, "z " * 300)]
    near = rows[20][1].split()
    rows += [(500 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :])) for i in range(20)]
    return rows


def brute_substrings(rows, window=50):
    words = {i: WORD.findall(t or "") for i, t in rows}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(make, seed):
    rows = corpus(seed)
    got = substrings.drop_repeats(make(rows, extra=True), joined=True)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    found = {r[0]: (r[-2], r[-1], r[1] or "") for r in got.collect()}
    assert found == brute_substrings(rows)


def test_substrings_keep_untouched_text_nulls_and_repeats(make, spark):
    body = " ".join(f"q{k}" for k in range(80))
    rows = [(1, "a  b\nc"), (2, body), (2, body), (None, body), (3, body + "  tail"), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substrings.drop_repeats(make(rows)).collect()), key=str)
    want = [(1, "a  b\nc", 3, 0), (2, body, 80, 0), (2, body, 80, 0), (3, "tail", 81, 80), (4, None, 0, 0), (5, "", 0, 0), (None, body, 80, 0)]
    assert got == sorted(want, key=str)
    assert substrings.drop_repeats(make([])).count() == 0
    with pytest.raises(ValueError):
        substrings.anchor_width(31)


def test_every_offset_finds_an_aligned_anchor():
    cover = set(substrings.COVER)
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + d) % substrings.PERIOD in cover and (b + d) % substrings.PERIOD in cover for d in range(substrings.PERIOD))


def brute_lines(rows, width=3):
    cut = {i: t.split("\n") if t is not None else [] for i, t in rows}
    first = {}
    for i in sorted(cut):
        for k in range(len(cut[i]) - width + 1):
            first.setdefault(tuple(cut[i][k : k + width]), (i, k))
    out = {}
    for i, ls in cut.items():
        gone = [False] * len(ls)
        for k in range(len(ls) - width + 1):
            if first[tuple(ls[k : k + width])] != (i, k):
                gone[k : k + width] = [True] * width
        out[i] = (len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g))
    return out


def test_lines_match_brute_force(make):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n\n"), (903, "a\nb"), (904, "same\n" * 5000)]
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in lines.drop_repeated_lines(make(rows)).collect()}
    assert found == brute_lines(rows)


def test_lines_with_nulls_repeats_and_clashing_names(make):
    t = "one\ntwo\nthree\nfour"
    out = lines.drop_repeated_lines(make([(1, t), (1, t), (None, t), (2, t), (3, None)], extra=True)).collect()
    got = sorted(((r[0], r[1], r[-1]) for r in out), key=str)
    assert got == sorted([(1, t, 0), (1, t, 0), (None, t, 0), (2, "", 4), (3, None, 0)], key=str)
    assert lines.drop_repeated_lines(make([])).count() == 0


def plain_fingerprint(text, width=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    each = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(make):
    rows = corpus(4)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = brute_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make(rows, extra=True)).collect()}
    assert found == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_simhash_spark_hash_agrees(make, spark):
    from pyspark.sql import functions as F

    row = make([(1, "One TWO three four")]).select(F.hex(F.xxhash64(F.lit("one two three four")))).first()[0]
    assert int(row, 16) == simhash.fingerprint(b"One TWO three four")


def test_simhash_hot_buckets_are_cut(spark):
    """Thousands of close fingerprints in one bucket, by tiles of 64, give the components of brute force."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64), axis=1)
    f = np.unique(np.concatenate([centre.repeat(150) ^ flips, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    prints = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "bits long")
    want = np.arange(len(f))
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    want = graph.local_roots(want, i, j)
    for tile in (64, 8192):
        edges = simhash.links(prints, tile=tile)
        at = {int(x): k for k, x in enumerate(f.view(np.int64))}
        pairs = [(at[r.a], at[r.b]) for r in edges.collect()]
        got = graph.local_roots(np.arange(len(f)), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert (got == want).all()


def test_simhash_edges(make):
    assert simhash.near_duplicates(make([])).count() == 0
    rows = [(7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (None, "ALPHA beta gamma delta"), (3, ""), (9, None), (None, "lonely text without an id at all")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (3, 3), (9, 3), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in nearcopies.representatives(make(rows)).collect()), key=str)
    assert kept == sorted([(7, "alpha beta gamma delta"), (3, ""), (None, "lonely text without an id at all")], key=str)


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(k, k + 1) for k in range(1, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {1000 + k: 1000 for k in range(300)}


def test_windows_cross_block_borders():
    """Texts longer than a hashing block give the same words and windows as their parts."""
    from assayer.llm import words

    body = b" ".join(b"w%d" % (k * 7919 % 5000) for k in range(120_000))
    whole, first = words.word_hashes([b"lead", body, b"", b"x" * 400_000])
    assert np.diff(first).tolist() == [1, 120_000, 0, 1]
    seen = {}
    for h, w in zip(whole[1:120_001].tolist(), body.split(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    win, to = words.window_hashes(whole, first, 50)
    assert np.diff(to).tolist() == [0, 120_000 - 49, 0, 0]
    part, _ = words.window_hashes(whole[90_000:90_100], np.array([0, 100]), 50)
    assert (win[90_000 - 1 : 90_000 - 1 + 51] == part).all()
