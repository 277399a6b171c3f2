"""Exact Jaccard links against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from assayer.llm import ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text, width=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
    sets = [gram_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if find(y) == find(x) and rows[y][0] is not None]
        out.append((i, len(sets[x]), (min(ids) if ids else None) if sets[x] else i))
    return sorted(out, key=str)


def corpus(seed, families=25):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "ß", "İ", "Über"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = say(50), []
    for f in range(families):
        base = say(rng.choice([3, 8, 30, 90, 250]))
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += say(rng.randint(1, 4))
            rows.append(" ".join(w))
        if f % 3 == 0:
            rows += [" ".join(passage + say(rng.randint(0, 12))) for _ in range(3)]
    rows += ["one two three", "ONE two Three", "one two", "", None, " \n ", "same same same same same same", "same same same same"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force(make):
    rows = corpus(1)
    assert found(ngrams.near_duplicates(make(rows, extra=True))) == brute(rows)


def test_hot_buckets_and_large_groups_are_cut(make, monkeypatch):
    """Tiny tiles, everything hot: pieces meet two by two and give the same groups."""
    monkeypatch.setattr(ngrams, "TILE", 8)
    monkeypatch.setattr(ngrams, "HOT", 0)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = corpus(2, 6)
    for k in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(base[: 60 + 3 * k])) for k in range(20)]
    assert found(ngrams.near_duplicates(make(rows))) == brute(rows)


def test_exact_edge_of_the_threshold(make):
    words = [f"t{k}" for k in range(103)]  # 100 n-grams
    rows = [(1, " ".join(words)), (2, " ".join(words[:88])), (3, " ".join(words[:87])), (4, " ".join(words[1:] + ["u"])), (9, "p q r s t"), (8, "p q r s t u")]
    assert found(ngrams.near_duplicates(make(rows))) == brute(rows)


def test_nulls_repeats_and_empty_tables(make):
    rows = [(7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (None, "ALPHA beta gamma delta"), (3, ""), (9, None), (None, "no id for this one"), (None, None), (None, None)]
    assert found(ngrams.near_duplicates(make(rows))) == brute(rows)
    assert found(ngrams.near_duplicates(make([]))) == []
    assert found(ngrams.near_duplicates(make([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("n", [1, 2, 5, 17, 300])
def test_the_tree_keeps_every_pair_that_its_bound_allows(n):
    rng = np.random.default_rng(n)
    points = rng.poisson(3, (n, 16)) + np.repeat(rng.poisson(9, (-(-n // 5), 16)), 5, axis=0)[:n]
    sizes = points.sum(axis=1)
    i, j = ngrams.candidates(points, sizes, np.zeros(n, np.int64), 85)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    least = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(185 * least >= 85 * (sizes[:, None] + sizes[None]), 1)), strict=True)}
    assert got == want and len(got) == len(i)


def test_points_of_large_sets_fold_and_still_bound(monkeypatch):
    monkeypatch.setattr(ngrams, "GROUPS", 8)
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (5, 150, 160, 900, 1000, 3900, 4000)]
    points = [np.frombuffer(ngrams._point(u), np.int32) for u in sets]
    assert [len(p) for p in points] == [8, 8, 8, 64, 64, 256, 256]
    for u, p in zip(sets, points, strict=True):
        assert (ngrams._fold(p, 8) == np.bincount((u % np.uint64(8)).astype(int), minlength=8)).all()
    sizes, side = np.array([len(u) for u in sets]), np.zeros(7, np.int64)
    i, j = ngrams.likely(points, sizes, side, 85)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {(a, b) for a in range(7) for b in range(a + 1, 7) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    coarse = ngrams.candidates(np.array([ngrams._fold(p, 8) for p in points]), sizes, side, 85)
    assert linked == {(5, 6)} and linked <= got and len(got) < len(coarse[0])


def test_offers_of_linked_sets_meet():
    """Whatever the order of n-grams, two sets of the similarity share one of what both offer."""
    rng = random.Random(8)
    for _ in range(500):
        n = rng.randint(1, 60)
        a = set(range(n))
        b = set(list(a)[: n - rng.randint(0, n // 6)]) | {100 + k for k in range(rng.randint(0, n // 6))}
        if 100 * len(a & b) >= 85 * len(a | b):
            order = list(a | b)
            rng.shuffle(order)
            rank = {x: k for k, x in enumerate(order)}
            offer = lambda s: set(sorted(s, key=rank.get)[: ngrams.offered(len(s), 85)])  # noqa: E731, B023
            assert offer(a) & offer(b)


def test_a_set_stands_in_two_tiles_however_many_buckets_it_shares(make, monkeypatch):
    """Near copies of one text share many large buckets; their texts are not read once for each of these."""
    monkeypatch.setattr(ngrams, "TILE", 8)
    read, with_sets = [], ngrams._with_sets

    def counted(docs, text, tiles, width):
        read.append(tiles.count())
        return with_sets(docs, text, tiles, width)

    monkeypatch.setattr(ngrams, "_with_sets", counted)
    rng = random.Random(6)
    base, rows = [f"b{k}" for k in range(200)], []
    for k in range(80):
        w = list(base)
        w[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    assert found(ngrams.near_duplicates(make(rows))) == brute(rows)
    assert read[0] == 2 * 80


def test_points_are_moved_as_bytes_where_counts_allow():
    for counts in ([0, 3, 255, 1], [0, 3, 256, 70000]):
        point = np.array(counts, np.int32).tobytes()
        raw = ngrams._packed(point)
        assert len(raw) == (4 if max(counts) < 256 else 17)
        assert ngrams._unpacked(raw).tolist() == counts


def test_texts_that_no_tile_asks_for_are_not_moved(spark):
    texts = spark.range(-3000, 3000).selectExpr("xxhash64(id) as text_key", "id as text")
    tiles = texts.where("text % 50 = 0").select("text_key")
    got = {r.text for r in ngrams._asked_for(texts, tiles).collect()}
    assert set(range(-3000, 3000, 50)) <= got and len(got) < 200


def test_levels_tell_a_passage_in_full_slots(spark):
    """Counts of 1,100 and 1,500 are within one doubling, and have different levels."""
    texts = ["a b c d"] * 1100 + ["e f g h"] * 1500
    level = ngrams.rarity(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(set(level[level > 0].tolist())) == 2
