from __future__ import annotations

import random
from collections import defaultdict

from assayer.llm import packing


def brute(need, source, cluster, capacity):
    """Best fit by looking at every bin."""
    bins, where = [], [0] * len(need)
    for i in sorted(range(len(need)), key=lambda i: -need[i]):
        ok = [(b[0], k) for k, b in enumerate(bins) if b[0] >= need[i] and (source[i] is None or source[i] not in b[1]) and (cluster[i] is None or cluster[i] not in b[2])]
        k = min(ok)[1] if ok else len(bins)
        tight = min(ok)[0] if ok else None
        if not ok:
            bins.append([capacity, set(), set()])
        where[i] = (tight, need[i])
        bins[k][0] -= need[i]
        bins[k][1].add(source[i]), bins[k][2].add(cluster[i])
    return len(bins), where


def test_successor_search_finds_the_tightest_compatible_bin():
    for seed in range(6):
        rng = random.Random(seed)
        n = 300
        need = [rng.randint(1, 60) for _ in range(n)]
        source = [None if rng.random() < 0.1 else "hot" if rng.random() < 0.35 else f"s{rng.randint(0, 9)}" for _ in range(n)]
        cluster = [rng.choice([None, None, *range(40)]) for _ in range(n)]
        where, slots, filled = packing.pack_shard(need, source, cluster, 100)
        held = defaultdict(list)
        left = defaultdict(lambda: 100)
        for i in sorted(range(n), key=lambda i: -need[i]):
            ok = [left[b] for b in held if left[b] >= need[i] and all(source[i] is None or source[i] != source[j] for j in held[b]) and all(cluster[i] is None or cluster[i] != cluster[j] for j in held[b])]
            if where[i] in held:
                assert ok and left[where[i]] == min(ok)
            else:
                assert not ok
            held[where[i]].append(i)
            left[where[i]] -= need[i]
        assert all(100 - left[b] == filled[b] for b in held)
        assert all(sorted(slots[i] for i in held[b]) == list(range(len(held[b]))) for b in held)
        assert len(held) == brute(need, source, cluster, 100)[0]


def test_pack_places_every_word_once(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([0, 5, 40, 99, 100, 101, 350]), str(i % 37)) for i in range(400)]
    rows += [(None, "a", 12, None), (5, "b", None, None), (6, "b", 7, "6"), (6, "b", 7, "6")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_words long, cluster string").selectExpr("*", "1 as shard", "2 as bin", "3 as part")
    out = packing.pack(df, cluster="cluster", capacity=100, shard_pieces=60).collect()
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_words
        if r.bin >= 0:
            bins[r.shard, r.bin].append(r)
    want = defaultdict(int)
    for i, _, n, _ in rows:
        want[i] += n or 0
    assert total == want
    of = {}
    for i, s, _, c in rows:
        of.setdefault(i, (s, c))
    for members in bins.values():
        assert sum(r.n_words for r in members) == members[0].bin_words <= 100
        known = [of[r.doc_id] for r in members if r.doc_id not in (5, 6, None)]
        for k in (0, 1):
            got = [x[k] for x in known if x[k] is not None]
            assert len(got) == len(set(got))
    assert packing.pack(df.limit(0)).count() == 0


def test_word_count_matches_split(make):
    rows = [(1, "a b\tc\x0bd\n"), (2, ""), (3, None), (4, "x y z"), (5, " " * 500)]
    got = {r.doc_id: r.n for r in make(rows).select("doc_id", packing.word_count().alias("n")).collect()}
    assert got == {i: len((t or "").encode().split()) for i, t in rows}


def test_bins_do_not_depend_on_the_cluster(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 30)}", rng.randint(1, 60), str(i % 97)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_words long, cluster string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(tuple(r) for r in packing.pack(df.repartition(int(n)), cluster="cluster", capacity=100, shard_pieces=300).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    bins = {(r[4], r[5]): r[7] for r in seen[0]}
    assert {s for s, _ in bins} - {0, 1, 2}  # poor bins of the three shards were packed again
    assert sum(bins.values()) / len(bins) > 93
