from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from assayer.llm import nearcopies, store

SF = "/root/testdata/sf0.01"


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = store.keep(stage(spark, docs, SF))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    words = sum(len(r.text.encode().split()) for r in docs.collect())
    rows = packed.collect()
    assert sum(r.n_words for r in rows) == words and {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_near_copy_stage_keeps_one_of_each_group_and_all_clean(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"v{rng.randint(0, 3000)}" for _ in range(n))
    base = [say(400) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:10]):
        w = t.split()
        for k in range(4):
            c = list(w)
            for _ in range(k * 2):
                c[rng.randrange(len(c))] = "edit"
            rows.append((100 + 10 * i + k, " ".join(c), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == set(range(30))


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e", "en", None, 9), (3, "x " * 20_000, None, "s", 1), (3, "x " * 20_000, None, "s", 1)]
    for chosen in (rows, []):
        docs = spark.createDataFrame(chosen, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in pipeline.STAGES[:-1]:
            docs = store.keep(stage(spark, docs, SF))
        out = pipeline.STAGES[-1][1](spark, docs, SF)
        assert {r.doc_id for r in out.collect()} == ({1, None, 3} if chosen else set())


@pytest.mark.parametrize("tile", [6, 512])
def test_near_copies_are_linked_by_their_shingle_sets_exactly(make, tile):
    """Pairs on both sides of a similarity of 0.8, a large group, and a text of the same set with repeats."""
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for i in range(150):
        w = say(104)
        cut = 80 + i % 20
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:cut] + say(104 - cut)))]
    centre = say(100)
    for k in range(40):
        w = list(centre)
        w[rng.randrange(100)] = f"own{k}"
        rows.append((1000 + k, " ".join(w)))
    w = say(60)
    rows += [(2000, " ".join(w)), (2001, " ".join(w + w[:20] * 60))]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {}
    for r in nearcopies.groups(make(rows), tile=tile).collect():
        got.setdefault(r.root, set()).add(r.id)
    want = {}
    for i in sets:
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
