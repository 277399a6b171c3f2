"""Toxicity and language models: held-out accuracy on the given tables, and small cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


def third(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_toxicity_on_held_out_labels(spark):
    out = queries.QUERIES["op3_toxicity"](spark, BIG)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (third(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, r.toxic) for r in rows if r.held_out]
    hits, said, true = sum(p and t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert hits / said > 0.92 and hits / true > 0.8


def test_pairs_of_terms_are_learned():
    """Neither word alone is a sign; together they are, which additive weights can't tell."""
    rng = random.Random(4)
    noise = [f"n{k}" for k in range(30)]
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(noise, 6) + ["insultword"] * a + ["groupword"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(int(a and b))
    ids, to = toxicity.terms(texts)
    machine = toxicity.fit_machine(ids, to, np.array(y, float), float(np.mean(y)))
    score = lambda t: machine.score([t])[0]
    assert score(b"n1 n2 insultword n3 groupword") > 0.9
    assert score(b"n1 n2 insultword n3") < 0.3 and score(b"n1 groupword n4") < 0.3 and score(b"n1 n2") < 0.3


def test_pairs_of_words_that_are_neutral_alone_are_learned():
    """Toxic if both words occur or neither: each is as common in toxic rows as in clean ones."""
    rng = random.Random(6)
    noise = [f"n{k}" for k in range(30)]
    texts, y = [], []
    for k in range(1600):
        a, b = bool(k & 1), bool(k & 2)
        words = rng.sample(noise, 6) + ["insultword"] * a + ["groupword"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(int(a == b))
    ids, to = toxicity.terms(texts)
    machine = toxicity.fit_machine(ids, to, np.array(y, float), 0.5)
    score = machine.score([b"n1 insultword n3 groupword", b"n1 n2 n4", b"n1 insultword n2", b"n1 groupword n4"])
    assert (score[:2] > 0.9).all() and (score[2:] < 0.1).all()


def test_rare_toxic_words_count():
    """A word of ten toxic rows and no clean one, of 4,000, raises the score."""
    rng = random.Random(7)
    noise = [f"n{k}" for k in range(200)]
    texts = [" ".join(rng.sample(noise, 8) + ["common"] * (k % 2 and k % 10 != 1) + ["seldomword"] * (k % 400 == 1)).encode() for k in range(4000)]
    ids, to = toxicity.terms(texts)
    machine = toxicity.fit_machine(ids, to, np.array([k % 2 for k in range(4000)], float), 0.5)
    with_it, without = machine.score([b"n1 n2 n3 seldomword", b"n1 n2 n3"])
    assert with_it > without + 0.2


def test_terms_ignore_case_repeats_and_marks():
    a, _ = toxicity.terms([b"Idiot, idiot! IDIOT"])
    b, _ = toxicity.terms([b"idiot"])
    assert a.tolist() == b.tolist()
    ids, to = toxicity.terms([b"", b"a", b"\xc3\xa9t\xc3\xa9 12 ..."])
    assert np.diff(to).tolist()[0] == 0 and len(ids) == to[-1]


def test_toxicity_edges(make, spark):
    rows = [(i, ("bad rotten thing " if i % 2 else "fine good thing ") + f"w{i % 7}") for i in range(200)]
    rows += [(900, None), (901, ""), (None, "bad rotten"), (902, "x" * 100_000), (5, rows[5][1])]
    docs = make(rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.col("doc_id") < 150)
    out = toxicity.score(docs, machine).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[151] > 0.7 > 0.3 > by[152] and by[900] == by[901]
    assert toxicity.score(make([]), machine).count() == 0
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, none).collect())


def test_languages_on_held_out_documents(spark):
    out = queries.QUERIES["op6_language"](spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (third(r.doc_id, 5) == 0) for r in out)
    held = [r for r in out if r.held_out]
    right = sum(r.lang_pred == r.lang for r in held)
    assert right / len(held) > 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.8 * len(held) and sum(r.lang_pred == r.lang for r in sure) / len(sure) > 0.97


def test_language_edges(make, spark):
    rng = random.Random(1)
    say = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(30))
    rows = [(i, say("abcde") if i % 2 else say("vwxyz"), "aa" if i % 2 else "zz", "s", 1) for i in range(300)]
    rows += [(900, None, "aa", "s", 0), (901, "", "zz", "s", 0), (902, "123 ... !?", None, "s", 0), (903, "é", None, "s", 1), (None, say("abcde"), None, "s", 1), (904, say("vwxyz") * 500, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang_pred2", F.lit(1))
    model = langid.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[902].lang_score == 0
    assert got[None].lang_pred == "aa" and got[904].lang_pred == "zz" and got[903].lang_pred in ("aa", "zz")
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == ("aa" if i % 2 else "zz") for i in range(300)) == 300
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0), F.lit(True)).languages == ["und"]
    batch = model.probabilities([b"", b"a", rows[0][1].encode()])
    assert np.allclose(batch[2], model.probabilities([rows[0][1].encode()])[0])


def test_rare_languages_keep_their_rows_when_there_are_many(make, spark):
    """Forty languages and room for eighty rows: each has a row, and rare ones keep all of theirs."""
    from pyspark.sql import functions as F

    rows = [(1000 * k + i, f"lang{k} text number {i} of {k}", f"l{k:02d}") for k in range(40) for i in range(200 if k < 5 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), most=80)
    assert list(model.languages) == [f"l{k:02d}" for k in range(40)]


def test_language_columns_of_the_table_are_replaced(make, spark):
    from pyspark.sql import functions as F

    docs = make([(i, t) for i, t in enumerate(["one two three", "un deux trois", None, "12 34"] * 10)], extra=True).selectExpr("*", "'x' as lang_pred", "1 as _guess", "2 as guess")
    model = langid.fit(docs, F.lit(True))
    out = langid.identify(docs, model)
    assert out.columns.count("lang_pred") == 1 and {"_guess", "guess"} <= set(out.columns)
    assert {r.lang_pred for r in out.where("text is null or text = '12 34'").collect()} == {"und"}
