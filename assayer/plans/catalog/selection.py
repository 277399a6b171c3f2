"""Deduplication, sampling and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import fixtures as fx
from assayer.operators import select as S
from assayer.plans.catalog.registry import query


def _md5(seed: int, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


@query("O1_content_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return S.dedup_first(docs, "content_sha256", "doc_id")


@query("O2_contradictory_duplicates", """
SELECT sha256(text) AS content_sha256, min(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS first_id, min(CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS other_id
FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1""")
def contradictory(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("label"), F.sha2("text", 256).alias("content_sha256"))
    return S.contradictory_duplicates(docs, "content_sha256", "label", "doc_id")


@query("O3_skip_tally", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN n_chars < 200 THEN 'too_short' WHEN lang <> 'en' THEN 'language' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE reason IS NOT NULL GROUP BY 1""")
def skip_tally(spark, d):
    lab = fx.table(spark, d, "labels").select("doc_id", F.lit(True).alias("has_label"))
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(lab, "doc_id", "left")
    reason = F.when(F.col("has_label").isNull(), "unlabelled").when(F.col("n_chars") < 200, "too_short").when(F.col("lang") != "en", "language")
    return S.skip_tally(docs.withColumn("reason", reason))


@query("O4_largest_box", """
SELECT frame_id, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY w * h DESC, ordinal, l_partkey, l_suppkey) AS rn FROM fx_detections) WHERE rn = 1""", ("fx_detections",))
def largest_box(spark, d):
    return S.largest_detection(fx.detections(spark, d), "frame_id", ["ordinal", "l_partkey", "l_suppkey"]).select("frame_id", "x", "y", "w", "h")


@query("O5_seeded_sample", f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {_md5(7, 'doc_id')}, doc_id LIMIT 100")
def seeded_sample(spark, d):
    return S.seeded_sample(fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100, 7)


@query("O6_balanced_limit", f"""
SELECT label, sample_id FROM (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY {_md5(3, 'sample_id')}, sample_id) AS rn FROM fx_records) WHERE rn <= 150""", ("fx_records",))
def balanced_limit(spark, d):
    return S.balanced_limit(fx.records(spark, d).select("label", "sample_id"), "label", "sample_id", 301, 2, 3)


@query("O7_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def page(spark, d):
    return S.page(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


@query("O8_positional_sample", f"""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT *, CASE WHEN n <= 8 THEN pos ELSE pos * 8 // n END AS slot FROM r)
SELECT user_id, event_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY {_md5(5, 'event_id')}, event_id) AS rn FROM b) WHERE rn = 1""")
def positional_sample(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", "ts")
    return S.positional_sample(e, "user_id", "ts", "event_id", 8, 5).select("user_id", "event_id", "slot")


@query("O9_first_k", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) WHERE rn <= 3")
def first_k(spark, d):
    return S.first_k(fx.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"], 3)


@query("O11_recent", "SELECT id, status FROM fx_submissions WHERE status = 'done' ORDER BY received_at DESC, id DESC LIMIT 50", ("fx_submissions",))
def recent(spark, d):
    return S.recent(fx.submissions(spark, d), 50, "done").select("id", "status")


_COUPLES = f"""
SELECT stratum, max(CASE WHEN rn % 2 = 1 THEN id END) AS a, max(CASE WHEN rn % 2 = 0 THEN id END) AS b
FROM (SELECT 'n' || c_nationkey AS stratum, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_md5(11, 'c_custkey')}, c_custkey) AS rn FROM customer)
GROUP BY stratum, (rn - 1) // 2 HAVING count(*) = 2"""


def _faces(spark, d):
    return fx.table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("stratum"), F.col("c_custkey").alias("id"))


@query("O12_couples", f"SELECT stratum, a, b, a || '+' || b AS couple_id FROM ({_COUPLES})")
def couples(spark, d):
    return S.couples(_faces(spark, d), "stratum", "id", 11)


@query("O13_couple_expansion", f"""
WITH c AS (SELECT *, a || '+' || b AS couple_id FROM ({_COUPLES})),
r AS (SELECT couple_id || '/real/' || a AS sample_id, couple_id AS subject_id, stratum, CAST(NULL AS VARCHAR) AS generator, 0 AS label FROM c
  UNION ALL SELECT couple_id || '/real/' || b, couple_id, stratum, NULL, 0 FROM c
  UNION ALL SELECT couple_id || '/hull', couple_id, stratum, 'hull', 1 FROM c WHERE a % 7 <> 0
  UNION ALL SELECT couple_id || '/mesh', couple_id, stratum, 'mesh', 1 FROM c WHERE a % 5 <> 0
  UNION ALL SELECT couple_id || '/' || g, couple_id, stratum, g, 1 FROM c, (VALUES ('synthetic'), ('control')) t(g) WHERE a % 3 <> 0)
SELECT * FROM r""")
def couple_expansion(spark, d):
    pairs = S.couples(_faces(spark, d), "stratum", "id", 11)
    why = F.filter(F.array(
        F.when(F.col("a") % 7 == 0, "hull"), F.when(F.col("a") % 5 == 0, "mesh"), F.when(F.col("a") % 3 == 0, "control")), lambda x: x.isNotNull())
    failed = pairs.select("couple_id", F.explode(why).alias("generator"))
    return S.expand_couples(pairs, ["hull", "mesh"], failed, ("synthetic", "control"))


@query("O14_real_and_derived", """
SELECT c_custkey || '-' || arm AS sample_id, label, generator FROM customer,
  (VALUES ('real', 0, NULL), ('blend', 1, 'blend')) t(arm, label, generator)""")
def real_and_derived(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey")
    return S.expand_real_and_derived(c, "c_custkey", "blend").select("sample_id", "label", "generator")


@query("O15_shared_support", """
WITH k AS (SELECT *, CAST(floor(score / 50) AS BIGINT) AS size_key FROM fx_docs)
SELECT sample_id, size_key, label FROM k WHERE size_key IN (SELECT size_key FROM k GROUP BY 1 HAVING count(DISTINCT label) = 2)""", ("fx_docs",))
def shared_support(spark, d):
    docs = fx.docs(spark, d).withColumn("size_key", F.floor(F.col("score") / 50))
    return S.shared_support(docs, ["size_key"]).select("sample_id", "size_key", "label")


@query("O16_couple_adoption", f"""
WITH c AS (SELECT *, a || '+' || b AS couple_id FROM ({_COUPLES})), m AS (SELECT a AS id, couple_id FROM c WHERE a % 4 <> 0 UNION ALL SELECT b, couple_id FROM c WHERE a % 4 <> 0)
SELECT coalesce(couple_id, 'solo/' || o_custkey) AS couple_id, count(*) AS n FROM orders LEFT JOIN m ON o_custkey = id GROUP BY 1""")
def couple_adoption(spark, d):
    pairs = S.couples(_faces(spark, d), "stratum", "id", 11).where(F.col("a") % 4 != 0)
    of = pairs.select(F.explode(F.array("a", "b")).alias("id"), "couple_id")
    rows = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return S.adopt_couple(rows, of, "id").groupBy("couple_id").agg(F.count(F.lit(1)).alias("n"))


@query("O17_missed_attacks", "SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def missed_attacks(spark, d):
    s = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "F").alias("swapped"), (F.col("o_totalprice") > 300000).alias("approved"))
    return S.missed_attacks(s).select("session_id")


@query("O18_feature_cache", """
WITH i AS (SELECT doc_id, sha256(concat_ws('|', text, CAST(n_chars AS VARCHAR), 'pre-1', 'enc-1')) AS k FROM documents),
c AS (SELECT DISTINCT k FROM i WHERE doc_id % 3 = 0)
SELECT (SELECT count(*) FROM i) AS n_rows, (SELECT count(DISTINCT k) FROM i) AS n_keys, (SELECT count(*) FROM c) AS n_hits,
  (SELECT count(DISTINCT k) FROM i WHERE k NOT IN (SELECT k FROM c)) AS n_misses""")
def feature_cache(spark, d):
    key = S.cache_key(F.col("text"), F.col("n_chars"), "pre-1", "enc-1")
    items = fx.table(spark, d, "documents").select("doc_id", key.alias("cache_key"))
    cache = items.where(F.col("doc_id") % 3 == 0).select("cache_key").distinct()
    return S.cache_summary(items, cache)


@query("O19_licence_gate", """
WITH m AS (SELECT s_suppkey, s_nationkey % 7 <> 0 AS ok, 'f' || (s_suppkey + x) AS file FROM supplier, (VALUES (0), (100), (500)) t(x)
  UNION ALL SELECT s_suppkey, s_nationkey % 7 <> 0, 'f' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 10 = 0),
o AS (SELECT file, min(s_suppkey) AS asset_id, arg_min(ok, s_suppkey) AS ok, count(*) AS n FROM m GROUP BY 1),
f AS (SELECT 'f' || p_partkey AS file FROM part)
SELECT 'duplicate_claim' AS problem, file AS item FROM o WHERE n > 1
UNION ALL SELECT 'unregistered', f.file FROM f LEFT JOIN o ON f.file = o.file WHERE o.file IS NULL
UNION ALL SELECT 'non_commercial', CAST(o.asset_id AS VARCHAR) FROM f JOIN o ON f.file = o.file WHERE NOT ok""")
def licence_gate(spark, d):
    k = F.col("s_suppkey")
    base = F.array(*[F.concat(F.lit("f"), (k + x).cast("string")) for x in (0, 100, 500)])
    extra = F.when(k % 10 == 0, F.array(F.concat(F.lit("f"), (k + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    manifest = fx.table(spark, d, "supplier").select(
        k.alias("asset_id"), (F.col("s_nationkey") % 7 != 0).alias("commercial_use"), F.concat(base, extra).alias("files"))
    found = fx.table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"))
    return S.licence_problems(found, manifest)


@query("O20_coverage_difference", """
SELECT o_orderpriority AS fold, count(CASE WHEN o_orderkey % 49 = 0 AND o_orderkey % 50 <> 0 THEN 1 END) AS only_a,
  count(CASE WHEN o_orderkey % 50 = 0 AND o_orderkey % 49 <> 0 THEN 1 END) AS only_b
FROM orders WHERE NOT (o_orderkey % 49 = 0 AND o_orderkey % 50 = 0) GROUP BY 1""")
def coverage_difference(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("fold"), F.col("o_orderkey").alias("sample_id"))
    return S.coverage_difference(o.where(F.col("sample_id") % 50 != 0), o.where(F.col("sample_id") % 49 != 0), ["fold", "sample_id"], "fold")
