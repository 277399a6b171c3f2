"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import ann, bpe, hardneg, langid, lines, minhash, ngrams, packing, periodic, simhash, substrings, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op5_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    least AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s JOIN least USING (h) WHERE m < doc_id),
    each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.drop_repeats(docs, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query(
    "op8_line_dedup",
    """
    WITH l AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(ls[i:i + 2], chr(10))) AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS j FROM ranked WHERE r > 1),
    each AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS j FROM l),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT l.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM l LEFT JOIN kept USING (doc_id)
    """,
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edits(_table(spark, sf_dir, "documents"))


@_query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", packing.word_count().alias("n_words"), F.xxhash64("text").cast("string").alias("cluster"))
    return packing.pack(docs, cluster="cluster")


def _third(id_col: str, of: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), _third("doc_id", 3) != 1)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(_third("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, _third("doc_id", 5) != 0)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_third("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


@_query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
    digits AS (SELECT page_id, n, first, list_transform(range(0, 32), lambda k: ('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4)) & 31) AS v
               FROM p JOIN f USING (h, n))
    SELECT page_id, n AS payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM digits
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


@_query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


#: CRC-32 of a decimal id: a step for each byte and eight shifts after it.
_CRC_SQL = """
    xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda k: [1000 + ascii(substr(doc_id::VARCHAR, k::INT, 1)), 1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[]))),
        lambda c, s: CASE WHEN s >= 1000 THEN xor(c, s - 1000) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END), 4294967295::UBIGINT)
"""


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a hash of the id, all words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("ws"))
    sized = words.withColumn("n", F.size("ws")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    tail = "transform(sequence(0L, n - a - 1), i -> get(ws, cast(a + i % (1 + (n - a) div (3 + g % 8)) as int)))"
    repeated = F.expr(f"array_join(concat(slice(ws, 1, cast(a as int)), {tail}), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@_query(
    "op12_periodic_runs",
    rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_CRC_SQL} AS h FROM documents),
    s AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS altered, (h // 10)::BIGINT AS g FROM w),
    p AS (SELECT *, CASE WHEN altered THEN g % n ELSE 0 END AS a FROM s),
    t AS (SELECT doc_id, n, CASE WHEN altered THEN list_transform(range(0, n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END)::BIGINT + 1]) ELSE ws END AS ws FROM p),
    each AS (SELECT doc_id, n, unnest(ws) AS x, unnest(range(0, n)) AS i FROM t),
    same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM each l JOIN each r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
    island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
    told AS (SELECT doc_id, count(*) AS n_runs, max({{'l': length, 's': -start, 'p': -period}}) AS m,
                    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -m.s AS start, m.l AS length, -m.p AS period, 1000 * m.l // -m.p AS exponent_milli,
           sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(planted_repeats(_table(spark, sf_dir, "documents")))
    most = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    told = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("m", most).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.start")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@_query(
    "op13_hard_negatives",
    """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM pos JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@_query(
    "op11_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS k FROM w)),
    n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
    shared AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY a, b),
    link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
    SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(_table(spark, sf_dir, "documents"))
