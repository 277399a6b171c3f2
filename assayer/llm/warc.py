"""WARC archives: written by Spark, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.store import keep, shared_path

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ROWS_PER_FILE = 20_000
#: Bytes of a stretch by which spans and segments of a file are matched.
CELL = 1 << 20


def base32(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hex digest: five hex digits make four characters."""
    parts = []
    for k in range(8):
        v = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row per page: id, record text without its magic line's closing gap.

    Of pages with equal bodies of at least `least_bytes` bytes the one with the smallest id is a response, the others
    are revisits that name it; smaller bodies are responses. Null bodies are empty. Rows with a null id are left out:
    nothing could name them. Of repeated ids with equal bodies one row is the response (they share its name).
    """
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{body}`"), F.lit("")).alias("body")).where("page_id is not null")
    src = src.withColumn("n", F.octet_length("body").cast("long")).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    small = src.select("page_id", "sha", "n").where(F.col("n") >= least_bytes)
    first = small.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    later = keep(small.join(first, ["sha", "n"]).where("page_id <> first").select("page_id", "first", F.col("sha").alias("of")).distinct(), "revisits")
    both = src.join(later, (src.page_id == later.page_id) & (src.sha == later.of), "left").select(src["*"], "first")
    revisit = F.col("first").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    digest = base32(F.col("sha"))
    head = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nWARC-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("n").cast("string")),
        F.lit(GAP),
    )
    return both.select("page_id", F.concat(F.lit(MAGIC), head, F.when(revisit, "").otherwise(F.col("body"))).alias("record"))


def write(pages: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, **columns) -> None:
    """Write archives below `path`: whole records one after another, each closed by an empty line pair.

    Spark's own writer and committer do it, so any store it writes to will do and a lost task is simply run again.
    """
    records(pages, **columns).select("record").write.option("lineSep", GAP).option("maxRecordsPerFile", rows_per_file).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
SEGMENT = "file string, block long, k long, n long, body_at long, length long, kind string, page long, refers long, digest string, claimed long, sha string"


def _parse(segment: bytes) -> tuple:
    """Header facts of what follows a magic line; length None if there is no well-formed header."""
    end = segment.find(b"\r\n\r\n")
    none = (None,) * 8
    if end < 0:
        return none
    fields = {a.lower(): b for a, b in _FIELD.findall(segment[:end].replace(b"\r\n", b"\n"))}
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return none
    number = lambda name, pattern=rb"(\d+)": int(m[1]) if (m := re.search(pattern, fields.get(name, b""))) else None
    at, length = end + 4, int(size)
    body = segment[at : at + length]
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode() if len(body) == length else None
    digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace") or None
    return at, length, fields.get(b"warc-type", b"").decode("ascii", "replace"), number(b"warc-record-id", rb"<urn:page:(-?\d+)>"), number(b"warc-refers-to", rb"<urn:page:(-?\d+)>"), digest, number(b"warc-payload-length"), sha


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines, as Spark's splittable reader finds it: the piece before a file's first magic too."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records, one row per segment in reading order k of its block, with header facts but no bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for b in batches:
            files, blocks, pieces = (b.column(i).to_pylist() for i in range(3))
            out = []
            for f, s, p in zip(files, blocks, pieces, strict=True):
                k = k + 1 if (f, s) == last else 0
                last = (f, s)
                out.append((f, s, k, len(p), *_parse(p)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in SEGMENT.split(", ")])

    return _segments(spark, path).mapInArrow(run, SEGMENT)


def _placed(segments: DataFrame) -> DataFrame:
    """Adds `at`, the byte of the file where the segment's magic line begins (0 - len(MAGIC) for what precedes the first)."""
    step = len(MAGIC)
    ends = segments.groupBy("file", "block").agg(F.sum(F.col("n") + step).alias("size"))
    before = ends.withColumn("base", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = segments.withColumn("inside", F.coalesce(F.sum(F.col("n") + step).over(inner), F.lit(0)))
    return inside.join(before.select("file", "block", "base"), ["file", "block"]).withColumn("at", F.col("base") + F.col("inside") - step)


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) of the records on each file's chain from byte 0, by pointer jumping over (file, at, next).

    Each round doubles the length of every pointer, so the rounds grow with the logarithm of a file's records. Each is a
    written table.
    """
    jump = keep(edges.select("file", "at", "next"), "jumps")
    known = jump.select("file", "at")
    seen = keep(jump.where("at = 0").select("file", "at"), "seen")
    count = seen.count()
    while True:
        more = seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(known, ["file", "at"], "left_semi")
        seen = keep(seen.unionByName(more).distinct(), "seen")
        now = seen.count()
        if now == count:
            return seen
        count = now
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = keep(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")


def _bodies(spark: SparkSession, path: str, spans: DataFrame, placed: DataFrame) -> DataFrame:
    """SHA-1 of bodies that hold magic lines: their segments are read once more and put together.

    Only segments inside such records are moved, and only a record's own pieces meet in a task.
    """
    cells = spans.withColumn("cell", F.explode(F.expr(f"sequence(start div {CELL}, stop div {CELL})")))
    inside = placed.select("file", "block", "k", "at", F.expr(f"at div {CELL}").alias("cell")).alias("p").join(cells.alias("s"), ["file", "cell"]).where("p.at >= s.start and p.at < s.stop")
    wanted = keep(inside.select("file", "block", "k", F.col("p.at").alias("at"), "start", "body_at", "length"), "wanted")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for b in batches:
            ks = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = k + 1 if (f, s) == last else 0
                last = (f, s)
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ks, pa.int64())], ["file", "block", "piece", "k"])

    again = _segments(spark, path).mapInArrow(numbered, "file string, block long, piece binary, k long")

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        pieces = rows.column("piece").to_pylist()
        at, length = rows.column("body_at")[0].as_py(), rows.column("length")[0].as_py()
        body = MAGIC.encode().join(pieces)[at : at + length]
        ok = len(body) == length
        return pa.table([rows.column("file").slice(0, 1), rows.column("start").slice(0, 1), pa.array([base64.b32encode(hashlib.sha1(body).digest()).decode() if ok else None], pa.string())], names=["file", "start", "whole"])

    return again.join(wanted, ["file", "block", "k"]).groupBy("file", "start").applyInArrow(join, "file string, start long, whole string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every magic line is a candidate; its header names the byte where its successor begins. Only candidates that the
    chain of successors from byte 0 of their file reaches are records, so a magic line inside a payload is not taken
    for one. The digest of a response is computed from its body; that of a revisit is the one it states. A file cut
    short ends the chain at its last whole record. No archive, or empty ones: no rows.
    """
    step = len(MAGIC)
    placed = keep(_placed(_scan(spark, path)), "segments")
    heads = placed.where("at >= 0 and length is not null").withColumn("next", F.expr(f"at + {step} + body_at + length + {len(GAP)}"))
    heads = heads.withColumn("whole_end", F.expr(f"at + {step} + n"))
    found = heads.join(reachable(heads), ["file", "at"], "left_semi")
    spans = keep(found.where("sha is null").select("file", F.col("at").alias("start"), F.col("next").alias("stop"), "body_at", "length"), "spans")
    out = found
    if not spans.isEmpty():
        whole = _bodies(spark, path, spans, placed).withColumnRenamed("start", "at")
        out = found.join(whole, ["file", "at"], "left").withColumn("sha", F.coalesce("sha", "whole"))
    revisit = F.col("kind") == "revisit"
    return out.where(revisit | F.col("sha").isNotNull()).select(
        F.col("page").alias("page_id"),
        F.when(revisit, F.col("claimed")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("sha")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers")).alias("refers_to"),
    )


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, **columns)
    return read(pages.sparkSession, path)
