"""From files appearing in a folder to rows in a submission log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from assayer import schema as K
from assayer.operators.ranking import BUCKET, ordered_rank, running, with_value_bucket

LEGAL = (("", "queued"), ("queued", "running"), ("running", "done"), ("running", "failed"), ("running", "queued"))
STATES = ("", "queued", "running")
STATE_SHARES = 4_096  # part of a stream's checkpoint: another number needs a new one


def _move(was: str, status: str) -> str:
    """The state after an event: a finished submission is closed."""
    return was if (was, status) not in LEGAL else status if status in STATES else ""


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def acceptable(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Drop hidden, half-copied and empty files; works on batches and streams.

    The conditions use path and size only, so ``binaryFile`` never opens a
    rejected file.
    """
    name = F.lower(file_name(path))
    partial = F.lit(False)
    for suffix in K.PARTIAL_SUFFIXES:
        partial = partial | name.endswith(suffix)
    return files.where(~name.startswith(".") & ~partial & (F.col(size) > 0))


def watch_folder(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of new files; the checkpoint makes each one arrive once.

    Without an explicit age limit the file source ignores whatever is a week
    older than the newest file it has seen; a late file must still be taken.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d").option("recursiveFileLookup", True).load(folder)
    return acceptable(files)


def settled(snapshots: DataFrame, name: str = "name", scan: str = "scan", size: str = "size") -> DataFrame:
    """Every scan at which a file had kept its size for ``STABLE_SCANS`` listings.

    A settled file is taken and its name forgotten, so a file sent again under
    the same name settles again: inside a stretch of equal sizes every
    ``STABLE_SCANS``-th listing settles. Stretches are found by rank, an
    equi-join and a running count, not by a window over one file, so a file
    listed endlessly is still spread over tasks.
    """
    r = ordered_rank(snapshots.select(name, scan, size), [name], scan).select(name, scan, size, "rank")
    prev = r.select(F.col(name).alias("_n"), (F.col("rank") + 1).alias("_k"), F.col(size).alias("_s"))
    marked = r.join(prev, (F.col(name) == F.col("_n")) & (F.col("rank") == F.col("_k")), "left").select(
        name, scan, size, "rank", F.when(F.col("_s") == F.col(size), 0).otherwise(1).cast("bigint").alias("_new"), F.col("rank").cast("double").alias("_pos"))
    stretches = running(marked, [name], ["_pos"], ["_new"], bucket_on="_pos").select(name, scan, size, "rank", (F.col("_new_before") + F.col("_new")).alias("_run"))
    start = stretches.groupBy(name, "_run").agg(F.min("rank").alias("_first"))
    kept = stretches.join(start, [name, "_run"]).where((F.col("rank") - F.col("_first") + 1) % K.STABLE_SCANS == 0)
    return kept.select(name, F.col(scan).alias("settled_at"), size, F.when(F.col(size) == 0, "empty").otherwise("accepted").alias("outcome"))


def settle_stream(snapshots: DataFrame) -> DataFrame:
    """The same decisions on a stream of (name, scan, size) listings.

    State is one size and one count for a name that has not settled yet; it is
    dropped on settling.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, scans = state.get if state.exists else (-1, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("scan").itertuples(index=False):
            scans = scans + 1 if r.size == size else 1
            size = r.size
            if scans >= K.STABLE_SCANS:
                out.append((key[0], r.scan, r.size, "accepted" if r.size else "empty"))
                size, scans = -1, 0
        if scans:
            state.update((int(size), int(scans)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["name", "settled_at", "size", "outcome"])

    return snapshots.groupBy("name").applyInPandasWithState(
        step, "name string, settled_at long, size long, outcome string", "size long, scans int", "append", GroupStateTimeout.NoTimeout)


def enqueue(files: DataFrame, path: str, arrived: str, content_sha256: Column, source: str = "watch") -> DataFrame:
    """Queued events; the id covers path and arrival, so sending a file again is a new submission."""
    return files.select(
        F.substring(F.sha2(F.concat_ws("|", F.col(path), F.col(arrived).cast("string")), 256), 1, 32).alias("id"), content_sha256.alias("content_sha256"),
        file_name(path).alias("filename"), F.lit(source).alias("source"), F.col(path).alias("path"), F.col(arrived).alias("event_time"), F.lit("queued").alias("status"))


def latest(events: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Current row per submission: a map-side ``max_by``, not a window."""
    return events.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("id", "_r.*")


def transitions(events: DataFrame, order: str = "seq") -> DataFrame:
    """(id, order, was, status, legal): the state each event met, and whether it moved it.

    Only a legal event moves the state; a refused one leaves it as it was. A
    finished submission is closed, so its id stands where an unseen one does.

    Every event is a function on the few states, and functions compose in any
    grouping. A submission's events are cut into order-preserving buckets; the
    first pass keeps one function per bucket, the small table of functions is
    folded along each submission, and the second pass runs each bucket from the
    state it starts in. Both read sorted streams and hold one state.
    """
    at = with_value_bucket(events.select("id", order, "status").withColumn("_pos", F.col(order).cast("double")), "_pos").drop("_pos")
    sorted_ = at.repartition("id", BUCKET).sortWithinPartitions("id", BUCKET, order)
    kind, seq = (events.schema[c].dataType.simpleString() for c in ("id", order))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, list(STATES)
        for pdf in batches:
            out = []
            for i, b, s in zip(pdf["id"], pdf[BUCKET], pdf["status"], strict=True):
                if (i, b) != here:
                    if here is not None:
                        out.append((*here, state))
                    here, state = (i, b), list(STATES)
                state = [_move(w, s) for w in state]
            yield pd.DataFrame(out, columns=["id", BUCKET, "to"])
        if here is not None:
            yield pd.DataFrame([(*here, state)], columns=["id", BUCKET, "to"])

    maps = sorted_.select("id", BUCKET, "status").mapInPandas(shrink, f"id {kind}, {BUCKET} bigint, to array<string>")
    earlier = Window.partitionBy("id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    index = lambda s: F.array_position(F.array(*[F.lit(x) for x in STATES]), s).cast("int")
    start = F.aggregate(F.collect_list("to").over(earlier), F.lit(""), lambda s, to: F.element_at(to, index(s)))
    begin = maps.select("id", BUCKET, start.alias("_start"))
    joined = at.join(begin, ["id", BUCKET]).repartition("id", BUCKET).sortWithinPartitions("id", BUCKET, order)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, ""
        for pdf in batches:
            was, legal = [], []
            for i, b, s, first in zip(pdf["id"], pdf[BUCKET], pdf["status"], pdf["_start"], strict=True):
                if (i, b) != here:
                    here, state = (i, b), first
                was.append(state)
                legal.append((state, s) in LEGAL)
                state = _move(state, s)
            yield pd.DataFrame({"id": pdf["id"], order: pdf[order], "was": was, "status": pdf["status"], "legal": legal})

    return joined.select("id", BUCKET, order, "status", "_start").mapInPandas(follow, f"id {kind}, {order} {seq}, was string, status string, legal boolean")


def current_state(events: DataFrame, order: str = "seq") -> DataFrame:
    """The last legal event of each submission; one with none has no state."""
    return latest(transitions(events, order).where("legal"), [order], [order, "status"])


def illegal_transitions(events: DataFrame, order: str = "seq") -> DataFrame:
    """Events the lifecycle refuses, and the state they met."""
    return transitions(events, order).where(~F.col("legal")).drop("legal")


def orphans(events: DataFrame, now: Column, max_age: str, order: Sequence[str] = ("event_time",)) -> DataFrame:
    """Submissions left running for too long, as the events that requeue them."""
    cur = latest(events, order, ["event_time", "status"])
    late = (F.col("status") == "running") & (F.col("event_time") < now - F.expr(f"INTERVAL {max_age}"))
    return cur.where(late).select("id", now.alias("event_time"), F.lit("queued").alias("status"))


def lifecycle_stream(events: DataFrame, max_age: str | None = None) -> DataFrame:
    """Apply events per submission in order; refused ones come out marked and move nothing.

    Calling Python costs far more than an event, so submissions share a state by
    the hash of their id: the unfinished ones of one share, each with its status.
    A submission is dropped when it finishes. With ``max_age`` the events
    carry ``event_time``, and a submission left running for longer is put back
    in the queue by a timer on the watermark: a legal row without ``seq``.
    """
    age = None if max_age is None else int(pd.Timedelta(max_age).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unfinished = {i: (was, until) for i, was, until in zip(*state.get, strict=True)} if state.exists else {}
        now = 0 if age is None else state.getCurrentWatermarkMs()
        out, heard = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq")
            for i, seq, status, at in zip(rows["id"].tolist(), rows["seq"].tolist(), rows["status"].tolist(), rows["_at"].tolist(), strict=True):
                was, until = unfinished.get(i, ("", 0))
                ok = (was, status) in LEGAL
                out.append((i, seq, was, status, ok))
                if ok:
                    was, until = _move(was, status), at + (age or 0)
                heard.add(i)
                unfinished[i] = (was, max(until, now + 1))
            unfinished = {i: x for i, x in unfinished.items() if x[0]}
        if age is not None:
            late = [i for i, (was, until) in unfinished.items() if was == "running" and until < now and i not in heard]
            out += [(i, None, "running", "queued", True) for i in late]
            unfinished |= dict.fromkeys(late, ("queued", 0))
        if unfinished:
            state.update((list(unfinished), [x[0] for x in unfinished.values()], [int(x[1]) for x in unfinished.values()]))
            timers = [until for was, until in unfinished.values() if was == "running"]
            if age is not None and timers:
                state.setTimeoutTimestamp(max(min(timers), now + 1))
        elif state.exists:
            state.remove()
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pd.DataFrame({"id": cols[0], "seq": pd.array(cols[1], dtype="Int64"), "was": cols[2], "status": cols[3], "legal": cols[4]})

    timeout = GroupStateTimeout.NoTimeout if age is None else GroupStateTimeout.EventTimeTimeout
    stamped = events.withColumn("_at", F.lit(0)) if age is None else events.withColumn("_at", F.unix_millis("event_time")).withWatermark("event_time", "0 seconds")
    return stamped.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(STATE_SHARES))).groupBy("_share").applyInPandasWithState(
        step, "id string, seq long, was string, status string, legal boolean", "ids array<string>, status array<string>, until array<long>", "append", timeout)


def queue_depth(counts: DataFrame) -> DataFrame:
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    return counts.agg(n("queued").alias("queued"), n("running").alias("running"), n("done").alias("done"), n("failed").alias("failed"))


def expired(files: DataFrame, submissions: DataFrame, now: Column, retain_days: int) -> DataFrame:
    """Inputs past their retention that no unfinished submission still needs."""
    if retain_days <= 0:
        return files.where(F.lit(False))
    old = files.where(F.col("modified") < now - F.expr(f"INTERVAL {retain_days} DAYS"))
    unfinished = submissions.where(F.col("status").isin("queued", "running")).select("path")
    return old.join(unfinished, "path", "left_anti")
