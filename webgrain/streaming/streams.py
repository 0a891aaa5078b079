"""Streaming twins of the batch operators.

Event time has a watermark of ten minutes; later rows are dropped.  A window is
emitted once the watermark passes its end, so windows that are still open when a
stream ends don't come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"
TERMINAL = ("complete", "error")
#: Jobs share so many states, by a hash of their ids: Python is called once a group and
#: batch, not once a job.  A stream's number of groups stays with its checkpoint.
GROUPS = 1024
#: Kinds of messages as numbers; others are signs of life.
STARTED, COMPLETED, FAILED, OTHER = range(4)
ACTIONS = np.array(["done", "dead", "retry", "redeliver"], object)
DONE, DEAD, RETRY, REDELIVER = range(4)


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", **options: str) -> DataFrame:
    """Files of a folder as a stream, with event time as a timestamp."""
    stream = spark.readStream.schema(schema).options(**options).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def scrapes(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Metric pages that a scraper left in a folder, as a stream of (metric, label, value)."""
    from ..operators.metrics import scraped

    return scraped(spark.readStream.text(path), label)


def tumbling_counts(events: DataFrame, ts: str, size: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_rate(events: DataFrame, ts: str, size: str = "5 minutes", every: str = "15 seconds", *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.end").alias("at"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once(events: DataFrame, key: str) -> DataFrame:
    """Each job id once, within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def progress_events(results: DataFrame) -> DataFrame:
    """The stages of finished jobs as progress events."""
    e = lambda name, data: F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))
    last = F.when(F.col("status") == "completed", e("complete", F.col("latency_ms"))).otherwise(e("error", F.col("error_message")))
    return results.select("job_id", "ts", F.explode(F.array(e("started", F.col("domain")), e("headers", F.col("tier_used")), e("content", F.substring("domain", 1, 500)), last)).alias("e")).select(
        "job_id", "e.event", "e.data", "ts"
    )


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """The rows with the group of their job, by a hash; rows without a job are one of their own."""
    job = F.col("job_id").cast("long")
    group = F.when(job.isNull(), -1).otherwise(F.pmod(F.xxhash64(job), F.lit(groups))).cast("int")
    return rows.withColumns({"group": group, "job_id": F.coalesce(job, F.lit(0))})


def _stored(state: GroupState, fields: int) -> np.ndarray:
    """(fields, jobs): what a group's state says of its open jobs, their ids first."""
    return np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(fields, -1)


def _store(state: GroupState, jobs: np.ndarray, due: np.ndarray, now: int) -> None:
    """Keeps the jobs, and has the group called again when the first of them is due."""
    if jobs.shape[1]:
        state.update((np.ascontiguousarray(jobs, np.int64).tobytes(),))
        state.setTimeoutTimestamp(max(int(due.min()), now + 1))
    elif state.exists:
        state.remove()


def until_terminal(events: DataFrame, timeout_ms: int = 60_000, groups: int = GROUPS) -> DataFrame:
    """(job_id, events, closed): jobs' streams, closed by a terminal event or by silence."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, now = _stored(state, 3), max(state.getCurrentWatermarkMs(), 0)
        held = [(known[0], known[1], np.zeros(known.shape[1], bool), np.zeros(known.shape[1], bool))]
        if not state.hasTimedOut:
            for pdf in batches:
                which, jobs = pd.factorize(pdf["job_id"].to_numpy())
                ended = np.bincount(which, pdf["ended"].to_numpy(), len(jobs)) > 0
                held.append((jobs, np.bincount(which, minlength=len(jobs)), ended, np.ones(len(jobs), bool)))
        which, jobs = pd.factorize(np.concatenate([h[0] for h in held]))  # known ones come first
        n, ended, heard = (np.bincount(which, np.concatenate([h[k] for h in held]), len(jobs)).astype(np.int64) for k in (1, 2, 3))
        due = np.concatenate([known[2], np.zeros(len(jobs) - known.shape[1], np.int64)])
        due[heard > 0] = now + timeout_ms
        silent = (heard == 0) & (due < now)
        closed = (ended > 0) | silent
        _store(state, np.stack([jobs, n, due])[:, ~closed], due[~closed], now)
        if closed.any():
            names = jobs[closed] if group[0] >= 0 else [None] * int(closed.sum())
            yield pd.DataFrame({"job_id": names, "events": n[closed], "closed": np.where(silent[closed], "timeout", "done")})

    told = _dealt(events.withColumn("ended", F.coalesce(F.col("event").isin(*TERMINAL), F.lit(False))).drop("event", "data"), groups)
    return told.groupBy("group").applyInPandasWithState(step, "job_id long, events long, closed string", "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)


def strategy_state(fetches: DataFrame, key: str = "domain", ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Running state of each host: samples, successes and the stepwise rounded latency.

    A key's rows are taken in order of event time within a micro-batch; the state
    goes when no fetch came for its time to live.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, good, mean, last = state.get if state.exists else (0, 0, 0.0, 0)
        rows = pd.concat(list(batches))
        rows = rows.assign(ms=rows["ts"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "seq"])
        for ms, latency, ok in zip(rows["ms"], rows["latency_ms"], rows["ok"]):
            if n and ms - last >= ttl_ms:
                n, good, mean = 0, 0, 0.0
            mean = float(int((mean * n + latency) / (n + 1) + 0.5))
            n, good, last = n + 1, good + int(ok), int(ms)
        state.update((n, good, mean, last))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "sample_size": [n], "successes": [good], "avg_latency": [mean]})

    return fetches.groupBy(key).applyInPandasWithState(
        step, f"{key} string, sample_size long, successes long, avg_latency double", "n long, good long, mean double, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def rate_limit_state(calls: DataFrame, limit: int, key: str = "key", window_ms: int = 60_000) -> DataFrame:
    """Each call with the number of its key's calls in the last minute, and the code.

    The state is the times of that minute, the refused calls' too; it goes when the
    key has been silent for as long.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        ms = rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        times = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], dtype=np.int64), ms]))
        calls = np.searchsorted(times, ms, side="right") - np.searchsorted(times, ms - window_ms, side="right")
        last = int(times[-1])
        state.update(([int(t) for t in times[times > last - window_ms]],))
        state.setTimeoutTimestamp(max(last + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), key: group[0], "calls": calls, "code": np.where(calls > limit, 429, 200).astype("int32")})

    return calls.groupBy(key).applyInPandasWithState(step, f"id long, {key} string, calls long, code int", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def job_ledger(
    messages: DataFrame, *, attempts: int = 3, first_wait_ms: int = 1000, stall_ms: int = 15_000, redeliveries: int = 2, closed_ms: int = 60_000, groups: int = GROUPS
) -> DataFrame:
    """(job_id, action, number, at_ms): what a queue does with jobs as their messages come.

    Messages are (job_id, ts, kind, permanent), kind being started, completed or failed.  A
    job that fails is tried again (``retry``) after a wait that doubles, until its attempts
    are used up or the error is permanent: then it is ``dead``.  A job that started and has
    not been heard of for the time of a stall is delivered again (``redeliver``) so many
    times, and is ``dead`` after one stall more.  A completed job is ``done``.  What comes of
    a job that is done or dead is ignored for a while, so deliveries that repeat do no harm;
    the state goes afterwards.  Messages are taken by time within a micro-batch; null kinds
    and others count as signs of life.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, now = _stored(state, 5), state.getCurrentWatermarkMs()
        heard = [np.zeros((4, 0), np.int64)]
        if not state.hasTimedOut:
            heard += [np.stack([pdf[c].to_numpy().astype(np.int64) for c in ("job_id", "ms", "kind", "permanent")]) for pdf in batches]
        told = np.concatenate(heard, axis=1)
        told = told[:, np.lexsort((told[2] != STARTED, told[1], told[0]))]
        jobs, begins = np.unique(told[0], return_index=True)
        ends = np.append(begins[1:], told.shape[1])
        moves = np.isin(known[0], jobs) | (known[3] < now)
        before = {job: said for job, *said in known[:, moves].T.tolist()}
        spans = dict(zip(jobs.tolist(), zip(begins.tolist(), ends.tolist())))
        _, times, kinds, permanents = told.tolist()
        out: list[tuple[int, int, int, int]] = []
        left: list[tuple[int, int, int, int, int]] = []
        for job in spans | before:
            failures, stalls, due, closed = before.get(job, (0, 0, 0, 0))
            begin, end = spans.get(job, (0, 0))
            for at in range(begin, end + 1):
                ms = times[at] if at < end else now  # the watermark comes last
                while due and not closed and due < ms:
                    stalls += 1
                    closed = stalls > redeliveries
                    out.append((job, DEAD if closed else REDELIVER, stalls, due))
                    due += closed_ms if closed else stall_ms
                if closed or at == end:
                    continue
                kind = kinds[at]
                if kind == COMPLETED:
                    out.append((job, DONE, failures + 1, ms))
                    closed, due = True, ms + closed_ms
                elif kind == FAILED:
                    failures += 1
                    closed = failures >= attempts or permanents[at]
                    wait = first_wait_ms * 2 ** (failures - 1)
                    out.append((job, DEAD, failures, ms) if closed else (job, RETRY, failures, ms + wait))
                    due = ms + (closed_ms if closed else wait + stall_ms)
                else:
                    due = ms + stall_ms
            if not closed or due >= now:
                left.append((job, failures, stalls, due, closed))
        kept = np.concatenate([known[:, ~moves], np.array(left, np.int64).reshape(-1, 5).T], axis=1)
        _store(state, kept, kept[3], now)
        if out:
            job, action, number, at_ms = np.array(out, np.int64).T
            yield pd.DataFrame({"job_id": job if group[0] >= 0 else [None] * len(job), "action": ACTIONS[action], "number": number, "at_ms": at_ms})

    kind = F.when(F.col("kind") == "started", STARTED).when(F.col("kind") == "completed", COMPLETED).when(F.col("kind") == "failed", FAILED).otherwise(OTHER)
    told = messages.select("job_id", "ts", F.coalesce(F.unix_millis("ts"), F.lit(-(1 << 63))).alias("ms"), kind.alias("kind"), F.coalesce("permanent", F.lit(False)).alias("permanent"))
    return _dealt(told, groups).groupBy("group").applyInPandasWithState(
        step, "job_id long, action string, number long, at_ms long", "jobs binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def job_results(pages: DataFrame) -> DataFrame:
    """The stages of a job for each captured page: content, then score and verdict.

    Extraction is one pass of Python; the score is columns; neither needs state, so
    the same plan serves a batch and a stream.
    """
    from ..functions import quality as Q
    from ..operators.extract import extract_pages

    facts = pages.select("page_id", "url", "html", Q.quality_score(Q.PageFacts.of(F.col("html")), F.lit(200), F.lit(0)).alias("score"), Q.is_content(F.col("html"), F.lit(200), F.col("url")).alias("valid"))
    out = extract_pages(facts, ("markdown", "text"), keep=["page_id", "url", "score", "valid"])
    return out.withColumn("status", F.when(F.col("valid") & (F.col("score") >= Q.ACCEPT), "completed").otherwise("failed"))


def replay(stored: DataFrame, events: DataFrame, key: str = "job_id") -> DataFrame:
    """Events of jobs, where a job with a stored result gives that result alone."""
    done = stored.select(key, F.lit("complete").alias("event"), F.col("result").cast("string").alias("data"))
    rest = events.join(stored.select(key), key, "left_anti").select(key, "event", "data")
    return done.unionByName(rest)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives what it wrote."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, each, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream, handing each micro-batch and its number to ``each``."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def append_upserts(path: str):
    """A sink for keyed results: each micro-batch is a part of its own, rewritten if it
    runs again, so that the last version of a key is its row in the highest part."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return each
