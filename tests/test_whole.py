"""Queries over whole tables, against brute force on small fixtures of other dates."""

import datetime as dt
from collections import Counter

import pytest

from webgrain.plans import catalog
from webgrain.streaming import streams as S

MINUTE = dt.timedelta(minutes=1)
LATE = 10 * MINUTE  # the streams' watermark


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Folder and rows (event_id, ts, user_id, event_type, value) of three days that no query names, over two midnights."""
    folder = str(tmp_path_factory.mktemp("events"))
    begin = dt.datetime(2025, 3, 9, 21, 0, 30)
    kinds = ("view", "error", "purchase")
    rows = [(i, begin + i * i % 4001 * MINUTE, i % 4, kinds[i % 3], float(i % 50)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder, rows


def text(ts):
    return ts.strftime("%Y-%m-%d %H:%M:%S")


def minute_windows(ts):
    """The ends of the five windows of five minutes that a time is in."""
    at = ts.replace(second=0, microsecond=0)
    return [at + k * MINUTE for k in range(1, 6)]


def found(spark, name, folder):
    df = catalog.QUERIES[name](spark, folder)
    return sorted(map(tuple, df.collect()))


def test_stream_rate_5m_all_keeps_every_closed_window(spark, events):
    folder, rows = events
    closed = max(r[1] for r in rows) - LATE
    want = Counter(at for r in rows for at in minute_windows(r[1]) if at <= closed)
    assert found(spark, "stream_rate_5m", folder) == sorted((text(at), n) for at, n in want.items())


def test_rate_5m_all_counts_every_day_and_across_midnight(spark, events):
    folder, rows = events
    want = Counter((at, "failed" if r[3] == "error" else "completed") for r in rows for at in minute_windows(r[1]))
    assert {at.date() for at, _ in want} > {dt.date(2025, 3, 10)}
    assert found(spark, "rate_5m", folder) == sorted((text(at), status, n, round(n / 300, 6)) for (at, status), n in want.items())


def test_stream_usage_all_keeps_every_closed_window(spark, events):
    folder, rows = events
    closed = max(r[1] for r in rows) - LATE
    hours = Counter((r[1].replace(minute=0, second=0), r[3]) for r in rows)
    want = sorted((text(h), kind, n) for (h, kind), n in hours.items() if h + 60 * MINUTE <= closed)
    assert found(spark, "stream_hourly_usage", folder) == want
    days = Counter(r[1].replace(hour=0, minute=0, second=0) for r in rows)
    want = sorted((text(d), n) for d, n in days.items() if d + dt.timedelta(days=1) <= closed)
    assert want and found(spark, "stream_daily_usage", folder) == want


def test_stream_sessions_all_keeps_every_closed_session(spark, tmp_path):
    begin = dt.datetime(2025, 3, 9, 21)
    hours = {1: (0, 5, 10, 40, 41), 2: (3, 30, 70), 3: (71,)}
    rows = [(10 * user + i, begin + dt.timedelta(hours=h), user, "view", 1.0) for user, hs in hours.items() for i, h in enumerate(hs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    at = lambda h: text(begin + dt.timedelta(hours=h))
    assert found(spark, "stream_sessions", str(tmp_path)) == [(1, at(0), at(16), 3), (1, at(40), at(47), 2), (2, at(3), at(9), 1), (2, at(30), at(36), 1)]


class Slow:
    """A stream that any wait with a limit leaves running."""

    def __init__(self):
        self.ended = False

    def __getattr__(self, name):  # the writer's settings
        return lambda *a, **b: self

    writeStream = sparkSession = read = property(lambda self: self)  # noqa: N815
    schema = lambda self, *a: self

    def awaitTermination(self, timeout=None):  # noqa: N802
        self.ended = self.ended or timeout is None
        return self.ended

    def exception(self):
        return None

    def parquet(self, path):
        return "whole" if self.ended else "part"


def test_streams_are_read_when_they_have_ended():
    assert S.run_once(Slow(), "out", "state") == "whole"
    batches = Slow()
    S.run_batches(batches, lambda *a: None, "state")
    assert batches.ended


def test_job_ledger_over_several_batches(spark, tmp_path):
    """Retries, redeliveries and repeats whose messages come in micro-batches of their own."""
    at = lambda seconds: dt.datetime(2025, 3, 9, 21) + dt.timedelta(seconds=seconds)
    parts = [
        [(1, at(0), "started", False), (2, at(0), "started", None), (3, at(0), "started", False), (4, at(1), "failed", True), (5, at(0), "started", False)],
        [(1, at(1), "failed", None), (2, at(3), "completed", None), (2, at(4), "completed", None), (9, at(700), "started", False)],
        [(1, at(120), "started", False), (1, at(121), "completed", False), (5, at(101), "started", False), (9, at(5000), "started", False)],
        [(9, at(9000), "completed", False)],
    ]
    schema = "job_id long, ts timestamp, kind string, permanent boolean"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*").withWatermark("ts", "10 minutes")
        out = S.run_once(S.job_ledger(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    start = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r.job_id, r.action, r.number, (r.at_ms - start) // 1000) for r in out.collect())
    stalled = lambda job, *since: [(job, "redeliver", 1, since[0]), (job, "redeliver", 2, since[0] + 15), (job, "dead", 3, since[0] + 30)]
    want = [(1, "retry", 1, 2), *stalled(1, 17), (2, "done", 1, 3), *stalled(3, 15), (4, "dead", 1, 1), *stalled(5, 15)]
    assert [g for g in got if g[0] != 9] == sorted(want)
    assert [g[1] for g in got if g[0] == 9].count("redeliver") == 2


def opened(spark, stream, checkpoint):
    """Runs a stream over what is there: the number of states that it keeps."""
    query = stream.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_jobs_of_the_ledger_share_states(spark, tmp_path):
    """Python is called once a state and batch, so the number of states may not be that of jobs."""
    begun = "timestamp'2025-03-09 21:00:00'"
    spark.range(3000).selectExpr("id AS job_id", f"{begun} AS ts", "'started' AS kind", "false AS permanent").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id long, ts timestamp, kind string, permanent boolean").parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes")
    assert 0 < opened(spark, S.job_ledger(stream), f"{tmp_path}/state") <= 1024


def test_ledger_keeps_jobs_of_one_state_apart(spark, tmp_path):
    """Two hundred jobs and one without an id, all in few states, over two micro-batches."""
    at = lambda seconds: dt.datetime(2025, 3, 9, 21) + dt.timedelta(seconds=seconds)
    jobs = [*range(200), None]
    first = [(j, at(0), "failed", j is not None and j % 3 == 0) for j in jobs]
    then = [(j, at(2), "completed", None) for j in jobs if j is None or j % 2 == 0] + [(999, at(5000), "started", False)]
    schema = "job_id long, ts timestamp, kind string, permanent boolean"
    for n, rows in enumerate((first, then)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*").withWatermark("ts", "10 minutes")
        out = S.run_once(S.job_ledger(stream, groups=2), f"{tmp_path}/out", f"{tmp_path}/state")
    want = []
    for j in jobs:
        if j is not None and j % 3 == 0:
            want.append((j, "dead", 1))
            continue
        want.append((j, "retry", 1))
        want += [(j, "done", 2)] if j is None or j % 2 == 0 else [(j, "redeliver", 1), (j, "redeliver", 2), (j, "dead", 3)]
    assert Counter((r.job_id, r.action, r.number) for r in out.collect() if r.job_id != 999) == Counter(want)


def test_jobs_of_progress_streams_share_states(spark, tmp_path):
    spark.range(3000).selectExpr("id AS job_id", "'started' AS event", "'' AS data", "timestamp'2025-03-09 21:00:00' AS ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id long, event string, data string, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes")
    assert 0 < opened(spark, S.until_terminal(stream), f"{tmp_path}/state") <= 1024


def test_progress_streams_of_one_state_are_told_apart(spark, tmp_path):
    """Jobs that end in a later micro-batch, fall silent, or have no id, all in one state."""
    at = lambda seconds: dt.datetime(2025, 3, 9, 21) + dt.timedelta(seconds=seconds)
    parts = [
        [(9, "started", at(0))],  # the watermark is known from here on
        [(1, "started", at(0)), (1, "headers", at(1)), (2, "started", at(0)), (3, "started", at(0)), (3, "error", at(2)), (None, None, at(0))],
        [(1, "complete", at(3)), (None, "complete", at(3)), (9, "started", at(5000))],
        [(9, "headers", at(9000))],
    ]
    schema = "job_id long, event string, ts timestamp"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*").withWatermark("ts", "10 minutes")
        out = S.run_once(S.until_terminal(stream, groups=1), f"{tmp_path}/out", f"{tmp_path}/state")
    got = Counter(tuple(r) for r in out.collect() if r.job_id != 9)
    assert got == Counter([(1, 3, "done"), (2, 1, "timeout"), (3, 2, "done"), (None, 2, "done")])
