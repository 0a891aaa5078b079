"""Streaming queries, run over what is there, beside their batch twins in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import DERIVED_SQL, table
from ..streaming import streams as S

_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
#: In SQL: the stream's last watermark, by which windows are closed.
_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
LOCAL_WORK_DIR = "file:///tmp/checkpoints/webgrain"


def _work(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or LOCAL_WORK_DIR
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    """The events table as a stream of files."""
    return S.event_stream(spark, _files(sf_dir, "events"), table(spark, sf_dir, "events").schema)


def _files(sf_dir: str, name: str) -> str:
    """A pattern that fits the table, be it a file or a folder: streams read patterns of either."""
    return f"{sf_dir}/{name}.parque[t]"


def _run(spark, stream, mode="append"):
    work = _work(spark)
    return S.run_once(stream, f"{work}/out", f"{work}/state", mode)


def stream_hourly_usage(spark, sf_dir):
    """All hours that the stream emitted."""
    return _run(spark, S.tumbling_counts(_events(spark, sf_dir), "ts", "1 hour", "event_type")).select(_time("start").alias("start"), "event_type", "n")


def stream_daily_usage(spark, sf_dir):
    """All days that the stream emitted."""
    return _run(spark, S.tumbling_counts(_events(spark, sf_dir), "ts", "1 day")).select(_time("start").alias("start"), "n")


def stream_rate_5m(spark, sf_dir):
    """All windows that the stream emitted."""
    return _run(spark, S.sliding_rate(_events(spark, sf_dir), "ts", "5 minutes", "1 minute")).select(_time("at").alias("at"), "n")


def stream_sessions(spark, sf_dir):
    """All sessions that the stream emitted."""
    return _run(spark, S.sessions(_events(spark, sf_dir), "ts", "6 hours", "user_id")).select("user_id", _time("start").alias("start"), _time("end").alias("end"), "n")


def stream_dedupe(spark, sf_dir):
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, S.once(twice, "event_id").select("event_id"))


def stream_strategy(spark, sf_dir):
    """Running host state; with one micro-batch its last rows are the fold over all."""
    e = _events(spark, sf_dir)
    fetches = e.select(
        F.concat(F.lit("site"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com")).alias("domain"), "ts", F.col("event_id").alias("seq"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"),
    )
    work = _work(spark)
    S.run_batches(S.strategy_state(fetches), S.append_upserts(f"{work}/out"), f"{work}/state")
    rows = spark.read.parquet(f"{work}/out")
    return rows.groupBy("domain").agg(F.max_by(F.struct("sample_size", "successes", "avg_latency"), "batch").alias("r")).select("domain", "r.*")


def stream_progress(spark, sf_dir):
    """Progress streams of jobs up to their terminal event."""
    e = _events(spark, sf_dir)
    jobs = e.select(
        F.col("event_id").alias("job_id"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.lit(1).alias("latency_ms"),
        F.lit("x").alias("error_message"), F.lit("d").alias("domain"), F.lit(1).alias("tier_used"),
    )
    return _run(spark, S.until_terminal(S.progress_events(jobs)))


def stream_rate_limit(spark, sf_dir):
    calls = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("key"), "ts")
    return _run(spark, S.rate_limit_state(calls, 1))


def stream_jobs(spark, sf_dir):
    """Pages as a stream of jobs, extracted and scored."""
    pages = spark.readStream.schema(table(spark, sf_dir, "pages").schema).parquet(_files(sf_dir, "pages"))
    return _run(spark, S.job_results(pages).select("page_id", "score", "valid", "status", "title"))


def stream_ledger(spark, sf_dir):
    """Jobs that complete, fail once, for good or three times, or stall, as a queue would handle them."""
    i = F.col("event_id") % 5
    said = lambda kind, seconds, permanent=False: F.struct(F.lit(seconds).alias("after"), F.lit(kind).alias("kind"), F.lit(permanent).alias("permanent"))
    begun, failed = said("started", 0), said("failed", 1)
    story = (
        F.when(i == 0, F.array(begun)).when(i == 1, F.array(begun, said("completed", 2))).when(i == 2, F.array(begun, failed, said("completed", 4)))
        .when(i == 3, F.array(begun, said("failed", 1, True), said("completed", 2))).otherwise(F.array(begun, failed, said("failed", 3), said("failed", 7)))
    )
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_files(sf_dir, "events"))
    told = events.select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("begun"), F.explode(story).alias("m"))
    messages = told.select("job_id", (F.col("begun") + F.make_dt_interval(secs="m.after")).alias("ts"), "m.kind", "m.permanent")
    return _run(spark, S.job_ledger(messages.withWatermark("ts", S.WATERMARK)))


QUERIES = {
    f.__name__: f
    for f in (
        stream_rate_limit, stream_jobs, stream_ledger, stream_hourly_usage, stream_daily_usage, stream_rate_5m, stream_sessions, stream_dedupe, stream_strategy, stream_progress,
    )
}
_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "stream_rate_limit": """SELECT id, key, calls, CAST(CASE WHEN calls > 1 THEN 429 ELSE 200 END AS INT) AS code FROM (
  SELECT event_id AS id, key, count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS calls
  FROM (SELECT event_id, 'k' || (user_id % 3) AS key, epoch_us(ts) // 1000 AS ms FROM events))""",
    "stream_hourly_usage": f"SELECT {_AT.format('h')} AS start, event_type, count(*) AS n FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) WHERE h + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY h, event_type",
    "stream_daily_usage": f"SELECT {_AT.format('h')} AS start, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS h FROM events) WHERE h + INTERVAL 1 DAY <= {_CLOSED} GROUP BY h",
    "stream_rate_5m": f"""SELECT {_AT.format('w + INTERVAL 5 MINUTE')} AS at, count(*) AS n FROM (
  SELECT unnest([date_trunc('minute', ts) - to_minutes(k) for k in [0, 1, 2, 3, 4]]) AS w FROM events) WHERE w + INTERVAL 5 MINUTE <= {_CLOSED} GROUP BY w""",
    "stream_sessions": f"""SELECT user_id, {_AT.format('min(ts)')} AS start, {_AT.format('max(ts) + INTERVAL 6 HOUR')} AS "end", count(*) AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""",
    "stream_dedupe": "SELECT event_id FROM events",
    "stream_strategy": f"""WITH {DERIVED_SQL['request_log']}, sess AS (
  SELECT *, sum(brk) OVER (PARTITION BY domain ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN created_at < lag(created_at) OVER (PARTITION BY domain ORDER BY created_at, id) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS brk FROM request_log)),
last AS (SELECT * FROM sess QUALIFY session = max(session) OVER (PARTITION BY domain))
SELECT domain, count(*) AS sample_size, count(*) FILTER (WHERE status = 'completed') AS successes,
  list_reduce(list_prepend({{'n': 0::DOUBLE, 'm': 0::DOUBLE}}, list_transform(list(CAST(latency_ms AS DOUBLE) ORDER BY created_at, id), lambda x: {{'n': -1::DOUBLE, 'm': x}})),
    lambda a, x: {{'n': a.n + 1, 'm': floor((a.m * a.n + x.m) / (a.n + 1) + 0.5)}}).m AS avg_latency FROM last GROUP BY domain""",
    "stream_ledger": """WITH e AS (SELECT event_id AS job_id, epoch_us(ts) // 1000 AS ms, event_id % 5 AS i FROM events)
SELECT job_id, action, CAST(number AS BIGINT) AS number, CAST(ms + wait AS BIGINT) AS at_ms
FROM e JOIN (VALUES (1, 'done', 1, 2000), (2, 'retry', 1, 2000), (2, 'done', 2, 4000), (3, 'dead', 1, 1000), (4, 'retry', 1, 2000), (4, 'retry', 2, 5000), (4, 'dead', 3, 7000),
                    (0, 'redeliver', 1, 15000), (0, 'redeliver', 2, 30000), (0, 'dead', 3, 45000)) a(i, action, number, wait) USING (i)
WHERE i > 0 OR ms + wait < (SELECT max(ms + [0, 2000, 4000, 2000, 7000][i + 1]) - 600000 FROM e)""",
    "stream_progress": "SELECT event_id AS job_id, CAST(4 AS BIGINT) AS events, 'done' AS closed FROM events",
}
