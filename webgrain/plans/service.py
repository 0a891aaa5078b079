"""Queries over the service's edges: files in and out, metric pages, open paths, standing alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import KEYLESS_ROUTES, UNLIMITED_ROUTES, is_public_route
from ..operators import evaluate, metrics, sinks, usage
from ..sources.tables import NOW, gold_items, read_any, request_log, sql_with, table, users
from ..sources.tables import load_summary as load_file_rows
from ..streaming import streams as S
from .streams import _run, _work

_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_SQL_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
KINDS = ("csv", "json", "orc", "parquet")
PATHS = ("/v1/scrape", "/v1/scrape/stream/7", "/health", "/docs/json", "/openapi.json", "/metrics", "/v1/docs", "/v1/extract")


def public_routes(spark, sf_dir):
    """Which calls need a key, and which the rate limit counts."""
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % len(PATHS) + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select("event_id", path.alias("path"))
    return calls.select("event_id", "path", (~is_public_route(F.col("path"), KEYLESS_ROUTES)).alias("needs_key"), (~is_public_route(F.col("path"), UNLIMITED_ROUTES)).alias("limited"))


def issued_keys(spark, sf_dir):
    """A key for each user, as they'd ask for one."""
    asked = users(spark, sf_dir).select(F.col("id").alias("user_id"), F.concat(F.lit("first key of "), "name").alias("name"), F.concat(F.lit("sf_live_new_"), F.col("id").cast("string")).alias("secret"))
    return usage.issue_keys(asked, NOW).withColumn("created_at", _time("created_at"))


def log_sink(spark, sf_dir):
    """The log appended in two parts, a folder a day, and read back."""
    path = f"{_work(spark)}/log"
    log = request_log(spark, sf_dir)
    for part in (log.where("status = 'completed'"), log.where("status <> 'completed'")):
        sinks.append_log(part, path)
    kept = spark.read.schema(log.withColumn("date", F.to_date("created_at")).schema).parquet(path)
    return kept.groupBy(F.col("date").cast("string").alias("date"), "status").agg(F.count("*").alias("rows"), F.sum("latency_ms").alias("latency_ms"), F.sum("total_cost").cast("double").alias("total_cost"))


def file_formats(spark, sf_dir):
    """The log written in each format and read back by the same schema."""
    work = _work(spark)
    log = request_log(spark, sf_dir).select("id", "domain", "status", "latency_ms", "error_message")
    out = None
    for kind in KINDS:
        log.write.format(kind).save(f"{work}/{kind}")
        back = read_any(spark, f"{work}/{kind}", kind, log.schema).groupBy(F.lit(kind).alias("kind"), "status").agg(
            F.count("*").alias("rows"), F.sum("id").alias("ids"), F.sum("latency_ms").alias("latency_ms"), F.count("error_message").alias("errors"), F.max("domain").alias("last_domain")
        )
        out = back if out is None else out.unionByName(back)
    return out


def gold_file(spark, sf_dir):
    """Expected records of pages, two a line, through a gold file."""
    path = f"{_work(spark)}/gold"
    i = F.col("page_id")
    expected = F.struct(F.concat(F.lit("Page \""), i.cast("string"), F.lit("\"")).alias("title"), (i % 90 + 0.25).alias("price"), F.when(i % 4 > 0, "In stock").alias("availability"), (i % 5 + 1).cast("int").alias("rating"))
    item = lambda u: F.struct(u.alias("url"), expected.alias("expected"))
    lines = table(spark, sf_dir, "pages").select(F.lit(2).alias("_count"), F.array(item(F.col("url")), item(F.concat("url", F.lit("#again")))).alias("items"))
    lines.select(F.to_json(F.struct("_count", "items")).alias("value")).write.text(path)
    return gold_items(spark, path, lines=True)


def load_file(spark, sf_dir):
    """A run's summary in the load tester's form, written and read back as rows."""
    path = f"{_work(spark)}/load"
    run = evaluate.load_summary(request_log(spark, sf_dir).select("latency_ms", (F.col("status") == "completed").alias("ok")))
    pairs = lambda **measures: F.struct(F.struct(*(F.col(c).cast("double").alias(m) for m, c in measures.items())).alias("values"))
    parts = F.struct(
        pairs(avg="avg_ms", med="p50_ms", max="max_ms").alias("http_req_duration"), pairs(count="requests", rate="per_second").alias("http_reqs"), pairs(rate="failed_rate").alias("http_req_failed")
    )
    run.select(F.to_json(F.struct(parts.alias("metrics"))).alias("value")).write.text(path)
    return load_file_rows(spark, path)


def api_histogram(spark, sf_dir):
    return metrics.histogram(request_log(spark, sf_dir), F.col("latency_ms") / 1000, metrics.API_BUCKETS, "status").drop("bound")


def mean_duration(spark, sf_dir):
    return metrics.mean_duration(request_log(spark, sf_dir), F.col("latency_ms"), labels=("status",)).select(_time("at").alias("at"), "status", F.round("mean", 6).alias("mean"))


def stream_scrapes(spark, sf_dir):
    """Metric pages of the error counter as a stream of samples."""
    path = f"{_work(spark)}/scrapes"
    reasons = request_log(spark, sf_dir).select(F.concat(F.lit('say "'), F.coalesce("error_message", F.lit("a\\nb\nc")), F.lit('"')).alias("reason"))
    metrics.exposition(metrics.counter(reasons, "reason"), "errors_total", "reason").write.text(path)
    return _run(spark, S.scrapes(spark, path, "reason"))


def standing_alerts(spark, sf_dir):
    """The standing rules that a request log can feed, at each minute."""
    log = request_log(spark, sf_dir)
    fed = ("requests", "success_rate", "p95_seconds")
    found = metrics.alerts(metrics.health_samples(log), tuple(r for r in metrics.ALERT_RULES if r[1] in fed))
    return found.select("alert", "severity", _time("since").alias("since"), _time("until").alias("until"), "ticks")


QUERIES = {f.__name__: f for f in (public_routes, issued_keys, log_sink, file_formats, gold_file, load_file, api_histogram, mean_duration, stream_scrapes, standing_alerts)}

_RL = sql_with("request_log")
_paths = ", ".join(f"'{p}'" for p in PATHS)
_open = lambda routes: " OR ".join(f"starts_with(path, '{r}')" for r in routes)
_le = ", ".join(f"{b!r}::DOUBLE" for b in metrics.API_BUCKETS) + ", 'inf'::DOUBLE"
_le_rows = ", ".join(f"('{name}', {bound})" for name, bound in zip([*map(str, metrics.API_BUCKETS), "+Inf"], _le.split(", ")))
_RULE_ROWS = ", ".join(f"('{n}', '{m}', '{s}', INTERVAL {hold})" for n, m, _, _, hold, s in metrics.ALERT_RULES if m in ("requests", "success_rate", "p95_seconds"))
SQL = {
    "public_routes": f"SELECT event_id, path, NOT ({_open(KEYLESS_ROUTES)}) AS needs_key, NOT ({_open(UNLIMITED_ROUTES)}) AS limited FROM (SELECT event_id, [{_paths}][event_id % {len(PATHS)} + 1] AS path FROM events)",
    "issued_keys": sql_with("users") + f"""SELECT sha256(secret)[1:32] AS id, user_id, sha256(secret) AS key_hash, secret[1:12] AS key_prefix, name, true AS is_active, CAST(60 AS INT) AS rate_limit_per_minute, '{NOW}' AS created_at
FROM (SELECT id AS user_id, 'first key of ' || name AS name, 'sf_live_new_' || id AS secret FROM users)""",
    "log_sink": _RL + """SELECT strftime(created_at, '%Y-%m-%d') AS date, status, count(*) AS rows, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(total_cost) AS DOUBLE) AS total_cost FROM request_log GROUP BY 1, 2""",
    "file_formats": _RL + f"""SELECT kind, status, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(error_message) AS errors, max(domain) AS last_domain
FROM request_log, (VALUES {", ".join(f"('{k}')" for k in KINDS)}) k(kind) GROUP BY 1, 2""",
    "gold_file": """SELECT url || s AS url, 'Page "' || page_id || '"' AS title, CAST(page_id % 90 + 0.25 AS DOUBLE) AS price, CASE WHEN page_id % 4 > 0 THEN 'In stock' END AS availability, CAST(page_id % 5 + 1 AS INT) AS rating
FROM pages, (VALUES (''), ('#again')) t(s)""",
    "load_file": _RL + """SELECT metric, measure, value FROM (
  SELECT 'http_req_duration' AS metric, 'avg' AS measure, round(avg(latency_ms), 4) AS value FROM request_log
  UNION ALL SELECT 'http_req_duration', 'med', round(quantile_cont(latency_ms, 0.5), 4) FROM request_log
  UNION ALL SELECT 'http_req_duration', 'max', CAST(max(latency_ms) AS DOUBLE) FROM request_log
  UNION ALL SELECT 'http_reqs', 'count', CAST(count(*) AS DOUBLE) FROM request_log
  UNION ALL SELECT 'http_reqs', 'rate', CAST(round(count(*) / 60.0, 4) AS DOUBLE) FROM request_log
  UNION ALL SELECT 'http_req_failed', 'rate', CAST(round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS DOUBLE) FROM request_log)""",
    "api_histogram": _RL + f"""SELECT status, le, count(*) FILTER (WHERE latency_ms / 1000 <= bound) AS count, count(*) AS n, round(sum(latency_ms / 1000), 6) AS total
FROM request_log, (VALUES {_le_rows}) b(le, bound) GROUP BY status, le""",
    "mean_duration": _RL + f"""SELECT {_SQL_TIME.format('tick')} AS at, status, round(avg(latency_ms), 6) AS mean FROM (
  SELECT status, latency_ms, unnest([date_trunc('minute', created_at) + to_minutes(k) for k in [1, 2, 3, 4, 5]]) AS tick FROM request_log) GROUP BY tick, status""",
    "stream_scrapes": _RL + """SELECT 'errors_total' AS metric, 'say "' || coalesce(error_message, 'a\\nb' || chr(10) || 'c') || '"' AS reason, CAST(count(*) AS DOUBLE) AS value FROM request_log GROUP BY error_message""",
    "standing_alerts": sql_with("request_log", more=f"""w AS (
  SELECT unnest([date_trunc('minute', created_at) + to_minutes(k) for k in [1, 2, 3, 4, 5]]) AS tick, status, latency_ms / 1000 AS s FROM request_log),
ends AS (SELECT min(tick) AS lo, max(tick) AS hi FROM w),
ticks AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS tick FROM ends),
counted AS (SELECT tick, count(*) AS n, count(*) FILTER (WHERE status = 'completed') / count(*) AS ok FROM w GROUP BY tick),
le AS (SELECT w.tick, bound, count(*) FILTER (WHERE s <= bound) AS c, count(*) AS n FROM w, (SELECT unnest([{_le}]) AS bound) GROUP BY 1, 2),
steps AS (SELECT *, coalesce(lag(bound) OVER o, 0) AS prev, coalesce(lag(c) OVER o, 0) AS below FROM le WINDOW o AS (PARTITION BY tick ORDER BY bound)),
tail AS (SELECT tick, CASE WHEN isinf(bound) THEN prev ELSE prev + (bound - prev) * (0.95 * n - below) / (c - below) END AS p95 FROM steps WHERE c >= 0.95 * n QUALIFY row_number() OVER (PARTITION BY tick ORDER BY bound) = 1),
marked AS (SELECT r.*, tick, coalesce(CASE metric WHEN 'requests' THEN n IS NULL WHEN 'success_rate' THEN ok < 0.9 ELSE p95 > 10 END, false) AS firing
  FROM ticks LEFT JOIN counted USING (tick) LEFT JOIN tail USING (tick), (VALUES {_RULE_ROWS}) r(alert, metric, severity, hold)),
islands AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY tick ROWS UNBOUNDED PRECEDING) AS k FROM marked)""")
    + f"SELECT alert, severity, {_SQL_TIME.format('min(tick)')} AS since, {_SQL_TIME.format('max(tick)')} AS until, count(*) AS ticks FROM islands WHERE firing GROUP BY alert, severity, hold, k HAVING max(tick) >= min(tick) + hold",
}
