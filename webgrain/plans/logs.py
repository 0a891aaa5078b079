"""Queries over the request log and accounts: usage, limits, state, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import in_domains
from ..operators import evaluate, metrics, requests, routing, usage
from ..sources.tables import NOW, api_keys, request_log, sql_with, table, users

_day = lambda c: F.date_format(c, "yyyy-MM-dd")
_time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_SQL_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def log_search(spark, sf_dir):
    found = usage.log_filter(request_log(spark, sf_dir), 3, status="completed", domain="SITE3", tier_from=2)
    return usage.log_page(found, page=2, page_size=10).select("id", _time("created_at").alias("created_at"), "domain", "tier_used", "latency_ms", F.col("total_cost").cast("double").alias("total_cost"))


def log_count(spark, sf_dir):
    return usage.log_filter(request_log(spark, sf_dir), 3, status="completed", domain="site_", tier=4).agg(F.count("*").alias("total"))


def overview_today(spark, sf_dir):
    return usage.overview(request_log(spark, sf_dir), NOW)


def month_cost(spark, sf_dir):
    return usage.month_cost(request_log(spark, sf_dir), NOW)


def daily_requests(spark, sf_dir):
    return usage.daily_requests(request_log(spark, sf_dir), NOW).withColumn("date", F.col("date").cast("string"))


def tier_breakdown(spark, sf_dir):
    return usage.tier_breakdown(request_log(spark, sf_dir), NOW)


def usage_daily(spark, sf_dir):
    return usage.usage_daily(request_log(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


def usage_rollup(spark, sf_dir):
    return usage.usage_daily(request_log(spark, sf_dir), "user_id").withColumn("date", F.col("date").cast("string"))


def usage_range_totals(spark, sf_dir):
    daily = usage.usage_daily(request_log(spark, sf_dir).where(F.to_date("created_at").between("2024-01-05", "2024-01-20")))
    return usage.range_totals(daily)


def metered_usage(spark, sf_dir):
    return usage.metered_usage(users(spark, sf_dir), request_log(spark, sf_dir), NOW, hours=24)


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 11 == 0, "sf_live_none").otherwise(F.concat(F.lit("sf_live_"), F.col("user_id").cast("string")))
    return e.select("event_id", F.when(F.col("event_id") % 13 == 0, key).otherwise(F.concat(F.lit("Bearer "), key)).alias("authorization"))


def auth_lookup(spark, sf_dir):
    return usage.authenticate(_calls(spark, sf_dir), api_keys(spark, sf_dir), users(spark, sf_dir)).select("event_id", "user_id", "plan", "rate_limit_per_minute", "code")


def revoked_anti(spark, sf_dir):
    return usage.rejected(_calls(spark, sf_dir), api_keys(spark, sf_dir)).select("event_id")


def account_summary(spark, sf_dir):
    return usage.account_summary(users(spark, sf_dir), api_keys(spark, sf_dir), request_log(spark, sf_dir))


def key_rotation(spark, sf_dir):
    return usage.rotate_keys(api_keys(spark, sf_dir), F.col("id") % 3 == 0, NOW).select("id", "user_id", "key_hash", "name", "is_active", F.col("revoked_at").isNotNull().alias("revoked"))


def plan_update(spark, sf_dir):
    return usage.update_where(users(spark, sf_dir), F.col("id") % 4 == 0, plan=F.lit("pro"), name=F.upper("name")).select("id", "name", "plan")


def user_upsert(spark, sf_dir):
    old = users(spark, sf_dir).withColumn("version", F.lit(1))
    new = old.where("id % 5 = 0").select("id", "email", F.concat(F.lit("new "), "name").alias("name"), "plan", F.lit(2).alias("version"))
    return usage.upsert(old, new, ["id"], "version").select("id", "email", "name", "plan", "version")


def rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return requests.rate_limit(e, key="key", ts="ts", limit=1).select("event_id", "key", "calls", "code", "remaining", "reset")


def webhook_outcomes(spark, sf_dir):
    i = F.col("id")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 503, 204))), (i % 5 + 1).cast("int"))
    log = request_log(spark, sf_dir).select("id", F.when(i % 17 == 0, F.lit(None)).otherwise(status).alias("status"), (i % 3 + 1).cast("int").alias("attempt"), "error_message")
    return log.select(
        "id", requests.webhook_outcome(F.col("status"), F.col("attempt")).alias("outcome"), requests.backoff_ms(F.col("attempt")).alias("wait_ms"),
        requests.model_outcome(F.col("status"), F.col("error_message")).alias("model"), requests.is_permanent_error(F.col("error_message")).alias("permanent"),
    )


def _jobs(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("job_id"), (i % 4).alias("worker"), F.element_at(F.array(*map(F.lit, ("batch", "realtime", "standard", "background", "odd"))), (i % 5 + 1).cast("int")).alias("queue"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def queue_order(spark, sf_dir):
    return requests.queue_order(_jobs(spark, sf_dir)).select("job_id", "worker", "priority", "place")


def _results(spark, sf_dir):
    log = request_log(spark, sf_dir)
    return log.select(
        (F.col("user_id") % 50).cast("string").alias("key"), F.col("created_at").alias("ts"), (F.col("id") % 4 * 900).alias("cache_ttl"), F.col("id").cast("string").alias("result"),
        F.when(F.col("id") % 3 == 0, '{"a":"string"}').alias("extract_schema"), F.when(F.col("id") % 6 == 0, "[ ]").otherwise('{"a":1}').alias("json"), "id",
    )


def cache_rows(spark, sf_dir):
    return requests.cache_rows(_results(spark, sf_dir)).select("key", "result", _time("expires_at").alias("expires_at"))


def cache_lookup(spark, sf_dir):
    asked = _results(spark, sf_dir).select("id", "key", "ts")
    return requests.cache_lookup(asked, requests.cache_rows(_results(spark, sf_dir))).select("id", "key", "result", "cached")


def latest_results(spark, sf_dir):
    rows = request_log(spark, sf_dir).select((F.col("id") % 97).alias("job_id"), F.col("created_at").alias("ts"), F.col("id").alias("result"))
    return requests.latest_result(rows, ttl="1 hour", now="2024-01-30 20:00:00").select("job_id", "result")


def _steps(spark, sf_dir):
    return request_log(spark, sf_dir).select("domain", "proxy_tier", "created_at", "tier_used", "latency_ms", F.col("id").alias("seq"), (F.col("status") == "completed").alias("ok"))


def _fetches(spark, sf_dir):
    """The log with a site of its own for each user: with so few fetches, states do expire."""
    host = F.element_at(F.array(*map(F.lit, ("www.amazon.com", "walmart.com", "m.facebook.com", "a.example.com", "b.example.com"))), (F.col("user_id") % 5 + 1).cast("int"))
    return request_log(spark, sf_dir).select(
        F.concat(host, F.lit("/"), F.col("user_id").cast("string")).alias("site"), host.alias("host"), "created_at", "tier_used", "latency_ms",
        F.col("id").alias("seq"), (F.col("status") == "completed").alias("ok"), (F.col("event_type") == "purchase").alias("browser"),
    )


def domain_strategy(spark, sf_dir):
    return routing.domain_strategy(_fetches(spark, sf_dir), host="site").select(
        "site", "tier", "sample_size", F.round("success_rate", 6).alias("success_rate"), "avg_latency_ms", _time("last_updated").alias("last_updated")
    )


def strategy_before(spark, sf_dir):
    return routing.strategy_before(_fetches(spark, sf_dir), host="site").select("seq", "session", "prior_samples", F.round("prior_rate", 6).alias("prior_rate"), "prior_tier")


def route_decision(spark, sf_dir):
    s = routing.strategy_before(_fetches(spark, sf_dir), host="site")
    return s.select(
        "seq", routing.route_decision(F.col("host"), browser=F.col("browser"), tier=F.col("prior_tier"), success_rate=F.col("prior_rate"), samples=F.col("prior_samples")).alias("route")
    )


def proxy_scores(spark, sf_dir):
    log = _steps(spark, sf_dir)
    whole = routing.proxy_stats(log, now=NOW, by=["proxy_tier"])
    own = routing.proxy_stats(log, now=NOW, by=["proxy_tier", "domain"]).select("proxy_tier", "domain", F.col("successes").alias("s"), F.col("failures").alias("f"))
    base = routing.proxy_base_score(F.col("successes"), F.col("failures"), F.col("avg_latency"), F.col("hours"))
    scored = own.join(whole, "proxy_tier")
    return scored.select(
        "proxy_tier", "domain", "avg_latency", F.round(base, 6).alias("base_score"), F.round(routing.proxy_domain_score(base, F.col("s"), F.col("f")), 6).alias("score"),
        routing.should_demote(F.col("s"), F.col("f")).alias("demote"), routing.should_promote(F.col("s"), F.col("f")).alias("promote"),
    )


def proxy_rank(spark, sf_dir):
    return routing.pick_proxy(proxy_scores(spark, sf_dir).where("proxy_tier <> 'none'"), by="domain", provider="proxy_tier", score="score")


def proxy_sessions(spark, sf_dir):
    log = request_log(spark, sf_dir).select("id", "proxy_tier", "created_at")
    return routing.proxy_sessions(log, "proxy_tier", ["created_at", "id"]).select("id", "session")


def proxy_escalation(spark, sf_dir):
    has = F.when(F.col("id") % 2 == 0, F.array(F.lit("datacenter"), F.lit("mobile"))).otherwise(F.array(F.lit("residential"), F.lit("none")))
    return request_log(spark, sf_dir).select("id", routing.next_proxy_tier(F.col("proxy_tier"), has).alias("next"))


def proxy_tier_asof(spark, sf_dir):
    log = request_log(spark, sf_dir).select(F.col("user_id").cast("string").alias("domain"), "created_at", F.col("id").alias("seq"), "proxy_tier", (F.col("status") == "completed").alias("ok"))
    return routing.proxy_tier_before(log).select("seq", "prior_kind")


def spec_quality(spark, sf_dir):
    """Runs of stored specs by host, with the log's quality as theirs."""
    from ..operators.extract import spec_quality as fold

    log = request_log(spark, sf_dir).select("domain", F.col("quality_score").cast("double").alias("quality"))
    return fold(log, ["domain"]).withColumn("avgQuality", F.round("avgQuality", 6))


def replayed_events(spark, sf_dir):
    from ..operators.sinks import progress_rows
    from ..streaming.streams import replay

    jobs = request_log(spark, sf_dir).select(F.col("id").alias("job_id"), F.col("created_at").alias("ts"), "status", "latency_ms", "error_message", "domain", "tier_used")
    return replay(jobs.where("job_id % 3 = 0").select("job_id", F.col("tier_used").alias("result")), progress_rows(jobs))


def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(request_log(spark, sf_dir), ["event_type"], "latency_ms")


def percentile_targets(spark, sf_dir):
    measured = evaluate.percentiles(request_log(spark, sf_dir), ["event_type"], "latency_ms")
    targets = spark.createDataFrame([("error", 500, 2000, 5000), ("view", 9000, 20000, 50000)], "event_type string, target_p50 int, target_p95 int, target_p99 int")
    return evaluate.against_targets(measured, targets, "event_type")


def success_matrix(spark, sf_dir):
    log = request_log(spark, sf_dir).select("domain", (F.col("status") == "completed").alias("ok"), "latency_ms", F.col("tier_used").alias("tier"), F.col("quality_score").cast("double").alias("quality"))
    return evaluate.success_matrix(log, "domain")


def top_reasons(spark, sf_dir):
    return evaluate.top_reasons(request_log(spark, sf_dir), "domain")


def bench_summary(spark, sf_dir):
    log = request_log(spark, sf_dir).select(F.col("tier_used").alias("tier"), "status", (F.col("quality_score") >= 0.3).alias("ok"), "latency_ms")
    return evaluate.bench_summary(log)


def competitors(spark, sf_dir):
    log = request_log(spark, sf_dir).select("proxy_tier", (F.col("status") == "completed").alias("ok"), "latency_ms", "total_cost")
    return evaluate.competitors(log, "proxy_tier", "total_cost")


def load_summary(spark, sf_dir):
    return evaluate.load_summary(request_log(spark, sf_dir).select("latency_ms", (F.col("status") == "completed").alias("ok")))


def throttle_gaps(spark, sf_dir):
    return evaluate.gaps(request_log(spark, sf_dir), ["domain"], "created_at", "10 minutes")


def request_counter(spark, sf_dir):
    return metrics.counter(request_log(spark, sf_dir), "status", "tier_used")


def _seconds():
    return F.col("latency_ms") / 1000


def duration_histogram(spark, sf_dir):
    return metrics.histogram(request_log(spark, sf_dir), _seconds(), metrics.DURATION_BUCKETS, "status").drop("bound")


def cost_histogram(spark, sf_dir):
    return metrics.histogram(request_log(spark, sf_dir), F.col("total_cost").cast("double"), metrics.COST_BUCKETS).drop("bound")


def histogram_quantile(spark, sf_dir):
    b = metrics.histogram(request_log(spark, sf_dir), _seconds(), metrics.DURATION_BUCKETS, "event_type")
    return metrics.histogram_quantile(b, 0.5, "event_type")


def rate_5m(spark, sf_dir):
    return metrics.rate(request_log(spark, sf_dir), every="1 minute", labels=("status",)).select(_time("at").alias("at"), "status", "n", "per_second")


def counter_increase(spark, sf_dir):
    samples = request_log(spark, sf_dir).select("domain", "created_at", "id", (F.col("id") % 50).alias("value")).withColumn("at", F.struct("created_at", "id"))
    return metrics.increase(samples, by=["domain"], ts="at", value="value")


def success_ratio(spark, sf_dir):
    t = metrics.success_ticks(request_log(spark, sf_dir))
    return t.select(_time("at").alias("at"), "n", F.round("success_rate", 6).alias("success_rate"), F.round("slow_share", 6).alias("slow_share"))


def alerts(spark, sf_dir):
    """The success rule over hourly ticks, with a hold of two hours."""
    t = metrics.success_ticks(request_log(spark, sf_dir)).select("at", F.lit("success_rate").alias("metric"), F.col("success_rate").alias("value"))
    rules = (("low_success_rate", "success_rate", "<", 0.9, "2 hours", "warning"), ("no_success", "success_rate", "=", 0, "1 hour", "critical"))
    a = metrics.alerts(t, rules)
    return a.select("alert", "severity", _time("since").alias("since"), _time("until").alias("until"), "ticks")


def metrics_text(spark, sf_dir):
    return metrics.exposition(metrics.counter(request_log(spark, sf_dir), "status"), "requests_total", "status")


def pool_stats(spark, sf_dir):
    """Counts of fetches by state, as a pool of browsers would report them."""
    s = F.col("id") % 4
    return request_log(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(s == 0).alias("in_use"), F.count_if(s == 1).alias("idle"), F.count_if(s > 1).alias("waiting"))


def fetch_costs(spark, sf_dir):
    log = request_log(spark, sf_dir)
    return log.groupBy("tier_used", "proxy_tier").agg(F.count("*").alias("fetches"), F.sum("total_cost").cast("double").alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        log_search, log_count, overview_today, month_cost, daily_requests, tier_breakdown, usage_daily, usage_rollup, usage_range_totals, metered_usage,
        auth_lookup, revoked_anti, account_summary, key_rotation, plan_update, user_upsert, rate_limit, webhook_outcomes, queue_order, cache_rows,
        cache_lookup, latest_results, domain_strategy, strategy_before, route_decision, proxy_scores, proxy_rank, proxy_sessions, proxy_escalation, proxy_tier_asof, spec_quality, replayed_events,
        latency_percentiles, percentile_targets, success_matrix, top_reasons, bench_summary, competitors, load_summary, throttle_gaps, request_counter,
        duration_histogram, cost_histogram, histogram_quantile, rate_5m, counter_increase, success_ratio, alerts, metrics_text, pool_stats, fetch_costs,
    )
}

_USAGE = """count(*) AS total_requests, count(*) FILTER (WHERE status = 'completed') AS successful_requests, count(*) FILTER (WHERE status = 'failed') AS failed_requests,
  count(*) FILTER (WHERE cached) AS cached_requests, count(*) FILTER (WHERE tier_used = 1) AS tier1_requests, count(*) FILTER (WHERE tier_used = 2) AS tier2_requests,
  count(*) FILTER (WHERE tier_used = 3) AS tier3_requests, count(*) FILTER (WHERE tier_used >= 4) AS tier4_requests, CAST(coalesce(sum(total_cost), 0) AS DOUBLE) AS total_cost,
  coalesce(CAST(round(avg(latency_ms)) AS INT), 0) AS avg_latency_ms, coalesce(CAST(2 * sum(CAST(quality_score * 100 AS BIGINT)) + count(quality_score) AS BIGINT) // (2 * count(quality_score)), 0) / 100.0::DOUBLE AS avg_quality_score"""
_DATE = "CAST(CAST(created_at AS DATE) AS VARCHAR)"
_CALLS = """calls AS (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'sf_live_none' ELSE 'sf_live_' || user_id END AS key FROM events)"""
_RESULTS = """results AS (
  SELECT CAST(user_id % 50 AS VARCHAR) AS key, created_at AS ts, id % 4 * 900 AS ttl, CAST(id AS VARCHAR) AS result, id,
         id % 3 = 0 AND id % 6 = 0 AS poisoned FROM request_log),
stored AS (
  SELECT key, max_by(result, ts) AS result, max_by(ts + to_seconds(ttl), ts) AS expires_at FROM results WHERE ttl > 0 AND NOT poisoned GROUP BY key)"""
_FETCHES = """fetches AS (
  SELECT host || '/' || user_id AS site, host, created_at, tier_used, latency_ms, id AS seq, status = 'completed' AS ok, event_type = 'purchase' AS browser
  FROM (SELECT *, ['www.amazon.com', 'walmart.com', 'm.facebook.com', 'a.example.com', 'b.example.com'][user_id % 5 + 1] AS host FROM request_log)),
sess AS (
  SELECT *, sum(brk) OVER (PARTITION BY site ORDER BY created_at, seq ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL OR created_at >= lag(created_at) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS brk
        FROM fetches WINDOW w AS (PARTITION BY site ORDER BY created_at, seq)))"""
_FOLD = (
    "list_reduce(list_prepend({{'n': 0::DOUBLE, 'm': 0::DOUBLE}}, list_transform(list(CAST({lat} AS DOUBLE) ORDER BY created_at, seq), lambda x: {{'n': -1::DOUBLE, 'm': x}})), "
    "lambda a, x: {{'n': a.n + 1, 'm': floor((a.m * a.n + x.m) / (a.n + 1) + 0.5)}}).m"
)
_BEFORE = """before AS (
  SELECT *, nullif(count(*) OVER b, 0) AS prior_samples, avg(CAST(ok AS INT)) OVER b AS prior_rate,
         CASE WHEN lag(ok) OVER w THEN least(lag(tier_used) OVER w, 4) ELSE least(lag(tier_used) OVER w + 1, 4) END AS prior_tier
  FROM sess WINDOW w AS (PARTITION BY site, session ORDER BY created_at, seq), b AS (PARTITION BY site, session ORDER BY created_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_PROXY_SESS = """s_{n} AS (
  SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, id AS seq, CASE WHEN lag(created_at) OVER w IS NULL OR created_at >= lag(created_at) OVER w + INTERVAL 168 HOUR THEN 1 ELSE 0 END AS brk
    FROM request_log WINDOW w AS (PARTITION BY {by} ORDER BY created_at, id))),
l_{n} AS (SELECT * FROM s_{n} QUALIFY session = max(session) OVER (PARTITION BY {by}))"""
_PROXIES = (
    _PROXY_SESS.format(n="p", by="proxy_tier") + ",\n" + _PROXY_SESS.format(n="d", by="proxy_tier, domain")
    + f""",
whole AS (
  SELECT proxy_tier, count(*) FILTER (WHERE status = 'completed') AS successes, count(*) AS n, {_FOLD.format(lat="latency_ms")} AS avg_latency,
         epoch(TIMESTAMP '{NOW}' - CAST(strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) / 3600 AS hours FROM l_p GROUP BY proxy_tier),
own AS (SELECT proxy_tier, domain, count(*) FILTER (WHERE status = 'completed') AS s, count(*) AS k FROM l_d GROUP BY proxy_tier, domain),
based AS (
  SELECT o.*, avg_latency, successes / w.n * 0.5 + 0.3 / (1 + avg_latency / 5000) + 0.2 * greatest(0, 1 - hours / 168) AS base FROM own o JOIN whole w USING (proxy_tier)),
proxies AS (
  SELECT proxy_tier, domain, avg_latency, round(base, 6) AS base_score, round(CASE WHEN k >= 3 THEN s / k * 0.6 + base * 0.4 ELSE base END, 6) AS score,
         k >= 5 AND s / k < 0.7 AS demote, k >= 10 AND s / k > 0.95 AS promote FROM based)"""
)


def _pct(by: str, where: str = "true", names: tuple = ((50, "p50"), (95, "p95"), (99, "p99"))) -> str:
    cells = ", ".join(f"l[least(len(l), CAST(floor({p} / 100.0 * len(l)) AS INT) + 1)] AS {n}" for p, n in names)
    return f"SELECT {by}, CAST(len(l) AS BIGINT) AS n, {cells} FROM (SELECT {by}, list(latency_ms ORDER BY latency_ms) AS l FROM request_log WHERE {where} GROUP BY {by})"


def _buckets(value: str, bounds: tuple[float, ...], label: str | None) -> str:
    by = f"{label}, " if label else ""
    rows = " UNION ALL ".join(
        [f"SELECT {by}'{b}' AS le, CAST({b!r} AS DOUBLE) AS bound, count(*) FILTER (WHERE {value} <= {b!r}) AS count, count(*) AS n, round(sum({value}), 6) AS total FROM request_log" + (f" GROUP BY {label}" if label else "") for b in bounds]
        + [f"SELECT {by}'+Inf' AS le, CAST('inf' AS DOUBLE) AS bound, count(*) AS count, count(*) AS n, round(sum({value}), 6) AS total FROM request_log" + (f" GROUP BY {label}" if label else "")]
    )
    return f"buckets AS ({rows})"


_RL = sql_with("request_log")
SQL = {
    "log_search": _RL + f"SELECT id, {_SQL_TIME.format('created_at')} AS created_at, domain, tier_used, latency_ms, CAST(total_cost AS DOUBLE) AS total_cost FROM request_log WHERE user_id = 3 AND status = 'completed' AND domain ILIKE '%SITE3%' AND tier_used >= 2 ORDER BY request_log.created_at DESC, id DESC LIMIT 10 OFFSET 10",
    "log_count": _RL + "SELECT count(*) AS total FROM request_log WHERE user_id = 3 AND status = 'completed' AND domain ILIKE '%site_%' AND tier_used = 4",
    "overview_today": _RL + f"""SELECT total, successful, avg_latency_ms, CASE WHEN total > 0 THEN CAST(floor(successful * 100 / total + 0.5) AS BIGINT) ELSE 0 END AS success_rate FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful, coalesce(CAST(round(avg(latency_ms)) AS INT), 0) AS avg_latency_ms FROM request_log WHERE CAST(created_at AS DATE) = DATE '{NOW[:10]}')""",
    "month_cost": _RL + f"SELECT CAST(coalesce(sum(total_cost), 0) AS DOUBLE) AS total_cost FROM request_log WHERE created_at >= date_trunc('month', TIMESTAMP '{NOW}')",
    "daily_requests": _RL + f"SELECT {_DATE} AS date, count(*) AS requests FROM request_log WHERE CAST(created_at AS DATE) >= DATE '{NOW[:10]}' - 30 GROUP BY 1",
    "tier_breakdown": _RL + f"SELECT 'Tier ' || coalesce(CAST(tier_used AS VARCHAR), 'null') AS tier, count(*) AS requests FROM request_log WHERE CAST(created_at AS DATE) >= DATE '{NOW[:10]}' - 30 GROUP BY 1",
    "usage_daily": _RL + f"SELECT {_DATE} AS date, {_USAGE} FROM request_log GROUP BY 1",
    "usage_rollup": _RL + f"SELECT user_id, {_DATE} AS date, {_USAGE} FROM request_log GROUP BY 1, 2",
    "usage_range_totals": sql_with("request_log", more=f"daily AS (SELECT {_DATE} AS date, {_USAGE} FROM request_log WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1)")
    + """SELECT CAST(coalesce(sum(total_requests), 0) AS BIGINT) AS requests, round(coalesce(sum(total_cost), 0), 6) AS cost, CAST(coalesce(floor(avg(avg_latency_ms) + 0.5), 0) AS BIGINT) AS avg_latency_ms,
  CAST(coalesce(floor(sum(avg_latency_ms * total_requests) / sum(total_requests) + 0.5), 0) AS BIGINT) AS weighted_latency_ms,
  CASE WHEN sum(total_requests) > 0 THEN CAST(floor(sum(successful_requests) * 100 / sum(total_requests) + 0.5) AS BIGINT) ELSE 0 END AS success_rate FROM daily""",
    "metered_usage": sql_with("request_log", "users") + f"SELECT u.id AS user_id, count(r.id) AS requests FROM users u JOIN request_log r ON r.user_id = u.id WHERE r.created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND r.created_at <= TIMESTAMP '{NOW}' GROUP BY u.id",
    "auth_lookup": sql_with("users", "api_keys", more=_CALLS) + """SELECT event_id, k.user_id, u.plan, k.rate_limit_per_minute, CAST(CASE WHEN u.id IS NULL THEN 401 ELSE 200 END AS INT) AS code
FROM calls c LEFT JOIN api_keys k ON k.key_hash = sha256(c.key) AND k.is_active LEFT JOIN users u ON u.id = k.user_id""",
    "revoked_anti": sql_with("api_keys", more=_CALLS) + "SELECT event_id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM api_keys k WHERE k.is_active AND k.key_hash = sha256(c.key))",
    "account_summary": sql_with("request_log", "users", "api_keys") + """SELECT u.id AS user_id, u.plan, coalesce(k.n, 0) AS active_keys, coalesce(r.n, 0) AS requests FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n FROM api_keys WHERE is_active GROUP BY 1) k ON k.user_id = u.id LEFT JOIN (SELECT user_id, count(*) AS n FROM request_log GROUP BY 1) r ON r.user_id = u.id""",
    "key_rotation": sql_with("api_keys") + """SELECT id, user_id, key_hash, name, is_active AND id % 3 <> 0 AS is_active, is_active AND id % 3 = 0 AS revoked FROM api_keys
UNION ALL SELECT -id, user_id, sha256('rotated:' || id), name || ' (rotated)', true, false FROM api_keys WHERE is_active AND id % 3 = 0""",
    "plan_update": sql_with("users") + "SELECT id, CASE WHEN id % 4 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN id % 4 = 0 THEN 'pro' ELSE plan END AS plan FROM users",
    "user_upsert": sql_with("users") + "SELECT id, email, CASE WHEN id % 5 = 0 THEN 'new ' || name ELSE name END AS name, plan, CAST(CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM users",
    "rate_limit": """SELECT event_id, key, calls, CAST(CASE WHEN calls > 1 THEN 429 ELSE 200 END AS INT) AS code, greatest(0, 1 - calls) AS remaining, CAST(ceil((ms + 60000) / 1000) AS BIGINT) AS reset FROM (
  SELECT event_id, key, ms, count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS calls
  FROM (SELECT event_id, 'k' || (user_id % 3) AS key, epoch_us(ts) // 1000 AS ms FROM events))""",
    "webhook_outcomes": _RL + """SELECT id, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'stop' WHEN attempt >= 3 THEN 'gave up' ELSE 'retry' END AS outcome,
  CAST(1000 * power(2, attempt - 1) AS BIGINT) AS wait_ms, CASE WHEN status IN (413, 429) OR status >= 500 THEN 'next' ELSE 'stop' END AS model, coalesce(contains(error_message, 'ERR_NAME_NOT_RESOLVED'), false) AS permanent
FROM (SELECT id, CASE WHEN id % 17 = 0 THEN NULL ELSE [200, 404, 429, 503, 204][id % 5 + 1] END AS status, id % 3 + 1 AS attempt, error_message FROM request_log)""",
    "queue_order": """SELECT job_id, worker, priority, CAST(row_number() OVER (PARTITION BY worker ORDER BY priority, created_at, job_id) AS INT) AS place FROM (
  SELECT event_id AS job_id, event_id % 4 AS worker, CAST([3, 1, 2, 4, 4][event_id % 5 + 1] AS INT) AS priority, ts AS created_at FROM events)""",
    "cache_rows": sql_with("request_log", more=_RESULTS) + f"SELECT key, result, {_SQL_TIME.format('expires_at')} AS expires_at FROM stored",
    "cache_lookup": sql_with("request_log", more=_RESULTS) + "SELECT r.id, r.key, CASE WHEN s.expires_at > r.ts THEN s.result END AS result, coalesce(s.expires_at > r.ts, false) AS cached FROM results r LEFT JOIN stored s ON s.key = r.key",
    "latest_results": _RL + "SELECT job_id, result FROM (SELECT id % 97 AS job_id, max_by(id, created_at) AS result, max(created_at) AS ts FROM request_log GROUP BY 1) WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-30 20:00:00'",
    "domain_strategy": sql_with("request_log", more=_FETCHES + ",\nlast AS (SELECT * FROM sess QUALIFY session = max(session) OVER (PARTITION BY site))")
    + f"""SELECT site, CAST(CASE WHEN arg_max(ok, (created_at, seq)) THEN least(arg_max(tier_used, (created_at, seq)), 4) ELSE least(arg_max(tier_used, (created_at, seq)) + 1, 4) END AS INT) AS tier,
  count(*) AS sample_size, round(avg(CAST(ok AS INT)), 6) AS success_rate, CAST({_FOLD.format(lat="latency_ms")} AS INT) AS avg_latency_ms, {_SQL_TIME.format('max(created_at)')} AS last_updated FROM last GROUP BY site""",
    "strategy_before": sql_with("request_log", more=_FETCHES + ",\n" + _BEFORE) + "SELECT seq, CAST(session AS BIGINT) AS session, prior_samples, round(prior_rate, 6) AS prior_rate, CAST(prior_tier AS INT) AS prior_tier FROM before",
    "route_decision": sql_with("request_log", more=_FETCHES + ",\n" + _BEFORE) + """SELECT seq, CASE WHEN browser THEN 'browser' WHEN host IN ('walmart.com', 'www.walmart.com') THEN 'browser'
  WHEN prior_rate >= 0.5 AND prior_samples >= 3 AND prior_tier >= 3 THEN 'browser' WHEN prior_rate >= 0.5 AND prior_samples >= 3 THEN 'cached-' || prior_tier
  WHEN prior_tier IS NULL AND host IN ('www.amazon.com', 'm.facebook.com') THEN 'escalate-from-3' ELSE 'escalate' END AS route FROM before""",
    "proxy_scores": sql_with("request_log", more=_PROXIES) + "SELECT * FROM proxies",
    "proxy_rank": sql_with("request_log", more=_PROXIES) + """SELECT domain, proxy_tier, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, proxy_tier) AS rank, least(3, count(*) OVER (PARTITION BY domain)) AS n FROM proxies WHERE proxy_tier <> 'none')
WHERE rank = CASE WHEN n <= 2 THEN 1 ELSE CAST('0x' || md5(domain)[1:4] AS INT) % 3 + 1 END""",
    "proxy_sessions": _RL + """SELECT id, ltrim(concat(CASE WHEN n >= 1679616 THEN d[n // 1679616 % 36 + 1] ELSE '' END, d[n // 46656 % 36 + 1], d[n // 1296 % 36 + 1], d[n // 36 % 36 + 1], d[n % 36 + 1]), '0') AS session FROM (
  SELECT id, '0123456789abcdefghijklmnopqrstuvwxyz' AS d, row_number() OVER (PARTITION BY proxy_tier ORDER BY created_at, id) AS n FROM request_log)""",
    "proxy_escalation": _RL + """SELECT id, CASE WHEN id % 2 = 0 THEN CASE proxy_tier WHEN 'none' THEN 'datacenter' WHEN 'datacenter' THEN 'mobile' WHEN 'residential' THEN 'mobile' END
  ELSE CASE WHEN proxy_tier IN ('none', 'datacenter') THEN 'residential' END END AS next FROM request_log""",
    "proxy_tier_asof": _RL + """SELECT id AS seq, CASE WHEN last.at + INTERVAL 24 HOUR > created_at THEN last.kind ELSE 'datacenter' END AS prior_kind FROM (
  SELECT id, created_at, last_value(CASE WHEN status = 'completed' THEN {'at': created_at, 'kind': proxy_tier} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM request_log)""",
    "spec_quality": _RL + 'SELECT domain, count(*) AS "execCount", round(avg(CAST(quality_score AS DOUBLE)), 6) AS "avgQuality" FROM request_log GROUP BY domain',
    "replayed_events": _RL + """SELECT id AS job_id, 'complete' AS event, CAST(tier_used AS VARCHAR) AS data FROM request_log WHERE id % 3 = 0
UNION ALL SELECT id, unnest(['started', 'headers', 'content', CASE WHEN status = 'failed' THEN 'error' ELSE 'complete' END]), unnest([domain, CAST(tier_used AS VARCHAR), domain, CASE WHEN status = 'failed' THEN error_message ELSE CAST(latency_ms AS VARCHAR) END])
FROM request_log WHERE id % 3 <> 0""",
    "latency_percentiles": _RL + _pct("event_type"),
    "percentile_targets": _RL + f"""SELECT event_type, p50, t50 AS target_p50, p95, t95 AS target_p95, p99, t99 AS target_p99, CASE WHEN p50 <= t50 THEN 'PASS' ELSE 'MISS' END AS verdict_p50,
  CASE WHEN p95 <= t95 THEN 'PASS' ELSE 'MISS' END AS verdict_p95, CASE WHEN p99 <= t99 THEN 'PASS' ELSE 'MISS' END AS verdict_p99
FROM ({_pct("event_type")}) JOIN (VALUES ('error', 500, 2000, 5000), ('view', 9000, 20000, 50000)) t(event_type, t50, t95, t99) USING (event_type)""",
    "success_matrix": _RL + """SELECT domain, runs, passed, avg_ms, avg_tier, avg_quality, CAST(floor(passed * 100 / runs + 0.5) AS BIGINT) AS success_pct FROM (
  SELECT domain, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS passed, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_ms, round(avg(tier_used), 1) AS avg_tier, round(avg(CAST(quality_score AS DOUBLE)), 2) AS avg_quality FROM request_log GROUP BY domain)""",
    "top_reasons": _RL + """SELECT domain, reason, n, CAST(rank AS INT) AS rank FROM (SELECT domain, reason, n, row_number() OVER (PARTITION BY domain ORDER BY n DESC, reason) AS rank
  FROM (SELECT domain, split_part(error_message, ':', 1) AS reason, count(*) AS n FROM request_log WHERE error_message IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3""",
    "bench_summary": _RL + """SELECT CASE WHEN grouping(tier_used) = 0 THEN 'tier=' || tier_used WHEN grouping(status) = 0 THEN 'status=' || status ELSE 'all' END AS slice, count(*) AS runs, count(*) FILTER (WHERE quality_score >= 0.3) AS passed,
  CAST(floor(count(*) FILTER (WHERE quality_score >= 0.3) * 100 / count(*) + 0.5) AS BIGINT) AS pass_pct, round(avg(latency_ms), 4) AS mean_ms, max(latency_ms) AS max_ms,
  list_sort(list(latency_ms) FILTER (WHERE quality_score >= 0.3))[CAST(least(passed - 1, floor(0.5 * passed)) AS INT) + 1] AS median_ms, list_sort(list(latency_ms) FILTER (WHERE quality_score >= 0.3))[CAST(least(passed - 1, floor(0.95 * passed)) AS INT) + 1] AS p95_ms FROM request_log GROUP BY GROUPING SETS ((), (tier_used), (status))""",
    "competitors": sql_with("request_log", more=f"p AS ({_pct("proxy_tier", "status = 'completed'", ((50, "median_ms"), (95, "p95_ms")))})")
    + """SELECT a.proxy_tier, attempted, succeeded, median_ms, p95_ms, round(unit * attempted / nullif(succeeded, 0), 8) AS cost_per_success FROM (
  SELECT proxy_tier, count(*) AS attempted, count(*) FILTER (WHERE status = 'completed') AS succeeded, CAST(max(total_cost) AS DOUBLE) AS unit FROM request_log GROUP BY 1) a LEFT JOIN p USING (proxy_tier)""",
    "load_summary": _RL + """SELECT count(*) AS requests, round(count(*) / 60.0, 4) AS per_second, round(avg(latency_ms), 4) AS avg_ms, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.9), 4) AS p90_ms,
  round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms, max(latency_ms) AS max_ms, round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS failed_rate FROM request_log""",
    "throttle_gaps": _RL + """SELECT domain, count(*) AS calls, count(*) FILTER (WHERE soon) AS too_soon FROM (
  SELECT domain, created_at < lag(created_at) OVER (PARTITION BY domain ORDER BY created_at) + INTERVAL 10 MINUTE AS soon FROM request_log) GROUP BY domain""",
    "request_counter": _RL + "SELECT status, tier_used, count(*) AS value FROM request_log GROUP BY 1, 2",
    "duration_histogram": sql_with("request_log", more=_buckets("latency_ms / 1000", metrics.DURATION_BUCKETS, "status")) + "SELECT status, le, count, n, total FROM buckets",
    "cost_histogram": sql_with("request_log", more=_buckets("CAST(total_cost AS DOUBLE)", metrics.COST_BUCKETS, None)) + "SELECT le, count, n, total FROM buckets",
    "histogram_quantile": sql_with("request_log", more=_buckets("latency_ms / 1000", metrics.DURATION_BUCKETS, "event_type")) + """SELECT event_type, round(CASE WHEN isinf(bound) THEN prev ELSE prev + (bound - prev) * (0.5 * n - below) / nullif(count - below, 0) END, 6) AS quantile
FROM (SELECT *, coalesce(lag(bound) OVER w, 0) AS prev, coalesce(lag(count) OVER w, 0) AS below FROM buckets WINDOW w AS (PARTITION BY event_type ORDER BY bound)) WHERE count >= 0.5 * n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY bound) = 1""",
    "rate_5m": _RL + f"""SELECT {_SQL_TIME.format('w + INTERVAL 5 MINUTE')} AS at, status, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM (
  SELECT status, unnest([date_trunc('minute', created_at) - to_minutes(k) for k in [0, 1, 2, 3, 4]]) AS w FROM request_log) GROUP BY w, status""",
    "counter_increase": _RL + """SELECT domain, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END) AS BIGINT) AS increase FROM (
  SELECT domain, id % 50 AS v, lag(id % 50) OVER (PARTITION BY domain ORDER BY created_at, id) AS prev FROM request_log) GROUP BY domain""",
    "success_ratio": _RL + f"SELECT {_SQL_TIME.format('h + INTERVAL 1 HOUR')} AS at, count(*) AS n, round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate, round(count(*) FILTER (WHERE latency_ms > 10000) / count(*), 6) AS slow_share FROM (SELECT *, date_trunc('hour', created_at) AS h FROM request_log) GROUP BY h",
    "alerts": sql_with("request_log", more="""ticks AS (SELECT h + INTERVAL 1 HOUR AS tick, count(*) FILTER (WHERE status = 'completed') / count(*) AS v FROM (SELECT *, date_trunc('hour', created_at) AS h FROM request_log) GROUP BY h),
marked AS (SELECT r.*, tick, v, CASE r.alert WHEN 'no_success' THEN v = 0 ELSE v < 0.9 END AS firing FROM ticks, (VALUES ('low_success_rate', 'warning', 2), ('no_success', 'critical', 1)) r(alert, severity, hold)),
islands AS (SELECT *, sum(CASE WHEN firing THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY tick ROWS UNBOUNDED PRECEDING) AS k FROM marked)""")
    + f"SELECT alert, severity, {_SQL_TIME.format('min(tick)')} AS since, {_SQL_TIME.format('max(tick)')} AS until, count(*) AS ticks FROM islands WHERE firing GROUP BY alert, severity, hold, k HAVING max(tick) >= min(tick) + to_hours(hold)",
    "metrics_text": _RL + "SELECT 'requests_total{status=\"' || status || '\"} ' || count(*) AS line FROM request_log GROUP BY status",
    "pool_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 4 = 0) AS in_use, count(*) FILTER (WHERE event_id % 4 = 1) AS idle, count(*) FILTER (WHERE event_id % 4 > 1) AS waiting FROM events",
    "fetch_costs": _RL + "SELECT tier_used, proxy_tier, count(*) AS fetches, CAST(sum(total_cost) AS DOUBLE) AS cost FROM request_log GROUP BY 1, 2",
}
