"""Column functions and operators on hand-made rows: limits, nulls, odd texts."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from webgrain.functions import quality as Q
from webgrain.functions import text as X
from webgrain.functions import urls as U
from webgrain.operators import evaluate, extract, metrics, requests, routing, sinks, usage
from webgrain.sources import tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("phrase", Q.BLOCK_PHRASES)
@pytest.mark.parametrize("size,blocked", [(999, True), (9999, True), (10000, None)])
def test_block_phrases_by_size(spark, phrase, size, blocked):
    html = ("a" * 5000 + phrase.upper() + "a" * 10000)[:size] if size >= 9999 else (phrase.upper() + "a" * size)[:size]
    if size >= 9999 and phrase.upper() not in html:
        pytest.skip("phrase cut off")
    reason = one(spark, Q.block_reason(F.col("h"), F.lit(200)), h=html)
    assert reason == ("phrase" if blocked else None)


@pytest.mark.parametrize("status,ok", [(200, True), (301, True), (404, True), (403, False), (429, False), (500, False), (503, False)])
def test_status_gate(spark, status, ok):
    assert one(spark, Q.is_content(F.col("h"), F.lit(status)), h="<p>x</p>") == ok


def test_markers_short_bodies_and_nothing(spark):
    big = "x" * 12000
    assert one(spark, Q.block_reason(F.col("h"), F.lit(200)), h="px-captcha" + big) == "marker"
    assert one(spark, Q.block_reason(F.col("h"), F.lit(200)), h="x" * 4000 + "px-captcha" + big) is None
    assert one(spark, Q.block_reason(F.col("h"), F.lit(200)), h="") == "empty"
    assert one(spark, Q.block_reason(F.col("h"), F.lit(200), F.lit("https://www.Amazon.com/x")), h="tiny") == "short body"
    assert one(spark, Q.block_reason(F.col("h"), F.lit(200), F.lit("https://notamazon.com/")), h="tiny") is None


def score(spark, text, status=200, latency=0, tags=5, pad=0):
    html = "<p>" * tags + text + "<!--" + "c" * pad + "-->"
    facts = Q.PageFacts.of(F.col("h"))
    row = spark.range(1).select(F.lit(html).alias("h")).select(Q.quality_score(facts, F.lit(status), F.lit(latency)).alias("s"), Q.quality_signals(facts, F.lit(status), F.lit(latency)).alias("g")).first()
    return row.s, row.g


def test_quality_limits(spark):
    assert score(spark, "a" * 1500)[0] == 1.0 and score(spark, "a" * 1499)[0] == 0.85 and score(spark, "a" * 500, pad=600)[0] == 0.85
    assert score(spark, "a" * 499, pad=600)[0] == 0.5 and score(spark, "a" * 100)[0] == 0.8
    assert score(spark, "a" * 1500, latency=15000)[0] == 1.0 and score(spark, "a" * 1500, latency=15001)[0] == 0.9
    assert score(spark, "a" * 1500, tags=2)[0] == 0.9 and score(spark, "a" * 1500, status=404)[0] == 0.7
    assert score(spark, "captcha challenge " + "a" * 1500)[0] == 0.4 and score(spark, "captcha " + "a" * 5000)[0] == 1.0
    assert score(spark, "captcha challenge access denied rate limit", status=500)[0] == 0.0
    assert score(spark, "a" * 1500, status=404)[1][0] == "status 404" and score(spark, "a" * 1500)[1] == ["good content"]


def test_urls(spark):
    safe = lambda u: one(spark, U.url_safe(F.col("u")), u=u)
    assert safe("https://a.b/c") and not safe("http://[::1]/") and not safe("http://172.20.1.1/") and safe("http://172.32.1.1/") and not safe("nope") and not safe(None)
    assert one(spark, U.host(F.col("u")), u="HTTP://A.Example.COM:80/x") == "a.example.com"
    assert one(spark, U.suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert one(spark, U.bearer_key(F.col("h")), h="Bearer sf_live_1") == "sf_live_1" and one(spark, U.bearer_key(F.col("h")), h="Bearer other") is None
    key = hashlib.sha256(json.dumps({"url": "é", "formats": ["a"], "proxy": "auto"}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]
    assert one(spark, U.cache_key(F.lit("é"), F.array(F.lit("a")), F.lit("auto"))) == key


@pytest.mark.parametrize(
    "text,want",
    [
        ('```json\n{"a":1}\n```', '{"a":1}'), ('x {"a":[1]} y', '{"a":[1]}'), ('so [{"a":1},{"a":2}] end', '[{"a":1},{"a":2}]'), ('{"a":1', None), ("none", None),
        ('```\n[1]\n``` and {"b":2}', "[1]"), ("", None), (None, None), ("]{", None),
    ],
)
def test_json_repair(spark, text, want):
    assert one(spark, X.repaired_json(F.col("t")), t=text) == want


def test_schema_scores(spark):
    s = lambda j, schema: one(spark, X.fill_score(F.lit(j), F.lit(schema)))
    assert s('{"a":"x","b":""}', '{"properties":{"a":{},"b":{}}}') == 0.5 and s('[{"a":1}]', '{"items":{"properties":{"a":{}}}}') == 1.0
    assert s('{"a":1}', "{}") == 1.0 and s(None, '{"a":"x"}') == 0.0
    assert one(spark, X.missing_keys(F.array(F.lit("a"), F.lit("b")), F.lit('{"a":"x","b":null}'))) == ["b"]
    assert one(spark, X.with_heading(F.lit("text"), F.lit(" T "))) == "# T\n\ntext" and one(spark, X.with_heading(F.lit("# x"), F.lit("T"))) == "# x"


def test_outcomes(spark):
    w = lambda status, n: one(spark, requests.webhook_outcome(F.lit(status).cast("int"), F.lit(n)))
    assert [w(200, 1), w(404, 1), w(429, 1), w(500, 3), w(None, 1)] == ["delivered", "stop", "retry", "gave up", "retry"]
    assert one(spark, requests.backoff_ms(F.lit(3))) == 4000
    p = lambda s, j: one(spark, requests.poisoned(F.lit(s).cast("string"), F.lit(j).cast("string")))
    assert [p("{}", None), p("{}", " [ ] "), p("{}", '{"a":1}'), p(None, None)] == [True, True, False, False]


def test_signature(spark):
    row = sinks.webhook_payloads(spark.createDataFrame([(1, "u"), (2, None)], "id int, url string"), "k", "id", "url").orderBy("id").collect()
    assert row[0].signature == "sha256=" + hmac.new(b"k", row[0].payload.encode(), hashlib.sha256).hexdigest() and row[1].payload == '{"id":2}'


def test_strategy_fold_is_stepwise_and_expires(spark):
    rows = [("h", 0, 1, 100, True), ("h", 3600, 2, 101, False), ("h", 7200, 3, 100, True), ("h", 7200 + 86400, 2, 50, True), ("g", 0, 5, 9, False)]
    df = spark.createDataFrame(rows, "domain string, s int, tier_used int, latency_ms int, ok boolean").withColumn("created_at", F.timestamp_seconds("s")).withColumn("seq", F.col("s"))
    got = {r.domain: r for r in routing.domain_strategy(df).collect()}
    assert (got["h"].sample_size, got["h"].avg_latency_ms, got["h"].tier) == (1, 50, 2)  # exactly one day later: a new state
    assert (got["g"].tier, got["g"].success_rate) == (4, 0.0)
    three = {r.domain: r for r in routing.domain_strategy(df.where("s < 80000")).collect()}["h"]
    mean = 0.0
    for i, x in enumerate((100, 101, 100)):
        mean = int((mean * i + x) / (i + 1) + 0.5)
    assert (three.sample_size, three.avg_latency_ms, three.tier) == (3, mean, 3)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 1, 3)] + [("b", None), ("c", 7)], "k string, v int")
    got = {r.k: (r.n, r.p50, r.p95) for r in evaluate.percentiles(df, ["k"], "v").collect()}
    assert got == {"a": (4, 3, 5), "c": (1, 7, 7)}


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 100.0), ("b", 100.0)], "k string, v double")
    b = metrics.histogram(df, F.col("v"), (0.1, 1.0), "k")
    assert {r.k: r.quantile for r in metrics.histogram_quantile(b, 0.5, "k").collect()} == {"a": 0.1, "b": 1.0}


def test_alert_needs_its_hold_time(spark):
    rows = [(i * 60, "m", 0.0 if i in (1, 2, 3, 6) else 1.0) for i in range(9)]
    t = spark.createDataFrame(rows, "s int, metric string, value double").select(F.timestamp_seconds("s").alias("at"), "metric", "value")
    found = metrics.alerts(t, (("low", "m", "<", 0.5, "2 minutes", "warning"),)).collect()
    assert [(r.alert, r.ticks) for r in found] == [("low", 3)]


def test_counter_reset(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((5, 9, 2, 4))], "k string, ts int, v int")
    assert metrics.increase(df, by=["k"], ts="ts", value="v").first()["increase"] == 8


def test_empty_log(spark):
    log = tables.request_log(spark, "/root/testdata/sf0.001").limit(0)
    assert usage.overview(log, tables.NOW).first().asDict() == {"total": 0, "successful": 0, "avg_latency_ms": 0, "success_rate": 0}
    assert usage.month_cost(log, tables.NOW).first()["total_cost"] == 0.0 and usage.usage_daily(log).count() == 0


def test_extraction_columns(spark):
    df = spark.createDataFrame([(1, "<title>T</title><p>x</p>"), (2, None)], "page_id long, html string")
    rows = {r.page_id: r for r in extract.extract_pages(df).collect()}
    assert rows[1].title == "T" and rows[1].markdown.startswith("# T") and rows[2].title is None and rows[2].markdown is None
    found = extract.extract_structured(df, {"fields": {"t": {"selector": "title"}}}, keep=["page_id"])
    assert [r.t for r in extract.items(found, ["t"]).collect()] == ["T"]


def test_stored_specs(spark):
    pages = spark.createDataFrame([("http://a.b/x", "k"), ("http://c.d/", "k")], "url string, schema_key string")
    specs = spark.createDataFrame([("a.b", "k", "{}", ["t"], 3, 0.9)], "host string, schema_key string, spec string, requiredKeys array<string>, execCount int, avgQuality double")
    assert {r.url: r.spec for r in extract.stored_spec(pages, specs).collect()} == {"http://a.b/x": "{}", "http://c.d/": None}


def test_log_sink(spark, tmp_path):
    log = tables.request_log(spark, "/root/testdata/sf0.001")
    sinks.append_log(log, f"file://{tmp_path}/log")
    back = spark.read.parquet(f"file://{tmp_path}/log")
    assert back.count() == log.count() and back.where("date = DATE '2024-01-03'").count() == log.where("to_date(created_at) = DATE '2024-01-03'").count()


def test_gold_and_load_files(spark, tmp_path):
    gold = {"_count": 1, "items": [{"url": "u", "expected": {"title": "T", "price": 1.5, "availability": "In stock", "rating": 3}}]}
    (tmp_path / "g.json").write_text(json.dumps(gold, indent=1))
    assert tables.gold_items(spark, f"file://{tmp_path}/g.json").collect() == [("u", "T", 1.5, "In stock", 3)]
    load = {"summary": {"vus": 2}, "metrics": {"http_reqs": {"type": "counter", "contains": "default", "values": {"count": 5.0, "rate": 2.5}}}}
    (tmp_path / "l.json").write_text(json.dumps(load, indent=1))
    assert {(r.metric, r.measure): r.value for r in tables.load_summary(spark, f"file://{tmp_path}/l.json").collect()} == {("http_reqs", "count"): 5.0, ("http_reqs", "rate"): 2.5}


def test_signatures_are_hmacs(spark):
    import hashlib
    import hmac

    from webgrain.operators.requests import sign

    rows = [("body", "key"), ("", "k" * 64), ("é{}", "l" * 65), ("x" * 1000, "ü"), (None, "k"), ("b", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "payload string, secret string").coalesce(1).select(sign()).collect()]
    assert got == [None if b is None or k is None else "sha256=" + hmac.new(k.encode(), b.encode(), hashlib.sha256).hexdigest() for b, k in rows]


def test_sessions_are_numbered_over_ranges(spark):
    from webgrain.operators.routing import proxy_sessions

    rows = [("ab"[i % 2], f"2024-01-01 00:{i * 7 % 60:02d}:00", i) for i in range(100)]
    log = spark.createDataFrame(rows, "kind string, at string, id long").withColumn("at", F.col("at").cast("timestamp"))
    for parts in (1, 4, 7):
        got = {r.id: int(r.session, 36) for r in proxy_sessions(log, "kind", ["at", "id"], parts).collect()}
        assert got == {i: n for kind in "ab" for n, (_, i) in enumerate(sorted((at, i) for k, at, i in rows if k == kind), 1)}
    assert proxy_sessions(log.limit(0), "kind", ["at", "id"]).count() == 0


def test_rounded_means_need_only_a_sessions_first_steps(spark):
    import datetime as dt
    import random

    rng, at, rows = random.Random(5), dt.datetime(2024, 1, 1), []
    for host, low, high, n in (("narrow", 100, 112, 900), ("flat", 7, 7, 50), ("wide", 0, 4000, 300), ("below", -30, 3, 400), ("one", 9, 9, 1)):
        rows += [(host, at + dt.timedelta(minutes=i), rng.randint(low, high), i, 1, True) for i in range(n)]
    rows += [("blank", at + dt.timedelta(minutes=i), None if i == 40 else 3, i, 1, True) for i in range(60)]
    df = spark.createDataFrame(rows, "domain string, created_at timestamp, latency_ms int, seq long, tier_used int, ok boolean")
    want = {}
    for host, _, x, n, *_ in rows:
        mean = want.get(host, 0)
        want[host] = None if x is None or mean is None else (2 * (mean * n + x) + n + 1) // (2 * (n + 1))
    assert {r.domain: r.avg_latency_ms for r in routing.domain_strategy(df).collect()} == want
    stats = routing.proxy_stats(df, now="2024-01-02 00:00:00", by=["domain"]).collect()
    assert {r.domain: r.avg_latency for r in stats} == want
    kept = routing.last_session(df, ["domain"], ts="created_at", seq="seq", latency="latency_ms", gap="24 hours").where("_step IS NOT NULL").groupBy("domain").count()
    assert {r["domain"]: r["count"] for r in kept.collect()} == {"narrow": 26, "flat": 2, "wide": 300, "below": 68, "one": 1}


def test_metric_pages_come_back_as_they_were(spark):
    odd = ['plain', 'say "no"', "a\\nb", "a\nb", "back\\", '\\"', "", "a,b=\"c\"", "ü}"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(odd)], "why string, value long")
    lines = metrics.exposition(df, "errors_total", "why")
    assert all("\n" not in r.line for r in lines.collect())
    back = metrics.scraped(lines.withColumnRenamed("line", "value"), "why")
    assert sorted(map(tuple, back.collect())) == sorted(("errors_total", v, float(i)) for i, v in enumerate(odd))
    others = ["# HELP errors_total of all", "up 1", 'up{job="a",why="x"} 2.5 1700000000', "broken{", "bad{} word", ""]
    got = metrics.scraped(spark.createDataFrame([(v,) for v in others], "value string"), "why").collect()
    assert list(map(tuple, got)) == [("up", "", 1.0), ("up", "x", 2.5), ("bad", "", None)]


def test_alerts_see_minutes_without_requests(spark):
    rows = [("2024-01-01 00:00:10", "completed", 12000), ("2024-01-01 00:00:50", "failed", 20000), ("2024-01-01 00:30:00", "completed", 100)]
    log = spark.createDataFrame(rows, "created_at string, status string, latency_ms int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    samples = metrics.health_samples(log)
    at = {(str(r["at"])[11:16], r.metric): r.value for r in samples.collect()}
    assert at["00:01", "requests"] == 2 and at["00:05", "success_rate"] == 0.5 and at["00:06", "requests"] == 0 and at["00:06", "p95_seconds"] is None
    found = {r.alert: (str(r.since)[11:16], str(r.until)[11:16], r.ticks) for r in metrics.alerts(samples).collect()}
    assert found == {"no_requests": ("00:06", "00:30", 25)}
    assert metrics.health_samples(log.limit(0)).count() == 0


def test_issued_keys_are_the_same_when_asked_again(spark):
    asked = spark.createDataFrame([(1, "a", "sf_live_0123456789"), (2, None, "sf_live_9876543210")], "user_id long, name string, secret string")
    one_, two = (sorted(map(tuple, usage.issue_keys(asked, "2024-01-01").collect()), key=repr) for _ in range(2))
    assert one_ == two and len({r[0] for r in one_}) == 2 and not any("sf_live_0123456789" in str(v) for r in one_ for v in r)
